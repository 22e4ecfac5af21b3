"""Personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Labelled spans come from two places: windows of the corpus labelled by the base patterns (a sample of at most SAMPLE
windows, half of them with a digit or @, chosen by hash from all) and BUILT examples of written-around forms (spelled-out
e-mail signs, spaced or bracketed addresses, national phone numbers, other card separators) put into those windows, with
look-alikes (dates, versions, hashes, amounts, "at" between words) as negatives. The model (some KB) is then shipped.

Every character of every text is read: whole texts are cut into overlapping windows, and where two windows overlap their
emissions are blended, so that each text has one emission a character. One Viterbi path is then found for the whole text.
Stretches that no path can leave the tag "none" for with profit are found from running sums first (a bound, so the path
stays exact) and only the rest is searched. The patterns' spans always stay. A span of the path is added where it overlaps
none of those, stands free of letters and digits, and its tags beat "none" by MARGIN nats; a card number's check digit must be
right, a telephone number has at most 15 digits, and no added span
is longer than the windows that the model learned from. Nothing else decides what the model may find.

The squashing function is x / sqrt(1 + x^2), for the gates shifted to (0, 1): one that numpy computes fast.

Null texts are empty. Rows are read one by one, so null ids, repeated rows and extra columns change nothing; `n_chars` is
counted anew by redact() where it is a column of integers. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk
from lodestrata.llm.shared import stash

KINDS = ("email", "ip", "card", "phone")
#: Windows in decoding and their overlap; windows in training and what is seen beside them; labelled windows, built ones.
WINDOW, OVERLAP, TRAIN, AROUND, SAMPLE, BUILT = 256, 32, 72, 40, 1500, 5000
STRIDE = WINDOW - OVERLAP
MARGIN = 2.0
HIDDEN, EMBED = 10, 10
SIGN = re.compile(r"[0-9@]")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind as listed, then start; every scan is linear in the text."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the model ----

PAD, OTHER = 0, 127
TAGS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2 k: first character of kind k; 2 + 2 k: a later one


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < OTHER, points, OTHER).astype(np.int64)


def tags_of(spans: list[Span], start: int, size: int) -> np.ndarray:
    """Tags of the characters from start on."""
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        lo, hi = max(a, start), min(b, start + size)
        if lo < hi and not out[lo - start : hi - start].any():
            out[lo - start : hi - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(1 + x * x)


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of squash where it is y."""
    z = 1 - y * y
    return z * np.sqrt(z)


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


def gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.5 * slope(2 * y - 1)


class Tagger:
    """BiLSTM-CRF over characters; parameters in the dict `p`."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        if p is None:
            r = np.random.default_rng(seed)
            f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
            p = {"E": 0.5 * r.standard_normal((128, embed)).astype(np.float32), "O": f(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32)}
            p |= {"T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
            for d in "fb":
                p |= {f"X{d}": f(embed, 4 * hidden), f"H{d}": f(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
                p[f"c{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p, self.h = p, p["Hf"].shape[0]

    def lstm(self, x: np.ndarray, d: str, keep: bool):
        """(L, B, H) outputs over time-major x, and what the backward pass needs."""
        h, (n, b, _) = self.h, x.shape
        pre = x @ self.p[f"X{d}"] + self.p[f"c{d}"]
        out = np.zeros((n, b, h), np.float32)
        state, cell, memory = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = pre[t] + state @ self.p[f"H{d}"]
            gates = gate(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = squash(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = squash(cell)
            state = o * squashed
            out[t] = state
            if keep:
                memory.append((t, i, f, o, g, before, squashed, last))
        return out, memory

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids.T]
        (f, mf), (b, mb) = self.lstm(x, "f", keep), self.lstm(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["O"] + self.p["o"], (x, both, mf, mb)

    @cached_property
    def steps(self) -> np.ndarray:
        """The transitions that decoding allows: from none to none or a kind's first tag, on within a kind, back to none."""
        may = np.zeros((TAGS, TAGS), bool)
        may[:, 0] = may[0, 0] = True
        for k in range(1, TAGS, 2):
            may[0, k] = may[k, k + 1] = may[k + 1, k + 1] = True
        return np.where(may, self.p["T"], np.float32(-1e6))

    def read(self, ids: np.ndarray) -> np.ndarray:
        """(L, TAGS, B): emissions() for long batches, features first, with the embedding folded into a table."""
        h, (b, n) = self.h, ids.shape
        at = np.ascontiguousarray(ids.T)
        both = np.empty((n, 2 * h, b), np.float32)
        z, x = np.empty((4 * h, b), np.float32), np.empty((4 * h, b), np.float32)
        for k, d in enumerate("fb"):
            table = np.ascontiguousarray((self.p["E"] @ self.p[f"X{d}"] + self.p[f"c{d}"]).T)
            weights = np.ascontiguousarray(0.5 * self.p[f"H{d}"].T)  # states and gates are kept doubled
            state, cell, y = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32), np.empty((h, b), np.float32)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.matmul(weights, state, out=z)
                np.take(table, at[t], axis=1, out=x, mode="clip")
                z += x
                np.multiply(z, z, out=x)
                x += 1
                np.sqrt(x, out=x)
                z /= x
                gates = z[: 3 * h]
                gates += 1
                cell *= z[h : 2 * h]
                np.multiply(z[:h], z[3 * h :], out=y)
                cell += y
                cell *= 0.5
                np.multiply(cell, cell, out=y)
                y += 1
                np.sqrt(y, out=y)
                np.divide(cell, y, out=y)
                state = both[t, k * h : (k + 1) * h]
                np.multiply(y, z[2 * h : 3 * h], out=state)
        return np.matmul(0.5 * self.p["O"].T, both) + self.p["o"][:, None]

    def path(self, e: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best tags (R, L) of stretches with emissions e (R, L, TAGS); first, last: whether a text begins, ends there.

        Elsewhere a stretch has "none" before and after it.
        """
        (r, n, _), T = e.shape, self.steps
        score = e[:, 0] + np.where(first[:, None], np.where(T[0] > -1e5, self.p["S"], T[0]), T[0])
        back = np.empty((n, r, TAGS), np.int8)
        for t in range(1, n):
            s = score[:, :, None] + T[None]
            live = (t < sizes)[:, None]
            back[t] = np.where(live, s.argmax(1), np.arange(TAGS))
            score = np.where(live, s.max(1) + e[:, t], score)
        out = np.zeros((r, n), np.int64)
        tag = (score + np.where(last[:, None], 0, T[:, 0])).argmax(1)
        for t in range(n - 1, -1, -1):
            out[:, t] = np.where(t < sizes, tag, 0)
            if t:
                tag = back[t, np.arange(r), tag]
        return out

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e, (x, both, mf, mb) = self.emissions(ids, True)
        n, b, _ = e.shape
        y, T = tags.T, self.p["T"]
        # forward and backward sums as probabilities, each place divided by its whole c
        top, K = e.max(2, keepdims=True), np.exp(T)
        x_e = np.exp(e - top)
        alpha, beta, c = np.empty_like(e), np.ones_like(e), np.empty((n, b, 1), e.dtype)
        for t in range(n):
            alpha[t] = (alpha[t - 1] @ K if t else np.exp(self.p["S"])) * x_e[t]
            c[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= c[t]
        for t in range(n - 2, -1, -1):
            beta[t] = (x_e[t + 1] * beta[t + 1]) @ K.T / c[t + 1]
        total = (np.log(c) + top).sum((0, 2))
        hot = np.eye(TAGS, dtype=np.float32)[y]
        de = (alpha * beta - hot) / b
        pairs = K * (alpha[:-1].reshape(-1, TAGS).T @ (x_e[1:] * beta[1:] / c[1:]).reshape(-1, TAGS))
        dT = (pairs - hot[:-1].reshape(-1, TAGS).T @ hot[1:].reshape(-1, TAGS)) / b
        gold = np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + self.p["S"][y[0]] + T[y[:-1], y[1:]].sum(0)
        g = {"T": dT, "S": de[0].sum(0), "O": np.tensordot(both, de, ([0, 1], [0, 1])), "o": de.sum((0, 1))}
        dboth = de @ self.p["O"].T
        dx = np.zeros_like(x)
        for d, memory, dout in (("f", mf, dboth[:, :, : self.h]), ("b", mb, dboth[:, :, self.h :])):
            dh, dc = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
            dz = np.zeros((n, b, 4 * self.h), np.float32)
            g[f"H{d}"] = np.zeros_like(self.p[f"H{d}"])
            for t, i, f, o, c, before, squashed, last in reversed(memory):
                dh = dh + dout[t]
                dc = dc + dh * o * slope(squashed)
                dz[t] = np.concatenate([dc * c * gate_slope(i), dc * before * gate_slope(f), dh * squashed * gate_slope(o), dc * i * slope(c)], axis=1)
                g[f"H{d}"] += last.T @ dz[t]
                dh = dz[t] @ self.p[f"H{d}"].T
                dc = dc * f
            g[f"X{d}"], g[f"c{d}"] = np.tensordot(x, dz, ([0, 1], [0, 1])), dz.sum((0, 1))
            dx += dz @ self.p[f"X{d}"].T
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T, dx)
        return float((total - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 192, rate: float = 0.03) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, m, v, step, losses = np.random.default_rng(11), {}, {}, 0, []
        for epoch in range(epochs):
            order, seen = r.permutation(len(ids)), []
            for k in range(0, len(ids), batch):
                part = order[k : k + batch]
                loss, g = self.gradients(ids[part], tags[part])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                for name, x in g.items():
                    x = x * min(1, 5 / (norm + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * x**2
                    lr = rate * (1 - 0.9 * epoch / epochs)
                    self.p[name] = (self.p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


# ---- labelled spans ----


class Examples:
    """Built items with labels, from a seeded generator."""

    def __init__(self, seed: int = 5):
        self.r = np.random.default_rng(seed)

    def pick(self, *options: str) -> str:
        return options[self.r.integers(len(options))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def letters(self, lo: int, hi: int) -> str:
        return "".join(self.r.choice(list(string.ascii_lowercase), self.r.integers(lo, hi)))

    def email(self) -> str:
        name = self.letters(2, 7) + self.pick("", ".", "_", "") + self.letters(0, 6) + self.pick("", "", self.digits(2))
        dot = self.pick(".", ".", " dot ", " dot ", " dot ", "(dot)", " [dot] ", "[.]")
        at = self.pick("@", " @ ", " at ", " at ", " at ", "(at)", " (at) ", "[at]", " [at] ", " {at} ") if dot != "." else self.pick("@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " {at} ")
        return name + at + self.letters(3, 9) + dot + self.pick("com", "org", "net", "example", "de", "co.uk")

    def ip(self) -> str:
        return self.pick(".", ".", "[.]", " . ", "(.)").join(str(x) for x in self.r.integers(0, 256, 4))

    def card(self) -> str:
        d = self.pick("4", "5", "37", "6") + self.digits(15)
        d = d[:15]
        d += next(c for c in "0123456789" if luhn(d + c))
        s = self.pick("", " ", "-", ".", "/", "  ", "_")
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        d = self.digits
        return self.pick(
            f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}",
            f"+{d(1)}/{d(3)}/{d(3)}/{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)}({d(3)}){d(7)}",
        )

    def none(self) -> str:
        d = self.digits
        return self.pick(
            f"20{d(2)}-0{d(1)}-1{d(1)}", f"version {d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)}.{d(2)}", "".join(self.r.choice(list("0123456789abcdef"), 40)),
            f"1{d(1)}:{d(2)}:{d(2)}", f"{d(4)}", f"{d(2)} %", f"@{self.letters(3, 8)}", f"{self.letters(3, 6)}{d(3)}", f"{d(3)}-{d(2)}", f"[{d(2)}]", f"{d(5)}-{d(4)}", f"{self.letters(2, 5)} at {self.letters(3, 7)}",
            f"{self.letters(2, 8)} at {self.letters(3, 7)}. {self.letters(2, 7)}", f"{self.letters(3, 8)} dot {self.letters(2, 7)}", " ".join([self.letters(2, 8)] * 12), f"{d(2)} {self.letters(2, 6)} {d(3)} {self.letters(2, 6)}",
        )

    def placed(self, around: str) -> tuple[str, np.ndarray]:
        """A window of text with one built item in it, and its tags."""
        kind = self.pick("email", *KINDS, "none", "none")
        item = getattr(self, kind)()
        plain = SIGN.sub("e", around).ljust(TRAIN, " ")
        at = int(self.r.integers(0, TRAIN - 8))
        blank = "" if at == 0 else self.pick(" ", " ", ": ", "\n", "(")
        text = (plain[:at] + blank + item + self.pick(" ", ". ", ", ", "\n", "") + plain[at:])[:TRAIN]
        a = at + len(blank)
        return text, tags_of([(kind, a, a + len(item))] if kind != "none" else [], 0, TRAIN)


def starts_of(size: int) -> list[int]:
    """Starts of the windows of a text of so many characters; each but the first goes beyond the overlap."""
    return list(range(0, max(1, size - OVERLAP), STRIDE))


def sampled_windows(docs: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, tags as digits) of at most `most` windows: those of least hash among all of all documents, half with SIGN.

    A window is labelled by the patterns on it and AROUND characters to both sides, of which the hash is, too.
    """
    half = most // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[dict[int, tuple[str, int]]] = [{}, {}]
            for text in batch.column("text").to_pylist():
                for s in range(0, len(text), TRAIN):
                    lo = max(0, s - AROUND)
                    wide = text[lo : s + TRAIN + AROUND]
                    of = best[1 if SIGN.search(wide, s - lo, s - lo + TRAIN) else 0]
                    of[xxhash.xxh64_intdigest(wide.encode("utf-8", "surrogatepass")) >> 1] = (wide, s - lo)
                for k in (0, 1):
                    if len(best[k]) > 8 * half:
                        best[k] = {h: best[k][h] for h in sorted(best[k])[:half]}
            rows = []
            for sign, of in enumerate(best):
                for h in sorted(of)[:half]:
                    wide, s = of[h]
                    w = wide[s : s + TRAIN]
                    rows.append((sign, h, w, "".join(map(str, tags_of(base_spans(wide), s, len(w))))))
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["sign", "h", "w", "t"])

    windows = docs.select("text").where("text is not null").mapInArrow(run, "sign int, h long, w string, t string").distinct()
    windows = stash(windows, "windows")
    return [(r.w, r.t) for k in (0, 1) for r in windows.where(F.col("sign") == k).orderBy("h", "w", "t").limit(half).collect()]


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Train on labelled windows of docs and on built examples; returns the parameters."""
    real = sampled_windows(docs)
    make = Examples()
    filler = [w for w, _ in real if not SIGN.search(w)] or [w for w, _ in real] or ["the quick brown fox and the lazy dog went to see the sea and came"]
    texts = [(w, np.array(list(map(int, t)), np.int64)) for w, t in real]
    texts += [make.placed(filler[k % len(filler)]) for k in range(BUILT)]
    ids = np.full((len(texts), TRAIN), PAD, np.int64)
    tags = np.zeros((len(texts), TRAIN), np.int64)
    for k, (w, t) in enumerate(texts):
        ids[k, : len(w)] = encode(w)
        tags[k, : len(t)] = t
    tagger = Tagger()
    tagger.train(ids, tags)
    return tagger.p


def blended(tagger: Tagger, points: np.ndarray, offsets: np.ndarray, most: int = 1024) -> np.ndarray:
    """(characters, TAGS): the emissions of texts on end, of all their windows; offsets has the texts' starts and the end."""
    out = np.zeros((len(points), TAGS), np.float32)
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-(sizes - OVERLAP) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start, last = number * STRIDE, number == count[text] - 1
    width = np.minimum(WINDOW, sizes[text] - start)
    padded = np.append(points, PAD)
    step = np.maximum(1, -(-width // 128)) * 128
    ramp = ((np.arange(OVERLAP) + 0.5) / OVERLAP).astype(np.float32)
    for odd in (0, 1):  # windows of one parity do not overlap
        for w in np.unique(step[(number % 2 == odd) & (width > 0)]).tolist():
            members = np.flatnonzero((number % 2 == odd) & (step == w) & (width > 0))
            for lo in range(0, len(members), most):
                m = members[lo : lo + most]
                place = (offsets[text[m]] + start[m])[:, None] + np.arange(w)[None, :]
                inside = np.arange(w)[None, :] < width[m][:, None]
                e = np.ascontiguousarray(tagger.read(padded[np.where(inside, place, len(points))]).transpose(2, 0, 1))
                e[number[m] > 0, :OVERLAP] *= ramp[:w, None]
                if w == WINDOW:
                    e[~last[m], -OVERLAP:] *= ramp[::-1, None]
                for row, o, n in zip(e, place[:, 0].tolist(), width[m].tolist(), strict=True):
                    out[o : o + n] += row[:n]
    return out


def open_stretches(tagger: Tagger, e: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) of the places that lie in some run of a kind's tags which beats "none"; elsewhere the best path is "none".

    A run begins at s with its kind's first tag and goes on to u with its other tag, so its gain is begin[s] plus a
    difference of running sums: the best s up to a place and the best u from it on tell whether the place is open.
    """
    T, S = tagger.p["T"].astype(np.float64) - float(tagger.p["T"][0, 0]), tagger.p["S"].astype(np.float64) - float(tagger.p["S"][0])
    first, later = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    on = T[later, later][:, None]
    enter = np.maximum(T[0, first], S[first])[:, None]
    follow = np.maximum(T[first, later][:, None] - on, 0)  # a run of one place has no step to the other tag
    leave = np.maximum(np.maximum(T[first, 0], T[later, 0]), 0)[:, None] + 1e-3
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return []
    none = e[:, 0]
    hint = np.full(len(e), -np.inf, np.float32)  # above zero somewhere in every text that has a run with a gain
    for k in range(len(first)):
        np.maximum(hint, e[:, later[k]] - none + np.float32(on[k, 0]), out=hint)
        np.maximum(hint, e[:, first[k]] - none + np.float32((enter + follow + leave)[k, 0]), out=hint)
    out = []
    for k in full[np.maximum.reduceat(hint, offsets[full]) > 0].tolist():
        x = e[offsets[k] : offsets[k + 1]].T.astype(np.float64)
        sums = np.cumsum(x[later] - x[0] + on, axis=1)
        begin = x[first] - x[0] + enter + follow - sums
        best = np.maximum.accumulate(begin, axis=1) + np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1] + leave
        free = np.concatenate([[False], (best > 0).any(0), [False]])
        edges = np.flatnonzero(free[1:] != free[:-1])
        out += [(k, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def tagged_runs(tagger: Tagger, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(text, kind, from, to, nats by which it beats "none") of each run of tags on the best path of each text."""
    e = blended(tagger, points, offsets)
    todo = sorted(open_stretches(tagger, e, offsets), key=lambda x: x[2] - x[1])
    out = []
    T, S = tagger.steps, tagger.p["S"]
    at = 0
    while at < len(todo):
        to = min(len(todo), at + 256)
        while to > at + 1 and (todo[to - 1][2] - todo[to - 1][1]) * (to - at) > 1 << 18:
            to = at + max(1, (to - at) // 2)
        part = todo[at:to]
        at = to
        sizes = np.array([b - a for _, a, b in part])
        grid = np.zeros((len(part), int(sizes[-1]), TAGS), np.float32)
        for j, (k, a, b) in enumerate(part):
            grid[j, : b - a] = e[offsets[k] + a : offsets[k] + b]
        first = np.array([a == 0 for _, a, _ in part])
        last = np.array([b == offsets[k + 1] - offsets[k] for k, _, b in part])
        paths = tagger.path(grid, sizes, first, last)
        for j in np.flatnonzero(paths.any(1)).tolist():
            (k, a, _), y = part[j], paths[j]
            x = 0
            while x < sizes[j]:
                if not y[x]:
                    x += 1
                    continue
                kind, stop = (y[x] - 1) // 2, x + 1
                while stop < sizes[j] and y[stop] == 2 + 2 * kind:
                    stop += 1
                g = grid[j, np.arange(x, stop), y[x:stop]].sum() - grid[j, x:stop, 0].sum() + T[y[x : stop - 1], y[x + 1 : stop]].sum() - (stop - 1 - x) * T[0, 0]
                g += S[y[x]] - S[0] if first[j] and x == 0 else T[0, y[x]] - T[0, 0]
                if not (last[j] and stop == sizes[j]):
                    g += T[y[stop - 1], 0] - T[0, 0]
                out.append((k, int(kind), a + x, a + stop, float(g)))
                x = stop
    return out


def added_spans(text: str, runs: list[tuple[int, int, int, float]], base: list[Span]) -> list[Span]:
    """Spans that the runs (kind, from, to, nats) give beyond the base ones."""
    out, taken = [], [(a, b) for _, a, b in base]
    for kind, a, b, nats in runs:
        while a < b and text[a] in " \n\t.,;:":
            a += 1
        while b > a and text[b - 1] in " \n\t.,;:":
            b -= 1
        free = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if a >= b or b - a > TRAIN or nats < MARGIN or not free or any(p < b and a < q for p, q in taken):
            continue
        d = _digits(text[a:b])
        if KINDS[kind] == "card" and not (13 <= len(d) <= 19 and luhn(d)) or KINDS[kind] == "phone" and len(d) > 15:
            continue
        out.append((KINDS[kind], a, b))
    return out


def spans_of(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind as listed, then start."""
    points = [encode(t) for t in texts]
    offsets = np.cumsum([0, *map(len, points)])
    runs: dict[int, list] = {}
    if offsets[-1]:
        for k, *run in tagged_runs(tagger, np.concatenate(points), offsets):
            runs.setdefault(k, []).append(tuple(run))
    for k, t in enumerate(texts):
        base = base_spans(t)
        yield base, sorted(base + added_spans(t, runs.get(k, []), base), key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, columns: list[str], parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """`columns` of docs with the counts of base spans by kind, base_sha256, and all spans."""
    parameters = fit(docs) if parameters is None else parameters
    frame = docs.select(*columns, docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(parameters)
        for batch in batches:
            for lo, hi in tk.pieces(batch.column("_text"), 2 * tk.STEP):
                part = batch.slice(lo, hi - lo)
                found = list(spans_of(tagger, [t or "" for t in part.column("_text").to_pylist()]))
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                sums = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], *counts, sums, pa.array([listed(every) for _, every in found], pa.string())],
                    names=[*columns, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("_text").schema)
    return frame.mapInArrow(run, f"{kinds}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one, by the first's kind) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with personal data masked in `text`, and `n_chars`, where there is such a column, counted anew."""
    parameters = fit(docs) if parameters is None else parameters
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(parameters)
        for batch in batches:
            for lo, hi in tk.pieces(batch.column("text"), 2 * tk.STEP):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                new = [None if t is None else masked(t, every) for t, (_, every) in zip(texts, spans_of(tagger, [t or "" for t in texts]), strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns["text"] = pa.array(new, pa.string())
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    old = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([n if t == u or u is None else len(u) for n, t, u in zip(old, texts, new, strict=True)], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)
