"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of (source, language, topic) with their tokens. Raking multiplies the cells' factors
until the token weights meet the target share of every source, language and topic at once. A cell's factor over the
largest factor is the probability with which each of its documents is kept, so the kept tokens have the target shares in
expectation, without clipping. The draw is a hash of doc_id: the same on every run, and the same for repeated rows.

Targets are given by value, or follow the corpus's own shares to the power ALPHA (below 1 lifts what is rare). Sweeps go on
until every marginal is within CLOSE of its target; targets that no weights meet (a wanted value without tokens, say) end
after MOST_SWEEPS with the factors reached. A null source or language counts as "". Documents without tokens weigh nothing in
the cells and take their cell's probability; a cell of no tokens at all keeps all its documents. Only cells are shuffled by
value, after map-side sums: up to BROADCAST_CELLS of them are raked in numpy, more by grouped sums and joins, to the same
factors. An empty table gives an empty result. sample() keeps columns of any name; mix() replaces those it adds.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkernel as tk
from lodestrata.llm.shared import stash

ALPHA, CLOSE, MOST_SWEEPS = 0.85, 1e-13, 400
#: Sweeps that the SQL does.
SQL_SWEEPS = 60
#: Cells up to which they are broadcast; more are joined with salted keys.
BROADCAST_CELLS, SALTS = 50_000, 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"


def measured(texts: pa.Array) -> pa.Array:
    """(tokens, symbols, capitals, chars) of each text: words are runs of characters other than 0x20 and 0x09-0x0D."""
    parts = []
    for lo, hi in tk.pieces(texts):
        data, offsets = tk.column_bytes(texts.slice(lo, hi - lo))
        _, _, firsts = tk.words(data, offsets)
        sums = [np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])[offsets] for flag in (_SYMBOL, _UPPER, _LEAD)]
        parts.append([np.diff(x) for x in (firsts, *sums)])
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tokens", "symbols", "capitals", "chars"])


_SYMBOL, _UPPER, _LEAD = (np.zeros(256, np.int64) for _ in range(3))
_SYMBOL[list(SYMBOLS.encode())] = 1
_UPPER[list(UPPER.encode())] = 1
_LEAD[[b for b in range(256) if not 128 <= b < 192]] = 1  # begins a code point


def topic(m: Column) -> Column:
    """The kind of content: symbols, capitals, or prose by length."""
    words = m["tokens"]
    return (
        F.when(m["symbols"] * 10 > words, "symbols")
        .when(m["capitals"] * 3 > m["chars"], "capitals")
        .when(words < 100, "short prose")
        .when(words < 500, "prose")
        .otherwise("long prose")
    )


def labelled(docs: DataFrame, name: str) -> DataFrame:
    """docs with the struct `name`: _tokens, _source, _lang and _topic."""
    counts = F.arrow_udf(measured, "tokens long, symbols long, capitals long, chars long")
    out = docs.withColumn(name, counts(docs["text"]))
    m = F.col(name)
    return out.withColumn(name, F.struct(m["tokens"].alias("_tokens"), F.coalesce(docs["source"], F.lit("")).alias("_source"), F.coalesce(docs["lang"], F.lit("")).alias("_lang"), topic(m).alias("_topic")))


def rake(cells: DataFrame, axes: list[str], targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA) -> DataFrame:
    """`cells` (one row per combination of axes, with `_tokens` > 0) with `factor`: their weights meet the targets of all axes."""
    targets = targets or {}
    spark = cells.sparkSession
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        rows = cells.orderBy(*axes).toPandas()
        own = rows["_tokens"].to_numpy(float)
        sides = []
        for a in axes:
            code, values = pd.factorize(rows[a])
            whole = np.bincount(code, own, len(values))
            want = np.array([targets[a].get(v, 0.0) for v in values]) if a in targets else whole**alpha / (whole**alpha).sum()
            sides.append((code, want))
        factor = np.ones(len(rows))
        for _ in range(MOST_SWEEPS if len(rows) else 0):
            off = 0.0
            for code, want in sides:
                now = np.bincount(code, own * factor, len(want)) / own.sum()
                off = max(off, np.abs(now - want).max())
                factor *= np.divide(want, now, out=np.ones(len(want)), where=now > 0)[code]
            if off < CLOSE:
                break
        rows["factor"] = factor
        return spark.createDataFrame(rows, cells.select(*axes, "_tokens").schema.add("factor", "double"))
    total = float(cells.agg(F.sum("_tokens")).first()[0])
    wanted = []
    for a in axes:
        by_value = cells.groupBy(a).agg(F.sum("_tokens").alias("_n"))
        if a in targets:
            given = spark.createDataFrame([(v, float(x)) for v, x in targets[a].items()], f"`{a}` string, _want double")
            wanted.append(stash(by_value.join(given, a, "left").select(a, F.coalesce("_want", F.lit(0.0)).alias("_want")), "want"))
        else:
            power = by_value.agg(F.sum(F.pow("_n", F.lit(alpha)))).first()[0]
            wanted.append(stash(by_value.select(a, (F.pow("_n", F.lit(alpha)) / F.lit(power)).alias("_want")), "want"))
    cells = stash(cells.select(*axes, "_tokens", F.lit(1.0).alias("factor")), "cells")
    for _ in range(MOST_SWEEPS):
        off = 0.0
        for a, want in zip(axes, wanted, strict=True):
            now = cells.groupBy(a).agg((F.sum(F.col("_tokens") * F.col("factor")) / F.lit(total)).alias("_now")).join(want, a)
            now = stash(now, "now")
            off = max(off, now.agg(F.max(F.abs(F.col("_now") - F.col("_want")))).first()[0])
            step = F.when(F.col("_now") > 0, F.col("_want") / F.col("_now")).otherwise(1.0)
            cells = stash(cells.join(now.select(a, step.alias("_step")), a).select(*axes, "_tokens", (F.col("factor") * F.col("_step")).alias("factor")), "cells")
        if off < CLOSE:
            break
    return cells


def mixed(docs: DataFrame, name: str, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """docs with the struct `name`: the labels, and of the draw `_probability` and `_kept`."""
    axes = ["_source", "_lang", "_topic"]
    rows = labelled(docs, name)
    cells = stash(rows.select(f"{name}.*").groupBy(*axes).agg(F.sum("_tokens").alias("_tokens")), "cells")
    full = rake(cells.where("_tokens > 0"), axes, targets)
    top = full.agg(F.max("factor")).first()[0] or 1.0
    calibrated = full.select(F.struct(*axes).alias("_cell"), (F.col("factor") / F.lit(top)).alias("_share"))
    calibrated = calibrated.select(F.col("_cell").alias(f"{name}_cell"), F.col("_share").alias(f"{name}_share"))
    cell = F.struct(*[F.col(name)[a].alias(a) for a in axes])
    if calibrated.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        out = rows.join(F.broadcast(calibrated), cell == F.col(f"{name}_cell"), "left")
    else:
        salt = f"{name}_salt"
        salted = calibrated.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(salted, (cell == F.col(f"{name}_cell")) & (F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(SALTS)).cast("int") == F.col(salt)), "left").drop(salt)
    p = F.coalesce(F.col(f"{name}_share"), F.lit(1.0))
    m = F.col(name)
    out = out.withColumn(name, F.struct(m["_tokens"].alias("_tokens"), *[m[a].alias(a) for a in axes], p.alias("_probability"), (draw(docs["doc_id"]) < p).alias("_kept")))
    return out.drop(f"{name}_cell", f"{name}_share")


def free_name(docs: DataFrame) -> str:
    name = "_mix"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """docs with _tokens, _source, _lang, _topic, and of the draw `_probability` and `_kept`."""
    name = free_name(docs)
    added = ["_tokens", "_source", "_lang", "_topic", "_probability", "_kept"]
    return mixed(docs, name, targets).select(*[docs[c] for c in docs.columns if c not in added], f"{name}.*")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id (null: as an empty string)."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The documents of docs that the draw keeps, with the columns of docs."""
    name = free_name(docs)
    return mixed(docs, name, targets).where(f"{name}._kept").drop(name)


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL: doc_id, n_tokens, topic, probability, kept."""
    steps = []
    last = "c0"
    for k in range(SQL_SWEEPS):
        for a in ("source", "lang", "topic"):
            name = f"r{k}_{a}"
            steps.append(f"{name} as materialized (select * replace (case when sum(tokens * factor) over (partition by {a}) > 0 then factor * want_{a} * whole / sum(tokens * factor) over (partition by {a}) else factor end as factor) from {last})")
            last = name
    return f"""
with rows as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens
  from {table}),
named as (
  select doc_id, source, lang, tokens,
         case when (length(text) - length(translate(text, '{SYMBOLS}', ''))) * 10 > tokens then 'symbols'
              when (length(text) - length(translate(text, '{UPPER}', ''))) * 3 > length(text) then 'capitals'
              when tokens < 100 then 'short prose' when tokens < 500 then 'prose' else 'long prose' end as topic
  from rows),
cells as (select source, lang, topic, sum(tokens)::double as tokens from named group by all having sum(tokens) > 0),
wanted as (
  select *, pow(sum(tokens) over (partition by source), {ALPHA}) as ws, pow(sum(tokens) over (partition by lang), {ALPHA}) as wl,
         pow(sum(tokens) over (partition by topic), {ALPHA}) as wt, sum(tokens) over () as whole from cells),
c0 as materialized (
  select source, lang, topic, tokens, whole, 1.0::double as factor,
         ws / (select sum(x) from (select max(ws) as x from wanted group by source)) as want_source,
         wl / (select sum(x) from (select max(wl) as x from wanted group by lang)) as want_lang,
         wt / (select sum(x) from (select max(wt) as x from wanted group by topic)) as want_topic
  from wanted),
{", ".join(steps)},
calibrated as (select source, lang, topic, factor / max(factor) over () as p from {last})
select doc_id, n.tokens as n_tokens, n.topic as topic, round(coalesce(p, 1.0), 6) as probability,
       ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::ubigint::double / 4294967296.0 < coalesce(p, 1.0) as kept
from named n left join calibrated c on n.source = c.source and n.lang = c.lang and n.topic = c.topic
"""
