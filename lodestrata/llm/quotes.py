"""Chat formatting by quotation linking.

A line's quote level is its number of leading ">" marks. Runs of lines of one level are passages; a message's own text is
its lines of level 0 without an attribution line ("... wrote:") before a quote. Passages are normalised (marks, case and
white space aside) and hashed, whole and line by line, and each hash is joined to the latest earlier message of the
conversation whose own text holds it: whole, as one paragraph, or as one line. A message replies to the message that its
least nested linked quotes give most characters of (the later on a tie), and without a linked quote to the message before
it. Conversations are then put in reply order: a message comes after the one it replies to, a straight run of replies
first, then the branches, those that leave the run later first, and each message's own text stands without quotes.

Messages are ordered by turn, then role and text (nulls first). Numbers, the last holder of a passage and the branch of a
message come from range partitions stitched at their ends, and places in reply order from pointer doubling over branches: no
window, array or task holds a conversation, and the rounds grow with the logarithm of its branches. Only hashes that some message quotes are matched, by their latest earlier
holder: a line common to many messages makes no pairs. Null texts are empty; a null conv_id is a conversation of its own;
repeated rows are separate messages that follow each other. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import carried, in_order, stash

MARKS = r"^[ \t]*(>[ \t]?)+"
WROTE = r"(?i)^[ \t]*\S.{0,200}(wrote|writes|schrieb|a écrit|escribió):[ \t]*$"


def _plain(line: Column) -> Column:
    """Without marks, outer and repeated white space, and case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def lines_with_level(text: Column) -> Column:
    """Array of (line, level)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[ \t]", ""))
    return F.transform(lines, lambda x: F.struct(x.alias("line"), level(x).alias("level")))


def own_text(lines: Column) -> Column:
    """Level-0 lines, without attributions directly before a quote, joined; empty lines at either end go."""
    kept = F.filter(
        F.transform(lines, lambda x, i: F.struct(x["line"].alias("line"), x["level"].alias("level"), F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)).alias("next"))),
        lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["line"].rlike(WROTE)),
    )
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_position, parent_turn, n_quoted_lines, n_linked, text: one row a message.

    position: the place in reply order, from 1; parents are given by their position and turn; n_linked counts the quoted
    passages and lines that were found in an earlier message.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.coalesce("text", F.lit("")).alias("_key"))
    rows = in_order(rows, ["conv_id"], ["turn", "role", "_key"], ["turn"]).withColumnRenamed("position", "seq")
    # a key that is never null, for plain joins
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    rows = rows.withColumn("lines", lines_with_level(F.col("text")))
    rows = rows.withColumn("own", own_text(F.col("lines")))
    rows = stash(rows.withColumn("n_quoted_lines", F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long")), "messages")
    before = F.when(F.col("seq") > 1, F.col("seq") - 1)

    quoting = rows.where("n_quoted_lines > 0")
    if quoting.isEmpty():
        return rows.select(
            "conv_id", "turn", "role", F.col("seq").alias("position"), before.alias("parent_position"), F.when(F.col("seq") > 1, F.col("prev_turn")).alias("parent_turn"), "n_quoted_lines", F.lit(0).cast("long").alias("n_linked"), F.col("own").alias("text")
        )
    rows = rows.drop("lines", "text", "_key").join(_links(rows, quoting), ["conv", "seq"], "left")
    rows = stash(rows.withColumn("parent", F.coalesce("linked_parent", before)), "linked")
    out = rows.join(_places(rows), ["conv", "seq"], "left").withColumn("position", F.coalesce("place", "seq"))
    out = stash(out, "placed")
    above = out.select("conv", F.col("seq").alias("parent"), F.col("position").alias("parent_position"), F.col("turn").alias("parent_turn"))
    out = out.join(above, ["conv", "parent"], "left")
    return out.select("conv_id", "turn", "role", "position", "parent_position", "parent_turn", "n_quoted_lines", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("text"))


def _links(rows: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv, seq, linked_parent, n_linked) of the messages that quote what an earlier message said."""
    quoted = quoting.select("conv", "seq", F.posexplode("lines").alias("at", "x")).select("conv", "seq", "at", F.col("x.level").alias("level"), _plain(F.col("x.line")).alias("plain"))
    run = Window.partitionBy("conv", "seq").orderBy("at")  # one message's lines
    quoted = quoted.withColumn("_new", (F.col("level") != F.lag("level", 1, -1).over(run)).cast("int")).withColumn("passage", F.sum("_new").over(run)).where("level > 0")
    whole = quoted.groupBy("conv", "seq", "level", "passage").agg(F.array_sort(F.collect_list(F.struct("at", "plain"))).alias("x"))
    whole = whole.select("conv", "seq", "level", F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda y: y["plain"]), " "), r"\s+", " ")).alias("plain"))
    quotes = quoted.select("conv", "seq", "level", "plain").unionByName(whole).where("plain <> ''").distinct()
    quotes = stash(quotes.select("conv", "seq", "level", F.md5("plain").alias("hash"), F.length("plain").alias("size")), "quotes")

    units = F.concat(F.array(F.col("own")), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    held = rows.select("conv", "seq", F.explode(F.array_distinct(F.transform(units, _plain))).alias("plain")).where("plain <> ''")
    held = held.select("conv", "seq", F.md5("plain").alias("hash")).distinct()
    held = held.join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    # the latest earlier holder of each hash: an as-of join as one pass over both sides in order, a message's quotes before what it holds
    both = held.select("conv", "hash", "seq", F.lit(1).alias("side"), F.col("seq").alias("holds"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size"))
    both = both.unionByName(quotes.select("conv", "hash", "seq", F.lit(0).alias("side"), F.lit(None).cast("long").alias("holds"), "level", "size"))
    linked = carried(both, ["conv", "hash"], ["seq", "side", "level"], "holds", "holder").where("level is not null and holder is not null")
    linked = stash(linked.select("conv", "seq", "level", "holder", "size"), "quoted")
    votes = linked.groupBy("conv", "seq", "level", "holder").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    return votes.groupBy("conv", "seq").agg(
        F.max_by("holder", F.struct(-F.col("level"), F.col("chars"), F.col("holder"))).alias("linked_parent"), F.sum("n").alias("n_linked")
    )


def _places(rows: DataFrame) -> DataFrame:
    """(conv, seq, place) in reply order, for conversations with branches.

    A branch begins at a message that replies to another than the one before it. Branches are put in one list a conversation:
    after a branch comes the first that leaves it, or else the next beside it or beside the nearest branch around it.
    """
    heads = rows.where("parent <> seq - 1").select("conv").distinct()
    some = rows.join(heads, "conv", "left_semi").select("conv", "seq", "parent")
    some = some.withColumn("head", F.when(F.col("parent").isNull() | (F.col("parent") != F.col("seq") - 1), F.col("seq")))
    branch = stash(carried(some, ["conv"], ["seq"], "head", "branch").select("conv", "seq", "parent", "branch"), "branches")
    sizes = branch.groupBy("conv", "branch").agg(F.count("*").alias("size"))
    tree = branch.where("seq = branch and parent is not null").select("conv", "branch", F.col("parent").alias("at"))
    tree = tree.join(branch.select("conv", F.col("seq").alias("at"), F.col("branch").alias("above")), ["conv", "at"]).withColumn("back", -F.col("at"))
    tree = stash(in_order(tree, ["conv", "above"], ["back", "branch"], ["branch"]), "tree")
    inner = tree.where("position = 1").select("conv", F.col("above").alias("branch"), F.col("branch").alias("inner"))
    state = sizes.join(tree.select("conv", "branch", "above", F.col("next_branch").alias("beside")), ["conv", "branch"], "left").join(inner, ["conv", "branch"], "left")
    # the branch beside, or beside the nearest one around that has any: each round looks twice as far out
    state = stash(state.select("conv", "branch", "size", "inner", F.col("beside").alias("exit"), F.when(F.col("beside").isNull(), F.col("above")).alias("out")), "exits")
    while not state.where("out is not null").isEmpty():
        far = state.select("conv", F.col("branch").alias("out"), F.col("exit").alias("_exit"), F.col("out").alias("_out"))
        state = state.join(far, ["conv", "out"], "left").select("conv", "branch", "size", "inner", F.coalesce("exit", "_exit").alias("exit"), F.col("_out").alias("out"))
        state = stash(state, "exits")
    # messages from a branch to the end of the list: each round jumps twice as far
    state = stash(state.select("conv", "branch", F.col("size").alias("rest"), F.coalesce("inner", "exit").alias("jump")), "ranks")
    while not state.where("jump is not null").isEmpty():
        far = state.select("conv", F.col("branch").alias("jump"), F.col("rest").alias("_rest"), F.col("jump").alias("_jump"))
        state = state.join(far, ["conv", "jump"], "left").select("conv", "branch", (F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest"), F.col("_jump").alias("jump"))
        state = stash(state, "ranks")
    total = branch.groupBy("conv").agg(F.count("*").alias("total"))
    place = branch.join(state.select("conv", "branch", "rest"), ["conv", "branch"]).join(total, "conv")
    return place.select("conv", "seq", (F.col("total") - F.col("rest") + 1 + F.col("seq") - F.col("branch")).alias("place"))


def quoted_replies(conversations: DataFrame) -> DataFrame:
    """conversations in which each message first quotes the first line of the second message before it, by turn and role."""
    first = F.split(F.coalesce("text", F.lit("")), "\n", -1)[0]
    rows = in_order(conversations.select("conv_id", "turn", "role", "text", first.alias("line")), ["conv_id"], ["turn", "role", "text"], ["line"])
    two = in_order(rows.drop("position", "next_line"), ["conv_id"], ["turn", "role", "text"], ["prev_line"])
    text = F.when(F.trim(F.coalesce("prev_prev_line", F.lit(""))) != "", F.concat(F.lit("> "), F.col("prev_prev_line"), F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return two.select("conv_id", "turn", "role", text.alias("text"))


#: Parents and links of quoted_replies(): the latest earlier message that holds the quoted line as a line.
QUOTED_ORACLE = r"""
with m as (
  select conv_id, turn, role, coalesce(text, '') as own, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as seq from conversations),
q as (
  select *, trim(lower(regexp_replace(split_part(lag(own, 2) over (partition by conv_id order by seq), chr(10), 1), '\s+', ' ', 'g'))) as quoted from m),
l as (select conv_id, seq, trim(lower(regexp_replace(unnest(string_split(own, chr(10))), '\s+', ' ', 'g'))) as line from m),
h as (select q.conv_id, q.seq, max(l.seq) as holder from q join l on q.conv_id = l.conv_id and q.quoted = l.line and l.seq < q.seq where q.quoted <> '' group by all)
select q.conv_id, q.turn, q.role, p.turn as parent_turn, (h.holder is not null)::bigint as n_linked, md5(q.own) as text_md5
from q left join h using (conv_id, seq) left join m p on p.conv_id = q.conv_id and p.seq = coalesce(h.holder, q.seq - 1)
"""

#: The tables hold no quoted lines; this is the linear case. quoted_replies() has SQL for links; tests compare links and places
#: of random conversations with a brute-force linker.
ORACLE = r"""
with m as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, coalesce(text, '')) as seq from conversations),
o as (
  select *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')) as own,
         len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t]*>')))::bigint as n_quoted_lines from m)
select conv_id, turn, role, seq::bigint as position, lag(seq) over w::bigint as parent_position, lag(turn) over w as parent_turn,
       n_quoted_lines, 0::bigint as n_linked,
       md5(regexp_replace(regexp_replace(array_to_string(own, chr(10)), '^([ \t]*\n)+', ''), '(\n[ \t]*)+$', '')) as text_md5
from o window w as (partition by conv_id order by seq)
"""
