"""Name resolution and set joins over fact tables (members, entities, edges, accesses).

Names match without regard to case. All joins are equi-joins on upper(name), so Catalyst picks broadcast or sort-merge by
size; nothing here is hinted. Where a name has several holders the smallest id is taken, which makes results repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_name(defs: DataFrame, name: str, key: str) -> DataFrame:
    """(_upper, _id): one holder, that of the smallest id, for each name."""
    return defs.where(F.col(name).isNotNull()).groupBy(F.upper(name).alias("_upper")).agg(F.min(key).alias("_id"))


def resolve_edges(edges: DataFrame, defs: DataFrame, callee: str, name: str, key: str, internal: str | None = None) -> DataFrame:
    """edges with callee_id and resolved: the definition that the callee's name means, null if none.

    Rows for which the boolean column `internal` holds call into their own member: they are resolved without a holder.
    """
    held = first_by_name(defs, name, key)
    out = edges.join(held, F.upper(edges[callee]) == held["_upper"], "left").drop("_upper").withColumnRenamed("_id", "callee_id")
    found = F.col("callee_id").isNotNull()
    return out.withColumn("resolved", found | F.coalesce(F.col(internal), F.lit(False)) if internal else found)


def fill_entity(accesses: DataFrame, entities: DataFrame, entity: str, current: str, name: str, key: str) -> DataFrame:
    """accesses whose entity id is kept where there is one and looked up by name where it is null."""
    held = first_by_name(entities, name, key)
    out = accesses.join(held, F.upper(accesses[entity]) == held["_upper"], "left")
    return out.withColumn(current, F.coalesce(current, "_id")).drop("_upper", "_id")


def undefined_names(accesses: DataFrame, defs: DataFrame, entity: str, name: str, defined: str, skip_prefix: str = "WORKFILE-") -> DataFrame:
    """Distinct accessed names with no definition, or with any holder that is undefined."""
    d = defs.select(F.upper(name).alias("_upper"), F.col(defined).alias("_defined"))
    used = accesses.select(F.col(entity).alias("entity_name")).where(F.col("entity_name").isNotNull() & ~F.col("entity_name").ilike(f"{skip_prefix}%"))
    used = used.distinct()
    return used.join(d, F.upper("entity_name") == d["_upper"], "left").where(F.col("_upper").isNull() | ~F.col("_defined")).select("entity_name").distinct()


def unresolved_calls(edges: DataFrame, defs: DataFrame, callee: str, kind: str, caller: str, line: str, name: str) -> DataFrame:
    """Calls of names without a definition, by upper name and kind: calls, and caller and line of the first."""
    d = defs.select(F.upper(name).alias("_upper")).distinct()
    lost = edges.join(d, F.upper(edges[callee]) == d["_upper"], "left_anti")
    first = F.struct(F.col(line), F.col(caller))
    return lost.groupBy(F.upper(callee).alias("callee"), F.col(kind).alias("call_kind")).agg(
        F.count("*").alias("calls"), F.min_by(caller, first).alias("first_caller"), F.min_by(line, first).alias("first_line")
    )


def orphans(members: DataFrame, edges: DataFrame, key: str, name: str, callee_id: str, callee_name: str) -> DataFrame:
    """Members that no edge reaches by id or by name: two anti-joins on keys, where one on "id or name" would be a nested loop."""
    ids = edges.select(F.col(callee_id).alias("_id")).where("_id is not null").distinct()
    names = edges.select(F.upper(callee_name).alias("_upper")).where("_upper is not null").distinct()
    left = members.join(ids, members[key] == ids["_id"], "left_anti")
    return left.join(names, F.upper(left[name]) == names["_upper"], "left_anti")


def scopes(rows: DataFrame, member: str, line: str, is_marker: str, is_write: str) -> DataFrame:
    """Writes with the line of the boundary that closes their scope: the next marker at or after them in the member.

    Writes after a member's last marker belong to no scope and are left out.
    """
    ahead = Window.partitionBy(member).orderBy(line).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = rows.withColumn("boundary", F.min(F.when(F.col(is_marker), F.col(line))).over(ahead))
    return out.where(F.col(is_write) & F.col("boundary").isNotNull())


def reconcile(placeholders: DataFrame, named: DataFrame, number: str, base: str, key: str) -> DataFrame:
    """placeholder, target, candidates: a placeholder file takes the one named file of its number whose base fits (or is null)."""
    p = placeholders.select(F.col(key).alias("placeholder"), F.col(number).alias("_n"), F.col(base).alias("_b"))
    n = named.where(F.col(number).isNotNull()).select(F.col(key).alias("_t"), F.col(number).alias("_n"), F.col(base).alias("_b"))
    # sums by number and base first: files of one number make no pairs
    held = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_t").alias("_t"))
    own = held(n.where("_b is not null"), "_n", "_b")
    open_ = held(n.where("_b is null"), "_n").withColumnsRenamed({"_c": "_c0", "_t": "_t0"})
    every = held(n, "_n")
    based = p.where("_b is not null").join(own, ["_n", "_b"], "left").join(open_, "_n", "left")
    based = based.select("placeholder", (F.coalesce("_c", F.lit(0)) + F.coalesce("_c0", F.lit(0))).alias("candidates"), F.least("_t", "_t0").alias("target"))
    free = p.where("_b is null").join(every, "_n").select("placeholder", F.col("_c").alias("candidates"), F.col("_t").alias("target"))
    found = based.where("candidates > 0").unionByName(free).groupBy("placeholder").agg(F.sum("candidates").alias("candidates"), F.min("target").alias("target"))
    return found.withColumn("target", F.when(F.col("candidates") == 1, F.col("target")))


def repoint(facts: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """facts with the ids in `column` replaced by their targets."""
    m = mapping.where("target is not null").select(F.col("placeholder").alias("_from"), F.col("target").alias("_to"))
    return facts.join(m, facts[column] == m["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def name_holders(members: DataFrame, name: str, library: str) -> DataFrame:
    """For each upper name: members, the sorted libraries that hold it, and whether it is ambiguous."""
    out = members.groupBy(F.upper(name).alias("member_name")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set(library)), ",").alias("libraries"))
    return out.withColumn("ambiguous", F.col("members") > 1)


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


#: Rows of a frontier, or of what was seen, up to which they are broadcast: a few MB sent, whatever the input. Beyond, the join is a merge.
FEW = 100_000


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """rows, counted as n, with the hint that fits. The other side, the edges, is never collected, however small Catalyst takes it for."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def closure(edges: DataFrame, root, max_depth: int = 12, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, depth): the least number of steps to each node from root, by frontiers that leave out what was seen."""
    from lodestrata.plans.materialise import cut

    spark = edges.sparkSession
    e = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t is not null")
    kind = dict(e.dtypes)["_t"]
    seen = spark.createDataFrame([(root, 0)], f"node {kind}, depth int")
    front, n, known = seen, 1, 1
    for depth in range(1, max_depth + 1):
        step = e.join(_sized(front.select("node"), n), F.col("_s") == F.col("node"), "left_semi").select(F.col("_t").alias("node")).distinct()
        front = cut(step.join(_sized(seen.select("node"), known), "node", "left_anti").withColumn("depth", F.lit(depth)))
        n = front.count()
        if not n:
            break
        seen, known = seen.unionByName(front), known + n
    return seen


def closures(edges: DataFrame, roots: DataFrame, max_depth: int = 12, source: str = "src", target: str = "dst") -> DataFrame:
    """(member, node, depth) for every member in `roots`: its reachable nodes, cycles passed once, all members in one frontier."""
    from lodestrata.plans.materialise import cut

    e = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t is not null")
    seen, known = None, 0
    front = cut(roots.select("member", F.col("member").alias("node")).distinct())
    n = front.count()
    for depth in range(1, max_depth + 1):
        # the frontier's own edges first: a repeated edge makes no pairs
        near = e.join(_sized(front.select("node").distinct(), n), F.col("_s") == F.col("node"), "left_semi").distinct()
        step = near.join(_sized(front, n), F.col("_s") == F.col("node")).select("member", F.col("_t").alias("node")).distinct()
        if seen is not None:
            step = step.join(_sized(seen.select("member", "node"), known), ["member", "node"], "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth)))
        n = front.count()
        if not n:
            break
        seen, known = front if seen is None else seen.unionByName(front), known + n
        front = front.select("member", "node")
    return seen if seen is not None else front.select("member", "node", "depth")


def resolve_entity(wanted: DataFrame, entities: DataFrame, name: str, family: str, kind: str, default: str) -> DataFrame:
    """wanted with the entity its name means in a family of kinds (those that begin with `family`), without regard to case.

    entity_name and entity_kind are those of the least (kind, name) that fits, or the name itself under the `default` kind.
    """
    held = entities.where(F.col(kind).startswith(family)).groupBy(F.upper(name).alias("_upper")).agg(F.min(F.struct(kind, name)).alias("_e"))
    out = wanted.join(held, F.upper(wanted[name]) == held["_upper"], "left")
    return out.withColumns({"entity_name": F.coalesce(F.col("_e")[name], F.col(name)), "entity_kind": F.coalesce(F.col("_e")[kind], F.lit(default))}).drop("_upper", "_e")


def linked_entities(links: DataFrame, entities: DataFrame, members: DataFrame, source: str, target: str, via: str, key: str, name: str, member_key: str, member_name: str) -> DataFrame:
    """links with from_name, to_name and via_name: both ends must be known entities, the member that states the link may be unknown."""
    a = entities.select(F.col(key).alias(source), F.col(name).alias("from_name"))
    b = entities.select(F.col(key).alias(target), F.col(name).alias("to_name"))
    m = members.select(F.col(member_key).alias(via), F.col(member_name).alias("via_name"))
    return links.join(a, source).join(b, target).join(m, via, "left")


def callers_of(edges: DataFrame, wanted: DataFrame, callee: str, name: str) -> DataFrame:
    """edges that call a wanted name, with the name, without regard to case."""
    w = wanted.select(F.col(name).alias("_wanted")).distinct()
    return edges.join(w, F.upper(edges[callee]) == F.upper("_wanted")).withColumnRenamed("_wanted", name) if name not in edges.columns else edges.join(w, F.upper(edges[callee]) == F.upper("_wanted"), "left_semi")


def accesses_of(accesses: DataFrame, wanted: DataFrame, entity: str) -> DataFrame:
    """accesses of the wanted entities, without regard to case."""
    w = wanted.select(F.upper(entity).alias("_wanted")).distinct()
    return accesses.join(w, F.upper(accesses[entity]) == w["_wanted"], "left_semi")


def unknown_references(refs: DataFrame, known: DataFrame, ref: str) -> DataFrame:
    """Distinct references, in capitals, that are not known under any case."""
    k = known.select(F.upper(ref).alias(ref)).distinct()
    return refs.select(F.upper(ref).alias(ref)).distinct().join(k, ref, "left_anti")


def both_judged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row for each key that both sides judged, with both verdicts."""
    return left.join(right, key)


def facts_of_members(facts: DataFrame, members: DataFrame, member: str, key: str, carry: list[str]) -> DataFrame:
    """facts of the given members, with the members' columns `carry`; Catalyst broadcasts the members where they are few."""
    m = members.select(F.col(key).alias("_key"), *carry)
    return facts.join(m, facts[member] == m["_key"]).drop("_key")


def facts_in_batch(facts: DataFrame, batch: DataFrame, member: str, key: str) -> DataFrame:
    """facts of the members in a batch."""
    return facts.join(batch.select(F.col(key).alias("_key")).distinct(), F.col(member) == F.col("_key"), "left_semi")


def unambiguous(members: DataFrame, name: str) -> DataFrame:
    """members whose name, case and all, no other member has."""
    held = members.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return members.join(held, name, "left_semi")


def boundaries(markers: DataFrame, member: str, line: str) -> DataFrame:
    """Each marker with the one before and after it in its member."""
    w = Window.partitionBy(member).orderBy(line)
    return markers.withColumns({"previous": F.lag(line).over(w), "following": F.lead(line).over(w)})
