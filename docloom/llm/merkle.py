"""Merkle manifest of a dataset: a digest per row, trees of sixteen children per group, one root over the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import SPREAD_ROWS, staged

FANOUT = 16
#: Columns of documents in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its length in bytes, a colon and its text; a null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SPREAD_ROWS else df


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (with the column grp, first in ``order``) with pos, the place of each row in its group, and n, the group's rows.

    Rows are dealt to tasks by ranges of ``order`` and their place in the input, so neither a group nor a key that most
    rows hold comes to one task; a group's share of each task is counted and the counts before it are added up.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *order, "__tie").sortWithinPartitions(*order, "__tie")
    # The id of a row is its task's number and its place in the task.
    row = F.monotonically_increasing_id()
    ordered = staged(dealt.drop("__tie").withColumn("__row", row), "ordered")
    ordered = ordered.withColumn("__task", F.shiftright("__row", 33)).withColumn("__at", F.col("__row").bitwiseAND((1 << 33) - 1))
    parts = ordered.groupBy("grp", "__task").agg(F.min("__at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("grp")
    earlier = whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("grp", "__task", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("__shift"), F.sum("rows").over(whole).alias("n"))
    placed = ordered.join(_bounded(staged(shifts, "shifts")), ["grp", "__task"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__row", "__task", "__at", "__shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, pos, n, digest) with run, before and after: the digests of the other nodes of the run, joined.

    Columns at fixed distances before and behind a row hold the digests there; those outside the row's run, by its slot
    and the run's length, are masked.
    """
    slot = F.col("pos") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - (F.col("pos") - slot))
    beside = Window.partitionBy("grp", "run").orderBy("pos")
    before = [F.when(slot >= k, F.lag("digest", k).over(beside)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("digest", k).over(beside)) for k in range(1, FANOUT)]
    known = nodes.withColumn("run", F.floor(F.col("pos") / FANOUT))
    return known.withColumn("before", F.concat_ws("", *before)).withColumn("after", F.concat_ws("", *after))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level, hashed on the row of each run's first child; groups that came to one node end."""
    heads = with_siblings(nodes.where("n > 1")).where(F.col("pos") % FANOUT == 0)
    return heads.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels, written, from ``nodes`` up to the single nodes of the largest group."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = [nodes]
    while most > 1:
        levels.append(staged(_parents(levels[-1]), "level"))
        most = -(-most // FANOUT)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of each group (grp, digest) and the level it stands on."""
    found = [nodes.where("n = 1").select("grp", F.lit(k).alias("height"), "digest") for k, nodes in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _path() -> Column:
    return F.array(F.struct("before", "after"))


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """What stands above the nodes of level 0: (grp, run, path and the other columns of ``ends``).

    ``ends`` has grp, height and what goes on from the last node of a group. A node's path is its own siblings, then
    its parent's path; every step joins a level with the sixteenth part of it above, by runs.
    """
    rest = [c for c in ends.columns if c not in ("grp", "height", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        own = ends.where(F.col("height") == k).select("grp", F.lit(0).cast("long").alias("run"), "path", *rest)
        above = own if above is None else above.select("grp", F.col("pos").alias("run"), "path", *rest).union(own)
        if k:
            inner = with_siblings(levels[k]).join(above, ["grp", "run"])
            above = staged(inner.select("grp", "pos", F.when(F.col("n") > 1, F.concat(_path(), "path")).otherwise(F.col("path")).alias("path"), *rest), "paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, leaf, subroot, root and path (the siblings before and after the row's
    ancestors, level by level up to the root); with ``claimed``, that column of ``docs`` too.

    Leaves of a group stand in the order of ``key`` (nulls first, equal keys by leaf); every sixteen neighbours hash to a node
    of the next level until one is left, the subroot. Subroots, a null group first and then by bytes, hash to the root alike.
    Equal rows have equal leaves and stand side by side, each with its own path. An empty table gives no rows. Only the
    columns named count; others, whatever their names, are ignored.

    Per row only its digest travels: once to be put in order, once to its run. Levels shrink to a sixteenth; a path is
    shared by a run until the last step. Nothing is gathered by group, so one group may hold most rows.
    """
    given = docs.select(
        F.struct(F.col(key).alias("key"), F.col(group).alias("group")).alias("row"),
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp"),  # the empty text, first of all, stands for null
        F.col(key).alias("order"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        (claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed"),
    )
    leaves = _numbered(given, ["grp", "order", "digest"])
    levels = _levels(leaves.select("grp", "pos", "n", "digest"))
    subroots = staged(_tops(levels), "subroots")
    upper = _levels(staged(_numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("order"), "digest"), ["grp", "order"]), "groups"))
    root = _tops(upper).select("grp", "height", F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    outer = with_siblings(upper[0]).join(_paths(upper, root), ["grp", "run"])
    outer = outer.select(F.col("order").alias("grp"), F.col("digest").alias("subroot"), "root", F.when(F.col("n") > 1, F.concat(_path(), "path")).otherwise(F.col("path")).alias("path"))
    ends = staged(subroots.select("grp", "height").join(outer, "grp"), "ends")
    found = with_siblings(leaves).join(_paths(levels, ends), ["grp", "run"])
    path = F.when(F.col("n") > 1, F.concat(_path(), "path")).otherwise(F.col("path"))
    names = [F.col("row.key").alias(key), F.col("row.group").alias(group), F.col("digest").alias("leaf"), "subroot", "root", path.alias("path")]
    return found.select(*names, *(["claimed"] if claimed is not None else []))


def op12_merkle_manifest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text"))
    out = manifest(docs, claimed=leaf_digest(*[text if c == "text" else F.col(c) for c in FIELDS]))
    folded = fold(F.col("claimed"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def crc32_sql(value: str) -> str:
    """The unsigned CRC-32 of a short ASCII text in DuckDB's SQL."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({value}, ''), lambda c: ascii(c)::bigint)), lambda a, b: {step}), 4294967295::bigint)"


def _leaf_sql(text: str) -> str:
    values = [text if f == "text" else f"{f}::varchar" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_UP = "list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], '')))"
ORACLE = f"""
with recursive marked as (
  select *, coalesce('+' || source, '') as grp, case when {crc32_sql('doc_id::varchar')} % 5 = 0
    then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as claimed from documents),
leaves as (select grp, doc_id, {_leaf_sql('text')} as leaf, {_leaf_sql('claimed')} as claimed from marked),
placed as (select *, row_number() over (order by grp, doc_id nulls first, leaf) as id, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from leaves),
up(grp, level, l) as (
  select grp, 0, list(leaf order by pos) from placed group by grp
  union all select grp, level + 1, {_UP} from up where len(l) > 1),
tops as (select grp, level as height, l[1] as subroot, row_number() over (order by grp) - 1 as pos from up where len(l) = 1),
top(level, l) as (
  select 0, list(subroot order by pos) from tops
  union all select level + 1, {_UP} from top where len(l) > 1),
steps as (
  select grp, level, l from up where len(l) > 1
  union all select grp, height + top.level, top.l from tops, top where len(top.l) > 1),
walk(id, grp, level, pos, acc, proof) as (
  select p.id, p.grp, 0, case when t.height = 0 then t.pos else p.pos end, p.claimed, '' from placed p join tops t on p.grp = t.grp
  union all
  select w.id, w.grp, w.level + 1, case when w.level + 1 = t.height then t.pos else w.pos // 16 end,
    sha256(array_to_string(s.l[w.pos - w.pos % 16 + 1:w.pos], '') || w.acc || array_to_string(s.l[w.pos + 2:w.pos - w.pos % 16 + 16], '')),
    w.proof || array_to_string(s.l[w.pos - w.pos % 16 + 1:w.pos], '') || array_to_string(s.l[w.pos + 2:w.pos - w.pos % 16 + 16], '')
  from walk w join steps s on s.grp = w.grp and s.level = w.level join tops t on t.grp = w.grp),
ended as (select w.* from walk w where not exists (select 1 from steps s where s.grp = w.grp and s.level = w.level))
select p.doc_id, p.leaf, t.subroot, r.l[1] as root, sha256(e.proof) as proof_sha256, e.acc as folded_root, e.acc = r.l[1] as verified
from placed p join ended e on p.id = e.id join tops t on t.grp = p.grp cross join (select l from top where len(l) = 1) r
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": ORACLE}
