"""Exact top-k inner products by Voronoi groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import ship_package, staged

LEAST_PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT = 16, 4096, 1024
BLOCK = 1024  # rows of one group solved in one call
SLICE = 4096  # queries that meet them there, at about


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and v: floor(scale * x) of every component. Rows with a null key, a null vector or a null or non-finite component are
    left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("id"), made.alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one counts as filled up with zeros."""
    if len(rows) and all(len(r) == width for r in rows):
        return np.stack(rows.to_numpy()).astype(np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each row of ``queries`` (id, v) the ``k`` rows of ``vectors`` (id, v; written or cheap) with the largest inner
    products, ties to the smaller id, its own id left out: query_id, rank, vec_id, score. Both hold integer vectors whose
    products fit 64 bits; shorter vectors count as filled up with zeros. An empty table gives no rows.

    Some rows are pivots; every row joins the group of its nearest pivot, and a group is summed up by its size and radius.
    The products with the pivots, which are rows themselves, give each query a score that its k-th best reaches at least. By
    ``q.x <= q.pivot + |q| radius`` a query is sent only to groups that may hold as much, and each group is solved where it
    lies. Groups are split into blocks of about ``BLOCK`` rows, so rows that agree or crowd together do not meet in one task.
    Queries are dealt to slices of about ``SLICE``, and a block is solved once for each slice: both sides of a call are
    bounded, even where the bound spares no group.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // ROWS_PER_PIVOT))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(count).toPandas()  # bounded by MOST_PIVOTS
    slices = max(1, -(-queries.count() // SLICE))
    pivots = spark.sparkContext.broadcast((_matrix(chosen["v"], width), chosen["id"].to_numpy(np.int64)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = pivots.value[0].astype(np.float64)
        for b in batches:
            x = _matrix(b["v"], width).astype(np.float64)
            near = np.argmin((points**2).sum(1) - 2 * (x @ points.T), axis=1) if len(points) else np.zeros(len(x), int)
            away = np.sqrt(((x - points[near]) ** 2).sum(1))
            yield b.assign(group=near, away=away)

    data = staged(vectors.mapInPandas(assign, "id long, v array<long>, group int, away double"), "voronoi")
    summary = data.groupBy("group").agg(F.count("*").alias("rows"), F.max("away").alias("radius"))  # one row per pivot
    found = {r["group"]: (r["rows"], r["radius"]) for r in summary.collect()}
    radius = np.array([found.get(g, (0, -1.0))[1] for g in range(len(chosen))])
    blocks = np.array([-(-found.get(g, (0, 0))[0] // BLOCK) for g in range(len(chosen))], np.int64)
    bounds = spark.sparkContext.broadcast((radius, blocks))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (points, ids), (radius, blocks) = pivots.value, bounds.value
        for b in batches:
            for i in range(0, len(b), 256):
                some = b.iloc[i : i + 256]
                q = _matrix(some["v"], width)
                score = _products(q, points)
                # The k-th best of some rows is at most the k-th best of all.
                rows = np.where(some["id"].to_numpy(np.int64)[:, None] == ids, np.iinfo(np.int64).min, score)
                least = np.sort(rows, axis=1)[:, -k] if rows.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                most = score + length[:, None] * radius * (1 + 1e-9) + 1
                one, group = np.nonzero((most >= least[:, None]) & (radius >= 0))
                times = blocks[group]
                at = np.repeat(np.arange(len(one)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                who = one[at]
                yield pd.DataFrame({"group": group[at], "block": block, "id": some["id"].to_numpy()[who], "least": least[who], "v": some["v"].to_numpy()[who]})

    to_slice = F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int").alias("slice")
    sent = queries.mapInPandas(send, "group int, block int, id long, least long, v array<long>").select("*", to_slice)
    sizes = spark.createDataFrame([(g, int(x)) for g, x in enumerate(blocks)], "group int, blocks int")
    held = data.join(F.broadcast(sizes), "group").select("group", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"), "id", "v")
    # Asked blocks only: a block goes to the slices that have queries for it.
    if slices == 1:
        held = held.withColumn("slice", F.lit(0))
    else:
        sent = staged(sent, "asked")
        wanted = sent.select("group", "block", F.col("slice").alias("to")).distinct()
        held = held.join(wanted, ["group", "block"]).select("group", "block", "id", "v", F.col("to").alias("slice"))

    def solve(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("id")
        x, ids = _matrix(rows["v"], width), rows["id"].to_numpy(np.int64)
        for i in range(0, len(asked), 1024):
            some = asked.iloc[i : i + 1024]
            score, own = _products(_matrix(some["v"], width), x), some["id"].to_numpy(np.int64)
            may = (score >= some["least"].to_numpy(np.int64)[:, None]) & (ids != own[:, None])
            for q in np.flatnonzero(may.any(1)).tolist():
                at = np.flatnonzero(may[q])
                best = at[np.argsort(-score[q, at], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": own[q], "vec_id": ids[best], "score": score[q, best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    local = held.groupBy("group", "block", "slice").cogroup(sent.groupBy("group", "block", "slice")).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf):
    vectors = whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return top_products(vectors, vectors.where("id % 100 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

QUERIES = {"op9_exact_top_k": op9_exact_top_k}
ORACLES = {"op9_exact_top_k": ORACLE}
