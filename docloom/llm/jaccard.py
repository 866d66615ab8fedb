"""All pairs of documents with similar word shingles: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.llm.store import map_texts, salted_lookup, ship_package, staged
from docloom.llm.words import WORDS_SQL, blocks, mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 46, 5  # a pair at the threshold shares no band with probability (1 - 0.8^5)^46 = 1.2e-8
HASHES = BANDS * ROWS
STEP = 10  # MinHash values compared at a time
CHUNK = 1 << 15  # sets whose bands one task compares at once
TOLERANCE = 1e-9  # a pair is dropped when it reaches the threshold with a smaller probability
BLOCK = 512  # documents of one component compared in one call, against as many
SPREAD_ROWS = 500_000  # a list of keys is sent to all executors up to this length and shuffled beyond it
_DRAW = np.random.default_rng(20_240_601)
_FACTOR = _DRAW.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _DRAW.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer than five words, but not none, is one shingle."""
    for i, j, _, _, first, _, _, words in blocks(texts):
        last = max(0, len(words) - WORDS + 1)
        h = np.zeros(last, np.uint64)
        for k in range(WORDS):
            h += words[k : k + last] * _PLACE[k]
        h = mix(h)
        for d in range(j - i):
            a, n = first[d], first[d + 1] - first[d]
            if n >= WORDS:
                yield np.unique(h[a : a + n - WORDS + 1])
            elif n:
                yield mix(np.array([(words[a : a + n] * _PLACE[:n]).sum() + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[i : i + 4096, None] * _FACTOR + _SHIFT).min(0))
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def fewest_matches(n: int, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> int:
    """Matches among ``n`` MinHash values below which the similarity reaches the threshold with less than the tolerated
    probability, given nothing else (a uniform prior, so the posterior is a Beta distribution)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common shingles of the pairs."""
    if len(a) <= 16 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times[code] > 1
    column = np.cumsum(times > 1) - 1
    owner, code = owner[many], column[code[many]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, [c, c + 4096])
        holds = np.zeros((len(sets), 4096), np.float32)
        holds[owner[lo:hi], code[lo:hi] - c] = 1
        common += holds @ holds.T
    return common[a, b].astype(np.int64)


def similar_pairs(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band and reach the similarity. Where two blocks meet (sides 0 and 1), only pairs across them."""
    n = len(sets)
    bands = mix(signatures.reshape(n, BANDS, ROWS).astype(np.uint64) @ _PLACE[:ROWS])
    size = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(n), np.arange(n)) if not side.any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    meet = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        meet |= bands[left, k][:, None] == bands[right, k]
    if not side.any():
        meet = np.triu(meet, 1)
    a, b = np.nonzero(meet)
    a, b = left[a], right[b]
    fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    equal = np.zeros(len(a), np.int64)
    for done in range(0, HASHES, STEP):
        equal += (signatures[a, done : done + STEP] == signatures[b, done : done + STEP]).sum(1)
        likely = equal >= fewest_matches(done + STEP, similarity)
        a, b, equal = a[likely], b[likely], equal[likely]
    both = _intersections(sets, a, b) if len(a) else np.zeros(0, np.int64)
    good = both / np.maximum(1, size[a] + size[b] - both) >= similarity
    return a[good], b[good]


def _heads(hashed: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each row, where rows with an equal value in a column are connected."""
    a, b = [], []
    for column in hashed.T:
        order = np.argsort(column, kind="stable")
        same = np.flatnonzero(column[order[1:]] == column[order[:-1]])
        a.append(order[same])
        b.append(order[same + 1])
    return _roots(len(hashed), np.concatenate(a), np.concatenate(b))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, mark (a hash of the text), class_id, n_links, n_text_links and stays.

    A link joins two documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. n_links counts all
    other documents so linked, copies included; n_text_links those with another set, each set once. class_id is the smallest
    key among all documents that links connect; stays is true for the class's first row by key (nulls first) and mark.

    Copies (equal sets) are reduced to one first. Sets that share a band of MinHash values are candidates; they are gathered
    by the components of the graph of bands: first those within a chunk of a task, of which only one set goes on for
    each band, then across chunks. A component is dealt out in pairs of blocks of about ``BLOCK`` sets, so a
    group of any size is spread and no pair becomes a row. Within a call, pairs that share a band are compared on ``STEP`` more
    MinHash values at a time and dropped when the posterior probability of reaching the threshold falls below ``TOLERANCE``;
    the rest are verified on their shingles.

    Null texts and texts without words are in a class of their own. Equal rows get equal results; an empty table gives no
    rows. Two rows with the same key and text count as two documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bodies = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def sign(texts: list[str | None]) -> dict[str, list]:
        nodes, signatures = [], []
        for s in shingle_sets(texts):
            nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signatures.append(signature(s).tobytes() if len(s) else None)
        return {"node": nodes, "short": [int.from_bytes(n[:8], "little", signed=True) if n else 0 for n in nodes], "signature": signatures}

    signed = staged(map_texts(bodies, sign, "node binary, short long, signature binary", ["id", "mark"]), "signed")
    first = F.min(F.struct("id", "mark"))
    sets = staged(
        signed.where("node is not null").groupBy("node").agg(first.alias("first"), F.min("id").alias("low"), F.count("*").alias("copies"), F.first("short").alias("short"), F.first("signature").alias("signature")),
        "sets",
    )

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets of a chunk that bands connect get one head; each band goes on once for each head, each set once with its head."""
        held, n = [], 0
        for b in [*batches, None]:
            if b is not None and len(b):
                held.append(b)
                n += len(b)
            if n and (b is None or n >= CHUNK):
                short = np.concatenate([x["short"].to_numpy() for x in held])
                values = np.frombuffer(b"".join(s for x in held for s in x["signature"]), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
                hashed = mix((values @ _PLACE[:ROWS]) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64))
                head = _heads(hashed)
                pairs = np.unique(np.stack([hashed.ravel(), np.repeat(head, BANDS).astype(np.uint64)]), axis=1)
                yield pd.DataFrame({"band": pairs[0].view(np.int64), "a": short[pairs[1].astype(np.int64)], "member": pd.array([None] * pairs.shape[1], "Int64")})
                yield pd.DataFrame({"band": pd.array([None] * n, "Int64"), "a": short[head], "member": short})
                held, n = [], 0

    banded = staged(sets.select("short", "signature").mapInPandas(bands, "band long, a long, member long"), "banded")
    heads, banded = banded.where("member is not null").select("member", "a"), banded.where("member is null").select("band", "a")
    hubs = staged(banded.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b <> top").select("band", "b"), "bands")
    met = banded.join(F.broadcast(hubs), "band") if hubs.count() <= SPREAD_ROWS else salted_lookup(banded, hubs, ["band"], ["a"])
    linked = components(staged(met.where("a <> b").select("a", "b").distinct(), "met"))
    # A set alone in its chunk may be a head elsewhere linked; a set alone everywhere needs no comparison.
    crowded = heads.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    known = staged(crowded.join(linked, crowded["a"] == linked["node"], "full_outer").select(F.coalesce("a", "node").alias("a"), F.coalesce("label", "a").alias("label")), "heads")
    gathered = staged(salted_lookup(heads, known, ["a"], ["member"]).select(F.col("member").alias("node"), "label"), "gathered")

    sizes = gathered.groupBy("label").agg(F.count("*").alias("members"))
    total = gathered.count()
    cells = max(1, total // BLOCK)
    members = staged(
        sets.join(salted_lookup(gathered, sizes, ["label"], ["node"]).withColumnRenamed("node", "short"), "short")
        .select("node", "first", "copies", "signature", "label", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")),
        "members",
    )

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(shingles=[s.tobytes() for s in shingle_sets(b["text"].tolist())])

    wanted = members.select("first.id", "first.mark", "node", "copies", "signature", "label", "parts")
    wanted = F.broadcast(wanted) if total <= SPREAD_ROWS // 8 else wanted
    same = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.mark") == F.col("y.mark"))
    texts = bodies.alias("x").join(wanted.alias("y"), same).select("node", "copies", "signature", "label", "parts", "text")
    ready = texts.mapInPandas(shingles, "node binary, copies long, signature binary, label long, parts int, shingles binary").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = ready.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(cells))).alias("cell"),
        F.col("parts"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "node", "copies", "signature", "shingles",
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        signatures = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), HASHES)
        across = rows["i"].iloc[0] != rows["j"].iloc[0]
        a, b = similar_pairs(held, signatures, rows["side"].to_numpy() if across else np.zeros(len(rows), int))
        if across and not rows["side"].any():
            a, b = a[:0], b[:0]
        copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
        n = len(rows)
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        linked_sets = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        out = pd.DataFrame({"node": node, "root": node[_roots(n, a, b)], "links": links.astype(np.int64), "sets": linked_sets})
        return out[linked_sets > 0]

    found = staged(dealt.groupBy("cell", "parts", "i", "j").applyInPandas(compare, "node binary, root binary, links long, sets long"), "links")
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("sets").alias("n_text_links"))
    # Only sets with copies or links; all others are alone in their class.
    joined = sets.select("node", "first", "low", "copies").join(counts, "node", "left").join(classes, "node", "left").where("copies > 1 or links is not null")
    grouped = staged(joined.withColumn("label", F.coalesce("label", "node")), "grouped")
    heads = grouped.groupBy("label").agg(F.min("first").alias("head"), F.min("low").alias("class_id"))
    known = salted_lookup(grouped, heads, ["label"], ["node"]).select(
        "node", "head", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links")
    )
    joined = salted_lookup(signed.select("id", "mark", "node"), staged(known, "classes"), ["node"], ["id", "mark"], how="left")
    alone = F.col("head").isNull()
    return joined.select(
        F.col("id").alias(key),
        "mark",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        (alone | F.col("head").eqNullSafe(F.struct("id", "mark"))).alias("stays"),
    )


def op5_ngram_jaccard(spark, sf):
    return similar_documents(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_text_links")


ORACLE = """
with recursive dw as (select doc_id, {WORDS_SQL} as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from dw),
keyed as (select doc_id, s, len(s) as n, md5(array_to_string(s, chr(10))) as k from sets),
every as (select doc_id, n, k, unnest(s) as shingle from keyed),
each as (select * from every where shingle in (select shingle from every group by shingle having count(*) > 1)),
common as (
  select a.doc_id as a, b.doc_id as b, b.k <> a.k as other, b.k as k, count(*) / (a.n + b.n - count(*)) as share
  from each a join each b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n, a.k, b.k),
links as (select * from common where share >= 0.8),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a, min(b) as class_id from reach group by a),
counts as (select a, count(*) as n_links, count(distinct k) filter (other) as n_text_links from links group by a)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_text_links, 0)::bigint as n_text_links
from documents d join classes c on d.doc_id = c.a left join counts n on d.doc_id = n.a
""".replace("{WORDS_SQL}", WORDS_SQL)

QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLES = {"op5_ngram_jaccard": ORACLE}
