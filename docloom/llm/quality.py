"""Quality scores by averaged vectors of hashed words and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import keep_columns, map_texts, ship_package
from docloom.llm.words import PIECE, mix, run_hashes

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)  # characters (bytes of UTF-8)
SAMPLE = 2_000  # labelled documents used for training at most
DIMENSIONS, EPOCHS, RATE, SEED = 16, 5, 1.0, 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _features(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, another place, bucket) of all features of a buffer: words between blanks, pairs of neighbouring words, and character
    n-grams that do not reach over a blank (one at either end marks the border of a word). The buffer begins and ends
    with a blank."""
    data = np.frombuffer(raw, np.uint8)
    blank = _SPACE[data]
    if blank.all():
        return
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    words = run_hashes(np.where(blank, 0, data)[starts[0] :], starts - starts[0])
    yield starts, starts, (words % np.uint64(BUCKETS)).astype(np.int32)
    pairs = mix(words[:-1] * np.uint64(31) + words[1:])
    pairs[words[:-1] == words[1:]] = 1  # a word said twice is one feature, whatever the word
    yield starts[:-1], starts[1:], (pairs % np.uint64(BUCKETS)).astype(np.int32)
    values = np.where(blank, 32, data).astype(np.uint32) + np.uint32(1)
    blanks = np.cumsum(blank, dtype=np.int32)
    for n in NGRAMS:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        h = np.full(last, n, np.uint32)
        for k in range(n):
            h = h + values[k : k + last] * _FACTORS[k]
        whole = blanks[n - 2 : n - 2 + last] == blanks[:last]  # no blank inside
        place = np.flatnonzero(whole)
        h = h[place]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = place + 1  # the second character is never a blank
        yield inside, inside, (h >> np.uint32(14)).astype(np.int32)


def _buffers(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Texts joined by two line breaks, a few MB at a time: first, last + 1, bytes, beginning of each. Between two texts
    stand two blanks; only pairs of words reach over them."""
    i = 0
    while i < len(texts):
        parts, size, j = [b"\n"], 1, i
        begins = []
        while j < len(texts) and (not begins or size < PIECE):
            begins.append(size)
            part = (texts[j] or "").encode("utf-8", "surrogatepass") + b"\n\n"
            parts.append(part)
            size += len(part)
            j += 1
        yield i, j, b"".join(parts), np.array([*begins, size], np.int64)
        i = j


def _placed(raw: bytes, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features; a pair of words belongs to the text of both."""
    for first, last, bucket in _features(raw):
        owner = np.searchsorted(begins, first, "right") - 1
        if last is not first:
            same = owner == np.searchsorted(begins, last, "right") - 1
            owner, bucket = owner[same], bucket[same]
        yield owner, bucket


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each whole text and how often each occurs."""
    for i, j, raw, begins in _buffers(texts):
        found = list(_placed(raw, begins))
        if not found:
            yield from ((np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in range(j - i))
            continue
        owner, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, times = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(j - i + 1) * BUCKETS)
        for d in range(j - i):
            yield (keys[bounds[d] : bounds[d + 1]] % BUCKETS).astype(np.int32), times[bounds[d] : bounds[d + 1]].astype(np.int32)


class Model:
    """Vectors of the buckets, averaged over a document, and a softmax layer for the classes 0 and 1."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        # Averaging and the layer are linear, so one number per bucket is all that scoring needs.
        self.pull = (vectors @ (output[1] - output[0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, raw, begins in _buffers(texts):
            total, count = np.zeros(j - i), np.zeros(j - i)
            for owner, bucket in _placed(raw, begins):
                total += np.bincount(owner, self.pull[bucket], j - i)
                count += np.bincount(owner, minlength=j - i)
            out[i:j] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Stochastic gradient descent, one document at a time, with a rate that falls to zero. Without examples every score is
    0.5; with one class the score is near that class."""
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(examples), 0
    shares = [(n / max(1, n.sum())).astype(np.float32) for _, n, _ in examples]
    for _ in range(EPOCHS):
        for k in draw.permutation(len(examples)).tolist():
            ids, _, label = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = shares[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            logits = output @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = wrong @ output
            output -= rate * np.outer(wrong, hidden)
            bias -= 0.05 * rate * wrong
            if len(ids):
                # Unlike words of one text, words that stand in many texts get many small steps.
                vectors[ids] -= (rate * np.sqrt(len(ids))) * share[:, None] * back
    return Model(vectors, output, bias)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out: those whose keys have the smallest hashes.
    Keys with contradicting labels, null labels and null keys are left out. Only distinct buckets and their counts reach the
    driver, at most ``sample`` rows."""
    ship_package(docs.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    chosen = marks.where("low = high").select(F.col(key).alias("id"), F.col("low").cast("int").alias("label")).where("id is not null")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(bags([t if isinstance(t, str) else None for t in b["text"]]))
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "ids": [x.astype("<i4").tobytes() for x, _ in found], "n": [x.astype("<i4").tobytes() for _, x in found]})

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").withColumn("id", F.col("id").cast("string"))
    counted = texts.mapInPandas(count, "id string, label int, ids binary, n binary")
    rows = counted.groupBy("id").agg(F.min(F.struct("label", "ids", "n")).alias("r")).select("id", "r.*").toLocalIterator()
    # One partition after the other, so that the driver never holds the rows twice.
    found = sorted(((r["id"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["n"], "<i4"), r["label"]) for r in rows), key=lambda r: r[0])
    return train([r[1:] for r in found])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, the share given to class 1. Only the text counts. A null text is empty; an empty one
    gets the score of the bias alone. An input column score is replaced."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    return map_texts(docs, lambda texts: {"score": shared.value.scores(texts)}, "score double", keep_columns(docs, ["score"]), text)


def score_ids(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` only; the texts stay in the tasks."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.select(key, text), lambda texts: {"score": shared.value.scores(texts)}, "score double", [key], text)


def op6_quality_classifier(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_ids(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES = {}
