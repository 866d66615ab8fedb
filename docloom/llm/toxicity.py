"""Toxicity by weak supervision: voters, a generative model of their votes, a linear classifier of its posterior labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.quality import held_out
from docloom.llm.store import keep_columns, map_texts, ship_package, staged
from docloom.llm.words import blocks, lowered, mix, word_hashes

SAMPLE = 4_000  # labelled documents read for lexicons and for training at most, half of each class where there are enough
STEMS = (4, 5, 6, 7, 8, 9)  # bytes at the beginning of longer words
LEAST_EVIDENCE = 20.0  # likelihood ratio statistic from which a word or stem enters a lexicon
RATIOS = (25.0, 100.0)  # and how many times more often it must stand in toxic documents: for the broad lists, for the sure ones
ENTRIES = 1024  # words and stems learned at most
LISTS = 8  # lexicons of each kind: broad and sure ones, of words and of stems
SEVERAL = (2, 4)  # entries met, for the voters that count
CORRELATED = 0.1  # correlation within the classes from which two voters count as dependent
LEAST_RATE = 1e-4  # no voter is taken to be right more surely
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 64, 0.5, 1e-4, 11

# Common insults, and words of address.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "fool", "jerk", "imbecile",
    "bastard", "bitch", "asshole", "retard", "filthy", "vermin", "freak", "creep", "coward", "ugly", "useless", "cretin", "dimwit",
    "dumm", "dummkopf", "arschloch", "abschaum", "trottel", "vollidiot", "schlampe", "hurensohn", "widerlich", "wertlos",
    "imbécile", "crétin", "connard", "salope", "ordure", "débile", "dégoûtant", "minable",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "cabrón", "inútil",
)
ADDRESS = ("you", "your", "youre", "du", "ihr", "dein", "tu", "vous", "toi", "usted", "eres")
HAND_LISTS = 4
PATTERNS = ("shouting", "exclamations", "masked", "address")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stems(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...] = STEMS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which words are longer, hash of their first bytes)."""
    h, power, done, size = np.zeros(len(starts), np.uint64), np.uint64(1), 0, ends - starts
    for n in lengths:
        which = np.flatnonzero(size > n)
        starts, size, h = starts[which], size[which], h[which]
        back = which if done == 0 else back[which]
        for k in range(done, n):
            h = h + low[starts + k] * power
            with np.errstate(over="ignore"):
                power = power * _STEP
        done = n
        yield n, back, mix(h + np.uint64(n))


def _stem_hash(stem: bytes) -> np.uint64:
    data = np.frombuffer(stem + b"-", np.uint8)
    return next(h[0] for n, _, h in _stems(data, np.zeros(1, np.int64), np.array([len(data)]), (len(stem),)))


class Lexicon:
    """Words and stems, found in texts by their hashes."""

    def __init__(self, words: list[str], stems: list[bytes]):
        self.size = len(words) + len(stems)
        hashes = np.concatenate([word_hashes(words), np.array([_stem_hash(s) for s in stems], np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.keys, self.entry = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.keys & np.uint64(0xFFFF)] = True
        self.you, self.insults = np.sort(word_hashes(list(ADDRESS))), np.sort(word_hashes(list(INSULTS)))

    def _met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are entries, the entry of each)."""
        which = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.keys, hashes[which]), self.size - 1)
        good = self.keys[at] == hashes[which]
        return which[good], self.entry[at[good]]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some texts at a time: first, last + 1, the distinct (text, entry) met, and which patterns each text has."""
        for i, j, raw, begins, first, starts, ends, words in blocks(texts):
            n, found = j - i, []
            owner = np.repeat(np.arange(n), np.diff(first))
            if self.size and len(words):
                which, entry = self._met(words)
                found.append(owner[which] * self.size + entry)
                for _, longer, hashes in _stems(lowered(raw), starts, ends):
                    which, entry = self._met(hashes)
                    found.append(owner[longer[which]] * self.size + entry)
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield i, j, pairs // max(1, self.size), pairs % max(1, self.size), self._patterns(np.frombuffer(raw, np.uint8), begins, owner, starts, ends, words, n)

    def _patterns(self, data, begins, owner, starts, ends, words, n) -> np.ndarray:
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int32)])
        loud = (upper[ends] - upper[starts] == ends - starts) & (ends - starts >= 4)
        marks = np.flatnonzero((data[1:] == 33) & (data[:-1] == 33))
        letter = (data | 32) - 97 < 26
        sign = np.isin(data[1:-1], [35, 36, 42, 64]) & letter[:-2] & letter[2:] if len(data) > 2 else np.zeros(0, bool)
        of = lambda places: np.searchsorted(begins, places, "right") - 1
        you, insult = np.isin(words, self.you), np.isin(words, self.insults)
        near = np.zeros(len(words), bool)
        for k in (1, 2, 3):
            near[k:] |= insult[k:] & you[:-k] & (owner[k:] == owner[:-k])
        counts = [np.bincount(x, minlength=n) for x in (owner[loud], of(marks), of(np.flatnonzero(sign) + 1), owner[near])]
        return np.stack([counts[0] >= 3, counts[1] >= 2, counts[2] >= 1, counts[3] >= 1], 1)


def _voters(kinds: list[int]) -> np.ndarray:
    """The lexicon of each entry: hand-written words first, then learned entries, those of a kind dealt out in turn."""
    hand, kinds = np.arange(len(INSULTS)) % HAND_LISTS, np.array(kinds, np.int64)
    turn = np.zeros(len(kinds), np.int64)
    for k in range(4):
        turn[kinds == k] = np.arange((kinds == k).sum())
    return np.concatenate([hand, HAND_LISTS + kinds * LISTS + turn % LISTS])


N_VOTERS = HAND_LISTS + 4 * LISTS + len(SEVERAL) + len(PATTERNS)


def _votes(n: int, doc: np.ndarray, entry: np.ndarray, patterns: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Which voters call each of ``n`` texts toxic; the others abstain."""
    votes = np.zeros((n, N_VOTERS), bool)
    votes[doc, lists[entry]] = True
    met, base = np.bincount(doc, minlength=n), HAND_LISTS + 4 * LISTS
    for k, least in enumerate(SEVERAL):
        votes[:, base + k] = met >= least
    votes[:, base + len(SEVERAL) :] = patterns
    return votes


@dataclass
class LabelModel:
    """How often each voter fires on toxic and on other documents, and which voters depend on each other.

    Given the class, the covariance of two independent voters is the product of what the class does to each, so the
    covariances of all pairs are a matrix of rank one where the voters are independent. It is fitted to the pairs that
    agree with it; what remains beyond ``CORRELATED`` is dependence. Of voters that say the same, each counts less.
    """

    toxic: np.ndarray
    other: np.ndarray
    correlations: np.ndarray
    shares: np.ndarray
    prior: float
    silence: float

    @staticmethod
    def fit(together: np.ndarray, silent: int, n: int, prior: float) -> LabelModel:
        """``together`` holds in how many of ``n`` documents each two voters fire (on the diagonal: each one), ``silent`` is the
        number of documents without any vote."""
        size, n = len(together), max(1, n)
        mean = np.diag(together) / n
        cov = together / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        free, scale = ~np.eye(size, dtype=bool), prior * (1 - prior)
        pull = spread.copy()
        for _ in range(6):
            for _ in range(60):
                weight = (free * pull[None, :] ** 2).sum(1)
                new = np.clip((free * cov * pull[None, :]).sum(1) / np.maximum(scale * weight, 1e-15), 0, 1)
                pull = 0.5 * pull + 0.5 * np.minimum(new, np.minimum(mean / prior, 1))
            rest = (cov - scale * np.outer(pull, pull)) / np.outer(spread, spread)
            np.fill_diagonal(rest, 0)
            # A voter stays tied to the half that fits it best.
            limit = np.maximum(CORRELATED, np.median(np.abs(rest), axis=1))
            free = (np.abs(rest) <= np.maximum(limit[:, None], limit[None, :])) & ~np.eye(size, dtype=bool)
        toxic = np.clip(mean + (1 - prior) * pull, LEAST_RATE, 1 - LEAST_RATE)
        other = np.clip(mean - prior * pull, LEAST_RATE, 1 - LEAST_RATE)
        linked = np.where(rest > CORRELATED, np.minimum(rest, 1), 0)
        shares = 1 / (1 + linked.sum(1))
        quiet = np.exp((shares * np.log1p(-other)).sum())
        missed = np.clip((silent / n - (1 - prior) * quiet) / prior, 0.01, 1)
        return LabelModel(toxic, other, rest, shares, prior, float(np.log(missed / max(quiet, 1e-9))))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that documents with these votes are toxic. Abstaining says nothing, unless all voters do."""
        gain = self.shares * np.log(self.toxic / self.other)
        total = np.log(self.prior / (1 - self.prior)) + votes @ gain + np.where(votes.any(1), 0, self.silence)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


@dataclass
class ToxicityModel:
    words: list[str]
    stems: list[bytes]
    weights: np.ndarray  # of the entries, then of the patterns
    bias: float
    labels: LabelModel | None = None

    def scorer(self):
        lexicon = Lexicon([*INSULTS, *self.words], self.stems)

        def score(texts: list[str | None]) -> dict[str, np.ndarray]:
            out = np.full(len(texts), self.bias)
            for i, j, doc, entry, patterns in lexicon.scan(texts):
                out[i:j] += np.bincount(doc, self.weights[entry], j - i) + patterns @ self.weights[lexicon.size :]
            return {"score": 1 / (1 + np.exp(-np.clip(out, -500, 500)))}

        return score


def _learn_entries(sample: DataFrame) -> tuple[list[str], list[bytes], list[int]]:
    """Words and stems that stand in toxic documents of the sample far more often than in others; of a stem and a longer one
    in the same documents the longer. Words, stems and the kind of list of each: 0 and 1 for words, 2 and 3 for stems, the
    odd ones where the higher ratio is reached. At most twice ``ENTRIES`` reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.array(b.column("label").to_pylist(), bool)
            for i, j, raw, _, first, starts, ends, words in blocks(b.column("text").to_pylist()):
                low, owner = lowered(raw), np.repeat(np.arange(i, j), np.diff(first))
                data = low.tobytes()
                for length, which, hashes in [(0, np.arange(len(words)), words), *_stems(low, starts, ends)]:
                    code, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                    pairs = np.unique(back * (j - i) + owner[which] - i)
                    marked = toxic[i + pairs % max(1, j - i)]
                    feature = pairs // max(1, j - i)
                    a, e = starts[which[at]], ends[which[at]]
                    names = [data[x : (x + length if length else y)] for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.binary()), pa.array(np.full(len(code), length), pa.int32()), pa.array(np.bincount(feature, marked, len(code)).astype(np.int64)), pa.array(np.bincount(feature, ~marked, len(code)).astype(np.int64))],
                        names=["name", "length", "t", "c"],
                    )

    counted = sample.mapInArrow(count, "name binary, length int, t long, c long").groupBy("name", "length").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return [], [], []
    share = toxic / (toxic + other)
    seen = F.col("t") + F.col("c")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (seen * F.lit(p)))).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), share) + part(F.col("c"), 1 - share))
    ratio = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (other + 1))
    strong = counted.withColumn("evidence", evidence).where((F.col("evidence") >= LEAST_EVIDENCE) & (ratio >= RATIOS[0])).withColumn("sure", (ratio >= RATIOS[1]).cast("int"))
    rows = strong.orderBy(F.desc("evidence"), "name", "length").limit(2 * ENTRIES).collect()
    longest: dict[tuple, bytes] = {}
    for r in rows:
        name = bytes(r["name"])
        if r["length"]:
            same = (r["t"], r["c"], name[: STEMS[0]])
            if len(name) > len(longest.get(same, b"")):
                longest[same] = name
    words = [(w, r["sure"]) for r in rows if not r["length"] and (w := bytes(r["name"]).decode("utf-8", "replace")) not in INSULTS and "\ufffd" not in w]
    listed = [w.encode() for w in INSULTS]  # their beginnings would only add other words
    stems = [(bytes(r["name"]), 2 + r["sure"]) for r in rows if r["length"] and longest[r["t"], r["c"], bytes(r["name"])[: STEMS[0]]] == bytes(r["name"])]
    stems = [(x, k) for x, k in stems if not any(w.startswith(x) for w in listed)]
    both = words[: ENTRIES // 2], stems[: ENTRIES // 2]
    return [w for w, _ in both[0]], [x for x, _ in both[1]], [k for some in both for _, k in some]


def _together(docs: DataFrame, text: str, lexicon: Lexicon, lists: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Over all documents: in how many each two voters fire, how many have no vote, and their number. A task gives one row for
    each pair of voters that it has met, so what is shuffled does not grow with its documents."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, lists))
    width = N_VOTERS * N_VOTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, lists = shared.value
        pairs, silent, n = np.zeros((N_VOTERS, N_VOTERS)), 0, 0
        for b in batches:
            for i, j, doc, entry, patterns in lexicon.scan(b.column("text").to_pylist()):
                votes = _votes(j - i, doc, entry, patterns, lists).astype(float)
                pairs += votes.T @ votes
                silent, n = silent + int((votes.sum(1) == 0).sum()), n + j - i
        cells = np.append(pairs.ravel(), [silent, n]).astype(np.int64)
        held = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(cells[held])], names=["cell", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(width + 2, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return cells[:width].reshape(N_VOTERS, N_VOTERS), int(cells[width]), int(cells[width + 1])


def _train(features: list[np.ndarray], size: int, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels by stochastic gradient descent with a step per weight."""
    draw = np.random.default_rng(SEED)
    x = np.zeros((len(features), size + 1), np.float32)
    for row, own in zip(x, features, strict=True):
        row[own] = 1
    x[:, size] = 1
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[size] = np.log(max(1e-3, (target * weight).sum()) / max(1e-3, ((1 - target) * weight).sum()))
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            p = 1 / (1 + np.exp(-np.clip(x[some] @ w, -50, 50)))
            slope = x[some].T @ ((p - target[some]) * weight[some]) / len(some)
            slope[:size] += DECAY * w[:size]
            seen += slope**2
            w -= RATE * slope / np.sqrt(seen)
    return w[:size], float(w[size])


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled documents that are not held out; null and contradicting labels and null keys are left out.

    The sample (at most ``sample`` documents, half of each class if there are as many, those whose keys have the smallest
    hashes) gives words and stems typical of toxic documents. With a hand-written list and four patterns of writing they
    make up ``N_VOTERS`` voters that call a document toxic or abstain. How often each two fire together is counted over all
    documents; from these counts and the share of toxic labels the label model takes how right each voter is and which
    depend on each other. The classifier is trained on the posterior labels of the sample, weighted back to that share.
    Only lexicon entries, pair counts and the entries met in the sample's documents reach the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key)) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    marks = marks.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("high")).where("label = high").select("id", "label")
    known = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = {k: known.get(k, 0) for k in (0, 1)}
    prior = min(max((total[1] + 1) / (total[0] + total[1] + 2), 0.01), 0.5)
    half = sample // 2
    take = {k: min(total[k], max(half, sample - total[1 - k])) for k in (0, 1)}
    chosen = None
    for k in (0, 1):
        part = marks.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(take[k])
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    held = staged(texts.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")
    words, stems, kinds = _learn_entries(held)
    lexicon, lists = Lexicon([*INSULTS, *words], stems), _voters(kinds)
    model = LabelModel.fit(*_together(docs, text, lexicon, lists), prior)
    shared = spark.sparkContext.broadcast((lexicon, lists))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, lists = shared.value
        for b in batches:
            rows = []
            for i, j, doc, entry, patterns in lexicon.scan(b.column("text").to_pylist()):
                votes = _votes(j - i, doc, entry, patterns, lists)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    own = np.concatenate([entry[bounds[d] : bounds[d + 1]], lexicon.size + np.flatnonzero(patterns[d])])
                    rows.append((own.astype("<i4").tobytes(), np.packbits(votes[d]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(b.column("id").to_pylist(), pa.string()), b.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "label", "met", "votes"])

    found = sorted(held.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(read, "id string, label int, met binary, votes binary").collect())
    size = lexicon.size + len(PATTERNS)
    if not found:
        return ToxicityModel(words, stems, np.zeros(size), float(np.log(prior / (1 - prior))), model)
    votes = np.stack([np.unpackbits(np.frombuffer(r["votes"], np.uint8))[:N_VOTERS] for r in found]).astype(float)
    drawn = {k: sum(r["label"] == k for r in found) for k in (0, 1)}
    weight = np.array([(prior if r["label"] else 1 - prior) * len(found) / drawn[r["label"]] for r in found])
    weights, bias = _train([np.frombuffer(r["met"], "<i4") for r in found], size, model.posterior(votes), weight)
    return ToxicityModel(words, stems, weights, bias, model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``kept`` columns of ``docs`` (all, unless given) and ``score``, from 0 to 1. Only the whole text counts; a null one is empty, and
    an empty one gets the score of the bias alone. Equal texts get equal scores. An input column score is replaced."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list = []  # one for each worker

    def make(texts: list[str | None]) -> dict:
        if not scorers:
            scorers.append(shared.value.scorer())
        return scorers[0](texts)

    return map_texts(docs, make, "score double", keep_columns(docs, ["score"]) if kept is None else kept, text)


def op11_toxicity(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels), kept=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLES = {}
