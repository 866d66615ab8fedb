import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import QUERIES, toxicity

BIG = 9_007_199_254_740_993
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def entries_of(text, words, stems):
    """Plain version: numbers of the entries that a text holds."""
    found = {w.encode() for w in WORD.findall((text or "").translate(LOWER))}
    return sorted([k for k, w in enumerate(words) if w.encode() in found] + [len(words) + k for k, s in enumerate(stems) if any(len(w) > len(s) and w.startswith(s) for w in found)])


def patterns_of(text):
    text = text or ""
    words = WORD.findall(text.translate(LOWER))
    raw = WORD.findall(text)
    near = any(w in toxicity.INSULTS and any(v in toxicity.ADDRESS for v in words[max(0, i - 3) : i]) for i, w in enumerate(words))
    return [
        sum(len(w) >= 4 and re.fullmatch("[A-Z]+", w) is not None for w in raw_words(text)) >= 3,
        len(re.findall("!(?=!)", text)) >= 2,
        re.search(r"[A-Za-z][#$*@](?=[A-Za-z])", text) is not None,
        near,
    ] if raw or text else [False] * 4


def raw_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def test_scan_against_plain_version(documents):
    texts = [r["text"] for r in documents.collect()] + ["You IDIOT! you!!! du bist ein ARSCHLOCH", "SHOUTING LOUD WORDS HERE", "sh#t f**k s*t", "idiots lose loser-losing", "ééééé ééé éé", ""]
    words, stems = [*toxicity.INSULTS, "éé", "one"], ["lose".encode(), "éé".encode(), "edthin"[:5].encode()]
    lexicon = toxicity.Lexicon(words, stems)
    for i, j, doc, entry, patterns in lexicon.scan(texts):
        for d in range(j - i):
            assert entry[doc == d].tolist() == entries_of(texts[i + d], words, stems)
            assert patterns[d].tolist() == patterns_of(texts[i + d])


def test_label_model_finds_rates_and_copies():
    draw = np.random.default_rng(2)
    n, prior = 60_000, 0.2
    toxic = draw.random(n) < prior
    high, low = np.array([0.6, 0.4, 0.5, 0.3, 0.7, 0.45]), np.array([0.01, 0.02, 0.05, 0.005, 0.03, 0.01])
    votes = draw.random((n, 6)) < np.where(toxic[:, None], high, low)
    copy = np.where(draw.random(n) < 0.95, votes[:, 0], draw.random(n) < 0.1)
    votes = np.column_stack([votes, copy]).astype(float)
    model = toxicity.LabelModel.fit((votes.T @ votes).astype(np.int64), int((votes.sum(1) == 0).sum()), n, prior)
    assert np.abs(model.toxic[:6] - high).max() < 0.08
    assert np.abs(model.other[:6] - low).max() < 0.03
    # The copy repeats 95 of 100 votes: what is left within the classes, over the spread of all votes, is 0.45.
    assert abs(model.correlations[0, 6] - 0.45) < 0.1 and model.shares[0] < 0.8 and model.shares[2] > 0.9


    def ranked(score):
        """How often a toxic document scores above another one, ties half."""
        values, back = np.unique(score, return_inverse=True)
        good, bad = np.bincount(back, toxic, len(values)), np.bincount(back, ~toxic, len(values))
        return (good * (np.cumsum(bad) - bad / 2)).sum() / (good.sum() * bad.sum())

    assert ranked(model.posterior(votes)) > max(0.95, *(ranked(votes[:, k]) for k in range(7)))


def test_scores(spark, documents, nothing):
    draw = np.random.default_rng(4)
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [f"w{x}" for x in draw.integers(0, 300, 40)]
        if bad:
            for x in draw.integers(0, 6, 3):
                words.insert(int(draw.integers(0, 40)), ["idiot", "scum", "zlorp", "zlorpish", "grumfel", "trash"][x])
        rows.append((BIG + k if k % 3 else k, " ".join(words)))
        marks.append((rows[-1][0], int(bad)))
    rows += [(None, "idiot scum"), (None, None), (7_000_001, ""), (7_000_002, "zlorp zlorpish")]
    marks += [(None, 1), (0, 0), (7_000_002, None), (123, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("more", F.lit(BIG)).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert "zlorp" in model.words and "w1" not in model.words
    again = toxicity.fit_toxicity(docs.repartition(7), labels)
    assert (model.words, model.stems, model.bias) == (again.words, again.stems, again.bias) and (model.weights == again.weights).all()
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "more", "score"]
    found = out.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found) == sorted((k or 0, t or "") for k, t in rows)
    assert {r["more"] for r in found} == {BIG}
    for r in found:
        plain = model.bias + model.weights[entries_of(r["text"], [*toxicity.INSULTS, *model.words], model.stems)].sum() + model.weights[-4:][patterns_of(r["text"])].sum()
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-plain)), abs=1e-9)
    truth = dict(marks)
    held = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([(r["score"] >= 0.7) == truth[r["doc_id"]] for r in held]) > 0.95
    assert toxicity.score_toxicity(nothing, model).collect() == []
    assert toxicity.score_toxicity(documents, model).count() == documents.count()


def test_no_labels(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (documents, nothing):
        model = toxicity.fit_toxicity(docs, none)
        assert model.words == [] and all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    one = spark.createDataFrame([(8, 1), (9, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, one)).collect())


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op11_toxicity"](spark, folder).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(truth[r["doc_id"]] for r in held if r["predicted"])
