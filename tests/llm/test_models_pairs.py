import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_sharding_lines import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import jaccard, quality
from docloom.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, js in links.items():
        for j in js:
            root[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], low[find(i)], len(links[i])) for i in range(len(rows))]


@pytest.mark.parametrize("block, spread", [(512, 500_000), (4, 0)])
def test_links_against_brute_force(spark, documents, nothing, monkeypatch, block, spread):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SPREAD_ROWS", spread)
    draw = random.Random(11)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    more = []
    for k in range(30):  # near copies on both sides of the threshold, and copies of them
        w = list(base)
        for _ in range(draw.randint(0, 4)):
            w[draw.randrange(len(w))] = f"q{draw.randint(0, 99)}"
        more += [(300 + k, " ".join(w))] * draw.choice([1, 1, 2])
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = jaccard.similar_documents(docs).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=order) == sorted(brute_links(rows), key=order)
    assert jaccard.similar_documents(nothing).count() == 0


def test_pruning_bound_is_the_posterior():
    draw = np.random.default_rng(1)
    for n in (12, 72):
        m = jaccard.fewest_matches(n, 0.8, 1e-3)
        for k, want in ((m, True), (m - 1, False)):
            share = (draw.beta(k + 1, n - k + 1, 2_000_000) >= 0.8).mean()
            assert (share >= 1e-3) == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (60, 50)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 60: 50, 50: 50}
    assert components(edges.limit(0)).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    draw = random.Random(2)
    good = lambda: " ".join(draw.choice(["the", "river", "runs", "over", "stones", "and", "sleeps"]) for _ in range(40))
    bad = lambda: draw.choice([lambda: good().upper().replace(" ", "!! "), lambda: (draw.choice("abcdefg") * 3 + " ") * 40])()
    rows = [(k, good() if k % 4 else bad(), int(k % 4 > 0)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "taken") for k, t, _ in rows] + [(None, None, ""), (9001, "", ""), (9001, "", "")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int"), {k: y for k, _, y in rows}


def test_quality_on_held_out_documents(spark, marked, monkeypatch):
    import zlib

    monkeypatch.setattr(quality, "SAMPLE", 300)
    docs, labels, truth = marked
    model = quality.fit(docs, labels, sample=300)
    scored = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored if r.doc_id is not None)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r.score for r in quality.score_ids(docs, model).collect()}
    assert all(by_id[r.doc_id] == r.score for r in scored)
    # Other texts in the batch do not change a score.
    texts = [r.text for r in docs.limit(50).collect()]
    assert np.allclose([model.scores([t])[0] for t in texts], model.scores(texts), atol=1e-6)


def test_labels_of_held_out_documents_do_not_count(spark, marked):
    docs, labels, _ = marked
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, sample=60), quality.fit(docs, turned, sample=60)
    assert (a.pull == b.pull).all() and a.bias == b.bias


def test_few_labels(spark, marked):
    docs, labels, _ = marked
    assert set(quality.fit(docs, labels.limit(0)).scores(["a b", None])) == {0.5}
    assert quality.fit(docs, labels.where("quality = 1"), sample=50).scores(["the river"])[0] > 0.5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_every_stage_on_awkward_rows(spark, documents, nothing, marked, tmp_path):
    _, labels, _ = marked
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    passage = documents.where("doc_id = 7").first().text[:120]
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (documents, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            if start is nothing:
                assert out.count() == 0
            docs = start  # each stage sees all the awkward rows


def test_pipeline(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, source).collect()
    kept = {r.doc_id for r in out}
    assert 0 < len(kept) < 200
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    dropped_good = [k for k, y in labels.items() if y == 1 and k not in kept]
    assert len(dropped_good) < 0.35 * len(labels)


def brute_lines_of(docs):
    """Documents after line dedup, by the brute-force version of the operator."""
    done = brute_lines([(k, 0, t) for k, t in docs])
    return [(k, done[k, 0][0]) for k, _ in docs if done[k, 0][1] == 0 or done[k, 0][2] < done[k, 0][1]]


def brute_cut(text, items):
    """The text without windows of benchmark items; a line break in each place, until none is left."""
    while True:
        found = list(WORD.finditer((text or "").translate(LOWER)))
        w, hit = [m.group() for m in found], []
        for item in items:
            v = words(item)
            for i in range(max(1, len(v) - 9) if v else 0):
                part = v[i : i + 10]
                hit += [(j, j + len(part)) for j in range(len(w) - len(part) + 1) if w[j : j + len(part)] == part]
        if not hit:
            return text
        spans = []
        for a, b in sorted(hit):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for a, b in reversed(spans):
            text = text[: found[a].start()] + "\n" + text[found[b - 1].end() :]


def test_pipeline_against_brute_force(spark):
    """From the classifier's choice on, every stage is redone plainly; the packing is checked for its places."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, source).select("doc_id", "text").collect()
    rest = brute_lines_of(sorted((r.doc_id, r.text) for r in good))
    classes = brute_links(rest)
    rest = [d for d, c in zip(rest, classes, strict=True) if d[0] == c[1]]
    items = [r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").select("text").collect()]
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    want = []
    for key, text in rest:
        ids = np.array([*known.encode(brute_cut(text, items) or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = corpus_pipeline.run(spark, source).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x")
    docs = spark.createDataFrame([(3, text), (2, near), (5, text), (2, near), (8, "other words"), (8, "other words"), (None, None), (9, None), (9, "")], "doc_id long, text string")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (2, near), (8, "other words"), (9, ""), (9, "")]
