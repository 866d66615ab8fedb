import random
import re

import numpy as np
import pytest

from docloom.llm import decontam, knn, licenses
from docloom.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_at_any_piece_size(documents, monkeypatch):
    texts = [r.text or "" for r in documents.select("text").collect()] + ["x" * 100, "é" * 50 + "!"]
    for piece in (1 << 21, 7):
        monkeypatch.setattr("docloom.llm.words.PIECE", piece)
        for t in texts[:6] + texts[7:] if piece == 7 else texts:
            raw = t.encode()
            if piece == 7 and len(raw) > 5000:
                continue
            starts, ends, hashes = words_of(raw)
            assert [raw[a:b].decode().translate(LOWER) for a, b in zip(starts, ends, strict=True)] == words(t)
            assert len(set(zip(words(t), hashes.tolist(), strict=True))) == len(set(words(t)))


LICENSED = [
    "Released under the MIT License. MIT, license; mit license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "gnu general public", "cc by cc by-sa", "CC\nBY 4.0", "mit licenses", None, "", "apache " * 50 + "license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "permission is granted free of charge to any person obtaining a copy of this software",
]


def test_licenses_against_brute_force(spark, documents, nothing):
    docs = documents.select("doc_id", "text", "score").union(spark.createDataFrame([(500 + i, t, "taken") for i, t in enumerate(LICENSED * 2)], "doc_id long, text string, score string"))
    got = sorted(licenses.scan_licenses(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    want = []
    for r in docs.collect():
        w = words(r.text)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    by = {r.doc_id: r for r in got}
    assert by[501].labels == "apache,apache-2.0" and by[502].labels == "gpl,gpl-3.0" and by[510].labels == "mit-notice" and by[511].labels == ""
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert licenses.scan_licenses(nothing).count() == 0


def test_licence_notices_with_changed_words():
    texts = {label: [t for name, t, _ in licenses.TEMPLATES if name == label][-1] for label in ("gpl-3.0", "apache-2.0", "bsd", "mit-notice")}
    index = licenses.RareTokenIndex({w: 1000 if len(w) < 4 else 5 for w in licenses._vocabulary()}, 2000)

    def found(text):
        tokens = words(text)
        hashes = licenses.word_hashes(tokens) if tokens else np.zeros(0, np.uint64)
        return {(index.entries[k][0], int(s)) for k, _, starts, _ in index.find(hashes, np.array([0, len(tokens)])) for s in starts if k >= len(licenses.PHRASES)}

    def labels(text):
        return {label for label, _ in found(text)}

    for label, text in texts.items():
        tokens = text.split()
        assert label in labels(text) and label in labels("words before it " * 50 + text + " and after")
        assert label in labels(" ".join([tokens[0], "really", *tokens[1:]]))  # one word more moves all that follow
        assert label in labels(" ".join([tokens[0], *tokens[2:]]))
        assert labels(" ".join(sorted(tokens))) == set() and labels(" ".join(tokens[::2])) == set()
    twice = texts["bsd"] + " x" * 30 + " " + texts["bsd"]
    assert found(twice) == {("bsd", 0), ("bsd", len(words(texts["bsd"])) + 30)}
    assert labels("either version 3 of the gnu general public license") == set() and labels("") == set()
    assert labels(texts["gpl-3.0"].replace("version 3", "version 4")) == set()


def brute_windows(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for key, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        yield key, len(w), len(hit), tuple(sorted(met))


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_benchmark_against_brute_force(spark, documents, nothing, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 64)
    draw = random.Random(3)
    source = documents.where("doc_id = 7").first().text.split()
    items = [(1, " ".join(source[5:30])), (2, "Short, ITEM"), (3, None), (4, "..."), (5, " ".join(source[20:30])), (5, " ".join(source[50:70])), (None, "lonely words"), (6, "a a a a a a a a a a a")]
    texts = [(900 + i, " ".join(draw.choice([*source[5:32], "a", "a", "a", "short item", "zz"]) for _ in range(60))) for i in range(30)]
    texts += [(960, "x " + " ".join(source[5:30]) + " y " + " ".join(source[18:34])), (961, "a " * 40), (962, "short\titem lonely words"), (963, "short lonely words item")]
    docs = documents.select("doc_id", "text", "n_hit", "items").union(spark.createDataFrame([(k, t, "x", "y") for k, t in texts], "doc_id long, text string, n_hit string, items string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.find_benchmark(docs, benchmark).collect()]
    assert sorted(got, key=order) == sorted(brute_windows([(r.doc_id, r.text) for r in docs.collect()], items), key=order)
    cleaned = decontam.find_benchmark(docs, benchmark, clean=True)
    assert set(cleaned.columns) == set(docs.columns)
    after = cleaned.collect()
    assert all(n == 0 for _, _, n, _ in brute_windows([(r.doc_id, r.text) for r in after], items))
    before = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in before for r in after if r.n_hit == 0)
    assert decontam.find_benchmark(nothing, benchmark).count() == 0
    assert {r.n_hit for r in decontam.find_benchmark(docs, benchmark.limit(0)).collect()} == {0}


def test_fm_index_counts_and_locates():
    draw = np.random.default_rng(5)
    text = draw.integers(0, 4, 400)
    text[-1] = 0
    index = decontam.FMIndex(text.astype(np.int64), 3)
    patterns = draw.integers(1, 4, (50, 4)).astype(np.int64)
    lengths = draw.integers(1, 5, 50)
    which, place = index.search(patterns, lengths)
    want = {(p, i) for p in range(50) for i in range(len(text)) if i + lengths[p] <= len(text) and (text[i : i + lengths[p]] == patterns[p, : lengths[p]]).all()}
    assert set(zip(which.tolist(), place.tolist(), strict=True)) == want and len(which) == len(want)


def test_top_products_against_brute_force(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(1200)]  # one common vector
    rows += [(None, [1.0] * 6), (5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (5100, [0.5, 0.25]), (5200, []), (5300, [1e9] * 6)]
    table = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, score string")
    vectors = knn.whole_vectors(table)
    got = sorted(tuple(r) for r in knn.top_products(vectors, vectors.where("id % 100 = 0"), 10).collect())
    held = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (k for k in held if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(held[q], v, strict=False)), k) for k, v in held.items() if k != q)[:10]
        want += [(q, i, k, -s) for i, (s, k) in enumerate(best, 1)]
    assert got == sorted(want)
    few = vectors.where("id < 4")
    assert knn.top_products(few, few, 10).count() == 12
    monkeypatch.setattr(knn, "SLICE", 3)
    assert sorted(tuple(r) for r in knn.top_products(vectors, vectors.where("id % 100 = 0"), 10).collect()) == got
    assert knn.top_products(vectors.limit(0), vectors.limit(0)).count() == 0


def test_registered(spark):
    import __spark_entry__ as driver

    names = {n.split("_")[0] for n in driver.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in driver.queries()
