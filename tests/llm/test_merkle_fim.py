import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from differential import connect, normal
from pyspark.sql import functions as F

from docloom.llm import ORACLES, QUERIES, fim, merkle

FOLDER = "/root/testdata/sf0.001"
BIG = 9_007_199_254_740_993  # the first integer that a double cannot hold


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fields=merkle.FIELDS):
    """(key, leaf, subroot, root, siblings) of dict rows, in any order."""

    def leaf(r):
        return sha(*["-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in fields])

    def climb(nodes):
        """The last node and the siblings of every first one."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(paths):
                low = at[i] // 16 * 16
                p.append((nodes[low : at[i]], nodes[at[i] + 1 : low + 16]))
                at[i] //= 16
            nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        tops[g] = climb([x[0] for x in groups[g]])
    if not order:
        return []
    root, upper = climb([tops[g][0] for g in order])
    return [
        (r["doc_id"], digest, tops[g][0], root, tuple("".join(a + b) for a, b in tops[g][1][i] + upper[k]))
        for k, g in enumerate(order)
        for i, (digest, r) in enumerate(groups[g])
    ]


def manifest_rows(df):
    joined = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    out = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", joined.alias("s"), merkle.fold(F.col("leaf"), F.col("path")).alias("again"))
    found = []
    for r in out.collect():
        assert r["again"] == r["root"]
        found.append((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["s"])))
    return found


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 256, 3), (300, 5, 1, 1)])
def test_manifest_against_brute_force(spark, sizes):
    draw = random.Random(sum(sizes))
    rows = []
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((draw.choice([None, draw.randint(-50, 400), BIG + draw.randint(0, 3)]), [None, "ä", "b", ""][g], draw.choice([None, "en"]), draw.choice([None, 7]), draw.choice([None, "", "x\ny", "Ünï"])))
    draw.shuffle(rows)
    names = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, names).withColumn("pos", F.lit("mine")).withColumn("grp", F.lit("mine")).withColumn("leaf", F.lit(1)).repartition(5)
    assert ordered(manifest_rows(df)) == ordered(brute_manifest([dict(zip(merkle.FIELDS, (r[0], r[1], r[2], r[3], r[4]), strict=True)) for r in rows]))


def test_manifest_of_odd_rows(spark, documents, nothing):
    rows = [r.asDict() for r in documents.collect()]
    assert ordered(manifest_rows(documents)) == ordered(brute_manifest(rows))
    assert merkle.manifest(nothing).collect() == []


def test_changed_text_is_found(spark, documents):
    claimed = merkle.leaf_digest(*[F.concat("text", F.lit("!")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    for r in merkle.manifest(documents, claimed=claimed).select("claimed", "leaf", "root", merkle.fold(F.col("claimed"), F.col("path")).alias("again")).collect():
        assert (r["again"] == r["root"]) == (r["claimed"] == r["leaf"])


@pytest.mark.parametrize("text", ["0", "7", "123456789", "-5", "9007199254740993"])
def test_crc32_in_sql(text):
    import duckdb

    assert duckdb.sql("select " + merkle.crc32_sql(f"'{text}'")).fetchall()[0][0] == zlib.crc32(text.encode())


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_in_middle"])
def test_queries_against_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(ORACLES[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([c[0] for c in cursor.description], cursor.fetchall())


def brute_fim(key, text, rate=100, suffix_first=50, seed=7, sentinels=fim.SENTINELS):
    text, (p, s, m) = text or "", sentinels
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return (key, len(units), "plain", None, None, text)
    if h[3] % 100 < suffix_first:
        return (key, len(units), "spm", len(a), len(b), f"{s}{c}{p}{a}{m}{b}")
    return (key, len(units), "psm", len(a), len(b), f"{p}{a}{s}{c}{m}{b}")


@pytest.mark.parametrize("slice_bytes, options", [(4 << 20, {}), (64, {}), (1000, {"rate": 60, "suffix_first": 20, "seed": 3, "sentinels": ("<|p|>", "<|s|>", "<|m|>")})])
def test_fim_against_plain_version(spark, documents, nothing, monkeypatch, slice_bytes, options):
    monkeypatch.setattr(fim, "SLICE_BYTES", slice_bytes)
    draw = random.Random(5)
    alphabet = ["\n", "\n\n", "a", "é", "日本", "\U0001f600", "\u008a", "\x0b", "�", "<", "<P", "S>", "word "]
    more = [(1000 + k, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))) for k in range(150)]
    more += [(BIG, "a\nb<P>\nc"), (BIG + 1, "x\ny\nz"), (None, "null\nkey"), (None, None), (5000, "\n"), (5001, "end<S")]
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + more
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("mine")).withColumn("mine", F.lit(BIG))
    out = fim.fill_in_middle(df, **options)
    again = out.withColumn("again", fim.restore(F.col("output"), F.col("form"), options.get("sentinels", fim.SENTINELS))).collect()
    made = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in again]
    assert ordered(made) == ordered([brute_fim(k, t, **options) for k, t in rows])
    assert sorted(r["again"] for r in again) == sorted(t or "" for _, t in rows)
    assert all(r["mine"] == BIG for r in again)
    assert fim.fill_in_middle(nothing).collect() == []
    kept = fim.fill_in_middle(documents)
    assert kept.columns == [*[c for c in documents.columns if c != "text"], "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["score"] for r in kept.collect()} == {"taken"}


def test_marks_on_all_bytes():
    data = np.random.default_rng(1).integers(0, 256, 8 * 500, dtype=np.uint8)
    data[:300] = 10
    words = np.append(data, np.zeros(8, np.uint8)).view(np.uint64)
    for marks, true in ((fim.line_ends(words), data == 10), (fim.continuations(words), (data & 0xC0) == 0x80)):
        held = fim.Marks(marks)
        places = np.flatnonzero(true)
        assert (held.select(np.arange(len(places))) == places).all()
        every = np.arange(len(data) + 1)
        assert (held.rank(every) == np.concatenate([[0], np.cumsum(true)])).all()
