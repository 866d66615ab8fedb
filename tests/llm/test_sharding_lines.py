from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import lines, sharding, store


@pytest.fixture(scope="module")
def written(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    documents.write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def _shuffled(df, **options):
    known = df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__row"))
    return sharding.shuffle_into_shards(known, F.col("__row"), **options)


def test_shards_hold_every_row_in_gapless_slots(written):
    for size in (1 << 24, 200):  # one bucket in a shard, and many
        out = _shuffled(written, shards=3, bucket_bytes=size)
        rows = out.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in written.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_key = defaultdict(set)
        for r in rows:
            by_key[r.doc_id].add((r.shard, r.grown_shard))
            assert r.grown_shard in (r.shard, 3)
        assert all(len(v) == 1 for v in by_key.values())
        assert out.columns.count("shard") == 1
        again = _shuffled(written, shards=3, bucket_bytes=size).collect()
        assert {(r.doc_id, r.text, r.shard, r.slot) for r in again} == {(r.doc_id, r.text, r.shard, r.slot) for r in rows}


def test_slots_are_not_in_key_order_and_shards_are_even(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(8000).selectExpr("id as doc_id", "'t' as text").write.parquet(path)
    rows = _shuffled(spark.read.parquet(path), shards=8).collect()
    counts = defaultdict(int)
    for r in rows:
        counts[r.shard] += 1
    assert min(counts.values()) > 850 and max(counts.values()) < 1150
    first = [r.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    ordered = sum(a < b for a, b in zip(first, first[1:], strict=False)) / len(first)
    assert 0.4 < ordered < 0.6
    assert sum(r.grown_shard == 8 for r in rows) == pytest.approx(8000 / 9, rel=0.15)


def test_one_key_with_most_rows_is_spread_over_many_buckets(spark, tmp_path):
    spark.range(4000).selectExpr("if(id % 4 = 0, id, null) as doc_id", "repeat('t', 50) as text").write.parquet(str(tmp_path / "d"))
    out = _shuffled(spark.read.parquet(str(tmp_path / "d")), shards=4, bucket_bytes=5_000)
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 400  # two buckets of about 100 rows each
    back = sharding.write_shards(out, str(tmp_path / "s"))
    assert back.columns == out.columns and sorted(map(str, back.collect())) == sorted(map(str, out.collect()))
    stored = back.select("slot", "shard", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    assert all(a.slot < b.slot for a, b in zip(stored, stored[1:], strict=False) if a.f == b.f)


def test_no_rows(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "e"))
    assert _shuffled(spark.read.schema(nothing.schema).parquet(str(tmp_path / "e"))).count() == 0
    assert lines.dedupe_lines(nothing).count() == 0


def _edit_one(a, b):
    """Word edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= 1


def brute_lines(docs):
    """Every line against every earlier one."""
    import re

    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = [], {}
    for key, mark, text in rows:
        if (key, mark) in out:
            continue
        if text is None or not re.search(r"[^ \t\r\n]", text):
            out[key, mark] = (text, 0, 0)
            continue
        kept, n, own = [], 0, []
        for piece in re.split(r"\n(?=[ \t\r]*[^ \t\r\n])", text):
            words = tuple(w for w in re.split(r"[ \t\r\n]+", piece) if w)
            if not words:
                continue
            n += 1
            if not any(words == s or (max(len(words), len(s)) >= 5 and abs(len(words) - len(s)) < 2 and _edit_one(words, s)) for s in seen):
                kept.append(piece)
            own.append(words)
            seen.append(words)
        out[key, mark] = ("\n".join(kept), n, n - len(kept))
    return out


@pytest.mark.parametrize("spread", [500_000, 0])
def test_lines_against_brute_force(spark, documents, monkeypatch, spread):
    monkeypatch.setattr(lines, "SPREAD_ROWS", spread)
    base = "a b c d e f g h"
    more = [(100 + i, t) for i, t in enumerate([base, "x " + base, base + " y", "a b c Z e f g h", "a b c Z e f Q h", "a b c d e", "a b c d", "a b c", "a b", "p q r s", "p q r s t", "p q r t", "b c d e f g h", "a a a a a", "a a a a", "w\n" + base + "\n\nnew line here", "u v w x y z\nu v w x y z", "u v w x z"])]
    small = documents.where("doc_id is null or doc_id <> 4").select("doc_id", "text", "n_lines").union(spark.createDataFrame([(k, t, "taken") for k, t in more], "doc_id long, text string, n_lines string"))
    marked = [(r.doc_id, r.mark, r.text) for r in small.select("doc_id", F.xxhash64("text").alias("mark"), "text").collect()]
    want = brute_lines(marked)
    got = lines.dedupe_lines(small).collect()
    assert len(got) == len(marked)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.n_lines, r.n_removed) for r in got) == sorted(
        ((k is None, k or 0), want[k, m][0] or "", *want[k, m][1:]) for k, m, _ in marked
    )


def test_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w77 ", "")), (3, long.replace("w2990", "q").replace("w5 ", ""))], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in lines.dedupe_lines(docs).orderBy("doc_id").collect()] == [(1, 0), (2, 1), (3, 0)]


def test_repeated_lookups_are_not_sent_through_the_driver(spark, tmp_path):
    spark.range(30_000).selectExpr("xxhash64(id) as k", "id as v").write.parquet(str(tmp_path / "k"))
    lookup = spark.read.parquet(str(tmp_path / "k"))  # 16 times as many rows are joined, in a table that Spark takes to be as small
    rows = spark.range(60_000).selectExpr("xxhash64(id) as k", "id")
    joined = store.salted_lookup(rows, lookup, ["k"], ["id"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 30_000 and joined.where("id = v").count() == 30_000


@pytest.mark.parametrize("bits", [1 << 26, 1 << 13])
def test_long_lists_of_keys(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(store, "MOST_BITS", bits)
    spark.range(3_000).selectExpr("nullif(id, 5) * 7 as id", "xxhash64(id) as mark").write.parquet(str(tmp_path / "k"))
    keys = spark.read.parquet(str(tmp_path / "k"))
    rows = spark.range(40_000).selectExpr("nullif(id, 5) * 7 as id", "xxhash64(if(id < 9000, id, -id)) as mark", "id as n").union(spark.range(2).selectExpr("null", "xxhash64(id)", "id"))
    want = sorted([*range(3_000)])
    for most in (0, 2_999, 3_000):
        held = store.among(rows, keys, ["id", "mark"], most, nullable=["id"])
        assert held.columns == ["id", "mark", "n"] and sorted(r.n for r in held.collect()) == want
        assert sorted(r.n for r in store.among(rows.where("n <> 5"), keys.select("mark"), ["mark"], most, ["n"]).collect()) == sorted([*[n for n in want if n != 5], 0, 1])
    few = store.may_hold(rows, keys, 3_000, ["id", "mark"]).count()
    assert 3_000 <= few < (6_000 if bits > 1 << 20 else 20_000)


def test_no_long_list_is_sent_whole(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(lines, "SPREAD_ROWS", 100)
    monkeypatch.setattr(lines, "among", lambda df, keys, on, most, *a, **b: sent.append((on, keys.count(), most)) or store.among(df, keys, on, most, *a, **b))
    text = "concat_ws('\n', concat_ws(' ', 'a', id, 'b', id + 1, 'c', id + 2), concat_ws(' ', 'x', id - 1, 'b', id, 'c', id + 1), 'same line for all of them')"
    docs = spark.range(400).selectExpr("id as doc_id", f"{text} as text")
    got = lines.dedupe_lines(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [on for on, _, _ in sent] == [["half"], ["id", "mark"], ["v1"]] and all(n > most == 100 for _, n, most in sent)
    assert "broadcast" not in plan  # what goes is gathered with the places of all lines, not listed
    assert {(r.n_lines, r.n_removed, r.doc_id == 0) for r in got.collect()} == {(3, 0, True), (3, 2, False)}
