import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import search as se
from docloom.operators.asof import asof_backward


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_no long, text string")


def test_hit_over_a_line_break(spark):
    got = se.search(
        pages(spark, [("d", 1, "foo\nbar"), ("d", 2, "nothing"), ("d", 3, " a foo bar \nfoo bar")]),
        spark.createDataFrame([("d", 1, 0, "A"), ("d", 3, 1, "B"), ("d", 3, 2, "C"), ("d", 0, 3, "none")], "doc_id string, page_no long, seq int, title string"),
        ["foo bar", " ", "Nothing"], ignore_case=False,
    )
    assert [tuple(r) for r in se.verbose_report(got).collect()] == [("foo bar", "d", "A", 1, ""), ("foo bar", "d", "C", 3, "a foo bar foo bar")]
    assert [tuple(r) for r in se.short_report(got).collect()] == [("foo bar", "d")]


def test_nearest_heading(spark):
    outline = spark.createDataFrame([("d", 1, 0, "A"), ("d", 3, 1, "B"), ("d", 3, 2, "C")], "doc_id string, page_no long, seq int, title string")
    asked = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("e", 1)], "doc_id string, page_no long")
    got = {(r.doc_id, r.page_no): r.heading for r in se.with_heading(asked, outline, band=2).collect()}
    assert got == {("d", 1): "A", ("d", 2): "A", ("d", 3): "C", ("e", 1): ""}


@pytest.mark.parametrize("band", [1, 3, 1000])
def test_asof_against_brute_force(spark, band):
    """One key holds most rows; small bands force values to be carried over several empty bands."""
    rng = random.Random(band)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice("abc")
    left = [(key(), rng.randrange(-50, 200), i) for i in range(300)]
    right = [(key(), rng.randrange(-50, 200), i, f"v{i}") for i in range(60)]
    got = asof_backward(
        spark.createDataFrame(left, "k string, at long, id int"),
        spark.createDataFrame(right + [(None, 0, 99, "no key")], "k string, at long, seq int, v string"),
        ["k"], "at", "at", ["v"], ["seq"], band=band,
    )
    want = {}
    for k, at, i in left:
        fits = [(ra, seq, v) for rk, ra, seq, v in right if rk == k and ra <= at]
        want[i] = max(fits)[2] if fits else None
    assert {r.id: r.v for r in got.collect()} == want
    assert got.count() == len(left)


def test_term_tables_of_any_size(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [("d", i, word(rng.randrange(0, 120)) + ("\n" if i % 3 else "") + word(40)) for i in range(40)]
    terms = []
    for n in (1, 2, 3, 5, 7, 14, 15, 16, 31, 40, 63, 70):
        for _ in range(3):
            text = rng.choice(texts)[2].replace("\n", " ")
            at = rng.randrange(max(1, len(text) - n))
            terms.append(text[at : at + n])
    terms = [(i, t.upper() if i % 2 else t) for i, t in enumerate(terms) if t.strip()]
    table = spark.createDataFrame(terms, "seq int, term string")
    for ci in (False, True):
        fold = str.lower if ci else str
        want = {(p, s) for _, p, x in texts for s, t in terms if fold(t) in fold(x.replace("\n", " "))}
        for limit in (500, 0):  # with and without short terms as literals
            old, se.LITERAL_TERMS = se.LITERAL_TERMS, limit
            try:
                got = se.find_by_gram(pages(spark, texts), table, ci)
                rows = [(r.page_no, r.seq) for r in got.collect()]
            finally:
                se.LITERAL_TERMS = old
            assert len(rows) == len(set(rows)) and set(rows) == want


def test_term_table_keeps_the_bag(spark):
    file_terms = spark.createDataFrame([(0, "b"), (1, "a")], "seq int, term string")
    table = se.term_table(["a"], file_terms)
    got = se.find_terms(pages(spark, [("d", 1, "a b")]), table)
    assert sorted((r.seq, r.term) for r in got.collect()) == [(0, "a"), (1, "b"), (2, "a")]
    assert se.find_terms(pages(spark, [("d", 1, "a b")]), []).count() == 0


def test_outline_order(spark):
    outline = spark.createDataFrame(
        [("d", 2, 0, "x"), ("d", 1, 1, "y"), ("d", 0, 2, "z"), ("c", 5, 0, "w")], "doc_id string, page_no long, seq int, title string"
    )
    assert [tuple(r) for r in se.outline_list(outline).collect()] == [("c", "w"), ("d", "y"), ("d", "x")]


@pytest.mark.parametrize("text", ["", "ab", "ab\n", "\nab\n", "long line one\nab\nlong line two\n\nlong\nab\ncd", "long line\nlong line", "ab\ncd\nlong line here\n\n"])
def test_headings_in_the_text(spark, text):
    """Against a plain walk over the lines; lines of at most three characters are headings."""
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    want, last = [], ""
    for i, line in enumerate(text.split("\n"), start=1):
        last = line if len(line) <= 3 else last
        want.append((i, last, line))
    got = se.headed_line_pages(docs, r"[^\n]{0,3}").orderBy("page_no")
    assert [(r.page_no, r.heading, r.text) for r in got.collect()] == want


def test_small_scan_with_many_grams_is_not_broadcast(spark):
    """A few bytes of keys become terms whose grams are many times as large; the scan's size says nothing about them."""
    few = spark.range(40).select(F.col("id").cast("int").alias("seq"), F.concat(F.lit("no such term, nr. "), "id").alias("term"))
    text = [("d", 1, "there is no such term, nr. 7 here")]

    def plan(terms):
        found = se.find_by_gram(pages(spark, text), terms)
        return found, found._jdf.queryExecution().sparkPlan().toString()

    found, small = plan(few)
    assert sorted(r.seq for r in found.collect()) == [7] and "BroadcastHashJoin" in small
    old, se.BROADCAST_CHARS = se.BROADCAST_CHARS, 100
    try:
        found, large = plan(few)
        assert sorted(r.seq for r in found.collect()) == [7] and "BroadcastHashJoin" not in large
    finally:
        se.BROADCAST_CHARS = old
