import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import address as ad
from docloom.functions import logs as lg
from docloom.functions import text as tx

S = F.col("s")


@pytest.mark.parametrize("given,want", [("a/b:c", "a_b_c"), ("x<>y", "x_y"), ('\\/:*?"<>|', "_"), ("plain", "plain")])
def test_safe_file_name(value, given, want):
    assert value(tx.safe_file_name(S), s=(str, given)) == want


@pytest.mark.parametrize("given,want", [("1.0", "1"), (" 2 ", "2"), ("1.0.0", "1.0"), (None, ""), ("　3.0\t", "3"), ("10.05", "10.05")])
def test_normalise_key(value, given, want):
    assert value(tx.normalise_key(S), s=(str, given)) == want


@pytest.mark.parametrize("given,want", [("tns:Foo", "Foo"), ("a:b:c", "c"), (None, ""), ("Foo", "Foo")])
def test_local_name(value, given, want):
    assert value(tx.local_name(S), s=(str, given)) == want


def test_names(value):
    assert value(tx.anchor_id("msg", S), s=(str, "a:b c.d")) == "msg_a_b_c_d"
    assert value(tx.function_name(S), s=(str, "1.2.3")) == "test_1_2_3"
    assert value(tx.keyed_path(F.lit("1"), S), s=(str, "a?b")) == "1/a_b.txt"


@pytest.mark.parametrize("prefix,want", [("URL=", "x=1"), ("METHOD=", "GET"), ("POST_DATA=", '"xxx"'), ("BODY=", "")])
def test_prefixed_value(value, prefix, want):
    text = 'URL=first\nMETHOD=GET\nPOST_DATA="xxx"\nURL=x=1\n URL=indented'
    assert value(tx.prefixed_value(S, prefix), s=(str, text)) == want


def test_snippets(value):
    assert value(tx.snippet(S), s=(str, "a" * 101)) == "a" * 97 + "..."
    assert value(tx.snippet(S), s=(str, "a" * 100)) == "a" * 100
    assert value(tx.snippet(S), s=(str, "a\nb\rc")) == "a bc"
    assert value(tx.squeeze(S), s=(str, " a \n\t b ")) == "a b"
    assert value(tx.shorten(S, 200), s=(str, "b" * 201)) == "b" * 197 + "..."


def test_matching_lines(value):
    text = "  foo here \nnothing\nmore FOO foo"
    assert value(tx.matching_lines(S, F.lit("foo")), s=(str, text)) == "foo here more FOO foo"
    assert value(tx.matching_lines(S, F.lit("FOO"), True), s=(str, text)) == "foo here more FOO foo"
    assert value(tx.matching_lines(S, F.lit("foo bar")), s=(str, "foo\nbar")) == ""


def test_lines_of_matches(value):
    text = "a X b\n\nX X\ny\nX"
    assert value(tx.match_lines(tx.cut(S, "X")), s=(str, text)) == [1, 3, 3, 5]
    assert value(tx.match_lines(tx.cut(S, "Q")), s=(str, text)) == []
    assert value(tx.match_lines(tx.cut(S, "(?s)b.*?y")), s=(str, text)) == [1]
    assert value(tx.line_at(S, "y", 10), s=(str, text)) == 13
    assert value(tx.blank_blocks(S, "(?s)b.*?y"), s=(str, text)) == "a X \n\n\n\nX"


@pytest.mark.parametrize("given", ["a &amp;&amp; b", "&lt;&#39;&#x1F389;&gt;", "&amp;lt;", "&nosuch; &", "&eacute;&copy", "plain", "", "&apos;&#146;&#x80;", "&notit; &notin;", "&ampx &fjlig; &NewLine;", "&CounterClockwiseContourIntegral;"])
def test_unescape(value, given):
    import html

    assert value(tx.unescape(S), s=(str, given)) == html.unescape(given)


def test_relative_path(value):
    assert value(tx.relative_path(S, "/data/in"), s=(str, "/data/in/x/y.jsp")) == "x/y.jsp"
    assert value(tx.relative_path(S, "/data/in"), s=(str, "/other/y.jsp")) == "/other/y.jsp"


@pytest.mark.parametrize("given", ["abc", "日本語 text", "é ｱ Ａ ①", "", "🎉x", "плюс"])
def test_display_width(value, given):
    want = sum(2 if unicodedata.east_asian_width(c) in "FWA" else 1 for c in given)
    assert value(tx.display_width(S), s=(str, given)) == want
    assert value(tx.pad_display(S, 20), s=(str, given)) == given + " " * (20 - want)


@pytest.mark.parametrize(
    "n,want", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA"), (16384, "XFD"), (18278, "ZZZ"), (18279, "AAAA"), (0, ""), (None, None)]
)
def test_letters(value, n, want):
    assert value(ad.column_letters(F.col("n")), n=(int, n)) == want
    if want:
        assert value(ad.column_number(S), s=(str, want.lower())) == n


def test_letters_are_a_bijection(spark):
    rows = spark.range(1, 20000).select("id", ad.column_letters(F.col("id")).alias("l"))
    assert rows.where(ad.column_number(F.col("l")) != F.col("id")).count() == 0
    assert rows.select("l").distinct().count() == 19999


def test_offsets_and_ranges(value):
    assert value(ad.column_offset(S, -1), s=(str, "D")) == "C"
    assert value(ad.column_offset(S, -1), s=(str, "A")) is None
    assert value(ad.range_address(S, 2, 3), s=(str, "A1")) == "A1:C2"
    assert value(ad.range_address(S, 1, 1), s=(str, "AZ10")) == "AZ10:AZ10"
    assert value(ad.range_address(S, 2, 3), s=(str, "11")) is None


@pytest.mark.parametrize("size,want", [(12.0, 10.5), (11.0, 9.5), (10.0, 8.5), (9.0, 7.5), (None, 9.5)])
def test_rescaled_size(value, size, want):
    assert value(ad.rescaled_size(F.col("n")), n=(float, size)) == want


@pytest.mark.parametrize(
    "line,level,message",
    [("[t] [Debug]hi", "DEBUG", "hi"), ("plain", "UNKNOWN", "plain"), ("[t] only", "UNKNOWN", "[t] only"), ("[2024] [Info] a [b] c", "INFO", " a [b] c")],
)
def test_log_fields(value, line, level, message):
    assert value(lg.log_level(S), s=(str, line)) == level
    assert value(lg.log_message(S), s=(str, line)) == message


def test_clock(value):
    assert value(lg.as_of("2024-10-01 00:00:00")) == dt.datetime(2024, 10, 1)
    for wrong in ("bad", None):
        assert abs((value(lg.as_of(wrong)) - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 120
