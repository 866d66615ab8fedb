"""Near-duplicate lines by their deletion neighbourhoods, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import among, keep_columns, salted_lookup, staged

LEAST_WORDS = 5  # one edited word of at least five leaves a similarity of 0.8 or more
BREAK = r"\n(?=[ \t\r]*[^ \t\r\n])"
SPREAD_ROWS = 50_000  # a list of keys is sent to all executors up to this length; of a longer one a table of bits is


def _words(piece: Column) -> Column:
    return F.filter(F.split(F.translate(piece, "\t\r\n", "   "), " "), lambda w: w != "")


def _coded(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _halves(words: Column) -> Column:
    """Keys that two lines within one edit must share: the edit lies in the first or in the second half, so the other
    half is untouched. The halves are those of the shorter line; a line is asked as the shorter and as the longer one."""
    n = F.size(words)

    def keys(base: Column) -> list[Column]:
        head = F.floor(base / 2).cast("int")
        tail = base - head
        return [F.xxhash64(F.lit(0), base, F.slice(words, F.lit(1), head)), F.xxhash64(F.lit(1), base, F.slice(words, n - tail + 1, tail))]

    return F.when(n >= LEAST_WORDS, F.array(*keys(n), *keys(n - 1))).when(n == LEAST_WORDS - 1, F.array(*keys(n)))


def _within_one(a: Column, b: Column) -> Column:
    """Edit distance in words of at most one: equal beginnings and equal ends together leave at most one word."""

    def equal_from_start(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        first = F.array_position(same, False)
        return F.when(first == 0, F.size(same)).otherwise(first - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return equal_from_start(a, b) + equal_from_start(F.reverse(a), F.reverse(b)) >= longest - 1


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text``, with ``n_lines`` and ``n_removed``.

    Lines are compared as words between blanks. A line goes if an earlier one (smaller ``key``, nulls first; then place
    in the text) has the same words, or differs by one inserted, deleted or replaced word where the longer of the two has
    five words or more. The earlier line counts even if it went itself, so the first of all always stays.

    Method: distinct lines (128-bit hashes) with their first places; those that share an untouched half with another line
    (nothing else can be within one edit) emit all variants with one word deleted as 128-bit keys; equal variants meet,
    each line is paired with the earliest only, and the pair's edit distance is verified on the words. Groups are reduced
    by minima, never enumerated, so thousands of variants of one line cost as many rows. Texts are shuffled once, to
    meet the places of their lines that stay; before that only hashes and places travel.

    Blank lines stay with the line before them. Null texts, texts without words and empty tables come back unchanged.
    Two rows with the same key and text get the same result. Input columns n_lines and n_removed are replaced.
    """
    kept = keep_columns(docs, ["n_lines", "n_removed"])
    bodies = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))
    place = F.struct("id", "mark", "pos")

    facts = F.transform(
        F.split("body", BREAK),
        lambda piece: _once(
            _words(piece),
            lambda w: F.when(
                F.size(w) > 0,
                _once(_coded(w), lambda c: F.struct(F.xxhash64(w).alias("k1"), F.xxhash64(F.lit(77), c).alias("k2"), _halves(c).alias("halves"))),
            ),
        ),
    )
    found = bodies.select("id", "mark", F.posexplode_outer(facts).alias("pos", "line")).where("line is not null")
    lines = staged(
        found.groupBy("line.k1", "line.k2")
        .agg(F.min(place).alias("place"), F.first("line.halves").alias("halves"))
        .select("k1", "k2", "place.*", "halves"),
        "lines",
    )

    # Which half is shared: even places of the array are first halves, odd places second ones.
    halves = lines.select("k1", "k2", place.alias("place"), F.posexplode("halves").alias("kind", "half"))
    shared = staged(halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("half"), "halves")
    near = among(halves, shared, ["half"], SPREAD_ROWS, ["k1"]).groupBy("k1", "k2").agg(
        F.max(F.col("kind") % 2 == 0).alias("head"), F.max(F.col("kind") % 2 == 1).alias("tail"), F.min("place").alias("place")
    )
    near = staged(near.select("k1", "k2", "head", "tail", "place.*"), "near")

    # The words of those lines, from the texts that hold them.
    owners = staged(near.select("id", "mark").distinct(), "owners")
    holding = among(bodies, owners, ["id", "mark"], SPREAD_ROWS, nullable=["id"])
    split = holding.dropDuplicates(["id", "mark"]).select("id", "mark", F.posexplode(F.split("body", BREAK)).alias("pos", "piece"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark")) & (F.col("a.pos") == F.col("b.pos"))
    asked = staged(
        near.alias("a").join(split.alias("b"), same).select("k1", "k2", "head", "tail", F.struct("a.id", "a.mark", "a.pos").alias("place"), _words(F.col("piece")).alias("words")),
        "asked",
    )

    # With an equal first half the edit is in the second one, and the other way round.
    n = F.size("words")
    low = F.when(F.col("tail"), F.lit(0)).otherwise(F.floor((n - 1) / 2).cast("int"))
    high = F.when(F.col("head"), n - 1).otherwise(F.least(n - 1, F.floor(n / 2).cast("int")))

    def keyed(cut: Column, rest: Column) -> Column:
        return F.struct(cut.alias("cut"), F.xxhash64(rest).alias("v1"), F.xxhash64(F.lit(78), rest).alias("v2"))

    neighbours = _once(
        _coded(F.col("words")),
        lambda c: F.concat(
            F.array(keyed(F.lit(-1), c)),
            F.when(
                n >= LEAST_WORDS,
                F.transform(F.sequence(low, high), lambda i: _once(F.concat(F.slice(c, F.lit(1), i), F.slice(c, i + 2, n)), lambda rest: keyed(i, rest))),
            ).otherwise(F.array().cast("array<struct<cut:int,v1:bigint,v2:bigint>>")),
        ),
    )
    variants = staged(asked.select("k1", "k2", "place", F.posexplode_outer(neighbours).alias("__at", "v")).select("k1", "k2", "place", "v.*"), "neighbours")
    equal = staged(variants.groupBy("v1").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("v1"), "variants")
    met = staged(among(variants, equal, ["v1"], SPREAD_ROWS, ["k1"]).select("k1", "k2", "place", "cut", "v1", "v2"), "met")
    same_cut = met.groupBy("v1", "v2", "cut").agg(F.min("place").alias("low"))
    any_cut = same_cut.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("cut") < 0, F.col("low"))).alias("whole"), F.min(F.when(F.col("cut") >= 0, F.col("low"))).alias("longer")
    )
    earliest = same_cut.join(any_cut, ["v1", "v2"]).select(
        "v1", "v2", "cut", F.when(F.col("cut") >= 0, F.least("low", "whole")).otherwise(F.col("longer")).alias("other")
    ).where(F.col("other").isNotNull())
    pairs = (
        salted_lookup(met, earliest, ["v1", "v2", "cut"], ["k1", "k2"])
        .where(F.col("other") < F.col("place"))
        .groupBy("k1", "k2")
        .agg(F.min("other").alias("other"))
    )
    partner = asked.select(F.col("place").alias("other"), F.col("words").alias("other_words"))
    gone = staged(
        pairs.join(asked.select("k1", "k2", "place", "words"), ["k1", "k2"])
        .join(partner, "other")
        .where(_within_one(F.col("words"), F.col("other_words")))
        .select("place.*"),
        "gone",
    )
    # Places of lines that go meet those of all lines where these are gathered by text, so they need no join of their own.
    stay = (
        lines.select("id", "mark", "pos", F.lit(False).alias("goes")).unionByName(gone.withColumn("goes", F.lit(True)))
        .groupBy("id", "mark")
        .agg(F.collect_list(F.when(~F.col("goes"), F.col("pos"))).alias("every"), F.collect_list(F.when(F.col("goes"), F.col("pos"))).alias("gone"))
        .select("id", "mark", F.array_except("every", "gone").alias("stay"))
    )
    full = docs.select(F.struct(*kept).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("mark"))
    joined = full.alias("a").join(stay.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark")), "left")
    body = F.col(f"row.`{text}`")
    cut = _once(
        F.split(body, BREAK),
        lambda pieces: F.struct(
            F.size(F.filter(pieces, lambda p: p.rlike(r"[^ \t\r\n]"))).alias("n"),
            F.transform(F.sort_array("stay"), lambda i: F.get(pieces, i)).alias("rest"),
        ),
    )
    rebuilt = joined.select("row", F.explode(F.array(F.when(body.isNotNull(), cut))).alias("cut"))
    n_lines = F.coalesce("cut.n", F.lit(0))
    new_text = F.when(n_lines > 0, F.coalesce(F.array_join("cut.rest", "\n"), F.lit(""))).otherwise(body)
    return rebuilt.select(
        *[new_text.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept],
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.coalesce(F.size("cut.rest"), F.lit(0))).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark, sf):
    out = dedupe_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_left"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


ORACLE = r"""
with pieces as (
  select doc_id, unnest(string_split(regexp_replace(text, '\n([ \t\r]*[^ \t\r\n])', chr(1) || '\1', 'g'), chr(1))) as piece,
         generate_subscripts(string_split(regexp_replace(text, '\n([ \t\r]*[^ \t\r\n])', chr(1) || '\1', 'g'), chr(1)), 1) as pos
  from documents),
worded as (select *, list_filter(regexp_split_to_array(piece, '[ \t\r\n]+'), lambda w: w <> '') as words from pieces),
filled as (select * from worded where len(words) > 0),
ranked as (select *, row_number() over (order by doc_id, pos) as place from filled),
lines as (select words, min(place) as place from ranked group by words),
variants as (
  select place, len(words) as n, -1 as cut, md5(array_to_string(words, chr(10))) as rest from lines
  union all
  select place, n, cut, md5(array_to_string(list_concat(words[1:cut], words[cut + 2:]), chr(10))) from (
    select place, words, len(words) as n, unnest(range(len(words))) as cut from lines where len(words) >= 5)),
gone as (
  select distinct b.place from variants a join variants b on a.rest = b.rest and a.place < b.place
  where greatest(a.n, b.n) >= 5 and (a.cut = b.cut or a.cut = -1 or b.cut = -1)),
stay as (
  select r.doc_id, r.pos, r.piece from ranked r join lines l on r.place = l.place where r.place not in (select place from gone)),
joined as (select doc_id, string_agg(piece, chr(10) order by pos) as text, count(*) as n from stay group by doc_id),
counts as (select doc_id, count(*) as n from filled group by doc_id)
select d.doc_id, coalesce(c.n, 0)::bigint as n_lines, (coalesce(c.n, 0) - coalesce(j.n, 0))::bigint as n_removed,
  length(case when c.n > 0 then coalesce(j.text, '') else d.text end)::bigint as n_left,
  md5(coalesce(case when c.n > 0 then coalesce(j.text, '') else d.text end, '')) as text_md5
from documents d left join joined j on d.doc_id = j.doc_id left join counts c on d.doc_id = c.doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": ORACLE}
