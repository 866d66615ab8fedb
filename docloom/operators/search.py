"""Term search over paged text.

Pages are rows ``(doc_id, page_no, text)``; an outline is rows ``(doc_id, page_no, seq, title)``; terms are
a Python list or rows ``(seq, term)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.asof import asof_backward
from docloom.operators.rows import explode_rows

# Term tables up to this size become literals of the plan; larger ones go through the gram join.
LITERAL_TERMS = 500
LITERAL_CHARS = 100_000
BROADCAST_CHARS = 4_000_000  # grams with their terms, counted; more of them are shuffled, whatever the scan's size suggests
GRAMS = (32, 16, 8, 4, 2, 1)  # block lengths, longest first
SHORT = 15  # shorter terms need blocks below eight characters; if they are few, they become literals


def line_pages(documents: DataFrame) -> DataFrame:
    """Treat each line of a document as a page, numbered from 1."""
    return explode_rows(documents.select("doc_id", "text"), ["doc_id"], F.split("text", "\n"), "pos", "text").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("page_no"), "text"
    )


def headed_line_pages(documents: DataFrame, heading: str) -> DataFrame:
    """Lines of documents as pages, each with its nearest heading, where headings are lines of the same text.

    ``heading`` is a pattern for whole heading lines. The text is cut at its headings and the sections are
    exploded, so the heading needs no lookup: one scan, no shuffle.
    """
    parts, n = F.col("parts"), F.size("starts")

    def section(k: Column) -> Column:
        own = F.concat(F.when(k > 0, F.element_at(parts, 2 * k)).otherwise(""), F.element_at(parts, 2 * k + 1))
        inner = F.when(k < n, F.regexp_replace(own, r"\n\z", "")).otherwise(own)
        return F.struct(
            F.when(k > 0, F.element_at("starts", F.greatest(k, F.lit(1)))).otherwise(F.lit(1)).alias("start"),
            F.when(k > 0, F.element_at(parts, 2 * k)).otherwise("").alias("heading"),
            # The part before the first heading is no page of its own when it is empty.
            F.when((k > 0) | (n == 0) | (F.length(own) > 0), F.split(inner, "\n")).alias("lines"),
        )

    pattern = rf"(?<![^\n])(?:{heading})(?![^\n])"
    cut = documents.select("doc_id", tx.cut(F.col("text"), pattern).alias("parts"))
    numbered = cut.select("doc_id", "parts", tx.match_lines(parts).alias("starts"))
    sections = explode_rows(numbered, ["doc_id"], F.transform(F.sequence(F.lit(0), n), section), "__pos", "s")
    flat = sections.select("doc_id", "s.start", "s.heading", "s.lines")
    lines = explode_rows(flat, ["doc_id", "start", "heading"], F.col("lines"), "pos", "text")
    return lines.select("doc_id", (F.col("start") + F.col("pos")).cast("bigint").alias("page_no"), "heading", "text")


def term_table(inline: Sequence[str], from_file: DataFrame | None = None) -> Sequence[str] | DataFrame:
    """Inline terms first, then those of the file; repeated terms stay repeated."""
    if from_file is None:
        return list(inline)
    first = from_file.sparkSession.createDataFrame(list(enumerate(inline)), "seq int, term string")
    rest = from_file.select((F.col("seq") + len(inline)).cast("int").alias("seq"), "term")
    return first.unionByName(rest)


def _few(terms: DataFrame) -> DataFrame | None:
    """The terms, if they are few enough to become literals and not none at all."""
    size = terms.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("chars")).first()
    small = 0 < size["n"] <= LITERAL_TERMS and size["chars"] <= LITERAL_CHARS
    return terms if small else None


def _literals(terms: Sequence[str] | DataFrame) -> list[tuple[int, str]] | None:
    """Terms as a Python list if they are few, else None. The size is checked before any row is fetched. Null and empty
    terms find nothing, however many terms there are."""
    if not isinstance(terms, DataFrame):
        found = [(i, t.strip()) for i, t in enumerate(terms) if t and t.strip()]
        return None if len(found) > LITERAL_TERMS or sum(len(t) for _, t in found) > LITERAL_CHARS else found
    filled = terms.where(F.length("term") > 0)
    few = _few(filled)
    if few is None:
        return [] if not filled.head(1) else None
    return [(r["seq"], r["term"]) for r in few.select("seq", "term").orderBy("seq").collect()]


def find_terms(pages: DataFrame, terms: Sequence[str] | DataFrame, ignore_case: bool = False) -> DataFrame:
    """Every (page, term) pair where the page text holds the term: ``pages`` columns plus seq and term.

    Newlines count as blanks when matching. A short term list is tested against each page in place, with
    no join and no shuffle.
    """
    literals = _literals(terms)
    if literals is None:
        if not isinstance(terms, DataFrame):
            listed = [(i, t.strip()) for i, t in enumerate(terms) if t and t.strip()]
            terms = pages.sparkSession.createDataFrame(listed, "seq int, term string")
        return find_by_gram(pages, terms, ignore_case)
    if not literals:
        return pages.select("*", F.lit(0).alias("seq"), F.lit("").alias("term")).where(F.lit(False))

    fold = F.lower if ignore_case else (lambda c: c)
    wanted = F.array(
        *[
            F.struct(F.lit(i).cast("int").alias("seq"), F.lit(t).alias("term"), fold(F.lit(t)).alias("folded"))
            for i, t in literals
        ]
    )
    # The outer one-element array binds the normalised text once for all terms.
    found = F.flatten(
        F.transform(
            F.array(fold(tx.one_line(F.col("text")))),
            lambda page: F.filter(wanted, lambda w: F.contains(page, w["folded"])),
        )
    )
    return explode_rows(pages, pages.columns, found, "__pos", "__hit").select(*pages.columns, "__hit.seq", "__hit.term")


def find_by_gram(pages: DataFrame, terms: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Search with a term table of any size.

    A page is cut into blocks of ``g`` characters. A term of at least ``2g - 1`` characters covers a whole
    block wherever it lies, and that block is one of the ``g`` first grams of the term. So pages and terms
    join on grams, and the pairs are then checked in full. Each term uses the longest block it can, and
    pages are cut only for the block lengths in use. Page ids travel with the blocks, not the text; the
    text joins once, for pages that have candidates.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    size = F.coalesce(*[F.when(F.length("folded") >= 2 * g - 1, F.lit(g)) for g in GRAMS])
    listed = (
        terms.where(F.length("term") > 0)
        .select(F.col("seq").cast("int").alias("seq"), "term", fold(F.col("term")).alias("folded"))
        .withColumn("size", size)
    )
    few = _few(listed.where(F.length("folded") < SHORT))
    if few is not None:
        rest = find_by_gram(pages, terms.where(F.length(fold(F.col("term"))) >= SHORT), ignore_case)
        return find_terms(pages, few, ignore_case).unionByName(rest)
    # At most one row per block length, with the characters of its grams, each beside its term.
    chars = F.sum(F.col("size") * (F.col("size") + 2 * F.length("term") + 32))
    found = listed.groupBy("size").agg(chars.alias("chars")).collect()
    sizes = sorted(r["size"] for r in found)
    if not sizes:
        return pages.select("*", F.lit(0).alias("seq"), F.lit("").alias("term")).where(F.lit(False))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.substr(F.col("folded"), i, F.col("size"))))
    wanted = listed.select("seq", "term", "folded", F.explode(grams).alias("gram"))

    body = fold(tx.one_line(F.col("text")))
    blocks = F.flatten(F.array(*[F.regexp_extract_all("body", F.lit(f"(?s).{{{g}}}"), F.lit(0)) for g in sizes]))
    cut = explode_rows(
        pages.select("doc_id", "page_no", body.alias("body")), ["doc_id", "page_no"], F.array_distinct(blocks), "__pos", "gram"
    )
    # A table of few bytes may hold terms whose grams fill the driver, so their count decides, not the plan's guess.
    wanted = F.broadcast(wanted) if sum(r["chars"] for r in found) <= BROADCAST_CHARS else wanted.hint("merge")
    candidates = cut.join(wanted, "gram").select("doc_id", "page_no", "seq", "term", "folded").distinct()
    return (
        pages.hint("merge").join(candidates, ["doc_id", "page_no"])
        .where(F.contains(fold(tx.one_line(F.col("text"))), F.col("folded")))
        .select(*pages.columns, "seq", "term")
    )


def search(
    pages: DataFrame,
    outline: DataFrame,
    terms: Sequence[str] | DataFrame,
    ignore_case: bool = False,
    band: int = 4096,
) -> DataFrame:
    """Full hit list: term, doc_id, page_no, nearest heading at or before the page, context lines."""
    hits = find_terms(pages, terms, ignore_case).select(
        "seq", "term", "doc_id", "page_no",
        tx.matching_lines(F.col("text"), F.col("term"), ignore_case).alias("context"),
    )
    return with_heading(hits, outline, band)


def with_heading(hits: DataFrame, outline: DataFrame, band: int = 4096) -> DataFrame:
    """Add ``heading``: the last outline entry at or before the page, empty if there is none."""
    found = asof_backward(
        hits, entries(outline), by=["doc_id"], left_on="page_no", right_on="page_no",
        payload=["title"], tie_break=["seq"], band=band,
    )
    return found.withColumn("heading", F.coalesce("title", F.lit(""))).drop("title")


def entries(outline: DataFrame) -> DataFrame:
    """Outline entries that point to a real page."""
    return outline.where(F.col("page_no") >= 1)


def outline_list(outline: DataFrame) -> DataFrame:
    """Headings per document in page order."""
    return entries(outline).orderBy("doc_id", "page_no", "seq").select("doc_id", "title")


def documents_with_hits(hits: DataFrame) -> DataFrame:
    """Short report: each (term, document) once, with the page it was first seen on."""
    return hits.groupBy("term", "doc_id").agg(F.min("page_no").alias("first_page"))


def short_report(hits: DataFrame) -> DataFrame:
    return documents_with_hits(hits).orderBy("doc_id", "first_page", "term").select("term", "doc_id")


def verbose_report(hits: DataFrame) -> DataFrame:
    return hits.orderBy("doc_id", "page_no", "seq").select("term", "doc_id", "heading", "page_no", "context")
