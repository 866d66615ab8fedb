"""Search and as-of queries. A page is a line of a document unless a query says otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import search as se
from docloom.operators.asof import HOUR, asof_backward
from docloom.operators.rows import spread
from docloom.sources.tables import read_table

# One term is listed twice: a term list is a bag.
TERMS = ["that of", "license", "the and", "that of"]
SHORT = 30


def _documents(spark, sf):
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"))


def _lines(spark, sf):
    return se.line_pages(_documents(spark, sf))


def _outline(pages):
    """Short lines act as headings."""
    return pages.where(F.length("text") < SHORT).select("doc_id", "page_no", F.lit(0).alias("seq"), F.col("text").alias("title"))


def search_hits(spark, sf):
    pages = _lines(spark, sf)
    return se.search(pages, _outline(pages), TERMS).select("seq", "term", "doc_id", "page_no", "heading", "context")


def search_sections(spark, sf):
    """The same hits with headings read off the text itself: one scan, no shuffle."""
    pages = se.headed_line_pages(_documents(spark, sf), rf"[^\n]{{0,{SHORT - 1}}}")
    return se.find_terms(pages, TERMS).select(
        "seq", "term", "doc_id", "page_no", "heading", tx.matching_lines(F.col("text"), F.col("term")).alias("context")
    )


def search_hits_ci(spark, sf):
    pages = _lines(spark, sf)
    hits = se.find_terms(pages, [t.upper() for t in TERMS], ignore_case=True)
    return hits.select(
        "seq", "term", "doc_id", "page_no", tx.matching_lines(F.col("text"), F.col("term"), True).alias("context")
    )


def search_docs(spark, sf):
    return se.documents_with_hits(se.find_terms(_lines(spark, sf), TERMS))


def search_context(spark, sf):
    """Whole documents as pages, so a term may also lie across a line break."""
    pages = _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), "text")
    return se.find_terms(pages, TERMS[:3]).select(
        "doc_id", "term", tx.matching_lines(F.col("text"), F.col("term")).alias("context")
    )


def search_term_table(spark, sf):
    """Terms from a table: every line of the benchmark passages, searched in whole documents."""
    terms = (
        read_table(spark, sf, "benchmark")
        .select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select((F.col("item_id") * 1000 + F.col("pos")).cast("int").alias("seq"), tx.strip(F.col("line")).alias("term"))
        .where(F.length("term") > 0)
    )
    pages = _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), "text")
    return se.find_by_gram(pages, terms).select("doc_id", "seq", "term")


def outline_list(spark, sf):
    return se.outline_list(_outline(_lines(spark, sf)))


def asof_heading(spark, sf):
    """Nearest heading of every line."""
    pages = _lines(spark, sf)
    lines = pages.select("doc_id", "page_no")
    return se.with_heading(lines, _outline(pages), band=128)


def asof_events(spark, sf):
    """Last signup of the user at or before each purchase."""
    events = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signups = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return asof_backward(
        buys, signups, by=["user_id"], left_on="ts", right_on="ts", payload=["signup_id"], tie_break=["signup_id"], band=24 * HOUR
    ).select("event_id", "user_id", "signup_id")


def _asof_by(spark, sf, at, band):
    events = read_table(spark, sf, "events").select("event_id", "user_id", at.alias("at"), "event_type")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    signups = events.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("signup_id"))
    return asof_backward(
        buys, signups, by=["user_id"], left_on="at", right_on="at", payload=["signup_id"], tie_break=["signup_id"], band=band
    ).select("event_id", "signup_id")


def asof_double(spark, sf):
    """The signup with the nearest value not above that of each purchase; values are fractions."""
    return _asof_by(spark, sf, F.col("value"), 10)


def asof_date(spark, sf):
    """Last signup on the day of each purchase or before; days only."""
    return _asof_by(spark, sf, F.col("ts").cast("date"), 7)


def search_term_edges(spark, sf):
    """Null and empty terms beside real ones find nothing, in a short term table and in a long one alike."""
    nation = read_table(spark, sf, "nation")
    few = nation.select(F.col("n_nationkey").cast("int").alias("seq"), F.when(F.col("n_nationkey") % 5 > 1, F.lit("that of")).when(F.col("n_nationkey") % 5 == 1, F.lit("")).alias("term"))
    many = few.unionByName(read_table(spark, sf, "orders").select((F.col("o_orderkey") + 100).cast("int").alias("seq"), F.concat(F.lit("no such term "), "o_orderkey").alias("term")))
    pages = _documents(spark, sf).select("doc_id", F.lit(1).alias("page_no"), "text")
    found = [se.find_terms(pages, t).select("doc_id", "seq", F.lit(k).alias("terms")) for k, t in (("few", few), ("many", many))]
    return found[0].unionByName(found[1])


QUERIES = {
    f.__name__: f
    for f in (asof_double, asof_date, search_term_edges, search_hits, search_sections, search_hits_ci, search_docs, search_context, search_term_table, outline_list, asof_heading, asof_events)
}

_TERM_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") v(seq, term)"
LINES_SQL = """
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
                     generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents)"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CONTEXT = (
    "array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, term)), "
    "lambda l: " + _STRIP.format("l") + "), ' ')"
)

ORACLES = {
    "search_hits": f"""
        WITH {LINES_SQL},
        heads AS (SELECT doc_id, page_no, t AS title FROM lines WHERE length(t) < {SHORT}),
        hits AS (SELECT CAST(seq AS INTEGER) AS seq, term, doc_id, page_no, t FROM lines JOIN {_TERM_SQL} ON contains(t, term))
        SELECT q.seq, q.term, q.doc_id, q.page_no, coalesce(h.title, '') AS heading, {_STRIP.format('q.t')} AS context
        FROM hits q ASOF LEFT JOIN heads h ON q.doc_id = h.doc_id AND q.page_no >= h.page_no""",
    "search_hits_ci": f"""
        WITH {LINES_SQL}
        SELECT CAST(seq AS INTEGER) AS seq, upper(term) AS term, doc_id, page_no, {_STRIP.format('t')} AS context
        FROM lines JOIN {_TERM_SQL} ON contains(lower(t), term)""",
    "search_docs": f"""
        WITH {LINES_SQL}
        SELECT term, doc_id, min(page_no) AS first_page FROM lines JOIN {_TERM_SQL} ON contains(t, term) GROUP BY ALL""",
    "search_context": f"""
        SELECT doc_id, term, {_CONTEXT} AS context
        FROM documents JOIN {_TERM_SQL} ON contains(replace(text, chr(10), ' '), term) WHERE seq < 3""",
    "search_term_table": f"""
        WITH terms AS (SELECT CAST(item_id * 1000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq,
                              unnest(string_split(text, chr(10))) AS line FROM benchmark)
        SELECT doc_id, seq, {_STRIP.format('line')} AS term FROM documents
        JOIN terms ON length({_STRIP.format('line')}) > 0 AND contains(replace(text, chr(10), ' '), {_STRIP.format('line')})""",
    "outline_list": f"WITH {LINES_SQL} SELECT doc_id, t AS title FROM lines WHERE length(t) < {SHORT}",
    "asof_heading": f"""
        WITH {LINES_SQL}
        SELECT doc_id, page_no, coalesce(last_value(CASE WHEN length(t) < {SHORT} THEN t END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), '') AS heading FROM lines""",
    "asof_events": """
        SELECT p.event_id, p.user_id, s.event_id AS signup_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
}
_ASOF = """
    SELECT p.event_id, max(struct_pack(a := {at_s}, b := s.event_id)).b AS signup_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND {at_s} <= {at_p} GROUP BY p.event_id"""
ORACLES["asof_double"] = _ASOF.format(at_s="s.value", at_p="p.value")
ORACLES["asof_date"] = _ASOF.format(at_s="CAST(s.ts AS DATE)", at_p="CAST(p.ts AS DATE)")
ORACLES["search_term_edges"] = """
    SELECT doc_id, CAST(n_nationkey AS INTEGER) AS seq, t.terms FROM documents, nation, (VALUES ('few'), ('many')) t(terms)
    WHERE n_nationkey % 5 > 1 AND contains(replace(replace(text, chr(10), ' '), chr(13), ' '), 'that of')"""
ORACLES["search_sections"] = ORACLES["search_hits"]
