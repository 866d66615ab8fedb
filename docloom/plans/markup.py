"""Markup and rule queries: over the web pages as they are, and over server pages that Spark builds around them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import markup as mk
from docloom.operators import rules as ru
from docloom.operators.nesting import IMPLIED_ENDS
from docloom.operators.rows import explode_rows, spread
from docloom.operators.rules import Rule
from docloom.sources.tables import read_table

# Two pairs overlap on purpose: the first rule of the list must win.
PAGE_RULES = (
    Rule("style_tag", "Style tags", "低", "html_tag", "use style sheets", pattern=r"^(b|i|u|strike)$"),
    Rule("one_letter", "One-letter tags", "中", "html_tag", "second choice for b", pattern=r"^[a-z]$"),
    Rule("nav", "Navigation", "高", "html_tag", "move to a component", pattern=r"^nav$"),
    Rule("the_link", "Links to The", "中", "html_attr_value", "replace", pattern=r"^/The"),
    Rule("any_link", "Rooted links", "低", "html_attr_value", "replace", pattern=r"^/"),
    Rule("font", "Fonts", "other", "html_tag", "never occurs", pattern=r"^font$"),
)

# A long list of rules: one for each beginning of three letters from a to q, and some that overlap them.
_LETTERS = "abcdefghijklmnopq"
LIBRARY = (
    Rule("the", "Links to the", "高", "html_attr_value", "before all others", pattern=r"(?i)^/the$"),
    *[
        Rule(f"at_{a}{b}{c}", "Links by beginning", "中", "html_attr_value", "", pattern=f"^/{a}{b}{c}")
        for a in _LETTERS for b in _LETTERS for c in _LETTERS
    ],
    Rule("ending", "Links by ending", "低", "html_attr_value", "", pattern=r"^/.*(ing|tion)$"),
    Rule("stop", "Links with a stop", "低", "html_attr_value", "nothing to look up", pattern=r"[,.]$"),
    Rule("heading", "Headings", "低", "html_tag", "", pattern=r"^h[1-6]$"),
)


def _pages(spark, sf):
    return spread(read_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


# Server page around a web page. "{id}", "{html}" and "{url}" stand for the columns of the page.
SERVER_PAGE = (
    '<%-- about {url}\n <% hidden %> --%><%@ page language="java"\n %>\n<%@ include file="/inc/{id}.jsp" %>\n{html}\n'
    "<%! int k{id}; %><% if (n < {id}) {\n  go();\n} %>\n"
    '<c:forEach items="${rows{id}}" var="r" varStatus="s">\n'
    '<form:input path="f{id}" cssClass="${a == {id}}" disabled onclick="go({id})"/>\n'
    '<p title="${t.x}">${total{id} > 0} and <u>x</u></p>\n</c:forEach>\n'
    '<a href="javascript:void({id})"><b>t</b></a>\n<jsp:include page="/part{id}.jsp"/><%= v{id} %>\n'
    "<script>\nfunction f{id}(a) { return a; }\nvar g = (x) => x; function f{id}(b) {}\n"
    'window.onload = init;\nbtn.addEventListener("click", function() {});\n</script><script src="/s{id}.js"></script>'
)


def _server_pages(spark, sf):
    values = {"{id}": F.col("page_id").cast("string"), "{html}": F.col("html"), "{url}": F.col("url")}
    parts = [values.get(p, F.lit(p)) for p in re.split(r"(\{(?:id|html|url)\})", SERVER_PAGE)]
    pages = spread(read_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select(F.col("page_id").alias("doc_id"), F.concat(*parts).alias("text"))


def tag_tokens(spark, sf):
    return mk.tags(_pages(spark, sf)).select("doc_id", "pos", "line", "name", "tag")


def tag_counts(spark, sf):
    return mk.tags(_pages(spark, sf)).groupBy("name").agg(F.count("*").alias("n_tags"))


def attr_counts(spark, sf):
    return mk.attributes(_pages(spark, sf)).groupBy("name", "attr").agg(
        F.count("*").alias("n_attrs"), F.countDistinct("value").alias("n_values")
    )


def tag_family(spark, sf):
    return mk.tags(_server_pages(spark, sf)).groupBy(mk.family(F.col("name")).alias("family")).agg(F.count("*").alias("n_tags"))


def tag_labels(spark, sf):
    return mk.tags(_server_pages(spark, sf)).where(mk.family(F.col("name")) != "plain").select(
        "doc_id", mk.display_name(F.col("name")).alias("tag_label")
    )


def attribute_labels(spark, sf):
    """Attributes of form and control tags by their usual names."""
    return mk.labelled_attributes(_server_pages(spark, sf)).select("doc_id", "name", "place", "label", "marker", "value")


def tag_depth(spark, sf):
    return mk.depth(_pages(spark, sf)).select("doc_id", "pos", "name", F.col("depth").cast("int").alias("depth"))


def _broken_pages(spark, sf):
    """Pages with end tags left out, and with stray ones."""
    k, text = F.col("doc_id") % 3, F.col("text")
    lost = F.replace(F.replace(text, F.lit("</li>"), F.lit("")), F.lit("</p>"), F.lit(""))
    stray = F.concat(F.lit("<ul><li>a<li><b>b</ul><p></nav></i><table><tr><td><p>x<td>y<tr><td>z</table>"), F.replace(text, F.lit("</p>"), F.lit("</b>")), F.lit("<div><dl><dt>t<dd>d"))
    return _pages(spark, sf).withColumn("text", F.when(k == 1, lost).when(k == 2, stray).otherwise(text))


def tag_structure(spark, sf):
    """Depth, enclosing tag and end of every tag of broken pages, as plain tag readers see them."""
    return mk.structure(_broken_pages(spark, sf)).select("doc_id", "pos", "name", "depth", "parent", F.col("end").alias("end_pos"), "closed")


def tag_structure_implied(spark, sf):
    """The same with implied ends, as in browsers."""
    return mk.structure(_broken_pages(spark, sf), implied=True).select("doc_id", "pos", "name", "depth", "parent", F.col("end").alias("end_pos"), "closed")


def element_snippets(spark, sf):
    """Elements shown whole: closed ones, one closed by its surroundings and one open to the end, with bare attributes."""
    pages = spread(read_table(spark, sf, "pages").select("page_id", "url"))
    parts = ['<div><form:input path="p', F.col("page_id"), '" disabled="" value="">', F.col("url"), "<b>", F.col("page_id"), "</form:input></b></div>", '<p><a href="', F.col("url"), '">x<i>y</p>z<input checked=\'\' name="', F.col("page_id"), '"><a name="n">', F.col("url"), "<u>"]
    docs = pages.select(F.col("page_id").alias("doc_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))
    return mk.tags(docs).select("doc_id", "pos", mk.tag_snippet(F.col("name"), F.col("tag"), F.col("element")).alias("snippet"))


def link_facts(spark, sf):
    return mk.links(_server_pages(spark, sf)).select("doc_id", "dep_kind", "target")


def text_nodes(spark, sf):
    return mk.text_nodes(_pages(spark, sf)).select("doc_id", "pos", "kind", "text", "shown")


def comment_strip(spark, sf):
    return _pages(spark, sf).select("doc_id", mk.strip_comments(F.col("text")).alias("text"))


def tag_snippets(spark, sf):
    tags = mk.tags(_pages(spark, sf)).where("name = 'a'")
    return tags.select("doc_id", mk.tag_snippet(F.col("name"), F.col("tag"), F.col("element")).alias("snippet"))


def snippets(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.shorten(tx.squeeze(F.col("text")), 200).alias("short_text")
    )


def line_numbers(spark, sf):
    """Line of every occurrence of a term in whole documents."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    lines = tx.match_lines(tx.cut(F.col("text"), "license|that of"))
    return explode_rows(docs, ["doc_id"], lines, "pos", "line")


def js_functions(spark, sf):
    return mk.calls(_pages(spark, sf), r"(\w+)\(").select("doc_id", "name", "n_calls")


def include_facts(spark, sf):
    return mk.includes(_server_pages(spark, sf)).select("doc_id", "line", "file")


def logic_segments(spark, sf):
    return mk.logic(_server_pages(spark, sf)).select("doc_id", "line", "kind", "code", F.col("line_count").cast("int").alias("line_count"))


def inline_events(spark, sf):
    return mk.events(_server_pages(spark, sf)).select("doc_id", "line", "event")


def script_functions(spark, sf):
    return mk.script_functions(_server_pages(spark, sf)).select("doc_id", "line", "name", "raw")


def script_bindings(spark, sf):
    return mk.script_bindings(_server_pages(spark, sf)).select("doc_id", "line", "name", "raw")


def el_expressions(spark, sf):
    found = ru.candidates(_server_pages(spark, sf), ["el_expression"])
    return found.select("doc_id", "line", "phase", F.col("value").alias("el"), "raw")


def rule_hits_default(spark, sf):
    """The default rules over server pages."""
    return ru.hits(_server_pages(spark, sf)).select("doc_id", "line", "line_count", "rule_id", "snippet", "raw")


def rule_hits(spark, sf):
    """Custom rules over the web pages."""
    return ru.hits(_pages(spark, sf), PAGE_RULES).select("doc_id", "pos", "idx", "rule_id", "complexity", "snippet")


def rule_library(spark, sf):
    """Some 4,900 rules over the web pages, looked up by what their matches must hold."""
    return ru.hits(_pages(spark, sf), LIBRARY).select("doc_id", "pos", "idx", "rule_id", "complexity", "snippet")


def rule_library_table(spark, sf):
    """The same list as a table, over attribute values: hits per rule."""
    rows = mk.attributes(_pages(spark, sf)).select(
        "doc_id", F.lit("html_attr_value").alias("target"), F.lit("").alias("kind"), "value"
    )
    return ru.first_match(rows, ["doc_id"], ru.rule_table(spark, LIBRARY)).groupBy("rule_id").agg(F.count("*").alias("n_hits"))


def rule_library_summary(spark, sf):
    """Hits of every rule of the long list, rules without any included."""
    return ru.summary(ru.hits(_pages(spark, sf), LIBRARY), LIBRARY).select("grade", "rule_id", "n_hits")


def rule_first_match(spark, sf):
    """The same tag rules kept as a table."""
    rows = mk.tags(_pages(spark, sf)).select(
        "doc_id", "pos", F.lit("html_tag").alias("target"), F.lit(None).cast("string").alias("kind"), F.col("name").alias("value")
    )
    return ru.first_match(rows, ["doc_id", "pos"], ru.rule_table(spark, PAGE_RULES)).select("doc_id", "pos", "value", "rule_id")


def rule_summary(spark, sf):
    return ru.summary(ru.hits(_pages(spark, sf), PAGE_RULES), PAGE_RULES).select("grade", "rule_id", "rule_name", "n_hits")


def rule_pivot(spark, sf):
    pages = _pages(spark, sf)
    return ru.pivot_by_document(pages, ru.hits(pages, PAGE_RULES), PAGE_RULES)


def rule_totals(spark, sf):
    pages = _pages(spark, sf)
    return ru.totals(pages, ru.hits(pages, PAGE_RULES))


def top_files(spark, sf):
    return ru.top_documents(ru.hits(_pages(spark, sf), PAGE_RULES))


QUERIES = {
    f.__name__: f
    for f in (
        tag_tokens, tag_counts, attr_counts, tag_family, tag_labels, attribute_labels, tag_depth, tag_structure, tag_structure_implied, element_snippets, link_facts, text_nodes, comment_strip,
        tag_snippets, snippets, line_numbers, js_functions, include_facts, logic_segments, inline_events, script_functions,
        script_bindings, el_expressions, rule_hits_default, rule_hits, rule_library, rule_library_table, rule_library_summary, rule_first_match, rule_summary, rule_pivot,
        rule_totals, top_files,
    )
}

_PIECE = (
    r"(?is)<%.*?%>|<!--.*?-->|<![a-z][^>]*>|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
    r"|</?[A-Za-z][^\s/>]*(?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>"
)
_TOKENS = f"""
    raws AS (SELECT page_id AS doc_id, html, regexp_extract_all(html, '{_PIECE}') AS r FROM pages),
    toks AS (SELECT doc_id, html, unnest(r) AS raw, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS pos FROM raws),
    tags AS (SELECT doc_id, pos, raw, html, lower(regexp_extract(raw, '^<([A-Za-z][^\\s/>]*)', 1)) AS name,
        regexp_extract(raw, '^<[A-Za-z][^>]*>') AS tag FROM toks WHERE regexp_matches(raw, '^<[A-Za-z]'))"""
_ATTRS = f"""
    {_TOKENS},
    pairs AS (SELECT doc_id, pos, name,
        regexp_extract_all(regexp_replace(tag, '^<[A-Za-z][^\\s/>]*', ''), '[^\\s\\"''<>/=]+(?:\\s*=\\s*(?:\\"[^\\"]*\\"|''[^'']*''|[^\\s\\"''>]+))?') AS l
        FROM tags),
    attrs AS (SELECT doc_id, pos, name, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS idx, unnest(l) AS a FROM pairs),
    named AS (SELECT doc_id, pos, name, idx, lower(string_split(a, '=')[1]) AS attr,
        regexp_replace(regexp_replace(a, '^[^=]+=?', ''), '^\\"(.*)\\"$', '\\1') AS value FROM attrs)"""


# Tags that end others, for the implied ends: the tag, those it ends, those it does not look beyond.
_ENDS = "(VALUES " + ", ".join(f"('{name}', {list(ends)}, {list(stops)})" for name, (ends, stops) in IMPLIED_ENDS.items()) + ") e(name, ends, stops)"


def _structure(pages: str, implied: bool) -> str:
    """A stack of open tags, moved on by one tag a step. A step first drops what an end tag or an implied end closes, then adds
    the tag itself; ``level`` is the number of tags that stay open in between."""
    last_stop = "coalesce(list_max(list_filter(range(1, len(w.names) + 1), lambda i: list_contains(e.stops, w.names[i]))), 0)"
    first_end = f"list_min(list_filter(range({last_stop} + 1, len(w.names) + 1), lambda i: list_contains(e.ends, w.names[i])))"
    own = "CASE WHEN c.kind = '-' AND list_contains(w.names, c.name) THEN len(w.names) - list_position(list_reverse(w.names), c.name)"
    level = f"{own} {f"WHEN c.kind <> '-' AND e.name IS NOT NULL THEN coalesce({first_end} - 1, len(w.names))" if implied else ''} ELSE len(w.names) END"
    return f"""
    WITH RECURSIVE source AS ({pages}), {_TOKENS.replace('FROM pages', 'FROM source')},
    marks AS (SELECT doc_id, pos, lower(regexp_extract(raw, '^</?([A-Za-z][^\\s/>]*)', 1)) AS name,
        CASE WHEN raw LIKE '</%' THEN '-' WHEN raw LIKE '%/>' OR raw ILIKE '%</script>' OR raw ILIKE '%</style>'
            OR lower(regexp_extract(raw, '^<([A-Za-z][^\\s/>]*)', 1)) IN ({', '.join(f"'{t}'" for t in mk.VOID_TAGS)}) THEN '=' ELSE '+' END AS kind
        FROM toks WHERE regexp_matches(raw, '^</?[A-Za-z]')),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM marks),
    walk(doc_id, i, stack, names, level, before, had) AS (
        SELECT doc_id, 0::BIGINT, []::INTEGER[], []::VARCHAR[], 0::BIGINT, []::INTEGER[], []::VARCHAR[] FROM (SELECT DISTINCT doc_id FROM c)
        UNION ALL
        SELECT doc_id, i, CASE WHEN kind = '+' THEN list_append(stack[:level], pos) ELSE stack[:level] END,
            CASE WHEN kind = '+' THEN list_append(names[:level], name) ELSE names[:level] END, level, stack, names
        FROM (SELECT w.doc_id, c.i, c.pos, c.kind, c.name, w.stack, w.names, CAST({level} AS BIGINT) AS level
            FROM walk w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1 {f'LEFT JOIN {_ENDS} ON e.name = c.name' if implied else ''})),
    ends AS (SELECT w.doc_id, unnest(w.before[w.level + 1:]) AS pos, c.pos AS end_pos, unnest(list_transform(range(1, len(w.before[w.level + 1:]) + 1), lambda k: k = 1)) AND c.kind = '-' AS closed
        FROM walk w JOIN c USING (doc_id, i) WHERE len(w.before) > w.level)
    SELECT c.doc_id, c.pos, c.name, CAST(w.level AS INTEGER) AS depth, w.before[w.level] AS parent,
        CASE WHEN c.kind = '=' THEN c.pos ELSE e.end_pos END AS end_pos, c.kind = '=' OR coalesce(e.closed, false) AS closed
    FROM c JOIN walk w USING (doc_id, i) LEFT JOIN ends e ON e.doc_id = c.doc_id AND e.pos = c.pos WHERE c.kind <> '-'"""


_BROKEN = """SELECT page_id, CASE page_id % 3 WHEN 1 THEN replace(replace(html, '</li>', ''), '</p>', '')
    WHEN 2 THEN '<ul><li>a<li><b>b</ul><p></nav></i><table><tr><td><p>x<td>y<tr><td>z</table>' || replace(html, '</p>', '</b>') || '<div><dl><dt>t<dd>d'
    ELSE html END AS html FROM pages"""


def _case(rules, target, value):
    arms = " ".join(f"WHEN regexp_matches({value}, '{r.pattern}') THEN {i}" for i, r in enumerate(rules) if r.target == target)
    return f"CASE {arms} END"


_RULES_SQL = "(VALUES " + ", ".join(
    f"({i}, '{r.id}', '{r.name}', '{r.complexity}', {ru.COMPLEXITY_ORDER.get(r.complexity, 99)})" for i, r in enumerate(PAGE_RULES)
) + ") r(no, rule_id, rule_name, complexity, grade)"
_HITS = f"""
    {_ATTRS},
    cand AS (SELECT doc_id, pos, 0 AS idx, name AS value, {_case(PAGE_RULES, 'html_tag', 'name')} AS no FROM tags
        UNION ALL SELECT doc_id, pos, 2 * idx + 1, value, {_case(PAGE_RULES, 'html_attr_value', 'value')} FROM named),
    hits AS (SELECT doc_id, pos, idx, rule_id, complexity, value FROM cand JOIN {_RULES_SQL} ON cand.no = r.no)"""

_LIBRARY_HITS = f"""
    {_ATTRS},
    hits AS (SELECT doc_id, pos, 0 AS idx, 'heading' AS rule_id, '低' AS complexity, name AS value FROM tags WHERE regexp_matches(name, '^h[1-6]$')
        UNION ALL SELECT doc_id, pos, 2 * idx + 1, CASE WHEN regexp_matches(value, '(?i)^/the$') THEN 'the'
            WHEN regexp_matches(value, '^/[{_LETTERS}]{{3}}') THEN 'at_' || substr(value, 2, 3)
            WHEN regexp_matches(value, '^/.*(ing|tion)$') THEN 'ending' WHEN regexp_matches(value, '[,.]$') THEN 'stop' END AS rule_id,
            CASE WHEN rule_id = 'the' THEN '高' WHEN rule_id LIKE 'at_%' THEN '中' ELSE '低' END, value
        FROM named WHERE rule_id IS NOT NULL)"""

# Lines of the server page: the web page starts on line 5; "b" is the line of the first logic after it.
_SERVER = """
    s AS (SELECT page_id AS doc_id, page_id AS i, html, length(html) - length(replace(html, chr(10), '')) + 6 AS b FROM pages)"""


def _rows(*selects: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {x} FROM s" for x in selects)


_FORM = """'<form:input path="f' || i || '" cssClass="${a == ' || i || '}" disabled onclick="go(' || i || ')"/>'"""
_LINK = """'<a href="javascript:void(' || i || ')"><b>t</b></a>'"""
_EL = _rows(
    """CAST(b + 3 AS INTEGER) AS line, 2 AS phase, '${rows' || i || '}' AS el, '<c:forEach items="${rows' || i || '}" var="r" varStatus="s">' AS raw""",
    f"""CAST(b + 4 AS INTEGER), 2, '${{a == ' || i || '}}', {_FORM}""",
    """CAST(b + 5 AS INTEGER), 3, '${t.x}', '<p title="${t.x}">'""",
    """CAST(b + 5 AS INTEGER), 7, '${total' || i || ' > 0}', '<p title="${t.x}">'""",
)

ORACLES = {
    "tag_tokens": f"""
        WITH {_TOKENS},
        between AS (SELECT page_id AS doc_id, unnest(regexp_split_to_array(html, '{_PIECE}')) AS t,
            generate_subscripts(regexp_split_to_array(html, '{_PIECE}'), 1) - 1 AS pos FROM pages),
        breaks AS (SELECT doc_id, pos, length(t) - length(replace(t, chr(10), '')) AS n FROM between
            UNION ALL SELECT doc_id, pos + 1, length(raw) - length(replace(raw, chr(10), '')) FROM toks),
        starts AS (SELECT DISTINCT doc_id, pos, 1 + sum(n) OVER (PARTITION BY doc_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS line FROM breaks)
        SELECT doc_id, pos, CAST(line AS INTEGER) AS line, name, tag FROM tags JOIN starts USING (doc_id, pos)""",
    "tag_counts": f"WITH {_TOKENS} SELECT name, count(*) AS n_tags FROM tags GROUP BY name",
    "attr_counts": f"WITH {_ATTRS} SELECT name, attr, count(*) AS n_attrs, count(DISTINCT value) AS n_values FROM named GROUP BY ALL",
    "tag_family": f"""
        WITH {_TOKENS}, f AS (SELECT CASE WHEN name = 'script' THEN 'script' ELSE 'plain' END AS family FROM tags
            UNION ALL SELECT f FROM pages, (VALUES ('control'), ('form'), ('include'), ('script'), ('script'),
                ('plain'), ('plain'), ('plain'), ('plain')) v(f))
        SELECT family, count(*) AS n_tags FROM f GROUP BY family""",
    "tag_labels": f"""
        WITH {_TOKENS} SELECT doc_id, name AS tag_label FROM tags WHERE name = 'script'
        UNION ALL SELECT page_id, l FROM pages, (VALUES ('c:forEach'), ('form:input'), ('jsp:include'), ('script'), ('script')) v(l)""",
    "attribute_labels": f"WITH {_SERVER} " + _rows(
        "'c:foreach' AS name, 3 AS place, 'items' AS label, '' AS marker, '${rows' || i || '}' AS value",
        "'c:foreach', 2, 'var', '🆔', 'r'",
        "'c:foreach', 8, 'varStatus', '', 's'",
        "'form:input', 3, 'path', '🔴', 'f' || i",
        "'form:input', 7, 'cssClass', '', '${a == ' || i || '}'",
    ),
    "tag_depth": "SELECT doc_id, pos, name, depth FROM (" + _structure("SELECT * FROM pages", False) + ")",
    "tag_structure": _structure(_BROKEN, False),
    "tag_structure_implied": _structure(_BROKEN, True),
    "element_snippets": """
        SELECT page_id AS doc_id, s.pos, s.snippet FROM pages, LATERAL (VALUES
            (0, '<div>'), (1, '<form:input path="p' || page_id || '" disabled value="">' || url || '<b>' || page_id || '</form:input>'), (2, '<b>'),
            (6, '<p>'), (7, '<a href="' || url || '">x<i>y'), (8, '<i>'), (10, '<input checked name="' || page_id || '">'),
            (11, '<a name="n">' || url || '<u>'), (12, '<u>')) s(pos, snippet)""",
    "link_facts": f"""
        WITH {_ATTRS}
        SELECT doc_id, 'link' AS dep_kind, value AS target FROM named WHERE name = 'a' AND attr = 'href'
        UNION ALL SELECT doc_id, 'script', 'inline' FROM tags WHERE name = 'script'
        UNION ALL SELECT doc_id, attr, value FROM named WHERE attr IN ('type', 'value', 'name')
        UNION ALL SELECT page_id, 'link', 'javascript:void(' || page_id || ')' FROM pages
        UNION ALL SELECT page_id, 'include', '/part' || page_id || '.jsp' FROM pages
        UNION ALL SELECT page_id, 'script', 'inline' FROM pages
        UNION ALL SELECT page_id, 'script', '/s' || page_id || '.js' FROM pages""",
    "text_nodes": f"""
        WITH {_TOKENS}, p AS (SELECT page_id AS doc_id, regexp_split_to_array(html, '{_PIECE}') AS l FROM pages),
        n AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 2 AS INTEGER) AS pos, 'text' AS kind, unnest(l) AS t FROM p
            UNION ALL SELECT doc_id, pos, 'comment', raw[5:-4] FROM toks WHERE raw LIKE '<!--%'
            UNION ALL SELECT doc_id, pos, 'doctype', regexp_replace(raw, '(?i)^<!doctype |>$', '', 'g') FROM toks WHERE raw ILIKE '<!doctype%'
            UNION ALL SELECT doc_id, pos, 'script', regexp_replace(raw, '(?i)^<[^>]*>|</[a-z]+>$', '', 'g') FROM toks
                WHERE raw ILIKE '%</script>' OR raw ILIKE '%</style>'),
        d AS (SELECT doc_id, pos, kind, CASE WHEN kind = 'text' THEN replace(replace(replace(replace(replace(replace(replace(
            t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') ELSE t END AS t FROM n),
        s AS (SELECT doc_id, pos, kind, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM d)
        SELECT doc_id, pos, kind, t AS text, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS shown FROM s WHERE t <> ''""",
    "comment_strip": "SELECT page_id AS doc_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS text FROM pages",
    "tag_snippets": """
        SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS snippet FROM pages""",
    "snippets": """
        SELECT doc_id,
            replace(replace(CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END, chr(10), ' '), chr(13), '') AS snippet,
            CASE WHEN length(q) > 200 THEN left(q, 197) || '...' ELSE q END AS short_text
        FROM (SELECT doc_id, text, trim(regexp_replace(text, '[\\n\\t ]+', ' ', 'g')) AS q FROM documents)""",
    "line_numbers": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        m AS (SELECT doc_id, line, unnest(regexp_extract_all(t, 'license|that of')) AS w FROM l)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS pos, CAST(line AS INTEGER) AS line FROM m""",
    "js_functions": f"""
        WITH {_TOKENS}, b AS (SELECT doc_id, pos, unnest(regexp_extract_all(raw, '(\\w+)\\(', 1)) AS name FROM tags WHERE name = 'script')
        SELECT doc_id, name, count(*) AS n_calls FROM b GROUP BY doc_id, pos, name""",
    "include_facts": f"WITH {_SERVER} " + _rows("CAST(4 AS INTEGER) AS line, '/inc/' || i || '.jsp' AS file"),
    "logic_segments": f"WITH {_SERVER} " + _rows(
        "CAST(b AS INTEGER) AS line, 'declaration' AS kind, ' int k' || i || '; ' AS code, CAST(1 AS INTEGER) AS line_count",
        "CAST(b AS INTEGER), 'scriptlet', ' if (n < ' || i || ') {' || chr(10) || '  go();' || chr(10) || '} ', 3",
        "CAST(b + 8 AS INTEGER), 'expression', ' v' || i || ' ', 1",
    ),
    "inline_events": f"WITH {_SERVER} " + _rows("CAST(b + 4 AS INTEGER) AS line, 'onclick=''go(' || i || ')''' AS event"),
    "script_functions": f"WITH {_SERVER} " + _rows(
        "CAST(b + 10 AS INTEGER) AS line, 'f' || i AS name, 'function f' || i || '(' AS raw",
        "CAST(b + 11 AS INTEGER), 'g', 'var g = (x) =>'",
    ),
    "script_bindings": f"WITH {_SERVER} " + _rows(
        "CAST(b + 12 AS INTEGER) AS line, 'window.onload → init' AS name, 'window.onload = init' AS raw",
        "CAST(b + 13 AS INTEGER), 'btn.on(''click'') → (anonymous)', 'btn.addEventListener(\"click\", function'",
    ),
    "el_expressions": f"WITH {_SERVER} {_EL}",
    "rule_hits_default": f"WITH {_SERVER} " + _rows(
        "CAST(b AS INTEGER) AS line, CAST(1 AS INTEGER) AS line_count, 'jsp_declaration' AS rule_id, 'declaration' AS snippet, '<%! int k' || i || '; %>' AS raw",
        "CAST(b AS INTEGER), 3, 'scriptlet', 'scriptlet', '<% if (n < ' || i || ') {' || chr(10) || '  go();' || chr(10) || '} %>'",
        "CAST(b + 8 AS INTEGER), 1, 'jsp_expression', 'expression', '<%= v' || i || ' %>'",
        f"CAST(b + 4 AS INTEGER), NULL, 'complex_el', '${{a == ' || i || '}}', {_FORM}",
        """CAST(b + 5 AS INTEGER), NULL, 'complex_el', '${total' || i || ' > 0}', '<p title="${t.x}">'""",
        f"CAST(b + 4 AS INTEGER), NULL, 'boolean_attr', 'disabled', {_FORM}",
        f"CAST(b + 4 AS INTEGER), NULL, 'inline_event', 'onclick=''go(' || i || ')''', {_FORM}",
        "CAST(b + 5 AS INTEGER), NULL, 'deprecated_tag', 'u', '<u>'",
        f"CAST(b + 7 AS INTEGER), NULL, 'javascript_pseudo_url', 'javascript:void(' || i || ')', {_LINK}",
        "CAST(b + 10 AS INTEGER), NULL, 'js_function', 'f' || i, 'function f' || i || '('",
        "CAST(b + 11 AS INTEGER), NULL, 'js_function', 'g', 'var g = (x) =>'",
        "CAST(b + 12 AS INTEGER), NULL, 'js_event_bind', 'window.onload → init', 'window.onload = init'",
        "CAST(b + 13 AS INTEGER), NULL, 'js_event_bind', 'btn.on(''click'') → (anonymous)', 'btn.addEventListener(\"click\", function'",
    ),
    "rule_hits": f"WITH {_HITS} SELECT doc_id, pos, idx, rule_id, complexity, value AS snippet FROM hits",
    "rule_library": f"WITH {_LIBRARY_HITS} SELECT doc_id, pos, idx, rule_id, complexity, value AS snippet FROM hits",
    "rule_library_table": f"WITH {_LIBRARY_HITS} SELECT rule_id, count(*) AS n_hits FROM hits WHERE rule_id <> 'heading' GROUP BY rule_id",
    "rule_library_summary": f"""
        WITH {_LIBRARY_HITS}, l AS (SELECT unnest(string_split('{_LETTERS}', '')) AS c),
        r AS (SELECT 1 AS grade, 'the' AS rule_id UNION ALL SELECT 2, 'at_' || a.c || b.c || d.c FROM l a, l b, l d
            UNION ALL SELECT 3, unnest(['ending', 'stop', 'heading']))
        SELECT CAST(grade AS INTEGER) AS grade, rule_id, count(h.doc_id) AS n_hits FROM r LEFT JOIN hits h USING (rule_id) GROUP BY ALL""",
    "rule_first_match": f"""
        WITH {_TOKENS}, c AS (SELECT doc_id, pos, name AS value, {_case(PAGE_RULES, 'html_tag', 'name')} AS no FROM tags)
        SELECT doc_id, pos, value, rule_id FROM c JOIN {_RULES_SQL} ON c.no = r.no""",
    "rule_summary": f"""
        WITH {_HITS} SELECT CAST(r.grade AS INTEGER) AS grade, r.rule_id, r.rule_name, count(h.doc_id) AS n_hits
        FROM {_RULES_SQL} LEFT JOIN hits h ON h.rule_id = r.rule_id GROUP BY ALL""",
    "rule_pivot": f"""
        WITH {_HITS} SELECT p.page_id AS doc_id, {', '.join(f"count(*) FILTER (h.rule_id = '{r.id}') AS {r.id}" for r in PAGE_RULES)}
        FROM pages p LEFT JOIN hits h ON h.doc_id = p.page_id GROUP BY p.page_id""",
    "rule_totals": f"WITH {_HITS} SELECT (SELECT count(*) FROM pages) AS n_docs, (SELECT count(*) FROM hits) AS n_hits",
    "top_files": f"WITH {_HITS} SELECT doc_id, count(*) AS n_hits FROM hits GROUP BY doc_id ORDER BY n_hits DESC, doc_id LIMIT 5",
}
