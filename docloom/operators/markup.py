"""Markup extraction: tokens, attributes, embedded logic, scripts, text nodes.

Input is ``(doc_id, text)``, one row per source file or page. Each document is cut once into text pieces
and markup pieces; everything is computed inside the row, without a shuffle. Which tag stands in which is
found in one pass over short codes of the tags (:mod:`docloom.operators.nesting`); the text stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.nesting import nest, tag_code
from docloom.operators.rows import explode_rows, inline_rows

# Patterns and names that decide what counts as which kind of markup.
SERVER_COMMENT = r"(?s)<%--.*?--%>"
STATIC_INCLUDE = r'<%@\s*include\s+file="(.*?)"\s*%>'
OTHER_DIRECTIVE = r'(?s)<%@(?!\s*include\s+file="[^\n"]*"\s*%>).*?%>'
EL = r"\$\{.*?\}"
JS_FUNCTION = (
    r"(?U)function\s+([\w$]+)\s*\(|(?:const|let|var)\s+([\w$]+)\s*=\s*(?:function\s*\(|\([^)]*\)\s*=>|\w+\s*=>)"
)
JS_EVENT = (
    r"(?U)((?:window|document)\.(on\w+))\s*=\s*([\w$]+)"
    r"|(\w+(?:[.(][^)]*\))*(?:\.\w+)*)\.addEventListener\s*\(\s*['\"]([\w]+)['\"]\s*,\s*([\w$]+)"
)
FORM_ATTRIBUTES = {
    "modelattribute": "modelAttribute", "commandname": "commandName", "path": "path", "items": "items",
    "method": "method", "action": "action", "cssclass": "cssClass", "csserrorclass": "cssErrorClass",
    "enctype": "enctype", "value": "value", "label": "label", "itemvalue": "itemValue",
    "itemlabel": "itemLabel", "type": "type",
}
CONTROL_ATTRIBUTES = {
    "test": "test", "var": "var", "items": "items", "value": "value", "begin": "begin", "end": "end",
    "step": "step", "varstatus": "varStatus", "url": "url", "name": "name",
}
FORM_MARKERS = {"modelattribute": "📦", "commandname": "📦", "path": "🔴"}
CONTROL_MARKERS = {"test": "❓", "var": "🆔"}
CONTROL_TAGS = {
    "c:foreach": "c:forEach", "c:setwhen": "c:setWhen", "fmt:formatdate": "fmt:formatDate",
    "fmt:formatnumber": "fmt:formatNumber", "fmt:parsedate": "fmt:parseDate",
    "fmt:parsenumber": "fmt:parseNumber", "fmt:requestencoding": "fmt:requestEncoding",
    "fmt:setbundle": "fmt:setBundle", "fmt:setlocale": "fmt:setLocale", "fmt:settimezone": "fmt:setTimeZone",
}
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
    "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
)
WHOLE_TAGS = ("a", "input", "form:input")  # shown up to their end
BARE_ATTRIBUTES = (
    "allowfullscreen", "async", "autofocus", "autoplay", "checked", "controls", "default", "defer", "disabled", "formnovalidate", "hidden", "ismap",
    "loop", "multiple", "muted", "nomodule", "novalidate", "open", "playsinline", "readonly", "required", "reversed", "selected",
)
LIST_ATTRIBUTES = ("class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone")

# A tag: a name, then anything up to ">" where quoted values may hold ">". Possessive, so it never backtracks.
_TAG = r"</?[A-Za-z][^\s/>]*+(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
# One markup piece. Order matters: earlier forms swallow what they contain.
PIECE = (
    r"(?is)<%.*?%>|<!--.*?-->|<![a-z][^>]*>"
    r"|<script(?=[\s>])[^>]*>.*?</script\s*>|<style(?=[\s>])[^>]*>.*?</style\s*>|" + _TAG
)
_OPENING = r"(?s)^(" + _TAG + r")"
_ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"


def clean(text: Column) -> Column:
    """Remove server comments and directives other than includes; their newlines stay."""
    cleaned = tx.blank_blocks(tx.blank_blocks(text, SERVER_COMMENT), OTHER_DIRECTIVE)
    return F.when(F.contains(text, F.lit("<%")), cleaned).otherwise(text)


def strip_comments(text: Column, pattern: str = r"(?s)<!--.*?-->|<%--.*?--%>") -> Column:
    """Remove comments of either kind; their newlines stay."""
    return tx.blank_blocks(text, pattern)


def _kind(piece: Column) -> Column:
    return (
        F.when(piece.startswith("<%@"), "include")
        .when(piece.startswith("<%"), "logic")
        .when(piece.startswith("<!--"), "comment")
        .when(piece.startswith("<!"), "doctype")
        .when(piece.startswith("</"), "close")
        .otherwise("open")
    )


def _tag_name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))


def pieces(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, alternating text and markup ``parts``, ``lines`` of the markup parts."""
    parted = docs.select("doc_id", tx.cut(clean(F.col("text")), PIECE).alias("parts"))
    return parted.select("doc_id", "parts", tx.match_lines(F.col("parts")).alias("lines"))


def nested(docs: DataFrame, implied: bool = False) -> DataFrame:
    """:func:`pieces` with ``nest``, what :func:`docloom.operators.nesting.nest` says of each markup part."""

    def code(piece: Column) -> Column:
        name = _tag_name(piece)
        alone = piece.endswith("/>") | name.isin(*VOID_TAGS) | piece.rlike(r"(?i)</(?:script|style)\s*>$")
        return tag_code(name, piece.startswith("</"), piece.rlike("^<[A-Za-z]"), alone)

    known = pieces(docs)
    codes = F.transform(F.filter("parts", lambda _, i: i % 2 == 1), code)
    return known.select(*known.columns, nest(codes, implied).alias("nest"))


def tokens(docs: DataFrame, elements: bool = True) -> DataFrame:
    """Markup tokens in document order.

    Columns: doc_id, pos, line, kind (open, close, logic, include, comment, doctype), name, tag (opening or
    closing tag as written), body (script or style content, logic code), element (``WHOLE_TAGS`` up to their
    end; null for others, and without ``elements``), raw.
    """
    parts = F.col("parts")
    marked = F.transform(
        F.col("lines"),
        lambda line, k: F.struct(
            line.alias("line"),
            F.element_at(parts, 2 * k + 2).alias("raw"),
            (_element(k) if elements else F.lit(None).cast("string")).alias("element"),
        ),
    )
    source = nested(docs) if elements else pieces(docs)
    return _describe(explode_rows(source, ["doc_id"], marked, "pos", "t").select("doc_id", "pos", "t.*"))


def tokens_and_text(docs: DataFrame) -> DataFrame:
    """Like :func:`tokens`, with the text ``after`` each token, plus one row at position -1 for the text
    before the first. Where that text or a comment holds EL, ``parent`` is the tag around it (raw, line).
    """
    parts, lines = F.col("parts"), F.col("lines")

    def enclosing(k: Column) -> Column:
        """The tag open after token ``k``. The one-element array binds its number, so it is read once."""
        at = F.element_at(F.col("nest"), (k + 1).cast("int"))["around"]
        raw = lambda j: F.element_at(parts, (2 * j + 2).cast("int"))
        found = F.transform(
            F.filter(F.array(at), lambda j: j >= 0),
            lambda j: F.struct(
                tag_snippet(_tag_name(raw(j)), F.regexp_extract(raw(j), _OPENING, 1), _element(j)).alias("raw"),
                F.element_at(lines, j + 1).alias("line"),
            ),
        )
        return F.try_element_at(found, F.lit(1))

    def entry(line: Column, k: Column) -> Column:
        raw = F.when(k > 0, F.try_element_at(parts, 2 * k))
        after = F.element_at(parts, 2 * k + 1)
        asks = F.contains(F.concat(F.when(raw.startswith("<!"), raw).otherwise(""), after), F.lit("${"))
        return F.struct(
            line.alias("line"), raw.alias("raw"), after.alias("after"),
            F.when(k > 0, _element(k - 1)).alias("element"),
            F.when(asks & (k > 0), enclosing(k - 1)).alias("parent"),
        )

    marked = F.transform(F.concat(F.array(F.lit(0)), lines), entry)
    exploded = explode_rows(nested(docs), ["doc_id"], marked, "k", "t")
    return _describe(exploded.select("doc_id", (F.col("k") - 1).alias("pos"), "t.*"), "after", "parent")


def _describe(rows: DataFrame, *extra: str) -> DataFrame:
    raw = F.col("raw")
    opening = F.regexp_extract(raw, _OPENING, 1)
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    content = F.regexp_replace(F.substr(raw, F.length("tag") + 1), r"(?i)</(?:script|style)\s*>$", "")
    return (
        rows.withColumn("kind", F.when(raw.isNull(), "start").otherwise(_kind(raw)))
        .withColumn("tag", F.when(is_open, opening).when(is_close, raw))
        .select(
            "doc_id", "pos", "line", "kind",
            F.when(is_open | is_close, _tag_name(raw)).alias("name"),
            "tag",
            F.when(is_open, content)
            .when(F.col("kind") == "logic", F.regexp_extract(raw, r"(?s)^<%[=!]?(.*)%>$", 1))
            .otherwise(raw).alias("body"),
            "element", "raw", *extra,
        )
    )


def _element(k: Column) -> Column:
    """The source of the ``k``-th tag with all that stands in it, for the tags that are shown whole; null for others.

    A tag that is not closed ends where the tag around it does, or at the end of the document."""
    parts, found = F.col("parts"), F.element_at(F.col("nest"), (k + 1).cast("int"))
    here, first = F.element_at(parts, (2 * k + 2).cast("int")), 2 * k + 2
    last = 2 * found["end"] + F.when(found["own"], 2).otherwise(1)
    whole = F.array_join(F.slice(parts, first.cast("int"), (last - first + 1).cast("int")), "")
    return F.when(here.rlike(r"(?i)^<(?:" + "|".join(WHOLE_TAGS) + r")(?=[\s>/])"), whole)


def tags(docs: DataFrame, elements: bool = True) -> DataFrame:
    """Opening tags only: doc_id, pos, line, name, tag, body, element."""
    return tokens(docs, elements).where(F.col("kind") == "open").drop("kind", "raw")


def attribute_list(tag: Column) -> Column:
    """Attributes of an opening tag in source order: array of (name, value), names lower-cased."""
    inner = F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*", "")

    def pair(a: Column) -> Column:
        name = F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1))
        value = F.regexp_extract(a, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
        bare = tx.unescape(F.regexp_replace(value, r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2"))
        listed = F.trim(F.regexp_replace(bare, r"\s+", " "))
        return F.struct(
            name.alias("name"), F.when(name.isin(*LIST_ATTRIBUTES), listed).otherwise(bare).alias("value"),
            (~F.contains(a, F.lit("="))).alias("bare"),
        )

    return F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), pair)


def attributes(docs: DataFrame) -> DataFrame:
    """One row per attribute: doc_id, pos, line, tag name, idx, attribute name and value."""
    found = explode_rows(tags(docs, False), ["doc_id", "pos", "line", "name"], attribute_list(F.col("tag")), "idx", "a")
    return found.select("doc_id", "pos", "line", "name", "idx", F.col("a.name").alias("attr"), F.col("a.value").alias("value"))


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute out of an :func:`attribute_list`; null when absent."""
    found = F.filter(attrs, lambda a: a["name"] == name)
    return F.try_element_at(F.transform(found, lambda a: a["value"]), F.lit(1))


def events(docs: DataFrame) -> DataFrame:
    """Inline event attributes as ``name='value'``."""
    return attributes(docs).where(F.col("attr").startswith("on")).select(
        "doc_id", "pos", "line", "name", "idx",
        F.concat("attr", F.lit("='"), "value", F.lit("'")).alias("event"),
    )


def logic(docs: DataFrame) -> DataFrame:
    """Embedded logic: doc_id, pos, line, kind (scriptlet, expression, declaration), code, line_count."""
    kind = (
        F.when(F.col("raw").startswith("<%="), "expression")
        .when(F.col("raw").startswith("<%!"), "declaration")
        .otherwise("scriptlet")
    )
    return tokens(docs, False).where(F.col("kind") == "logic").select(
        "doc_id", "pos", "line", kind.alias("kind"), F.col("body").alias("code"),
        (tx.newlines(F.col("body")) + 1).alias("line_count"),
        tx.shorten(tx.squeeze(F.col("raw")), 200).alias("display"),
    )


def includes(docs: DataFrame) -> DataFrame:
    """Static includes: doc_id, pos, line, file."""
    return tokens(docs, False).where(F.col("kind") == "include").select(
        "doc_id", "pos", "line", F.regexp_extract("raw", STATIC_INCLUDE, 1).alias("file")
    )


def functions_in(body: Column) -> Column:
    """Function definitions of one script: array of (name, raw, line offset), first definition of a name only."""
    found = _matches(body, JS_FUNCTION)
    named = F.transform(
        found,
        lambda m: F.struct(
            F.coalesce(
                F.nullif(F.regexp_extract(m["raw"], JS_FUNCTION, 1), F.lit("")),
                F.regexp_extract(m["raw"], JS_FUNCTION, 2),
            ).alias("name"),
            m["raw"].alias("raw"), m["offset"].alias("offset"),
        ),
    )
    return _first_by_name(named)


def bindings_in(body: Column) -> Column:
    """Event bindings of one script: array of (``target → handler``, raw, line offset), distinct."""

    def describe(m: Column) -> Column:
        group = lambda i: F.regexp_extract(m["raw"], JS_EVENT, i)
        assigned = F.length(group(1)) > 0
        target = F.when(assigned, group(1)).otherwise(F.concat(group(4), F.lit(".on('"), group(5), F.lit("')")))
        handler = F.when(assigned, group(3)).otherwise(group(6))
        shown = F.when(handler == "function", "(anonymous)").otherwise(handler)
        return F.struct(
            F.concat(target, F.lit(" → "), shown).alias("name"), m["raw"].alias("raw"), m["offset"].alias("offset")
        )

    return _first_by_name(F.transform(_matches(body, JS_EVENT), describe))


def _matches(body: Column, pattern: str) -> Column:
    """All matches with the number of newlines before each. The pattern runs only if it matches at all."""
    cut = F.transform(F.array(tx.cut(body, pattern)), lambda p: F.zip_with(
        tx.match_lines(p),
        F.filter(p, lambda _, i: i % 2 == 1),
        lambda line, raw: F.struct(raw.alias("raw"), (line - 1).alias("offset")),
    ))
    return F.flatten(cut)


def _first_by_name(found: Column) -> Column:
    """Keep the first entry of each name, in order. The one-element arrays bind entries and names once."""

    def firsts(entries: Column) -> Column:
        names = F.array(F.transform(entries, lambda x: x["name"]))
        return F.flatten(
            F.transform(names, lambda n: F.filter(entries, lambda x, i: F.array_position(n, x["name"]) == i + 1))
        )

    return F.flatten(F.transform(F.array(found), firsts))


def inline_scripts(docs: DataFrame) -> DataFrame:
    """Script tags without a source: doc_id, pos, line, body."""
    source = F.coalesce(attribute(attribute_list(F.col("tag")), "src"), F.lit(""))
    return tags(docs, False).where((F.col("name") == "script") & (source == "")).select("doc_id", "pos", "line", "body")


def script_functions(docs: DataFrame) -> DataFrame:
    return _script_facts(docs, functions_in)


def script_bindings(docs: DataFrame) -> DataFrame:
    return _script_facts(docs, bindings_in)


def _script_facts(docs: DataFrame, extract) -> DataFrame:
    found = explode_rows(inline_scripts(docs), ["doc_id", "pos", "line"], extract(F.col("body")), "idx", "f")
    return found.select("doc_id", "pos", "idx", (F.col("line") + F.col("f.offset")).alias("line"), "f.name", "f.raw")


def calls(docs: DataFrame, pattern: str) -> DataFrame:
    """Calls in inline scripts: ``pattern`` has one group, the name; each name once per script, with its count."""
    found = F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    return (
        explode_rows(inline_scripts(docs), ["doc_id", "pos"], found, "idx", "name")
        .groupBy("doc_id", "pos", "name")
        .agg(F.count("*").alias("n_calls"))
    )


def links(docs: DataFrame) -> DataFrame:
    """Dependency facts: dynamic include page, script source or inline, link target, and type/value/name fields."""
    n, attrs = F.col("name"), F.col("attrs")
    plain = ~(n.startswith("form:") | n.startswith("c:") | n.startswith("fmt:"))

    def fact(when: Column, kind: str, target: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("dep_kind"), target.alias("target")))

    def field(name: str) -> Column:
        return fact(plain & attribute(attrs, name).isNotNull(), name, attribute(attrs, name))

    blank = F.lit("")
    src = F.coalesce(attribute(attrs, "src"), blank)
    found = F.array(
        fact(n == "jsp:include", "include", F.coalesce(attribute(attrs, "page"), blank)),
        fact((n == "script") & (src != ""), "script", src),
        fact((n == "script") & (src == ""), "script", F.lit("inline")),
        fact((n == "a") & attribute(attrs, "href").isNotNull(), "link", attribute(attrs, "href")),
        field("type"), field("value"), field("name"),
    )
    listed = tags(docs, False).withColumn("attrs", attribute_list(F.col("tag")))
    return inline_rows(listed, ["doc_id", "pos", "line", "name"], F.array_compact(found))


def family(name: Column) -> Column:
    return (
        F.when(name.startswith("form:"), "form")
        .when(name.startswith("c:") | name.startswith("fmt:"), "control")
        .when(name == "jsp:include", "include")
        .when(name == "script", "script")
        .otherwise("plain")
    )


def display_name(name: Column) -> Column:
    """Lower-cased control tags back to their usual spelling."""
    return tx.relabel(name, CONTROL_TAGS)


def labelled_attributes(docs: DataFrame) -> DataFrame:
    """Known attributes of form and control tags under their usual names: doc_id, pos, line, name, place (in the list of known
    names, from 1), attr, label, marker (empty for most) and value. Empty values are shown, other attributes are not."""
    form = family(F.col("name")) == "form"
    control = family(F.col("name")) == "control"

    def by_family(of_form: Column, of_control: Column) -> Column:
        return F.when(form, of_form).when(control, of_control)

    def place(known: dict) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in known]), F.col("attr")).cast("int")

    def marker(marks: dict) -> Column:
        return F.when(F.col("attr").isin(*marks), tx.relabel(F.col("attr"), marks)).otherwise("")

    return attributes(docs).where(form | control).select(
        "doc_id", "pos", "line", "name", by_family(place(FORM_ATTRIBUTES), place(CONTROL_ATTRIBUTES)).alias("place"), "attr",
        by_family(tx.relabel(F.col("attr"), FORM_ATTRIBUTES), tx.relabel(F.col("attr"), CONTROL_ATTRIBUTES)).alias("label"),
        by_family(marker(FORM_MARKERS), marker(CONTROL_MARKERS)).alias("marker"), "value",
    ).where("place > 0")


def text_nodes(docs: DataFrame, static: bool = True) -> DataFrame:
    """Text of a document: doc_id, pos (of the markup it belongs to, -1 before the first), kind, el, text.

    kind is ``text`` between markup, or comment, doctype or script for text inside it. ``el`` joins the EL
    expressions by blanks; ``text`` is what remains and ``shown`` the same cut to 200 characters for display. ``static=False``
    keeps only nodes with EL and drops their plain text.
    """

    def node(part: Column, i: Column) -> Column:
        between = i % 2 == 0
        inner = (
            F.when(between, tx.unescape(part))
            .when(part.startswith("<!--"), F.regexp_extract(part, r"(?s)^<!--(.*)-->$", 1))
            .when(part.rlike("(?i)^<!doctype"), F.regexp_extract(part, r"(?is)^<!doctype\s*(.*)>$", 1))
            .when(part.rlike(r"(?i)</(?:script|style)\s*>$"), F.regexp_extract(part, r"(?is)^<(?:script|style)[^>]*>(.*)</\w+\s*>$", 1))
            .otherwise("")
        )
        kind = (
            F.when(between, "text").when(part.startswith("<!--"), "comment").when(part.startswith("<!"), "doctype").otherwise("script")
        )
        # Text at part i follows markup i / 2 - 1; markup at part i is number (i - 1) / 2.
        pos = F.floor((i - 1) / F.lit(2)).cast("int")
        return F.struct(pos.alias("pos"), kind.alias("kind"), tx.strip(inner).alias("node"))

    parted = docs.select("doc_id", tx.cut(clean(F.col("text")), PIECE).alias("parts"))
    nodes = F.filter(F.transform(F.col("parts"), node), lambda n: F.length(n["node"]) > 0)
    el = F.array_join(F.regexp_extract_all("node", F.lit(f"({EL})"), F.lit(1)), " ")
    rest = tx.strip(F.regexp_replace("node", EL, ""))
    rows = inline_rows(parted, ["doc_id"], nodes).select("doc_id", "pos", "kind", el.alias("el"), rest.alias("text"))
    rows = rows.withColumn("shown", tx.shorten(F.col("text"), 200))
    return rows if static else rows.where(F.length("el") > 0).withColumns({"text": F.lit(""), "shown": F.lit("")})


def tag_snippet(name: Column, tag: Column, element: Column) -> Column:
    """Source shown for a tag: the whole element for ``WHOLE_TAGS``, the opening tag for every other tag. Attributes that count
    by being there are shown without their empty value."""
    shown = F.when(name.isin(*WHOLE_TAGS), F.coalesce(element, tag)).otherwise(tag)
    bare = r"(?i)(\s(?:" + "|".join(BARE_ATTRIBUTES) + r"))\s*=\s*(?:\"\"|'')"
    return F.when(F.contains(shown, F.lit('""')) | F.contains(shown, F.lit("''")), F.regexp_replace(shown, bare, "$1")).otherwise(shown)


def depth(docs: DataFrame, implied: bool = False) -> DataFrame:
    """Nesting depth of each opening tag: doc_id, pos, name and the number of tags open around it."""
    return structure(docs, implied).select("doc_id", "pos", "name", "depth")


def structure(docs: DataFrame, implied: bool = False) -> DataFrame:
    """Where each opening tag stands: doc_id, pos, name, depth, parent (position of the tag around it, or null), end (position of
    the token that ends it, or null at the end of the document) and closed (whether that is its own end tag).

    End tags end what is open in their element, and stray ones count for nothing; with ``implied``, tags such as ``li``
    and ``p`` also end their predecessors. One pass over the tags of a document, no shuffle.
    """
    names = F.transform(F.filter("parts", lambda _, i: i % 2 == 1), lambda p: F.struct(p.rlike("^<[A-Za-z]").alias("opens"), _tag_name(p).alias("name")))
    found = F.zip_with(names, F.col("nest"), lambda x, n: F.struct(x["opens"].alias("opens"), x["name"].alias("name"), n.alias("n")))
    rows = explode_rows(nested(docs, implied).withColumn("size", F.size("nest")), ["doc_id", "size"], found, "pos", "t").where("t.opens")
    number = lambda c, lost: F.when(~lost, F.col(c))
    return rows.select(
        "doc_id", "pos", F.col("t.name").alias("name"), F.col("t.n.depth").alias("depth"), number("t.n.parent", F.col("t.n.parent") < 0).alias("parent"),
        number("t.n.end", F.col("t.n.end") >= F.col("size")).alias("end"), F.col("t.n.own").alias("closed"),
    )
