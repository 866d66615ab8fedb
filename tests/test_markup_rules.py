import pytest
from pyspark.sql import functions as F

from docloom.operators import markup as mk
from docloom.operators import rules as ru
from docloom.operators.rules import Rule

PAGE = """<%-- c
c --%><%@ page language="java" %>
<%@ include file="/inc/h.jsp" %>
<div class="a  b" id='x'>
<%! int i;
 %><% if (a<b) { %>
<a href="javascript:void(0)"
  onclick="go('1')"><b>t</b> ${x == 1} y</a><p>${name}<br/>q
<form:input path="p" cssClass="${a && b}" disabled data="a=b ${c}"/>
<script>
function f(a){}
const g = (a) => a; let h = x => x;
function f(){}
window.onload = init; btn.addEventListener('click', function(){});
</script><!-- ${cc > 1} --><font>z</font><%= v %></div>"""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PAGE), (2, "plain ${q>1} text"), (3, ""), (4, "<A HREF=x.html>k<i>l</A>\n<c:forEach items='${l}' var='v'/>")]
    return spark.createDataFrame(rows, "doc_id int, text string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_hits_in_traversal_order(docs):
    found = ru.hits(docs).where("doc_id = 1").orderBy("pos", "phase", "idx").select("rule_id", "line", "line_count", "snippet")
    assert [tuple(r) for r in found.collect()] == [
        ("jsp_declaration", 5, 2, "declaration"),
        ("scriptlet", 6, 1, "scriptlet"),
        ("javascript_pseudo_url", 7, None, "javascript:void(0)"),
        ("inline_event", 7, None, "onclick='go('1')'"),
        ("complex_el", 7, None, "${x == 1}"),
        ("boolean_attr", 9, None, "disabled"),
        ("complex_el", 9, None, "${a && b}"),
        ("complex_el", 9, None, "a=b ${c}"),
        ("js_function", 11, None, "f"),
        ("js_function", 12, None, "g"),
        ("js_function", 12, None, "h"),
        ("js_event_bind", 14, None, "window.onload → init"),
        ("js_event_bind", 14, None, "btn.on('click') → (anonymous)"),
        ("complex_el", 8, None, "${cc > 1}"),
        ("deprecated_tag", 15, None, "font"),
        ("jsp_expression", 15, 1, "expression"),
    ]


def test_raw_source(docs):
    found = {r.rule_id: r.raw for r in ru.hits(docs).where("doc_id = 1").collect()}
    assert found["inline_event"] == "<a href=\"javascript:void(0)\"\n  onclick=\"go('1')\"><b>t</b> ${x == 1} y</a>"
    assert found["scriptlet"] == "<% if (a<b) { %>"
    assert found["jsp_declaration"] == "<%! int i;\n %>"
    assert found["deprecated_tag"] == "<font>"


def test_text_without_markup(docs):
    assert rows(ru.hits(docs).where("doc_id = 2").select("rule_id", "line", "snippet"), "rule_id") == [("complex_el", 0, "${q>1}")]
    assert ru.hits(docs).where("doc_id = 3").count() == 0


def test_tags_and_attributes(docs):
    assert rows(mk.tags(docs).where("doc_id = 4").select("pos", "line", "name", "tag", "element"), "pos") == [
        (0, 1, "a", "<A HREF=x.html>", "<A HREF=x.html>k<i>l</A>"),
        (1, 1, "i", "<i>", None),
        (3, 2, "c:foreach", "<c:forEach items='${l}' var='v'/>", None),
    ]
    assert rows(mk.attributes(docs).where("doc_id = 4").select("pos", "attr", "value"), "pos", "idx") == [
        (0, "href", "x.html"), (3, "items", "${l}"), (3, "var", "v"),
    ]
    assert ("class", "a b") in rows(mk.attributes(docs).select("attr", "value"), "attr")


def test_long_tags_do_not_overflow(spark):
    text = "<a " + "x='1' " * 30000 + ">" + "t" * 10 + "</a>" + "<!-- " + "c" * 200000 + " -->"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert mk.tokens(docs).count() == 3
    assert mk.attributes(docs).count() == 30000


def test_structure(docs):
    assert rows(mk.includes(docs).select("doc_id", "line", "file"), "doc_id") == [(1, 3, "/inc/h.jsp")]
    assert [r.display for r in mk.logic(docs).orderBy("pos").collect()] == ["<%! int i; %>", "<% if (a<b) { %>", "<%= v %>"]
    depth = {r.name: r.depth for r in mk.depth(docs).where("doc_id = 1").collect()}
    assert (depth["div"], depth["a"], depth["b"], depth["br"]) == (0, 1, 2, 2)
    assert rows(mk.text_nodes(docs).where("doc_id = 2").select("el", "text"), "el") == [("${q>1}", "plain  text")]
    kinds = rows(mk.text_nodes(docs).where("doc_id = 1 and kind <> 'text'").select("kind", "el"), "pos")
    assert kinds == [("script", ""), ("comment", "${cc > 1}")]
    assert mk.text_nodes(docs, static=False).where("doc_id = 1 and kind = 'text'").count() == 2
    assert rows(mk.links(docs).select("dep_kind", "target"), "doc_id", "pos") == [
        ("link", "javascript:void(0)"), ("script", "inline"), ("link", "x.html"),
    ]
    assert mk.strip_comments(F.lit("a<!-- x\n --><%-- y --%>b")) is not None


def test_labels_and_families(value):
    assert value(mk.display_name(F.lit("fmt:settimezone"))) == "fmt:setTimeZone"
    assert value(mk.display_name(F.lit("div"))) == "div"
    for name, want in {"form:input": "form", "c:if": "control", "fmt:x": "control", "jsp:include": "include", "script": "script", "p": "plain"}.items():
        assert value(mk.family(F.lit(name))) == want


def test_labelled_attributes(spark):
    text = """<form:form modelAttribute="m" METHOD='post' id=x><c:if test="${a}" path="p"><fmt:formatDate value="" VAR=v /><p path="q">"""
    found = mk.labelled_attributes(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))
    assert rows(found.select("name", "place", "label", "marker", "value"), "name", "place") == [
        ("c:if", 1, "test", "❓", "${a}"), ("fmt:formatdate", 2, "var", "🆔", "v"), ("fmt:formatdate", 4, "value", "", ""),
        ("form:form", 1, "modelAttribute", "📦", "m"), ("form:form", 5, "method", "", "post"),
    ]


def test_first_rule_wins_in_both_forms(spark, docs):
    rules = (
        Rule("i_first", "i", "低", "html_tag", "", pattern="^i$"),
        Rule("any", "any", "高", "html_tag", ""),
        Rule("never", "never", "中", "html_tag", "", pattern="^i$"),
    )
    want = {("i", "i_first"), ("a", "any"), ("c:foreach", "any")}
    found = ru.hits(docs.where("doc_id = 4"), rules)
    assert {(r.snippet, r.rule_id) for r in found.collect()} == want
    cand = ru.candidates(docs.where("doc_id = 4"), ["html_tag"]).select("doc_id", "pos", "target", "kind", "value")
    by_table = ru.first_match(cand, ["doc_id", "pos"], ru.rule_table(spark, rules))
    assert {(r.value, r.rule_id) for r in by_table.collect()} == want
    assert rows(ru.summary(found, rules).select("rule_id", "n_hits"), "grade", "rule_id") == [("any", 2), ("never", 0), ("i_first", 1)]
    logic = ru.candidates(docs.where("doc_id = 1"), ["jsp-logic"]).select("doc_id", "pos", "target", "kind", "value")
    by_kind = ru.first_match(logic, ["doc_id", "pos"], ru.rule_table(spark, ru.DEFAULT_RULES))
    assert {r.rule_id for r in by_kind.collect()} == {"jsp_declaration", "scriptlet", "jsp_expression"}


def test_reports_include_zeros(docs):
    found = ru.hits(docs)
    pivot = {r.doc_id: r for r in ru.pivot_by_document(docs, found).collect()}
    assert (pivot[3].scriptlet, pivot[1].complex_el, pivot[2].complex_el) == (0, 4, 1)
    assert tuple(ru.totals(docs, found).first()) == (4, found.count())
    assert ru.summary(found).count() == 10
    assert ru.report(found).columns == ["file", "line", "line_count", "complexity", "rule_name", "snippet", "raw"]


def test_top_documents(spark):
    counts = {"a": 3, "b": 2, "c": 2, "d": 1}
    found = spark.createDataFrame([(d,) for d, n in counts.items() for _ in range(n)], "doc_id string")
    assert rows(ru.top_documents(found), F.desc("n_hits"), "doc_id") == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]


@pytest.mark.parametrize("el,hit", [("${a == b}", True), ("${name}", False), ("a=b ${c}", True)])
def test_complex_el(value, el, hit):
    no = ru.rule_index(ru.DEFAULT_RULES, F.lit("el_expression"), F.lit(""), F.lit(el))
    assert (value(no) is not None) == hit


@pytest.mark.parametrize("tag,hit", [("font", True), ("fonts", False), ("u", True)])
def test_deprecated(value, tag, hit):
    assert (value(ru.rule_index(ru.DEFAULT_RULES, F.lit("html_tag"), F.lit(""), F.lit(tag))) is not None) == hit
