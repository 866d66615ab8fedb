"""The stack of open tags against a plain reader, and elements shown whole."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import markup as mk
from docloom.operators import rules as ru
from docloom.operators.nesting import IMPLIED_ENDS

TAG = re.compile(r"(?s)<!--.*?-->|</?([A-Za-z][^\s/>]*)[^>]*>")


def plain(text, implied=False):
    """(pos, name, depth, parent, end, closed) of each opening tag, each looked up by walking the list of open tags."""
    marks = [(m.group(0), (m.group(1) or "").lower()) for m in TAG.finditer(text)]
    out, opened = {}, []

    def drop(level, at, own):
        for k, (pos, _) in enumerate(opened[level:]):
            out[pos][4:] = [at, own and k == 0]
        del opened[level:]

    for pos, (raw, name) in enumerate(marks):
        if raw.startswith("<!--"):
            continue
        if raw.startswith("</"):
            levels = [k for k, (_, n) in enumerate(opened) if n == name]
            if levels:
                drop(levels[-1], pos, True)
            continue
        if implied and name in IMPLIED_ENDS:
            ends, stops = IMPLIED_ENDS[name]
            low = max([k for k, (_, n) in enumerate(opened) if n in stops], default=-1)
            levels = [k for k, (_, n) in enumerate(opened) if n in ends and k > low]
            if levels:
                drop(levels[0], pos, False)
        out[pos] = [pos, name, len(opened), opened[-1][0] if opened else None, None, False]
        if raw.endswith("/>") or name in mk.VOID_TAGS:
            out[pos][4:] = [pos, True]
        else:
            opened.append((pos, name))
    return sorted(tuple(v) for v in out.values())


@pytest.mark.parametrize("implied", [False, True])
def test_structure_against_plain_reader(spark, implied):
    draw = random.Random(3)
    names = ["div", "p", "li", "ul", "ol", "b", "td", "tr", "table", "tbody", "dd", "dl", "option", "select", "br", "c:if", "Form:Input", "h1", "button"]
    texts = ["", "no tags", "<ul><li>a<li>b</ul><p>", "</p></div>x", "<b><i></b></i><u>", "<p><p><p>", "<br></br><img/>", "<table><tr><td>a<td>b<tr><td><p>c<ul><li>d<li>e</table>f"]
    for _ in range(200):
        texts.append("".join(draw.choice(["<{}>", "<{}>", "</{}>", "<{} a='1'/>", "<!-- {} -->", "text"]).format(draw.choice(names)) for _ in range(draw.randint(0, 60))))
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string").repartition(4)
    found = {}
    for r in mk.structure(docs, implied).collect():
        found.setdefault(r["doc_id"], []).append((r["pos"], r["name"], r["depth"], r["parent"], r["end"], r["closed"]))
    for k, text in enumerate(texts):
        assert sorted(found.pop(k, [])) == plain(text, implied), text
    assert not found


def test_depth_without_shuffle(spark):
    docs = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>")], "doc_id int, text string")
    assert [(r["name"], r["depth"]) for r in mk.depth(docs).orderBy("pos").collect()] == [("ul", 0), ("li", 1), ("li", 2), ("p", 0)]
    assert [(r["name"], r["depth"]) for r in mk.depth(docs, implied=True).orderBy("pos").collect()] == [("ul", 0), ("li", 1), ("li", 1), ("p", 0)]
    assert "Exchange" not in mk.depth(docs)._jdf.queryExecution().executedPlan().toString()


def test_elements_shown_whole(spark):
    text = '<form:input path="x" disabled="" title="">in<b>side</b></form:input><a href="u">open <i>to</i> the end <input checked="" value="">'
    tags = mk.tags(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    shown = [r["s"] for r in tags.select(mk.tag_snippet(F.col("name"), F.col("tag"), F.col("element")).alias("s")).collect()]
    assert shown == [
        '<form:input path="x" disabled title="">in<b>side</b></form:input>', "<b>", '<a href="u">open <i>to</i> the end <input checked value="">', "<i>", '<input checked value="">',
    ]


def test_expressions_in_broken_markup(spark):
    text = "<div><p>a<p title='t'>${x > 1}</div>${y > 2}<ul><li>k<li>${z > 3}<!-- ${c > 4} --></ul></li>${w > 5}"
    hits = ru.hits(spark.createDataFrame([(1, text)], "doc_id int, text string")).where("rule_id = 'complex_el'")
    assert {(r["snippet"], r["raw"]) for r in hits.collect()} == {
        ("${x > 1}", "<p title='t'>"), ("${y > 2}", "${y > 2}"), ("${z > 3}", "<li>"), ("${c > 4}", "<li>"), ("${w > 5}", "${w > 5}"),
    }


def test_many_expressions_in_linear_time(spark):
    def spent(n):
        docs = spark.createDataFrame([(1, "<div>" + "<p>${a > 1}</p><i>" * n)], "doc_id int, text string")
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            assert ru.hits(docs).count() == n
            best = min(best, time.perf_counter() - start)
        return best

    assert spent(2000) < 2 * spent(1000) + 0.5
