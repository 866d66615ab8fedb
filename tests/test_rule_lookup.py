"""Rules looked up by texts their matches must hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import rules as ru
from docloom.operators.literals import required_literals
from docloom.operators.rules import Rule


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        ("javascript:", {"javascript:"}),
        ("(?i)^On[A-Z]+Click$", {"click"}),
        ("^(font|center|u)$", {"font", "center", "u"}),
        (r"a\.b\+c", {"a.b+c"}),
        ("ab+c", {"ab"}),
        ("ab?cd", {"cd"}),
        ("ab{2,}cde", {"cde"}),
        ("(?:xyz)*q", {"q"}),
        ("(?:xyz){1,3}q", {"xyz"}),
        ("(?=long text)b", {"b"}),
        ("(?<name>abc)d", {"abc"}),
        ("[a[b]c&&d]ef", {"ef"}),
        ("Größe", {"größe"}),
        (".*[=!<>|&]+.*", None),
        ("a|", None),
        ("(a|b*)", None),
        ("", None),
        (r"\Qa.b\E", None),
        (r"(?x)a b", None),
        (r"(a)\1b", None),
        (r"\x41b", None),
        ("[]a]b", None),
        ("(" * 3000 + "a" + ")" * 3000, None),
        ("a)b", None),
        ("a\\", None),
        ("a{,3}", None),
    ],
)
def test_required_texts(pattern, texts):
    found = required_literals(pattern)
    assert found == (None if texts is None else frozenset(texts))


def _pattern(draw, depth=0):
    def atom():
        kind = draw.randrange(8)
        if kind < 4 or depth > 2:
            return draw.choice(["a", "b", "c", "A", r"\.", "é"])
        if kind == 4:
            return draw.choice([".", "[ab]", r"\w", "[^a]", "^", "$"])
        inner = _pattern(draw, depth + 1)
        return draw.choice(["(", "(?:", "(?=", "(?!", "(?i:"]) + inner + ")"

    def counted():
        x = atom()
        return x if x in "^$" or x.startswith(("(?=", "(?!")) else x + draw.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"])

    return "|".join("".join(counted() for _ in range(draw.randint(1, 4))) for _ in range(draw.choice([1, 1, 2])))


def test_every_match_holds_a_text():
    draw = random.Random(5)
    told = 0
    for _ in range(4000):
        pattern = _pattern(draw)
        texts = required_literals(pattern)
        if texts is None:
            continue
        told += 1
        for _ in range(20):
            value = "".join(draw.choice("abcABC.éx") for _ in range(draw.randint(0, 8)))
            if re.search(pattern, value, re.ASCII | re.IGNORECASE):
                assert any(t in value.lower() for t in texts), (pattern, value, texts)
    assert told > 1500


@pytest.fixture(scope="module")
def many():
    draw = random.Random(3)
    rules = [Rule(f"r{i}", "", "", draw.choice(["x", "y"]), "", draw.choice([None, None, "k"]), _pattern(draw)) for i in range(400)]
    rules[7] = Rule("r7", "", "", "x", "", "k", None)
    return rules


@pytest.fixture(scope="module")
def values(spark):
    draw = random.Random(4)
    rows = [
        (i, draw.choice(["x", "y", "z", None]), draw.choice(["k", "", None]), "".join(draw.choice("abcABC.é x") for _ in range(draw.randint(0, 6))))
        for i in range(300)
    ]
    rows += [(300, "x", "k", None), (301, "x", "", None), (303, "x", "", "\U0001f600é")]
    return spark.createDataFrame(rows * 2, "id int, target string, kind string, value string")


def test_first_rule_as_tried_one_by_one(spark, many, values):
    tried = values.select("id", ru.rule_index(many, F.col("target"), F.col("kind"), F.col("value")).alias("no")).where("no is not null")
    found = values.select("id", F.explode(ru.first_fitting(many, F.col("target"), F.col("kind"), F.col("value"))).alias("no"))
    want = sorted(map(tuple, tried.collect()))
    assert sorted(map(tuple, found.collect())) == want
    table = ru.rule_table(spark, many)
    ids = sorted((r["id"], f"r{r['no']}") for r in tried.collect())
    looked_up = ru.first_match(values, ["id"], table)
    assert looked_up.columns == ["id", "target", "value", "rule_id"]
    assert sorted((r["id"], r["rule_id"]) for r in looked_up.collect()) == ids


def test_a_table_too_large_to_fetch_gives_the_same(spark, many, values, monkeypatch):
    table = ru.rule_table(spark, many)
    near = sorted(map(str, ru.first_match(values, ["id"], table).collect()))
    monkeypatch.setattr(ru, "MOST_RULES", 10)
    assert sorted(map(str, ru.first_match(values, ["id"], table).collect())) == near


def test_long_lists_over_documents(spark):
    long = "z" * 50_000
    docs = spark.createDataFrame([(1, "<a href='/x1'>t</a><b>"), (2, None), (3, ""), (4, f"<a href='/x2{long}'>")], "doc_id int, text string")
    rules = [Rule(f"n{i}", f"name {i}", "高", "html_attr_value", "", pattern=f"^/x{i}$") for i in range(3000)]
    found = ru.hits(docs, rules)
    assert [(r.doc_id, r.rule_id, r.rule_name) for r in found.collect()] == [(1, "n1", "name 1")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().nodeName()
    summed = ru.summary(found, rules)
    assert summed.count() == 3000 and [(r.rule_id, r.n_hits) for r in summed.where("n_hits > 0").collect()] == [("n1", 1)]
    assert ru.first_match(docs.selectExpr("doc_id", "'x' as target", "'' as kind", "text as value"), ["doc_id"], ru.rule_table(spark, rules[:1]).limit(0)).count() == 0
