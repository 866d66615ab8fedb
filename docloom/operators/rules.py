"""Rule matching over markup candidates, with first-match semantics, and the reports built on the hits."""

from __future__ import annotations

import json
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import markup as mk
from docloom.operators.literals import required_literals
from docloom.operators.rows import explode_rows, inline_rows

FEW_RULES = 100  # up to here rules are tried one after the other, beyond it they are looked up
MOST_RULES, MOST_CHARS = 20_000, 4_000_000  # a rule table of this size is fetched and becomes part of the plan
GRAM = 4  # characters of a pattern's text that are looked up


@dataclass(frozen=True)
class Rule:
    """``target`` says which candidates are tested, ``kind`` narrows embedded logic, ``pattern`` is searched in the value."""

    id: str
    name: str
    complexity: str
    target: str
    description: str
    kind: str | None = None
    pattern: str | None = None


# The default rules, in order of precedence.
DEFAULT_RULES = (
    Rule("scriptlet", "スクリプトレット(<% %>)", "高", "jsp-logic", "バックエンドAPI等への移行が必要", kind="scriptlet"),
    Rule("jsp_declaration", "JSP宣言(<%! %>)", "高", "jsp-logic", "バックエンドAPI等への移行が必要", kind="declaration"),
    Rule("jsp_expression", "JSP式(<%= %>)", "中", "jsp-logic", "直接的な出力。JSフレームワークのデータバインディング記法へ移行が必要", kind="expression"),
    Rule("js_event_bind", "JSイベントバインド", "中", "js_event", "React/Vue等のライフサイクルフックへの移行が必要"),
    Rule("js_function", "JS関数定義", "中", "js_function", "コンポーネント内メソッド等への移行が必要"),
    Rule("inline_event", "インラインイベント", "低", "inline_event", "JSXのイベントハンドラ(onClick等)へ移行"),
    Rule("complex_el", "複雑なEL式", "中", "el_expression", "Vue/Reactの算出プロパティや条件付きレンダリングへ移行", pattern=r".*[=!<>|&]+.*"),
    Rule("deprecated_tag", "非推奨HTMLタグ", "低", "html_tag", "CSSでのスタイリングへ移行が必要", pattern=r"^(font|center|marquee|blink|strike|u)$"),
    Rule("boolean_attr", "Boolean属性", "低", "html_attr_name", "React/Vueでは動的バインディング(props)への書き換えが必要", pattern=r"^(checked|disabled|readonly|selected|multiple)$"),
    Rule("javascript_pseudo_url", "JavaScript疑似URL", "低", "html_attr_value", "イベントハンドラまたはRouter遷移への書き換えが必要", pattern=r"javascript:"),
)

# Report order of the complexity grades; anything else sorts last.
COMPLEXITY_ORDER = {"高": 1, "中": 2, "低": 3}


def rule_index(rules: Sequence[Rule], target: Column, kind: Column, value: Column) -> Column:
    """Position of the first rule that fits, or null. One conditional chain; patterns are literals."""

    def fits(r: Rule) -> Column:
        test = target == r.target
        if r.kind is not None:
            test = test & (kind == r.kind)
        if r.pattern:
            test = test & value.rlike(r.pattern)
        return test

    return F.coalesce(*[F.when(fits(r), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))


def first_fitting(rules: Sequence[Rule], target: Column, kind: Column, value: Column) -> Column:
    """The position of the first rule that fits as an array of one, or an empty one: ``rule_index`` for long lists.

    Every match of a pattern holds one of its texts (``required_literals``), so a rule is tried only where a piece of such a
    text, up to four characters and the rarest of the list, stands in the value. The pieces are one constant hash table,
    and a value is cut into its pieces once, whatever the number of rules. Rules without such texts are always tried.
    """
    texts = [(i, r.target, required_literals(r.pattern) if r.pattern else None) for i, r in enumerate(rules)]
    times = Counter((t, piece) for _, t, found in texts for x in found or () for piece in set(_pieces(x)))
    entries = defaultdict(set)
    for i, t, found in texts:
        for piece in {""} if found is None else {min(_pieces(x), key=lambda g, t=t: (times[t, g], g)) for x in found}:
            entries[f"{t}\0{piece}"].add(i)
    n = 2 * len(entries) + 1
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for key, numbers in entries.items():
        buckets[zlib.crc32(key.encode()) % n].append({"key": key, "rules": sorted(numbers)})
    table = _constant(buckets, "array<array<struct<key:string,rules:array<int>>>>")
    listed = _constant([{"kind": r.kind, "pattern": r.pattern or None} for r in rules], "array<struct<kind:string,pattern:string>>")

    sizes = sorted({len(key) - key.index("\0") - 1 for key in entries} - {0})
    folded = F.translate(F.coalesce(value, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    cut = [F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes]

    def met(piece: Column) -> Column:
        key = F.concat(target, F.lit("\0"), piece)
        bucket = F.element_at(table, (F.crc32(F.encode(key, "UTF-8")) % n + 1).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["key"] == key), lambda e: e["rules"]))

    def fits(no: Column) -> Column:
        rule = F.element_at(listed, no + 1)
        return (rule["kind"].isNull() | (rule["kind"] == kind)) & (rule["pattern"].isNull() | F.regexp_like(value, rule["pattern"]))

    numbers = F.flatten(F.transform(F.array_distinct(F.concat(F.array(F.lit("")), *cut)), met))
    return F.slice(F.filter(F.array_sort(F.array_distinct(numbers)), fits), 1, 1)


def _pieces(text: str) -> list[str]:
    size = min(len(text), GRAM)
    return [text[i : i + size] for i in range(len(text) - size + 1)]


def _constant(rows: list, schema: str) -> Column:
    """Rows as one constant of the plan: the optimizer reads the text once."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


# What a rule can be tested against.
TARGETS = (
    "html_tag", "html_attr_name", "html_attr_value", "el_expression", "inline_event", "js_function", "js_event", "jsp-logic",
)
_CANDIDATE = "phase int, idx int, target string, kind string, value string, raw string, line int, line_count int"


def candidates(docs: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Everything rules are tested against, in traversal order (doc_id, pos, phase, idx).

    Per tag: its name, each attribute name and value, EL and events in attributes, then functions and
    bindings of inline scripts; besides tags, embedded logic and EL in text. Only what ``targets`` name is
    looked for: without rules on attributes, no attribute is parsed.
    """
    t, n, line, zero = F.col("tag"), F.col("name"), F.col("line"), F.lit(0)
    attrs, known = F.col("attrs"), F.col("known")
    none = F.array().cast(f"array<struct<{_CANDIDATE}>>")
    asks = set(targets).__contains__

    def candidate(phase: int, idx: Column, target: str, value: Column, raw: Column, at: Column, kind=None, line_count=None) -> Column:
        return F.struct(
            F.lit(phase).alias("phase"), idx.cast("int").alias("idx"), F.lit(target).alias("target"),
            (F.lit("") if kind is None else kind).alias("kind"), value.alias("value"), raw.alias("raw"),
            at.cast("int").alias("line"), (F.lit(None) if line_count is None else line_count).cast("int").alias("line_count"),
        )

    shown = mk.tag_snippet(n, t, F.col("element"))
    has_el = lambda a: F.contains(a["value"], F.lit("${"))

    def other_attribute(a: Column, i: Column) -> Column:
        event = candidate(3, i, "inline_event", F.concat(a["name"], F.lit("='"), a["value"], F.lit("'")), shown, line)
        el = candidate(3, i, "el_expression", a["value"], shown, line)
        found = F.when(a["name"].startswith("on"), event if asks("inline_event") else F.lit(None))
        return found.when(has_el(a), el) if asks("el_expression") else found

    of_tag = []
    if asks("html_tag"):
        of_tag.append(F.array(candidate(0, zero, "html_tag", n, shown, line)))
    if asks("html_attr_name"):
        of_tag.append(F.transform(attrs, lambda a, i: candidate(1, 2 * i, "html_attr_name", a["name"], shown, line)))
    if asks("html_attr_value"):
        of_tag.append(F.transform(attrs, lambda a, i: candidate(1, 2 * i + 1, "html_attr_value", a["value"], shown, line)))
    if asks("el_expression"):
        of_tag.append(
            F.transform(
                F.filter(attrs, lambda a: F.array_contains(known, a["name"]) & has_el(a)),
                lambda a: candidate(2, F.array_position(known, a["name"]), "el_expression", a["value"], shown, line),
            )
        )
    if asks("el_expression") or asks("inline_event"):
        others = F.filter(attrs, lambda a: ~F.array_contains(known, a["name"]))
        of_tag.append(F.array_compact(F.transform(others, other_attribute)))
    is_inline = (n == "script") & (F.coalesce(mk.attribute(attrs, "src"), F.lit("")) == "")
    def script_facts(phase: int, target: str, found: Column) -> Column:
        facts = F.transform(found, lambda f, i: candidate(phase, i, target, f["name"], f["raw"], line + f["offset"]))
        return F.when(is_inline, facts).otherwise(none)

    if asks("js_function"):
        of_tag.append(script_facts(4, "js_function", mk.functions_in(F.col("body"))))
    if asks("js_event"):
        of_tag.append(script_facts(5, "js_event", mk.bindings_in(F.col("body"))))

    def of_text(text: Column, phase: int, raw: Column, at: Column) -> Column:
        """EL of one text node, its expressions joined by blanks and tested as one value."""
        found = F.array_join(F.regexp_extract_all(text, F.lit(f"({mk.EL})"), F.lit(1)), " ")
        shown_as = lambda el: candidate(phase, zero, "el_expression", el, F.coalesce(raw, el), F.coalesce(at, zero))
        return F.when(
            F.contains(text, F.lit("${")),
            F.transform(F.filter(F.array(found), lambda el: F.length(el) > 0), shown_as),
        ).otherwise(none)

    parent_raw, parent_line = F.col("parent.raw"), F.col("parent.line")
    texts = asks("el_expression")
    if texts:
        of_tag.append(of_text(F.col("body"), 6, t, line))
    found = F.when(F.col("type") == "open", F.concat(none, *of_tag))
    if asks("jsp-logic"):
        logic_kind = (
            F.when(F.col("raw").startswith("<%="), "expression")
            .when(F.col("raw").startswith("<%!"), "declaration")
            .otherwise("scriptlet")
        )
        lines = tx.newlines(F.col("body")) + 1
        logic = candidate(0, zero, "jsp-logic", F.lit(""), F.col("raw"), line, kind=logic_kind, line_count=lines)
        found = found.when(F.col("type") == "logic", F.array(logic))
    if texts:
        found = found.when(F.col("type") == "comment", of_text(F.col("raw"), 6, parent_raw, parent_line))
    found = found.otherwise(none)
    everything = F.concat(found, of_text(tx.unescape(F.col("after")), 7, parent_raw, parent_line)) if texts else found

    no_attributes = F.array().cast("array<struct<name:string,value:string,bare:boolean>>")
    known_names = (
        F.when(n.startswith("form:"), F.array(*[F.lit(k) for k in mk.FORM_ATTRIBUTES]))
        .when(n.startswith("c:") | n.startswith("fmt:"), F.array(*[F.lit(k) for k in mk.CONTROL_ATTRIBUTES]))
        .otherwise(F.array().cast("array<string>"))
    )
    source = mk.tokens_and_text(docs) if texts else mk.tokens(docs)
    rows = (
        source.withColumnRenamed("kind", "type")
        .withColumn("attrs", F.when(F.col("type") == "open", mk.attribute_list(t)).otherwise(no_attributes))
        .withColumn("known", known_names)
    )
    return inline_rows(rows, ["doc_id", "pos"], everything)


def hits(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rule hits with everything the reports show. No shuffle: one pass over the documents."""
    found = candidates(docs, {r.target for r in rules})
    tested = F.col("target"), F.col("kind"), F.col("value")
    if len(rules) > FEW_RULES:
        found = explode_rows(found, found.columns, first_fitting(rules, *tested), "__pos", "rule_no")
    else:
        found = found.withColumn("rule_no", rule_index(rules, *tested))
    shown = tx.snippet(F.when(F.length("kind") > 0, F.col("kind")).otherwise(F.col("value")))
    picked = F.element_at(rule_literals(rules), F.col("rule_no") + 1)
    return found.where(F.col("rule_no").isNotNull()).select(
        "doc_id", "pos", "phase", "idx", "line", "line_count",
        picked["rule_id"].alias("rule_id"), picked["rule_name"].alias("rule_name"), picked["complexity"].alias("complexity"),
        shown.alias("snippet"), tx.strip(F.col("raw")).alias("raw"),
    )


def rule_literals(rules: Sequence[Rule]) -> Column:
    shown = [{"rule_id": r.id, "rule_name": r.name, "complexity": r.complexity, "description": r.description} for r in rules]
    return _constant(shown, "array<struct<rule_id:string,rule_name:string,complexity:string,description:string>>")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows, for rule lists kept as data: ord, rule_id, target, kind, pattern and the report fields."""
    return spark.createDataFrame(
        [(i, r.id, r.name, r.complexity, r.target, r.kind, r.pattern, r.description) for i, r in enumerate(rules)],
        "ord int, rule_id string, rule_name string, complexity string, target string, kind string, pattern string, description string",
    )


def first_match(rows: DataFrame, key: Sequence[str], rules: DataFrame) -> DataFrame:
    """Table-driven form: rows ``(key..., target, kind, value)`` against a rule table, first rule wins.

    A table of at most ``MOST_RULES`` rules is fetched when the plan is built and looked up in place (``first_fitting``): no
    join, one scan of the rows. Rules of a larger one are packed into one row per target, so the join adds at most one row
    per candidate and the choice among rules is made inside the row, in rule order.
    """
    listed = _listed(rules)
    if listed is not None:
        if not listed:
            return rows.select(*key, "target", "value", F.lit("").alias("rule_id")).where(F.lit(False))
        first = first_fitting(listed, F.col("target"), F.col("kind"), F.col("value"))
        kept = list(dict.fromkeys([*key, "target", "value"]))
        ids = _constant([r.id for r in listed], "array<string>")
        found = explode_rows(rows, kept, first, "__pos", "__no")
        return found.select(*key, "target", "value", F.element_at(ids, F.col("__no") + 1).alias("rule_id")).where(F.col("rule_id").isNotNull())
    packed = rules.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("ord", "rule_id", "kind", "pattern"))).alias("rules")
    )
    fits = lambda r: (
        (r["kind"].isNull() | (r["kind"] == F.col("kind"))) & (r["pattern"].isNull() | F.regexp_like(F.col("value"), r["pattern"]))
    )
    found = F.try_element_at(F.filter(F.col("rules"), fits), F.lit(1))
    return (
        rows.join(packed, "target")
        .select(*key, "target", "value", found["rule_id"].alias("rule_id"))
        .where(F.col("rule_id").isNotNull())
    )


def _listed(rules: DataFrame) -> list[Rule] | None:
    """The rules of a table in their order, or None if it is too large; its size is checked before a row is fetched."""
    size = rules.agg(F.count("*").alias("n"), F.sum(F.length("pattern")).alias("chars")).first()
    if size["n"] > MOST_RULES or (size["chars"] or 0) > MOST_CHARS:
        return None
    rows = rules.where("target is not null").select("ord", "rule_id", "target", "kind", "pattern").orderBy("ord", "rule_id", "kind", "pattern").collect()
    return [Rule(r["rule_id"], "", "", r["target"], "", r["kind"], r["pattern"]) for r in rows]


def _per_rule(rules: Sequence[Rule]) -> list[Column]:
    return [F.count_if(F.col("rule_id") == r.id).alias(r.id) for r in rules]


def pivot_by_document(docs: DataFrame, found: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Hits per document and rule, zero-filled, every scanned document included."""
    counted = found.groupBy("doc_id").agg(*_per_rule(rules))
    return docs.select("doc_id").join(counted, "doc_id", "left").fillna(0, subset=[r.id for r in rules])


def summary(found: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Hits per rule, rules without hits included, ordered by complexity and id.

    All counts come from one global aggregate, which is then turned into one row per rule; those of a long list from one
    aggregate by rule.
    """
    rank = lambda r: COMPLEXITY_ORDER.get(r.complexity, 99)
    if len(rules) > FEW_RULES:
        shown = _constant(
            [{"grade": rank(r), "rule_id": r.id, "rule_name": r.name, "complexity": r.complexity} for r in rules],
            "array<struct<grade:int,rule_id:string,rule_name:string,complexity:string>>",
        )
        listed = found.sparkSession.range(1).select(F.inline(shown))
        counted = found.groupBy("rule_id").agg(F.count("*").alias("n_hits"))
        return listed.join(counted, "rule_id", "left").select(
            "grade", "rule_id", "rule_name", "complexity", F.coalesce("n_hits", F.lit(0)).alias("n_hits")
        ).orderBy("grade", "rule_id")
    rows = F.array(
        *[
            F.struct(
                F.lit(rank(r)).alias("grade"), F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"),
                F.lit(r.complexity).alias("complexity"), F.col(f"`{r.id}`").alias("n_hits"),
            )
            for r in rules
        ]
    )
    return found.agg(*_per_rule(rules)).select(F.inline(rows)).orderBy("grade", "rule_id")


def totals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Number of documents and of hits."""
    counts = docs.agg(F.count("*").alias("n_docs"), F.lit(0).cast("bigint").alias("n_hits")).unionByName(
        found.agg(F.lit(0).cast("bigint").alias("n_docs"), F.count("*").alias("n_hits"))
    )
    return counts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_hits").alias("n_hits"))


def top_documents(found: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` documents with most hits; ties in document order. Documents without hits never show."""
    return found.groupBy("doc_id").agg(F.count("*").alias("n_hits")).orderBy(F.desc("n_hits"), "doc_id").limit(n)


def report(found: DataFrame, relative_to: str | None = None) -> DataFrame:
    """Rows of the migration list in traversal order."""
    file = tx.relative_path(F.col("doc_id"), relative_to) if relative_to else F.col("doc_id")
    return found.orderBy("doc_id", "pos", "phase", "idx").select(
        file.alias("file"), "line", "line_count", "complexity", "rule_name", "snippet", "raw"
    )
