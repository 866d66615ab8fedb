import pytest

from docloom.operators import services as sv
from docloom.plans import services as ps

XML = """<?xml version="1.0"?><{w}definitions targetNamespace="urn:x" {wd}="http://schemas.xmlsoap.org/wsdl/"
 xmlns:{s}='http://schemas.xmlsoap.org/wsdl/soap/' xmlns:{s}12="http://schemas.xmlsoap.org/wsdl/soap12/"
 xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:x">
<{w}types><xsd:schema><xsd:complexType name="T"><xsd:annotation><xsd:documentation> doc </xsd:documentation></xsd:annotation>
<xsd:complexContent><xsd:extension base="t:Base"><xsd:sequence><xsd:element name="a" type="xsd:int" minOccurs="0"/>
<xsd:choice><xsd:element name="b" type="t:U" nillable="true"><xsd:annotation><xsd:documentation>bdoc</xsd:documentation></xsd:annotation></xsd:element></xsd:choice>
<xsd:element name="n"><xsd:complexType><xsd:sequence><xsd:element name="nn" type="xsd:string"/></xsd:sequence></xsd:complexType></xsd:element>
</xsd:sequence></xsd:extension></xsd:complexContent></xsd:complexType>
<xsd:element name="E1"><xsd:complexType><xsd:annotation><xsd:documentation>inner</xsd:documentation></xsd:annotation>
<xsd:sequence><xsd:element name="p" type="t:T" maxOccurs="unbounded"/></xsd:sequence></xsd:complexType></xsd:element>
<xsd:element name="E2" type="xsd:string"/></xsd:schema></{w}types>
<{w}message name="M1"><{w}part name="x" element="t:E1"/><{w}part name="y" type="t:Zed"/><{w}part name="z"/></{w}message>
<{w}portType name="P"><{w}operation name="o"><{w}documentation> od </{w}documentation><{w}input message="t:M1"/>
<{w}output message="t:M9"/></{w}operation><{w}operation name="o2"/></{w}portType>
<{w}binding name="B" type="t:P"><{s}:binding transport="h"/><{w}operation name="o"><{s}:operation soapAction="x"/></{w}operation></{w}binding>
<{w}binding name="B2" type="t:P"><{s}12:binding style="rpc"/><{w}operation name="o"><{s}:operation soapAction="y"/></{w}operation>
<{w}operation name="o2"><{s}12:operation soapAction="q"/></{w}operation></{w}binding>
<{w}service name="S"><{w}port name="p1" binding="t:B"><{s}:address location="u1"/><{s}12:address location="u2"/></{w}port>
<{w}port name="p2" binding="t:B2"><{s}:address location="u1"/></{w}port><{w}port name="p3" binding="t:B2"/>
<{w}port name="p4"><{s}:address location="u1"/><{s}12:address/></{w}port></{w}service></{w}definitions>"""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, XML.format(w="wsdl:", wd="xmlns:wsdl", s="soap")), (2, XML.format(w="w:", wd="xmlns:w", s="s")),
        (3, XML.format(w="", wd="xmlns", s="soap")), (4, "<no xml"),
    ]
    return spark.createDataFrame(rows, "doc_id int, text string")


@pytest.fixture(scope="module")
def parsed(docs):
    return sv.parse(docs)


def rows(df, *columns):
    return [tuple(r) for r in df.where("doc_id = 1").select(*columns).collect()]


def test_prefixes_do_not_matter(parsed, docs):
    tables = [sv.services, sv.ports, sv.bindings, sv.binding_operations, sv.operations, sv.messages, sv.types, sv.fields, sv.references]
    for df in [t(parsed) for t in tables] + [sv.catalogue(docs)]:
        seen = {i: [] for i in (1, 2, 3)}
        for r in df.collect():
            seen[r["doc_id"]].append(str(tuple(r)[1:]))
        assert sorted(seen[1]) == sorted(seen[2]) == sorted(seen[3]) and seen[1]


def test_ports(parsed):
    assert rows(sv.ports(parsed), "port", "binding", "address") == [("p1", "B", "u2"), ("p2", "B2", "u1"), ("p3", "B2", ""), ("p4", "", "")]


def test_bindings(parsed):
    assert rows(sv.bindings(parsed), "binding", "port_type", "style", "transport") == [("B", "P", "document", "h"), ("B2", "P", "", "")]


def test_soap_actions(parsed):
    assert rows(sv.operations(parsed), "operation", "documentation", "input", "output", "soap_action") == [
        ("o", "od", "M1", "M9", "y"), ("o2", "", "", "", ""),
    ]
    assert rows(sv.soap_actions(parsed), "operation", "soap_action") == [("o", "x"), ("o", "y")]


def test_fields(parsed):
    assert rows(sv.fields(parsed), "type_name", "label") == [
        ("T", "a: int [0..1]"), ("T", "b: U [1..1] (nullable) - bdoc"), ("T", "n:  [1..1]"), ("T", "nn: string [1..1]"),
        ("E1", "p: T [1..unbounded]"),
    ]
    assert rows(sv.types(parsed), "kind", "name", "data_type", "documentation") == [
        ("complexType", "T", "", "doc"), ("complexType", "E1", "", "inner"), ("element", "E2", "string", ""),
    ]


def test_references(parsed):
    assert rows(sv.references(parsed), "ref_kind", "name", "anchor") == [
        ("input", "M1", "msg_M1"), ("output", "M9", None), ("element", "E1", "type_E1"), ("type", "Zed", None),
    ]


def test_catalogue(docs):
    lines = [r.line for r in sv.catalogue(docs).where("doc_id = 1").orderBy("line_no").collect()]
    text = "\n".join(lines)
    assert "  ├─ ポート: p1\n  │  ├─ バインディング: B\n  │  └─ エンドポイント: u2\n" in text
    assert "    SOAPAction: x\n    SOAPAction: y\n\n  ● o2\n" in text
    assert "  ├─ x (element: E1)\n  ├─ y (type: Zed)\n\n====" in text
    assert text.endswith("【要素】 E2 : string\n\n" + "=" * 80)
    assert sv.catalogue(docs).where("doc_id = 4").count() == 0


def test_one_broken_text_hurts_nobody(spark, docs):
    broken = spark.createDataFrame([(9, "<definitions><types><schema>" + "<complexType>" * 1500), (10, "<a><b></a></b>"), (11, "")], "doc_id int, text string")
    both = sv.parse(docs.union(broken))
    for table in (sv.ports, sv.types, sv.fields, sv.references, sv.messages):
        assert {r["doc_id"] for r in table(both).collect()} == {1, 2, 3}
    assert {(r["doc_id"], r["reason"]) for r in sv.rejects(docs.union(broken)).collect()} == {(4, "unreadable"), (9, "unreadable"), (10, "unreadable"), (11, "unreadable")}


def test_many_levels(spark):
    def nested(n):
        opened = "".join(f'<x:element name="e{i}"><x:complexType><x:sequence>' for i in range(n))
        return f'<definitions><types><x:schema xmlns:x="x"><x:complexType name="T"><x:choice>{opened}{"</x:sequence></x:complexType></x:element>" * n}</x:choice></x:complexType></x:schema></types></definitions>'

    # The XML reader takes 1,000 open tags; what nests deeper is told apart.
    docs = spark.createDataFrame([(1, nested(300)), (2, nested(1000))], "doc_id int, text string")
    fields = sv.fields(sv.parse(docs))
    assert [(r["doc_id"], r["name"]) for r in fields.orderBy("field_pos").collect()] == [(1, f"e{i}") for i in range(300)]
    assert [tuple(r) for r in sv.rejects(docs).collect()] == [(2, "unreadable")]


def test_text_is_left_alone(spark):
    text = """<definitions xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/"><portType name="P"><operation name="o">
<documentation><![CDATA[<soap:address/> <sequence>kept</sequence>]]></documentation></operation></portType>
<service name="S"><port name="p"><!-- <soap:address location="no"/> --><soap:address location="a&gt;b"/></port></service></definitions>"""
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert sv.operations(sv.parse(docs)).first()["documentation"] == "<soap:address/> <sequence>kept</sequence>"
    assert sv.ports(sv.parse(docs)).first()["address"] == "a>b"
    other = text.replace("<soap:", "<").replace("</soap:", "</").replace('<address location="a', '<address xmlns="http://schemas.xmlsoap.org/wsdl/soap/" location="a')
    assert sv.ports(sv.parse(spark.createDataFrame([(1, other), (2, other.replace('b"/>', 'b"> </address>'))], "doc_id int, text string"))).select("address").collect() == [("a>b",)] * 2


def test_no_job_while_a_plan_is_built(spark, docs):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    sv.fields(sv.parse(docs)), sv.catalogue(docs), sv.ports(sv.parse(docs))
    assert set(tracker.getJobIdsForGroup()) == before


def test_parts_in_one_split_are_read_by_all_cores(spark, tmp_path):
    """One description per part: a table in one split must not be parsed by one task."""
    spark.range(1, 17).selectExpr("id as p_partkey", "'n' as p_name", "id as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for query in (ps.wsdl_deep_fields, ps.wsdl_tree_fields):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_only_declarations_get_places(spark):
    """Names that merely begin alike are no declarations, whatever the prefix or the end of the tag."""
    text = """<definitions><types><x:schema xmlns:x="x"><x:elements name="no"/><element:no name="no"/><x:complexTypes name="no"/>
<complexType name="T"><y:element
 name="a"/><element name="b"/></complexType><x:element name="E"/></x:schema></types></definitions>"""
    parsed = sv.parse(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert rows(sv.types(parsed), "kind", "name") == [("complexType", "T"), ("element", "E")]
    assert rows(sv.fields(parsed), "type_name", "name") == [("T", "a"), ("T", "b")]


def test_default_soap_namespace_beside_prefixes(spark):
    uri = "http://schemas.xmlsoap.org/wsdl/soap/"
    port = '<definitions xmlns:a="{0}"><service name="S"><port name="p">{1}</port></service></definitions>'
    texts = [port.format(uri, '<a:address location="u"/>'), port.format(uri, f"<address xmlns = '{uri}' location='v'/>"), port.format(uri, "<address location='w'/>")]
    parsed = sv.parse(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert [r["address"] for r in sv.ports(parsed).orderBy("doc_id").collect()] == ["u", "v", ""]


def test_types_come_with_their_fields(spark, parsed, tmp_path):
    got = [(r["name"], r["labels"]) for r in sv.fields(parsed, listed=True).where("doc_id = 1").orderBy("type_pos").collect()]
    assert got == [
        ("T", ["a: int [0..1]", "b: U [1..1] (nullable) - bdoc", "n:  [1..1]", "nn: string [1..1]"]), ("E1", ["p: T [1..unbounded]"]), ("E2", None),
    ]
    tables = {
        "customer": ([(7, "c", 1, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(1, "N", 2)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(2, "R")], "r_regionkey int, r_name string"),
    }
    for name, (held, schema) in tables.items():
        spark.createDataFrame(held, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    types = {r["name"]: (r["n_fields"], r["fields"]) for r in ps.wsdl_types(spark, str(tmp_path)).collect()}
    assert types == {
        "T7": (4, "id: int [0..1]\nseg7: AUTO [1..unbounded] (nullable) - in AUTO\nmore:  [1..1]\ndeep7: string [1..1]"), "E7": (1, "p: T7 [1..1]"), "F7": (0, ""),
    }
