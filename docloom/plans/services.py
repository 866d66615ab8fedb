"""Service-description queries: one description per customer is written as XML by Spark and parsed back.

The SQL reads the tables directly, so a match shows that nothing was lost or mixed up on the way. A third
of the descriptions each uses long prefixes, short prefixes and a default namespace.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import services as sv
from docloom.operators.rows import explode_rows, spread
from docloom.sources.tables import read_table

# "{w}" is the prefix of service elements, "{s}" that of SOAP elements, "{decl}" the declaration of the former.
XML = """<?xml version="1.0"?>
<{w}definitions targetNamespace="urn:{region}" {decl}="http://schemas.xmlsoap.org/wsdl/"
  xmlns:{s}="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:{s}12='http://schemas.xmlsoap.org/wsdl/soap12/'
  xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:{region}">
<{w}types><xsd:schema>
<xsd:complexType name="T{k}"><xsd:annotation><xsd:documentation> of {nation}
 </xsd:documentation></xsd:annotation><xsd:sequence>
<xsd:element name="id" type="xsd:int" minOccurs="0"/>
<xsd:element name="seg{k}" type="t:{segment}" nillable="true" maxOccurs="unbounded"><xsd:annotation><xsd:documentation>in {segment}</xsd:documentation></xsd:annotation></xsd:element>
<xsd:element name="more"><xsd:complexType><xsd:choice><xsd:element name="deep{k}" type="xsd:string"/></xsd:choice></xsd:complexType></xsd:element>
</xsd:sequence></xsd:complexType>
<xsd:element name="E{k}"><xsd:complexType><xsd:annotation><xsd:documentation>inner {k}</xsd:documentation></xsd:annotation>
<xsd:all><xsd:element name="p" type="t:T{k}"/></xsd:all></xsd:complexType></xsd:element>
<xsd:element name="F{k}" type="xsd:string"/>
</xsd:schema></{w}types>
<{w}message name="M{k}"><{w}part name="body" element="t:E{k}"/><{w}part name="x" type="t:Missing"/><{w}part name="none"/></{w}message>
<{w}portType name="{nation}"><{w}operation name="get"><{w}documentation> Get {name} </{w}documentation>
<{w}input message="t:M{k}"/><{w}output message="t:Gone{k}"/></{w}operation><{w}operation name="ping"/></{w}portType>
<{w}binding name="B1" type="t:{nation}"><{s}:binding transport="http"/>
<{w}operation name="get"><{s}:operation soapAction="a{k}"/></{w}operation></{w}binding>
<{w}binding name="B2" type="t:{nation}"><{s}12:binding style="rpc"/>
<{w}operation name="get"><{s}:operation soapAction="b{k}"/></{w}operation>
<{w}operation name="ping"><{s}:operation soapAction=""/></{w}operation></{w}binding>
<{w}service name="{name}"><{w}port name="P1" binding="t:B1"><{s}:address location="http://one/{k}"/></{w}port>
<{w}port name="P2" binding="t:B2"><{s}:address location="http://old/{k}"/><{s}12:address location="http://two/{k}"/></{w}port>
<{w}port name="P3" binding="t:B2"/></{w}service>
</{w}definitions>"""
STYLES = (("wsdl:", "soap", "xmlns:wsdl"), ("w:", "s", "xmlns:w"), ("", "soap", "xmlns"))


def _template(style: tuple[str, str, str], columns: dict):
    w, s, decl = style
    rest = XML.replace("{w}", w).replace("{s}", s).replace("{decl}", decl)
    parts = []
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), columns[name]]
    return F.concat(*parts, F.lit(rest))


def _descriptions(spark, sf):
    customer, nation, region = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    customer = spread(customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    columns = {
        "k": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "nation": F.col("n_name"), "region": F.col("r_name"),
        "segment": F.col("c_mktsegment"),
    }
    style = F.pmod("c_custkey", F.lit(len(STYLES)))
    text = F.when(style == 0, _template(STYLES[0], columns)).when(style == 1, _template(STYLES[1], columns)).otherwise(_template(STYLES[2], columns))
    return rows.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def _parsed(spark, sf):
    return sv.parse(_descriptions(spark, sf))


def wsdl_roundtrip(spark, sf):
    """Customers and nations as they come back from the XML."""
    parsed = _parsed(spark, sf)
    return parsed.select(
        "doc_id", F.col("d._targetNamespace").alias("target_namespace"), F.col("d.service")[0]["_name"].alias("service"),
        F.col("d.portType")[0]["_name"].alias("port_type"),
    )


def wsdl_ports(spark, sf):
    return sv.ports(_parsed(spark, sf)).select("doc_id", "port_pos", "service", "port", "binding", "address")


def wsdl_bindings(spark, sf):
    return sv.bindings(_parsed(spark, sf)).select("doc_id", "binding_pos", "binding", "port_type", "style", "transport")


def wsdl_operations(spark, sf):
    return sv.operations(_parsed(spark, sf)).select(
        "doc_id", "operation_pos", "port_type", "operation", "documentation", "input", "output", "soap_action"
    )


def wsdl_soap_action(spark, sf):
    return sv.soap_actions(_parsed(spark, sf)).select("doc_id", "operation", "action_pos", "soap_action")


def wsdl_messages(spark, sf):
    return sv.messages(_parsed(spark, sf)).select("doc_id", "part_pos", "message", "part", "element", "type", "ref_kind")


def wsdl_types(spark, sf):
    """Types with the lines of the text catalogue for their fields."""
    return sv.fields(_parsed(spark, sf), listed=True).select(
        "doc_id", "type_pos", "kind", "name", "data_type", "documentation", F.greatest(F.size("fields"), F.lit(0)).alias("n_fields"),
        F.coalesce(F.array_join("labels", "\n"), F.lit("")).alias("fields"),
    )


def wsdl_fields(spark, sf):
    return sv.fields(_parsed(spark, sf)).select(
        "doc_id", "type_name", "field_pos", "name", "type", "min_occurs", "max_occurs", "nillable", "documentation", "label"
    )


def wsdl_references(spark, sf):
    return sv.references(_parsed(spark, sf)).select("doc_id", "ref_kind", "owner", "name", "anchor", "is_linked")


def wsdl_catalogue(spark, sf):
    return sv.catalogue(_descriptions(spark, sf))


def wsdl_deep_fields(spark, sf):
    """Fields of types nested as deep as the part's size modulo seven, below a restriction."""
    part = spread(read_table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_size") % 7).alias("n"))
    level = F.sequence(F.lit(0), F.col("n"))
    opened = F.array_join(F.transform(level, lambda i: F.concat(F.lit('<x:element name="e'), i, F.lit('"><x:complexType><x:sequence>'))), "")
    closed = F.repeat(F.lit("</x:sequence></x:complexType></x:element>"), F.col("n") + 1)
    head = '<definitions xmlns:x="http://www.w3.org/2001/XMLSchema"><types><x:schema><x:complexType name="T"><x:complexContent><x:restriction base="B">'
    tail = "</x:restriction></x:complexContent></x:complexType></x:schema></types></definitions>"
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(head), opened, closed, F.lit(tail)).alias("text"))
    return sv.fields(sv.parse(docs)).select("doc_id", "field_pos", "name", "type_name")


def wsdl_tree_fields(spark, sf):
    """Fields below groups and other wrappers, with comments and character data that look like tags, in two schemas."""
    part = spread(read_table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", "p_name", (F.col("p_size") % 4).alias("n"))
    k = F.col("p_partkey").cast("string")
    extra = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit('<x:group><x:any2><x:element name="g'), i, F.lit('" type="x:int"/></x:any2></x:group>'))), "")).otherwise("")
    parts = [
        '<definitions xmlns:x="http://www.w3.org/2001/XMLSchema"><types><!-- <x:schema><x:element name="lost"/></x:schema> --><x:schema><x:simpleType name="s"/>',
        '<x:element name="E', k, '" type="x:T"/><x:complexType name="T"><x:annotation><x:documentation><![CDATA[<sequence>', F.col("p_name"), "</sequence>]]> &amp; more<!-- not this --></x:documentation></x:annotation>",
        '<x:sequence><!-- <x:element name="gone"/> -->', extra, "<x:element name='last' minOccurs='0'><x:annotation><x:documentation>a <b>c</b></x:documentation></x:annotation></x:element></x:sequence></x:complexType></x:schema>",
        '<x:schema><x:group name="G"><x:complexType name="U"><x:element ref="r"/></x:complexType></x:group></x:schema></types></definitions>',
    ]
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))
    types = sv.types(sv.parse(docs))
    rows = explode_rows(types, ["doc_id", "type_pos", "kind", F.col("name").alias("type_name"), F.col("documentation").alias("type_doc")], F.col("fields"), "field_pos", "f")
    return rows.select("doc_id", "type_pos", "kind", "type_name", "type_doc", "field_pos", "f.name", "f.type", "f.min_occurs", "f.documentation")


def wsdl_prefixes(spark, sf):
    """Ports whose addresses stand under several prefixes, or name the SOAP namespace themselves; none to three per document."""
    uri = "http://schemas.xmlsoap.org/wsdl/soap/"
    nation = read_table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 4).alias("n"))
    address = lambda i: F.when(i % 3 == 0, F.lit("<a:address")).when(i % 3 == 1, F.lit("<b:address")).otherwise(F.lit(f'<address xmlns="{uri}"'))
    port = lambda i: F.concat(F.lit('<port name="P'), i, F.lit('">'), address(i), F.lit(' location="u'), i, F.lit('"/></port>'))
    ports = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), port), "")).otherwise("")
    head = f'<definitions xmlns:a="{uri}" xmlns:b="{uri}"><service name="S">'
    docs = nation.select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit(head), ports, F.lit("</service></definitions>")).alias("text"))
    return sv.ports(sv.parse(docs)).select("doc_id", "port_pos", "port", "address")


def wsdl_rejects(spark, sf):
    """Descriptions cut short, lost or replaced by plain text."""
    k = F.col("doc_id") % 5
    docs = _descriptions(spark, sf).withColumn("text", F.when(k == 1, F.substring("text", 1, 900)).when(k == 2, F.lit(None)).when(k == 3, F.lit("no description")).otherwise(F.col("text")))
    return sv.rejects(docs)


QUERIES = {
    f.__name__: f
    for f in (
        wsdl_deep_fields, wsdl_tree_fields, wsdl_prefixes, wsdl_rejects,
        wsdl_roundtrip, wsdl_ports, wsdl_bindings, wsdl_operations, wsdl_soap_action, wsdl_messages, wsdl_types, wsdl_fields,
        wsdl_references, wsdl_catalogue,
    )
}

_BASE = """
    c AS (SELECT c_custkey AS doc_id, c_custkey AS k, c_name, n_name, r_name, c_mktsegment AS seg
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _rows(*selects: str) -> str:
    return f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT doc_id, {x} FROM c" for x in selects)


_CATALOGUE = [
    "'" + sv.RULER + "'", f"'{sv.TITLE}'", "'" + sv.RULER + "'", "chr(10) || 'ターゲット名前空間: urn:' || r_name || chr(10)",
    f"chr(10) || '{sv.RULER}'", f"'{sv.SECTIONS['service']}'", f"'{sv.RULER}'",
    "chr(10) || '【サービス名】 ' || c_name",
    "'  ├─ ポート: P1'", "'  │  ├─ バインディング: B1'", "'  │  └─ エンドポイント: http://one/' || k",
    "'  ├─ ポート: P2'", "'  │  ├─ バインディング: B2'", "'  │  └─ エンドポイント: http://two/' || k",
    "'  ├─ ポート: P3'", "'  │  ├─ バインディング: B2'", "'  │  └─ エンドポイント: '",
    f"chr(10) || '{sv.RULER}'", f"'{sv.SECTIONS['operation']}'", f"'{sv.RULER}'",
    "chr(10) || '【ポートタイプ】 ' || n_name",
    "chr(10) || '  ● get'", "'    説明: Get ' || c_name", "'    入力: M' || k", "'    出力: Gone' || k",
    "'    SOAPAction: a' || k", "'    SOAPAction: b' || k",
    "chr(10) || '  ● ping'", "'    入力: '", "'    出力: '",
    f"chr(10) || '{sv.RULER}'", f"'{sv.SECTIONS['message']}'", f"'{sv.RULER}'",
    "chr(10) || '【メッセージ】 M' || k", "'  ├─ body (element: E' || k || ')'", "'  ├─ x (type: Missing)'",
    f"chr(10) || '{sv.RULER}'", f"'{sv.SECTIONS['type']}'", f"'{sv.RULER}'",
    "chr(10) || '【複合型】 T' || k", "'    説明: of ' || n_name", "'  ├─ id: int [0..1]'",
    "'  ├─ seg' || k || ': ' || seg || ' [1..unbounded] (nullable) - in ' || seg", "'  ├─ more:  [1..1]'", "'  ├─ deep' || k || ': string [1..1]'",
    "chr(10) || '【複合型】 E' || k", "'    説明: inner ' || k", "'  ├─ p: T' || k || ' [1..1]'",
    "chr(10) || '【要素】 F' || k || ' : string'", f"chr(10) || '{sv.RULER}'",
]

ORACLES = {
    "wsdl_deep_fields": """
        SELECT p_partkey AS doc_id, CAST(i AS INTEGER) AS field_pos, 'e' || i AS name, 'T' AS type_name
        FROM part, range(7) r(i) WHERE i <= p_size % 7""",
    "wsdl_tree_fields": """
        WITH p AS (SELECT p_partkey AS doc_id, '<sequence>' || p_name || '</sequence> & more' AS doc, p_size % 4 AS n FROM part)
        SELECT doc_id, 0 AS type_pos, 'complexType' AS kind, 'T' AS type_name, doc AS type_doc, CAST(i AS INTEGER) AS field_pos,
            CASE WHEN i < n THEN 'g' || (i + 1) ELSE 'last' END AS name, CASE WHEN i < n THEN 'int' ELSE '' END AS type,
            CASE WHEN i < n THEN '1' ELSE '0' END AS min_occurs, CASE WHEN i < n THEN '' ELSE 'a' END AS documentation
        FROM p, range(4) r(i) WHERE i <= n
        UNION ALL SELECT doc_id, 2, 'complexType', 'U', '', 0, NULL, '', '1', '' FROM p""",
    "wsdl_prefixes": """
        SELECT n_nationkey AS doc_id, CAST(i AS INTEGER) AS port_pos, 'P' || i AS port, 'u' || i AS address
        FROM nation, range(3) r(i) WHERE i < n_nationkey % 4""",
    "wsdl_rejects": f"""
        WITH {_BASE} SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'missing' ELSE 'unreadable' END AS reason FROM c WHERE doc_id % 5 IN (1, 2, 3)""",
    "wsdl_roundtrip": _rows("'urn:' || r_name AS target_namespace, c_name AS service, n_name AS port_type"),
    "wsdl_ports": _rows(
        "0 AS port_pos, c_name AS service, 'P1' AS port, 'B1' AS binding, 'http://one/' || k AS address",
        "1, c_name, 'P2', 'B2', 'http://two/' || k", "2, c_name, 'P3', 'B2', ''",
    ),
    "wsdl_bindings": _rows(
        "0 AS binding_pos, 'B1' AS binding, n_name AS port_type, 'document' AS style, 'http' AS transport",
        "1, 'B2', n_name, '', ''",
    ),
    "wsdl_operations": _rows(
        "0 AS operation_pos, n_name AS port_type, 'get' AS operation, 'Get ' || c_name AS documentation, 'M' || k AS input, 'Gone' || k AS output, 'b' || k AS soap_action",
        "1, n_name, 'ping', '', '', '', ''",
    ),
    "wsdl_soap_action": _rows("'get' AS operation, 0 AS action_pos, 'a' || k AS soap_action", "'get', 1, 'b' || k"),
    "wsdl_messages": _rows(
        "0 AS part_pos, 'M' || k AS message, 'body' AS part, 'E' || k AS element, '' AS type, 'element' AS ref_kind",
        "1, 'M' || k, 'x', '', 'Missing', 'type'", "2, 'M' || k, 'none', '', '', ''",
    ),
    "wsdl_types": _rows(
        "0 AS type_pos, 'complexType' AS kind, 'T' || k AS name, '' AS data_type, 'of ' || n_name AS documentation, 4 AS n_fields, "
        "'id: int [0..1]' || chr(10) || 'seg' || k || ': ' || seg || ' [1..unbounded] (nullable) - in ' || seg || chr(10) || "
        "'more:  [1..1]' || chr(10) || 'deep' || k || ': string [1..1]' AS fields",
        "1, 'complexType', 'E' || k, '', 'inner ' || k, 1, 'p: T' || k || ' [1..1]'", "2, 'element', 'F' || k, 'string', '', 0, ''",
    ),
    "wsdl_fields": _rows(
        "'T' || k AS type_name, 0 AS field_pos, 'id' AS name, 'int' AS type, '0' AS min_occurs, '1' AS max_occurs, 'false' AS nillable, '' AS documentation, 'id: int [0..1]' AS label",
        "'T' || k, 1, 'seg' || k, seg, '1', 'unbounded', 'true', 'in ' || seg, 'seg' || k || ': ' || seg || ' [1..unbounded] (nullable) - in ' || seg",
        "'T' || k, 2, 'more', '', '1', '1', 'false', '', 'more:  [1..1]'",
        "'T' || k, 3, 'deep' || k, 'string', '1', '1', 'false', '', 'deep' || k || ': string [1..1]'",
        "'E' || k, 0, 'p', 'T' || k, '1', '1', 'false', '', 'p: T' || k || ' [1..1]'",
    ),
    "wsdl_references": _rows(
        "'input' AS ref_kind, 'get' AS owner, 'M' || k AS name, 'msg_M' || k AS anchor, true AS is_linked",
        "'output', 'get', 'Gone' || k, NULL, false", "'element', 'M' || k, 'E' || k, 'type_E' || k, true",
        "'type', 'M' || k, 'Missing', NULL, false",
    ),
    "wsdl_catalogue": f"WITH {_BASE} SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, ["
    + ", ".join(_CATALOGUE) + "] AS l FROM c)",
}
