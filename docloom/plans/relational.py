"""Plain table queries: projection, joins, upsert, delete, constraints, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import logs as lg
from docloom.functions import text as tx
from docloom.operators import ingest, quality, tables
from docloom.operators.rows import spread
from docloom.sources.sinks import record_json
from docloom.sources.tables import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2024-01-15 00:00:00"
EXCLUDED_BRANDS = ["Brand#1", "Brand#7", "Brand#12"]


def scan_project(spark, sf):
    return tables.project_as(
        read_table(spark, sf, "part"),
        {"id": "p_partkey", "name": "p_name", "price": F.col("p_retailprice").cast("decimal(10,2)").cast("double")},
    )


def filter_eq(spark, sf):
    return tables.where_equal(read_table(spark, sf, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_custkey", "o_totalprice")


def records_json(spark, sf):
    part = read_table(spark, sf, "part")
    return part.select("p_partkey", record_json("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").alias("record"))


def table_counts(spark, sf):
    return tables.row_counts({n: read_table(spark, sf, n) for n in TABLES})


def preview(spark, sf):
    return ingest.preview(read_table(spark, sf, "part"), ["p_partkey"]).select("p_partkey", "p_name", "p_brand")


def fk_navigate(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    named = tables.navigate(customer, nation, "c_nationkey", "n_nationkey")
    return tables.navigate(orders, named, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "n_name")


def fk_join(spark, sf):
    """Per customer: orders, lines and their value. Lines are summed per order before they join."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")  # whole cents add up exactly in any order
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        tables.navigate(orders, lines, "o_orderkey", "l_orderkey")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.sum("cents").alias("cents"))
    )
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return tables.navigate(customer, per_customer, "c_custkey", "o_custkey").select(
        "c_custkey", "c_name",
        F.coalesce("orders", F.lit(0)).alias("n_orders"), F.coalesce("lines", F.lit(0)).alias("n_lines"),
        (F.coalesce("cents", F.lit(0)) / 100.0).alias("value"),
    )


def upsert(spark, sf):
    """Open orders are repriced; each urgent order is entered again under a new key."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    urgent = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(*orders.columns)
    changed = orders.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 100.0)
    added = urgent.withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return tables.upsert(orders, changed.unionByName(added), ["o_orderkey"])


def delete_first(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.delete_first(orders, ["o_custkey"], "o_orderkey")


def delete_first_where(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.delete_first_where(orders, "o_orderstatus", "P", "o_orderkey")


def dq_duplicates(spark, sf):
    return quality.duplicate_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_orphans(spark, sf):
    parents = read_table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    return quality.orphans(read_table(spark, sf, "orders"), parents, "o_custkey", "c_custkey")


def dq_columns(spark, sf):
    checks = {
        "null_names": quality.not_null("c_name"),
        "long_names": quality.too_long("c_name", 15),
        "bad_balances": quality.not_decimal("c_acctbal", 6, 2),
        "bad_fits": quality.not_decimal("c_acctbal", 10, 1),
    }
    return quality.column_report(read_table(spark, sf, "customer"), checks)


def name_pattern(spark, sf):
    part = read_table(spark, sf, "part")
    return part.where(tx.name_matches(F.col("p_name"), "(small|red) .*g")).select("p_partkey", "p_name")


def exclude_list(spark, sf):
    part = read_table(spark, sf, "part").withColumn("visible", F.col("p_size") > 10)
    return tables.without_names(part, "p_brand", EXCLUDED_BRANDS, "visible").select("p_partkey", "p_brand")


def union_dedupe(spark, sf):
    """Constant cells and formula cells overlap; an address in both counts once, as a constant."""
    orders = read_table(spark, sf, "orders")
    cells = lambda kind, cond: orders.where(cond).select("o_orderkey", F.lit(kind).alias("kind"), "o_orderstatus")
    return tables.union_distinct(
        [cells("constant", "o_orderstatus <> 'P'"), cells("formula", "o_orderpriority = '1-URGENT'")], ["o_orderkey"]
    )


def union_all(spark, sf):
    part = read_table(spark, sf, "part")
    found = lambda kind: part.where(F.col("p_type") == kind).select("p_partkey", F.lit(kind).alias("suffix"))
    return tables.union_bag([found("ECONOMY"), found("STANDARD"), found("ECONOMY")])


def not_processed(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.not_in(orders, done, ["o_orderkey"])


def _part_references(spark, sf):
    lines = read_table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return lines.select(F.col("l_partkey").alias("p_partkey"))


def ref_semi(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return tables.referenced(part, _part_references(spark, sf), ["p_partkey"])


def ref_anti(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return tables.not_in(part, _part_references(spark, sf), ["p_partkey"])


def anchor_ids(spark, sf):
    name = F.concat("p_type", F.lit(":"), "p_name", F.lit("."), "p_size")
    key = F.concat("p_size", F.lit("."), "p_partkey")
    return read_table(spark, sf, "part").select(
        "p_partkey", tx.anchor_id("msg", name).alias("anchor"), tx.function_name(key).alias("function_name"),
        tx.local_name(F.concat(F.lit("t:u:"), "p_name")).alias("local_name"),
    )


def as_of_filter(spark, sf):
    events = read_table(spark, sf, "events")
    return events.where(F.col("ts").cast("timestamp") <= lg.as_of(AS_OF)).select("event_id", "user_id")


def display_width(spark, sf):
    """Width of each text, and its part of the widest text per language (reports align on the maximum)."""
    docs = spread(read_table(spark, sf, "documents").select("lang", "source", "text"))
    return docs.groupBy("lang").agg(
        F.max(tx.display_width(F.col("text"))).cast("bigint").alias("max_width"),
        F.sum(tx.display_width(F.col("text"))).cast("bigint").alias("sum_width"),
        F.max(F.length(tx.pad_display(F.col("source"), 40))).cast("bigint").alias("padded"),
    )



QUERIES = {
    f.__name__: f
    for f in (
        scan_project, filter_eq, records_json, table_counts, preview, fk_navigate, fk_join, upsert, delete_first,
        delete_first_where, dq_duplicates, dq_orphans, dq_columns, name_pattern, exclude_list, union_dedupe, union_all,
        not_processed, ref_semi, ref_anti, anchor_ids, as_of_filter, display_width,
    )
}

ORACLES = {
    "scan_project": "SELECT p_partkey AS id, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price FROM part",
    "filter_eq": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'",
    "records_json": """
        SELECT p_partkey, CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand, 'p_size': p_size,
            'p_retailprice': p_retailprice}) AS VARCHAR) AS record FROM part""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "preview": "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 5",
    "fk_navigate": """
        SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "fk_join": """
        SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines,
            CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS value
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY c_custkey, c_name""",
    "upsert": """
        SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 100.0::DOUBLE ELSE o_totalprice END AS o_totalprice
        FROM orders
        UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "delete_first": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1""",
    "delete_first_where": """
        SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
        WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')""",
    "dq_duplicates": """
        SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "dq_orphans": """
        SELECT o_custkey, count(*) AS n_rows FROM orders
        WHERE o_custkey IS NOT NULL AND NOT EXISTS
            (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')
        GROUP BY o_custkey""",
    "dq_columns": """
        SELECT count(*) FILTER (c_name IS NULL) AS null_names, count(*) FILTER (length(c_name) > 15) AS long_names,
            count(*) FILTER (abs(c_acctbal) >= 10000 OR round(c_acctbal, 2) <> c_acctbal) AS bad_balances,
            count(*) FILTER (round(c_acctbal, 1) <> c_acctbal) AS bad_fits
        FROM customer""",
    "name_pattern": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|red) .*g')",
    "exclude_list": """
        SELECT p_partkey, p_brand FROM part
        WHERE p_size > 10 AND p_brand NOT IN ('Brand#1', 'Brand#7', 'Brand#12')""",
    "union_dedupe": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'constant' ELSE 'formula' END AS kind, o_orderstatus
        FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'""",
    "union_all": """
        SELECT p_partkey, p_type AS suffix FROM part, (VALUES ('ECONOMY'), ('STANDARD'), ('ECONOMY')) v(s) WHERE p_type = s""",
    "not_processed": """
        SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "ref_semi": """
        SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""",
    "ref_anti": """
        SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""",
    "anchor_ids": """
        SELECT p_partkey,
            'msg_' || replace(replace(replace(p_type || ':' || p_name || '.' || p_size, ':', '_'), ' ', '_'), '.', '_') AS anchor,
            'test_' || p_size || '_' || p_partkey AS function_name, p_name AS local_name
        FROM part""",
    "as_of_filter": f"SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '{AS_OF}'",
    "display_width": f"""
        SELECT lang, CAST(max(w) AS BIGINT) AS max_width, CAST(sum(w) AS BIGINT) AS sum_width,
            CAST(max(greatest(length(source), 40)) AS BIGINT) AS padded
        FROM (SELECT lang, source, length(text) + length(text) - length(regexp_replace(text, '{tx.wide_class()}', '', 'g')) AS w FROM documents)
        GROUP BY lang""",
}
