import csv
import io
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import ingest, logs, rules, services
from docloom.operators.markup import tokens
from docloom.sources import files, sheets, sinks
from docloom.streaming import jobs


def write(path, data, mode="w", **kw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **kw) as f:
        f.write(data)
    return str(path)


def parts(folder, ext):
    found = []
    for base, _, names in os.walk(folder):
        found += [os.path.join(base, n) for n in names if n.startswith("part-") and n.endswith(ext)]
    return sorted(found)


def test_discovery(spark, tmp_path):
    for name in ("a.xlsx", "sub/b.xlsm", "sub/c.xls", "sub/~$b.xlsm", "d.txt"):
        write(str(tmp_path / name), "x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.discover(spark, str(tmp_path), [".xlsx", ".xlsm", ".xls"])) == ["a.xlsx", "b.xlsm", "c.xls"]
    assert names(files.discover(spark, str(tmp_path), [".xlsx", ".xlsm"], recursive=False)) == ["a.xlsx"]
    assert files.discover(spark, str(tmp_path), [".txt"]).columns == ["path", "modified", "length"]


def test_texts_and_encodings(spark, tmp_path):
    write(str(tmp_path / "in/x/a.jsp"), b"ok \xff\r\nnext", "wb")
    write(str(tmp_path / "sj/b.jsp"), "表示".encode("cp932"), "wb")
    utf8 = files.read_texts(spark, str(tmp_path / "in"), [".jsp"]).first()
    assert (utf8.rel_path, utf8.text) == ("x/a.jsp", "ok �\nnext")
    assert files.read_texts(spark, str(tmp_path / "sj"), [".jsp"], "windows-31j").first().text == "表示"


def test_tasks_list_and_read_as_sparks_reader(spark, tmp_path, monkeypatch):
    names = ["a.txt", "_h.txt", "_k=v.txt", ".d.txt", "~$o.txt", "sub/b.txt", "sub/deep/er/c.txt", "_hid/c.txt", ".hid/c.txt", "_x=1/c.txt", "_metadata.txt"]
    names += ["_metadata_d/e.txt", "x._COPYING_", "sp ace/\u00fc%20#.txt", "t.txt.gz", "U.TXT", "n.md"]
    root = str(tmp_path / "odd")
    for i, n in enumerate(names):
        write(f"{root}/{n}", b"x\r\ny\xff" * (i + 1), "wb")
    write(f"{root}/empty.txt", "")
    os.symlink(f"{root}/sub", f"{root}/link")
    os.symlink(f"{root}/none", f"{root}/dangling.txt")
    monkeypatch.setattr(files, "CONTENT_BYTES", 20)
    for suffixes in ([".txt"], [".txt", ".md", ".gz", "_"]):
        for columns in (["path", "modified", "length"], ["path", "modified", "length", "content"]):
            both = [files.discover(spark, at, suffixes, content="content" in columns) for at in (root, f"file://{root}/")]
            assert both[0].schema == both[1].schema and both[1].columns == columns
            a, b = (sorted(tuple(r) for r in x.collect()) for x in both)
            assert a == b and len(a) >= 8
    key = lambda at: sorted((r.path, r.text) for r in files.read_texts(spark, at, [".txt"]).collect())
    assert key(root) == key(f"file:{root}")


def test_tasks_do_not_grow_with_files(spark, tmp_path):
    for i in range(40):
        write(str(tmp_path / f"many/{i % 3}/{i}.txt"), str(i))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # with the cost of an opening, a task for each file
    try:
        texts = files.read_texts(spark, (tmp_path / "many").as_uri(), [".txt"])
        assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(int(r.text) for r in texts.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_terms(spark, tmp_path):
    path = write(str(tmp_path / "terms.txt"), " one \n\n\t\n二　\r\nthree")
    assert [tuple(r) for r in files.read_terms(spark, path).orderBy("seq").collect()] == [(0, "one"), (3, "二"), (4, "three")]


def test_line_numbers_over_splits(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(400)), "b.txt": "\n\r\n\rone\r\n\n" * 60 + "end", "c.txt": "", "d.txt": "no end"}
    for name, text in texts.items():
        write(str(tmp_path / "t" / name), text.encode(), "wb")
    want = {(n, i, x) for n, text in texts.items() for i, x in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")) if text}
    for size in ("128m", "97", "10"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in files.read_lines(spark, str(tmp_path / "t")).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == len(want) and set(got) == want


def test_manifest_and_pending(spark, tmp_path):
    for name in ("src/a.xlsx", "src/sub/b.xlsx"):
        write(str(tmp_path / name), "x")
    write(str(tmp_path / "out/sub/b.pdf"), "x")
    os.utime(tmp_path / "src/sub/b.xlsx", (1000, 1000))
    got = ingest.pending(files.manifest(spark, str(tmp_path / "src"), ".xlsx"), files.manifest(spark, str(tmp_path / "out"), ".pdf"))
    assert [r.name for r in got.collect()] == ["a"]


def test_csv_reports(spark, tmp_path):
    hits = spark.createDataFrame([("a", "f", 'say "x"', None), ("b,c", "g", "two\nlines", "")], "term string, file string, heading string, context string")
    heads = {k: sinks.HIT_HEADINGS[k] for k in ("term", "file", "heading")}
    sinks.write_csv_report(hits.coalesce(1), str(tmp_path / "quoted"), heads, quote_all=True)
    text = open(parts(tmp_path / "quoted", ".csv")[0], encoding="utf-8").read()
    assert text == '"検索文字列","ファイル名","ブックマーク"\n"a","f","say ""x"""\n"b,c","g","two\nlines"\n'
    sinks.write_csv_report(hits.coalesce(1), str(tmp_path / "plain"), {"term": "対象", "context": "行数"}, byte_order_mark=True)
    assert open(parts(tmp_path / "plain", ".csv")[0], "rb").read() == "\ufeff対象,行数\na,\n\"b,c\",\n".encode()
    sinks.write_csv_report(hits.coalesce(1), str(tmp_path / "sj"), {"term": "対象"}, encoding="windows-31j")
    assert open(parts(tmp_path / "sj", ".csv")[0], "rb").read().startswith("対象".encode("cp932"))
    back = sheets.read_csv_sheet(spark, str(tmp_path / "quoted"))
    assert back.columns == list(heads.values()) and back.count() == 2


def test_table_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "no int, name string, price double")
    sinks.write_table_json(df, str(tmp_path / "t"), "no")
    assert spark.read.json(str(tmp_path / "t/data")).count() == 2
    schema = json.loads(open(parts(tmp_path / "t/schema", ".txt")[0], encoding="utf-8").read())
    assert schema == {
        "fields": [{"name": "no", "type": "integer"}, {"name": "name", "type": "string"}, {"name": "price", "type": "number"}],
        "primaryKey": ["no"],
    }
    assert df.select(sinks.record_json().alias("j")).first().j == '{"no":1,"name":"a","price":null}'


def test_import_to_keyed_files(spark, tmp_path):
    sheet = spark.createDataFrame(
        [(0, 1.0, "a/b", "old"), (1, 1.0, "a:b", "new"), (2, None, "x", "t"), (3, 2.0, " ", "t"), (4, 3.0, "v", None)],
        "pos int, `No.` double, v1 string, v2 string",
    )
    rows = ingest.import_rows(sheet, "No.", "v1", "v2", keep=["pos"])
    assert [r.pos for r in ingest.rejected(rows).orderBy("pos").collect()] == [2, 3]
    out = ingest.output_files(rows, "pos")
    assert [tuple(r) for r in out.orderBy("path").collect()] == [("1/a_b.txt", "1", "new"), ("3/v.txt", "3", "")]
    sinks.write_keyed_text(out, str(tmp_path / "k"), ["no"], "content")
    assert spark.read.text(str(tmp_path / "k/no=1")).first().value == "new"
    sinks.write_files(out, str(tmp_path / "f"), "path", "content")
    assert {str(p.relative_to(tmp_path / "f")): p.read_text() for p in (tmp_path / "f").rglob("*.txt")} == {"1/a_b.txt": "new", "3/v.txt": ""}
    with pytest.raises(ValueError, match="missing columns: v9, v8"):
        ingest.import_rows(sheet, "No.", "v9", "v8")


def test_reports_as_ordered_lines(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "<definitions xmlns='http://schemas.xmlsoap.org/wsdl/' targetNamespace='urn:q'/>")], "doc_id string, text string")
    lines = services.catalogue(docs)
    sinks.write_keyed_text(lines, str(tmp_path / "r"), ["doc_id"], "line", order=["line_no"])
    text = "".join(open(p, encoding="utf-8").read() for p in parts(tmp_path / "r/doc_id=d1", ".txt"))
    where = docs.select(sinks.report_path(F.lit("a.b/x.jsp")).alias("p")).first().p
    assert where == "a.b/x.jsp.txt"
    reports = lines.withColumn("path", F.concat(F.lit("out/"), sinks.report_path(F.concat("doc_id", F.lit(".wsdl")), ".txt")))
    sinks.write_files(reports, str(tmp_path / "m"), "path", "line", order=["line_no"])
    assert (tmp_path / "m/out/d1.txt").read_text() == "".join(r.line + "\n" for r in lines.orderBy("line_no").collect())
    assert "ターゲット名前空間: urn:q" in text and text.index("WSDL") < text.index("urn:q") < text.index("🔧")


def test_failed_write_publishes_nothing(spark, tmp_path):
    old = spark.createDataFrame([("x.txt", "old")], "path string, text string")
    root = tmp_path / "w"
    sinks.write_files(old, str(root), "path", "text")
    rows = spark.range(0, 40, 1, 4).select(F.format_string("d%d/x.txt", "id").alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("new").alias("text"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_files(rows.unionByName(old), str(root), "path", "text")
    assert [(p.relative_to(root).as_posix(), p.read_text()) for p in root.rglob("*") if p.is_file()] == [("x.txt", "old")]
    sinks.write_files(rows.where("path <> 'd39/x.txt'").unionByName(old), root.as_uri(), "path", "text")
    assert len([p for p in root.rglob("*") if p.is_file()]) == 40 and (root / "d7/x.txt").read_text() == "new"


def test_names_of_folders():
    names = ["/a/b/", "file:/a/b", "file:///a/b", "s3://x/a/b/"]
    assert [sinks._uri(n) for n in names] == ["file:///a/b"] * 3 + ["s3://x/a/b"]


def test_late_attempt_does_not_publish(tmp_path):
    batch = [pd.DataFrame({"path": ["a/x", "b"], "text": ["1", None]})]
    aside = tmp_path / "root/.writing"
    first, late = [pd.concat(list(sinks._write_aside(aside.as_uri(), "")(batch))) for _ in range(2)]
    assert len(late) == 2  # not in the committed table
    root = (tmp_path / "root").as_uri()
    assert [f["files"][0] for f in sinks._publish(root)([first])] == [2]
    assert [f["files"][0] for f in sinks._publish(root)([first])] == [2]  # a repeated task finds its files moved
    assert ((tmp_path / "root/a/x").read_text(), (tmp_path / "root/b").read_text()) == ("1", "")
    with pytest.raises(OSError):
        list(sinks._publish(root)([pd.DataFrame({"path": ["c"], "aside": [str(tmp_path / "none")]})]))


def test_aside_files_of_an_attempt_lie_together(tmp_path):
    batches = [pd.DataFrame({"path": ["a", "a", "b"], "text": ["1", None, "2"]}), pd.DataFrame({"path": ["b", "c"], "text": ["3", "\u8868"]})]
    aside = tmp_path / "root/.writing"
    tries = [pd.concat(list(sinks._write_aside(aside.as_uri(), "\n")(batches))) for _ in range(2)]
    folders = [{os.path.dirname(x) for x in t["aside"]} for t in tries]
    assert [len(f) for f in folders] == [1, 1] and folders[0] != folders[1]
    for t in tries:
        assert [(p, open(x, encoding="utf-8").read()) for p, x in zip(t["path"], t["aside"])] == [("a", "1\n\n"), ("b", "2\n3\n"), ("c", "\u8868\n")]


@pytest.mark.parametrize("links", [True, False])
def test_publishing_with_and_without_links(tmp_path, monkeypatch, links):
    made, link = [], os.link

    def linked(own, target):
        if not links:
            raise PermissionError("no links here")
        link(own, target)
        made.append(target)

    monkeypatch.setattr(os, "link", linked)
    top = tmp_path / "root"
    done = pd.DataFrame([(p, write(str(top / f".w/{n}"), p)) for n, p in enumerate(["a/x", "a/y", "b", "old"])], columns=["path", "aside"])
    write(str(top / "old"), "before")
    os.makedirs(top / "a")
    if links:  # an attempt that ended between the second name and the end of the first
        link(str(top / ".w/0"), str(top / "a/x"))
    for _ in range(2):
        assert [f["files"][0] for f in sinks._publish(top.as_uri())([done])] == [4]
        assert [(top / p).read_text() for p in done["path"]] == list(done["path"])
    assert sorted(made) == ([str(top / "a/y"), str(top / "b")] if links else [])


def test_one_document_in_parts(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("no"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "q", '), "id")).alias("name"))
    joined = lambda p: "".join(open(x, encoding="utf-8").read() for x in parts(p, ".txt"))
    for rows, n in ((df, 500), (df.where("no < 0"), 0), (df.where("no = 3"), 1)):
        to = tmp_path / f"j{n}"
        sinks.write_ordered_lines(sinks.table_json_lines(rows, "no"), str(to), ["part", "key"])
        found = json.loads(joined(to))
        assert found["schema"] == sinks.table_schema(df, "no")
        assert [tuple(r.values()) for r in found["data"]] == [tuple(r) for r in rows.orderBy("no").collect()] and len(found["data"]) == n
    lines = sinks.csv_lines(df, {"no": "番号", "name": "名"}, ["no"])
    sinks.write_ordered_lines(lines, str(tmp_path / "c"), ["part", "no"])
    with_heading = list(csv.reader(io.StringIO(joined(tmp_path / "c"))))
    assert with_heading == [["番号", "名"]] + [[str(r.no), r.name or ""] for r in df.orderBy("no").collect()]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "orders")
    sinks.replace_table(spark, spark.range(3), path, "2024-01-01")
    old = sinks.latest_version(spark, path)
    sinks.replace_table(spark, old.where("id <> 1"), path, "2024-01-02")
    assert sorted(r.id for r in sinks.latest_version(spark, path).collect()) == [0, 2]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.replace_table(spark, spark.range(3), path, "2024-01-02")


def test_log_stream_equals_batch(spark, tmp_path):
    write(str(tmp_path / "logs/a.log"), "[t] [Info]one\nplain\n")
    write(str(tmp_path / "logs/b.log"), "[t] [Error]two\n")
    stream = jobs.log_stream(spark, str(tmp_path / "logs"), files_per_trigger=1)
    jobs.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = logs.with_levels(spark.read.text(str(tmp_path / "logs")).withColumnRenamed("value", "line"))
    key = lambda df: sorted(tuple(r) for r in df.select("line", "level", "message").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)
    assert {r.level for r in batch.collect()} == {"INFO", "ERROR", "UNKNOWN"}


def test_tables_kept_up_with_a_stream(spark, tmp_path):
    rows = [(i, f"k{i % 3}" if i % 7 else None, (i * 37) % 50) for i in range(60)]
    schema = "id long, source string, at long"
    src = str(tmp_path / "in")

    def go(keep, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        keep(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination(120)

    kept = {
        "newest": lambda s, to, cp: jobs.keep_newest(s, to, cp, ["source"], ["at", "id"], 4),
        "firsts": lambda s, to, cp: jobs.keep_firsts(s, to, cp, ["source"], ["at", "id"]),
    }
    for part in (rows[:25], rows[25:]):  # stopped and started again in between
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(src)
        for name, keep in kept.items():
            go(keep, name)
    last = str(tmp_path / "newest")
    # A version whose batch was not finished is not read.
    jobs.folded(spark, last).limit(1).write.parquet(f"{last}/version=99")
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[2], r[0]))
    got = {(r.source, r.at, r.id) for r in jobs.folded(spark, last).collect()}
    assert got == {(k, *x) for k, g in groups.items() for x in sorted(g)[-4:]}
    first = {(r.source, r.at, r.id) for r in jobs.folded(spark, str(tmp_path / "firsts")).collect()}
    assert first == {(k, *min(g)) for k, g in groups.items()}


def test_hit_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        write(str(tmp_path / f"src/p{i}.jsp"), f"<% a{i}\n %><font>x</font><p onclick='f()'>${{a > {i}}}</p>")
    stream = jobs.hit_stream(spark, str(tmp_path / "src"), files_per_trigger=2)
    jobs.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    docs = files.read_texts(spark, str(tmp_path / "src"), [".jsp"]).select(F.col("path").alias("doc_id"), "text")
    key = lambda df: sorted((r.doc_id.rsplit("/", 1)[1], r.rule_id, r.line, r.snippet, r.raw) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(rules.hits(docs)) and tokens(docs).count() == 15


def test_expectations(spark):
    lines = spark.createDataFrame([(2, "[t] [Error]late hit"), (1, "[t] [Debug]hit"), (3, "bare")], "line_no int, line string")
    got = logs.check_expectations(lines, [("DEBUG", "hit"), ("INFO", "late"), ("INFO", "none"), ("UNKNOWN", "bare")])
    assert [(r.text, r.actual, r.message, r.status) for r in got.orderBy("check_no").collect()] == [
        ("hit", "DEBUG", "hit", "match"), ("late", "ERROR", "late hit", "mismatch"), ("none", None, None, "missing"), ("bare", "UNKNOWN", "bare", "match"),
    ]
