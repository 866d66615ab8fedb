import pytest
from pyspark.sql import functions as F

from docloom.operators import grid, group, ingest, quality, tables
from docloom.operators.grid import Area
from docloom.sources import sheets


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(1, 10, "a"), (2, 10, "b"), (3, 20, "c"), (4, None, "d")], "id int, product int, note string"
    )


def test_upsert(spark, orders):
    batch = spark.createDataFrame([(2, 30, "new"), (9, 10, "added")], "id int, product int, note string")
    assert rows(tables.upsert(orders, batch, ["id"]), "id") == [
        (1, 10, "a"), (2, 30, "new"), (3, 20, "c"), (4, None, "d"), (9, 10, "added"),
    ]


def test_upsert_rejects_repeated_keys(spark, orders):
    batch = spark.createDataFrame([(2, 30, "x"), (2, 31, "y")], "id int, product int, note string")
    with pytest.raises(Exception, match="key occurs twice"):
        tables.upsert(orders, batch, ["id"]).collect()
    for narrowed in (lambda df: df.select("id").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="twice"):
            narrowed(tables.upsert(orders, batch, ["id"]))
    with pytest.raises(Exception, match="twice"):
        tables.upsert(orders.select("id"), batch.select("id"), ["id"]).count()


def test_delete_first(orders):
    assert rows(tables.delete_first(orders, ["product"], "id"), "id") == [(2, 10, "b"), (4, None, "d")]
    assert [r[0] for r in rows(tables.delete_first_where(orders, "product", 10, "id"), "id")] == [2, 3, 4]
    assert tables.delete_first_where(orders, "product", 99, "id").count() == 4


def test_union_and_done(spark, orders):
    other = spark.createDataFrame([(1, 0, "z"), (7, 0, "y")], "id int, product int, note string")
    assert [r[2] for r in rows(tables.union_distinct([orders, other], ["id"]), "id")] == ["a", "b", "c", "d", "y"]
    assert tables.union_bag([orders, other]).count() == 6
    assert [r[0] for r in rows(tables.not_in(orders, other, ["id"]), "id")] == [2, 3, 4]


def test_quality(spark, orders):
    double = orders.unionByName(orders.where("id = 1")).unionByName(orders.where("id = 4"))
    assert rows(quality.duplicate_keys(double, ["product"], nulls_allowed=True), "product") == [(10, 3)]
    parents = spark.createDataFrame([(10,)], "pid int")
    assert rows(quality.orphans(orders, parents, "product", "pid")) == [(20, 1)]
    prices = spark.createDataFrame([(1.25,), (1.255,), (123456789.0,), (None,)], "p double")
    got = quality.column_report(prices, {"bad": quality.not_decimal("p"), "nulls": quality.not_null("p")}).first()
    assert tuple(got) == (2, 1)


CELLS = [("s", r, c, f"{r}{c}") for r in range(1, 5) for c in range(1, 5)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "sheet string, row_no int, col_no int, value string")


def at(df):
    return {(r.row_no, r.col_no): r.value for r in df.collect()}


def brute(move):
    out = {}
    for _, r, c, v in CELLS:
        place = move(r, c)
        if place:
            out[place] = v
    return out


BOX = Area(2, 2, 3, 3)


@pytest.mark.parametrize(
    "edit,move",
    [
        (lambda d: grid.delete_rows(d, 2, 3), lambda r, c: None if r in (2, 3) else (r - 2 if r > 3 else r, c)),
        (lambda d: grid.delete_cols(d, 1, 1), lambda r, c: None if c == 1 else (r, c - 1)),
        (lambda d: grid.delete_range(d, BOX), lambda r, c: None if r in (2, 3) and c in (2, 3) else (r - 2 if c in (2, 3) and r > 3 else r, c)),
        (
            lambda d: grid.delete_range(d, BOX, shift_up=True, shift_left=True),
            lambda r, c: None if r in (2, 3) and c in (2, 3) else (r, c - 2 if r in (2, 3) and c > 3 else c),
        ),
        (lambda d: grid.insert_range(d, BOX), lambda r, c: (r + 2 if c in (2, 3) and r >= 2 else r, c)),
        (lambda d: grid.insert_range(d, BOX, shift_right=True), lambda r, c: (r, c + 2 if r in (2, 3) and c >= 2 else c)),
        (lambda d: grid.insert_range(d, BOX, shift_down=False), lambda r, c: (r, c + 2 if r in (2, 3) and c >= 2 else c)),
    ],
)
def test_shifts(cells, edit, move):
    got = edit(cells)
    assert at(got) == brute(move) and got.columns == cells.columns and got.dtypes == cells.dtypes


def test_lists_of_edits_as_made_one_by_one(spark):
    import random

    draw = random.Random(2)
    sheets = {s: {(r, c): f"{s}/{r}/{c}" for r in range(1, 40) for c in range(1, 6)} for s in (1, 2, 3)}
    table = spark.createDataFrame([(s, r, c, v, "own") for s, held in sheets.items() for (r, c), v in held.items()] + [(None, 1, 1, "x", "own")], "sheet int, row_no long, col_no int, value string, start string")
    edits = []
    for s, steps in ((1, 200), (2, 7)):
        for k in range(steps):
            axis = draw.choice(["row", "row", "col"])
            kind = draw.choice(["insert", "insert", "delete"])
            at, n = draw.randint(-2, 8 if axis == "col" else 60), draw.randint(1, 2)
            edits.append((s, k, axis, kind, at, n))
            moved = {}
            for place, v in sheets[s].items():
                x = place[axis == "col"]
                if kind == "delete" and at <= x < at + n:
                    continue
                x += (n if kind == "insert" else -n) if x >= at else 0
                moved[(x, place[1]) if axis == "row" else (place[0], x)] = v
            sheets[s] = moved
    edits += [(3, 1, "row", "insert", None, 1), (3, 2, "row", "insert", 1, 0), (3, 3, "x", "insert", 1, 1), (3, 4, "row", "turn", 1, 1), (None, 1, "row", "delete", 1, 9), (9, 1, "row", "delete", 1, 1)]
    schema = "sheet int, step int, axis string, kind string, at int, n int"
    draw.shuffle(edits)
    done = grid.edit_lines(table, spark.createDataFrame(edits, schema))
    want = [(s, r, c, v, "own") for s, held in sheets.items() for (r, c), v in held.items()] + [(None, 1, 1, "x", "own")]
    assert sorted(map(str, map(tuple, done.collect()))) == sorted(map(str, want)) and len(sheets[1]) > 5
    assert done.schema.simpleString() == table.schema.simpleString()
    untouched = grid.edit_lines(table, spark.createDataFrame([], schema))
    assert sorted(map(str, untouched.collect())) == sorted(map(str, table.collect()))
    assert grid.edit_lines(table.limit(0), spark.createDataFrame(edits, schema)).count() == 0


def test_set_value_adds_missing_cells(spark, cells):
    names = spark.createDataFrame([("s",), ("t",)], "sheet string")
    got = grid.set_value(cells, Area(4, 4, 5, 4), "ID", names)
    assert {(r.sheet, r.row_no, r.col_no) for r in got.where("value = 'ID'").collect()} == {("s", 4, 4), ("s", 5, 4), ("t", 4, 4), ("t", 5, 4)}
    assert got.count() == 16 + 3
    assert grid.set_value(cells, BOX, "x").where("value = 'x'").count() == 4


def test_template_rows_and_columns(spark, cells):
    template = spark.createDataFrame([("t", 11, 1, "A"), ("t", 13, 2, "B"), ("t", 14, 1, "C")], "sheet string, row_no int, col_no int, value string")
    names = cells.select("sheet").distinct()
    got = at(grid.insert_copied_rows(cells, template, 11, 13, 2, names))
    assert (got[(1, 1)], got[(2, 1)], got[(4, 2)], got[(5, 1)], got[(7, 4)]) == ("11", "A", "B", "21", "44")
    wide = at(grid.insert_copied_cols(cells, template, 1, 2, 2, names))
    assert (wide[(1, 1)], wide[(1, 4)], wide[(11, 2)], wide[(13, 3)]) == ("11", "12", "A", "B")


def test_keywords_and_sections(spark):
    cells = spark.createDataFrame(
        [("s", 2, 1, "K"), ("s", 3, 1, "x"), ("s", 5, 1, "K"), ("s", 6, 1, "E"), ("s", 2, 4, "K"), ("t", 1, 1, "K"), ("u", 1001, 1, "K")],
        "sheet string, row_no int, col_no int, value string",
    )
    assert rows(grid.find_row(cells, 1, "K"), "sheet") == [("s", 2), ("t", 1), ("u", 1001)]
    assert rows(grid.find_row(cells, 1, "K", last=1000), "sheet") == [("s", 2), ("t", 1)]
    assert rows(grid.find_row(cells, 1, "K", first=3, last=1000), "sheet") == [("s", 5)]
    assert rows(grid.find_col(cells, 2, "K"), "sheet") == [("s", 1)]
    assert [r[1] for r in rows(grid.section(cells, 1, "K", "E"), "row_no", "col_no")] == [2, 2, 3, 5]
    assert grid.sheets_like(cells, "s|u").count() == 6


def test_objects(spark):
    objects = spark.createDataFrame([("Box 1", "delete me"), ("delete 2", None), (None, "keep"), ("Box 3", "")], "name string, text string")
    assert rows(grid.delete_objects(objects, "delete").select("name"), "name") == [(None,), ("Box 3",)]


def test_fonts(spark):
    cells = spark.createDataFrame([("s", "Arial", 12.0), ("s", "Meiryo", 12.0), ("t", None, None)], "sheet string, font_name string, font_size double")
    done = grid.rescale_fonts(cells, "Meiryo")
    assert rows(done.select("sheet", "font_size", "changed"), "sheet", "font_size") == [("s", 10.5, True), ("s", 12.0, False), ("t", 9.5, True)]
    assert rows(grid.changed_counts(done), "sheet") == [("s", 1), ("t", 1)]


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("s", 1, "No.", "v"), ("s", 2, "7", None)], "book string, r int, a string, b string")
    cells = sheets.to_cells(wide, "book", "r", ["a", "b"])
    header = sheets.header_of(cells, "s")
    assert header == {1: "No.", 2: "v"}
    assert [r.asDict() for r in sheets.to_wide(cells, header).collect()] == [{"sheet": "s", "row_no": 2, "No.": "7", "v": None}]


STEPS = [
    ("1.1", 0, group.OVERVIEW, "first"), ("1.1", 1, group.OVERVIEW, "last"), ("1.1", 2, group.SETUP_SQL, "select 1"),
    ("1.1", 3, group.REQUEST, "URL=/a\nMETHOD=GET\nPOST_DATA="), ("1.1", 4, group.SETUP_SQL, "select 2"),
    ("1.1", 5, group.RESPONSE, "{}"), ("1.1", 6, group.CHECK_SQL, "select 3"), ("1.2", 0, None, "ignored"), (None, 1, group.OVERVIEW, "no key"),
]


def test_last_by_kind(spark):
    """Against a plain walk: items without steps stay, steps without an item go, a null key has no steps."""
    steps = [("a", 1, "x", "one"), ("a", 3, "x", "two"), ("a", 2, "y", "y1"), ("b", 1, "z", "none"), (None, 1, "x", "lost"), ("d", 1, "x", "no item"), ("a", 4, None, "kindless"), ("a", None, "x", "no place"), ("c", 1, "x", None)]
    schema = "no string, pos long, kind string, content string"
    table = spark.createDataFrame(steps, schema)
    items = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("e",), (None,)], "no string")
    for of, keys in ((items, ["a", "b", "c", "e", None]), (table, ["a", "b", "c", "d", None])):
        want = set()
        for k in keys:
            own = [s for s in steps if k is not None and s[0] == k]
            last = max(((s[1], s[3]) for s in own if s[2] == "x" and s[1] is not None), default=(0, ""))[1]
            want.add((k, last or "", sum(s[2] == "y" for s in own)))
        got = [tuple(r) for r in group.last_by_kind(of, table, "no", "pos", "kind", "content", {"last_x": "x"}, {"n_y": "y"}).collect()]
        assert len(got) == len(want) and set(got) == want
    empty = spark.createDataFrame([], schema)
    assert group.last_by_kind(empty, empty, "no", "pos", "kind", "content", {"last_x": "x"}).count() == 0


def test_spec_lines(spark):
    steps = spark.createDataFrame(STEPS, "no string, pos int, kind string, content string").where("no is not null")
    lines = group.spec_lines(steps, "no", "pos", "kind", "content").orderBy("no", "part", "position", "line_no")
    assert [r.line for r in lines.collect()] == [
        "def test_1_1():", "    '''last'''", "    # 事前準備SQL", "    # 実行SQL: select 1", "    # 実行SQL: select 2",
        "    # HTTPリクエスト送信", "    url = '/a'", "    method = 'GET'", "    data = None", "    # HTTPレスポンス判定",
        "    expected_response = {}", "    # 判定用SQL", "    # 判定SQL: select 3", "def test_1_2():", "    pass",
    ]


def test_records_in_chunks(spark):
    steps = spark.createDataFrame(STEPS, "no string, pos int, kind string, content string")
    whole = group.group_records(steps, "no", "pos").orderBy("no").collect()
    assert [(r.no, len(r.records)) for r in whole] == [("1.1", 7), ("1.2", 1)] and whole[0].records[1].content == "last"
    parts = group.group_records(steps, "no", "pos", chunk=3).orderBy("no", "chunk").collect()
    assert [(r.no, r.chunk, len(r.records)) for r in parts] == [("1.1", 0, 3), ("1.1", 1, 3), ("1.1", 2, 1), ("1.2", 0, 1)]
    text = group.render(steps.where("no = '1.1'"), ["no"], "pos", "content", chunk=5).orderBy("chunk").collect()
    assert "\n".join(r.text for r in text) == "\n".join(s[3] for s in STEPS[:7])


def test_latest_with_one_hot_source(spark):
    events = spark.range(0, 5000).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("src"), F.col("id").alias("t"))
    got = ingest.latest(events, ["src"], ["t"], 20, spread=8)
    assert sorted(r.t for r in got.where("src = 'hot'").collect()) == sorted([i for i in range(5000) if i % 100][-20:])
    assert got.where("src = 'cold'").count() == 20


def test_pending(spark):
    src = spark.createDataFrame([("newer", 5), ("equal", 5), ("older", 5), ("none", 5)], "name string, modified int")
    out = spark.createDataFrame([("newer", 6), ("equal", 5), ("older", 4), ("older", 3), ("other", 9)], "name string, modified int")
    assert [r[0] for r in rows(ingest.pending(src, out), "name")] == ["none", "older"]


def test_tally(spark):
    jobs = spark.createDataFrame([("done",), ("skipped",), ("failed",), ("done",)], "status string")
    assert tuple(ingest.tally(jobs).first()) == (4, 3, 1, 1) and ingest.failures(jobs).count() == 1


def test_spread_moves_small_scans_only(spark):
    from docloom.operators.rows import join_one_per_key, spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 5)).rdd.getNumPartitions() == cores + 5
    facts = spark.range(0, 1000).select(F.lit("hot").alias("k"), "id").unionByName(spark.range(5).select(F.lit("cold").alias("k"), "id"))
    one = spark.createDataFrame([("hot", 1), ("none", 2)], "k string, v int")
    got = join_one_per_key(facts, one, ["k"], salt=F.col("id"))
    assert got.count() == 1000 and got.columns == ["k", "id", "v"]
