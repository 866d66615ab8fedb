"""Cell-grid operators over long tables ``(sheet, row_no, col_no, value)`` of many sheets.

An edit is one expression over the original coordinates and touches every row once; nothing is shuffled
unless cells of two tables must be matched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.address import rescaled_size
from docloom.functions.text import name_matches
from docloom.operators.rows import explode_rows, join_one_per_key

ROW, COL = "row_no", "col_no"


@dataclass(frozen=True)
class Area:
    """Rectangle of cells, bounds included."""

    top: int
    left: int
    bottom: int
    right: int

    @property
    def height(self) -> int:
        return self.bottom - self.top + 1

    @property
    def width(self) -> int:
        return self.right - self.left + 1

    def holds(self) -> Column:
        return F.col(ROW).between(self.top, self.bottom) & F.col(COL).between(self.left, self.right)


def _moved(cells: DataFrame, axis: str, when: Column, by: int) -> DataFrame:
    """Shift ``axis`` by ``by`` where ``when`` holds; the column order and type stay."""
    kind = cells.schema[axis].dataType
    shifted = F.when(when, F.col(axis) + by).otherwise(F.col(axis)).cast(kind).alias(axis)
    return cells.select(*[shifted if c == axis else F.col(c) for c in cells.columns])


def set_value(cells: DataFrame, area: Area, value: str, sheets: DataFrame | None = None) -> DataFrame:
    """Give every cell of ``area`` the value. With ``sheets``, cells that do not exist yet are added."""
    changed = cells.withColumn("value", F.when(area.holds(), F.lit(value)).otherwise(F.col("value")))
    if sheets is None:
        return changed
    row_type, col_type = cells.schema[ROW].dataType, cells.schema[COL].dataType
    rows = sheets.select("sheet", F.explode(F.sequence(F.lit(area.top).cast(row_type), F.lit(area.bottom).cast(row_type))).alias(ROW))
    wanted = rows.select("sheet", ROW, F.explode(F.sequence(F.lit(area.left).cast(col_type), F.lit(area.right).cast(col_type))).alias(COL))
    present = cells.where(area.holds()).select("sheet", ROW, COL)
    added = wanted.join(present, ["sheet", ROW, COL], "left_anti").withColumn("value", F.lit(value))
    return changed.unionByName(added, allowMissingColumns=True)


def delete_rows(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Remove rows first..last; later rows move up."""
    kept = cells.where(~F.col(ROW).between(first, last))
    return _moved(kept, ROW, F.col(ROW) > last, -(last - first + 1))


def delete_cols(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Remove columns first..last; later columns move left."""
    kept = cells.where(~F.col(COL).between(first, last))
    return _moved(kept, COL, F.col(COL) > last, -(last - first + 1))


def delete_range(cells: DataFrame, area: Area, shift_up: bool = True, shift_left: bool = False) -> DataFrame:
    """Remove a rectangle and close the gap from below, or from the right where ``shift_left`` is set."""
    kept = cells.where(~area.holds())
    if shift_left or not shift_up:
        beyond = F.col(ROW).between(area.top, area.bottom) & (F.col(COL) > area.right)
        return _moved(kept, COL, beyond, -area.width)
    beyond = F.col(COL).between(area.left, area.right) & (F.col(ROW) > area.bottom)
    return _moved(kept, ROW, beyond, -area.height)


def insert_range(cells: DataFrame, area: Area, shift_down: bool = True, shift_right: bool = False) -> DataFrame:
    """Open a blank rectangle, pushing cells down, or to the right where ``shift_right`` is set."""
    if shift_right or not shift_down:
        beyond = F.col(ROW).between(area.top, area.bottom) & (F.col(COL) >= area.left)
        return _moved(cells, COL, beyond, area.width)
    beyond = F.col(COL).between(area.left, area.right) & (F.col(ROW) >= area.top)
    return _moved(cells, ROW, beyond, area.height)


CHUNK = 32  # turning points of a sheet that are looked through at once


def turning_points(edits: DataFrame) -> DataFrame:
    """Lists of edits as one map per sheet and axis: ``(sheet, axis, start, move, lost)``. From line ``start`` of the sheet as it
    was up to the next turning point, lines move by ``move`` in all or, where ``lost``, are deleted by some edit.

    ``edits`` are rows ``(sheet, step, axis, kind, at, n)``: in the order of ``step``, ``n`` blank lines are put before line
    ``at`` (kind insert), or lines ``at`` to ``at + n - 1`` go (delete); axis is row or col. ``at`` counts as the sheet stands
    at that step, so it is first carried back through the earlier edits of its sheet. Steps that are equal go by kind, at and
    n. Rows with a null, with another kind or axis or with n below 1 change nothing. The edits of one sheet are one row in
    between, and the work on them grows with the square of their number.
    """
    usable = edits.where("axis in ('row', 'col') and kind in ('insert', 'delete') and n >= 1 and at is not null and step is not null and sheet is not null")
    one = F.struct("step", "kind", F.col("at").cast("bigint").alias("at"), F.col("n").cast("bigint").alias("n"))
    listed = usable.groupBy("sheet", "axis").agg(F.sort_array(F.collect_list(one)).alias("edits"))

    def before(line: Column, edit: Column) -> Column:
        """The first line that stands at ``line`` or beyond it after the edit."""
        at, n = edit["at"], edit["n"]
        opened = F.when(line <= at, line).otherwise(F.greatest(at, line - n))
        return F.when(edit["kind"] == "insert", opened).otherwise(F.when(line < at, line).otherwise(line + n))

    def points(edit: Column, i: Column) -> Column:
        earlier = F.reverse(F.slice(F.col("edits"), F.lit(1), i))
        origin = lambda line: F.aggregate(earlier, line, before)
        point = lambda start, move, lost: F.struct(start.alias("start"), move.alias("move"), F.lit(lost).alias("lost"))
        none = F.lit(0).cast("bigint")
        gone = F.array(point(origin(edit["at"]), none, 1), point(origin(edit["at"] + edit["n"]), -edit["n"], -1))
        return F.when(edit["kind"] == "insert", F.array(point(origin(edit["at"]), edit["n"], 0))).otherwise(gone)

    each = listed.select("sheet", "axis", F.explode(F.flatten(F.transform("edits", points))).alias("p"))
    summed = each.groupBy("sheet", "axis", "p.start").agg(F.sum("p.move").alias("move"), F.sum("p.lost").alias("lost"))
    so_far = Window.partitionBy("sheet", "axis").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("sheet", "axis", "start", F.sum("move").over(so_far).alias("move"), (F.sum("lost").over(so_far) > 0).alias("lost"))


def edit_lines(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert and delete whole rows and columns, each sheet by its own list of ``edits`` (see ``turning_points``).

    However long the lists are, cells are read once: each looks up its row and its column among the turning points of its
    sheet. Cells of sheets without edits stay. Sheets with most of the cells are dealt to many tasks.
    """
    point = F.struct("start", "move", "lost")
    of_axis = lambda a: F.sort_array(F.collect_list(F.when(F.col("axis") == a, point)))
    chunked = lambda all_: F.when(
        F.size(all_) > 0,
        F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda j: F.slice(all_, j * CHUNK + 1, F.lit(CHUNK))),
    )
    maps = turning_points(edits).groupBy("sheet").agg(of_axis("row").alias("__rows"), of_axis("col").alias("__cols"))
    maps = maps.select("sheet", *[chunked(F.col(c)).alias(c) for c in ("__rows", "__cols")])

    def found(chunks: str, line: str) -> Column:
        chunk = F.get(F.col(chunks), F.size(F.filter(chunks, lambda c: c[0]["start"] <= F.col(line))) - 1)
        return F.get(chunk, F.size(F.filter(chunk, lambda p: p["start"] <= F.col(line))) - 1)

    # An outer array of one binds each look-up once.
    both = F.array(F.struct(found("__rows", ROW).alias("r"), found("__cols", COL).alias("c")))
    placed = F.transform(
        both,
        lambda b: F.struct(
            *[(F.col(x) + F.coalesce(b[k]["move"], F.lit(0))).cast(cells.schema[x].dataType).alias(x) for x, k in ((ROW, "r"), (COL, "c"))],
            (F.coalesce(b["r"]["lost"], F.lit(False)) | F.coalesce(b["c"]["lost"], F.lit(False))).alias("lost"),
        ),
    )
    joined = join_one_per_key(cells, maps, ["sheet"], salt=F.struct(ROW, COL), how="left")
    kept = explode_rows(joined, cells.columns, F.filter(placed, lambda p: ~p["lost"]), "__pos", "__at")
    return kept.select(*[F.col(f"__at.{c}").alias(c) if c in (ROW, COL) else F.col(c) for c in cells.columns])


def insert_copied_rows(cells: DataFrame, template: DataFrame, first: int, last: int, at: int, sheets: DataFrame) -> DataFrame:
    """Insert rows first..last of a template sheet before row ``at`` of every sheet in ``sheets``."""
    moved = _moved(cells, ROW, F.col(ROW) >= at, last - first + 1)
    return moved.unionByName(_stamped(template.where(F.col(ROW).between(first, last)), ROW, (first, last), at - first, cells, sheets))


def insert_copied_cols(cells: DataFrame, template: DataFrame, first: int, last: int, at: int, sheets: DataFrame) -> DataFrame:
    """Insert columns first..last of a template sheet before column ``at`` of every sheet in ``sheets``."""
    moved = _moved(cells, COL, F.col(COL) >= at, last - first + 1)
    return moved.unionByName(_stamped(template.where(F.col(COL).between(first, last)), COL, (first, last), at - first, cells, sheets))


def _stamped(block: DataFrame, axis: str, bounds: tuple[int, int], by: int, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The template block, moved by ``by``, once per sheet.

    Every sheet asks for each template row (or column) by its number and joins the cells that have it, so the block may
    have any size; Spark broadcasts it where its own size check allows.
    """
    kinds = {c: cells.schema[c].dataType for c in (ROW, COL, "value")}
    asked = sheets.select("sheet", F.explode(F.sequence(*[F.lit(b).cast(kinds[axis]) for b in bounds])).alias("__line"))
    lines = block.select(F.col(axis).cast(kinds[axis]).alias("__line"), ROW, COL, "value")
    placed = {c: (F.col(c) + (by if c == axis else 0)) if c != "value" else F.col(c) for c in kinds}
    stamped = asked.join(lines, "__line").select("sheet", *[placed[c].cast(k).alias(c) for c, k in kinds.items()])
    return stamped.select(*cells.columns)


def delete_objects(objects: DataFrame, text: str) -> DataFrame:
    """Drop drawing objects whose text or name holds ``text``."""
    named = F.coalesce(F.contains("name", F.lit(text)), F.lit(False))
    told = F.coalesce(F.contains("text", F.lit(text)), F.lit(False))
    return objects.where(~(named | told))


def _from_to(axis: str, first: int, last: int | None) -> Column:
    return F.col(axis) >= first if last is None else F.col(axis).between(first, last)


def find_row(cells: DataFrame, col: int, keyword: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Per sheet the first row whose cell in ``col`` equals the keyword, to the end of the sheet unless told otherwise;
    sheets without it are left out."""
    found = cells.where((F.col(COL) == col) & (F.col("value") == keyword) & _from_to(ROW, first, last))
    return found.groupBy("sheet").agg(F.min(ROW).alias(ROW))


def find_col(cells: DataFrame, row: int, keyword: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Per sheet the first column whose cell in ``row`` equals the keyword, all columns unless told otherwise."""
    found = cells.where((F.col(ROW) == row) & (F.col("value") == keyword) & _from_to(COL, first, last))
    return found.groupBy("sheet").agg(F.min(COL).alias(COL))


def section(cells: DataFrame, col: int, start: str, end: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Cells from the row marked ``start`` to the row before the one marked ``end``, per sheet.

    Both markers come from one filtered aggregate; sheets that lack either are left out.
    """
    at = lambda keyword: F.min(F.when(F.col("value") == keyword, F.col(ROW)))
    marks = (
        cells.where((F.col(COL) == col) & F.col("value").isin(start, end) & _from_to(ROW, first, last))
        .groupBy("sheet")
        .agg(at(start).alias("__from"), at(end).alias("__to"))
        .where(F.col("__from").isNotNull() & F.col("__to").isNotNull())
    )
    return (
        join_one_per_key(cells, marks, ["sheet"], salt=F.col(ROW))
        .where((F.col(ROW) >= F.col("__from")) & (F.col(ROW) < F.col("__to")))
        .select(*cells.columns)
    )


def sheets_like(cells: DataFrame, pattern: str) -> DataFrame:
    """Cells of the sheets whose name matches from its start."""
    return cells.where(name_matches(F.col("sheet"), pattern))


def rescale_fonts(cells: DataFrame, target_font: str) -> DataFrame:
    """Set the font of every cell that has another one and rescale its size.

    ``changed`` marks the cells that were touched.
    """
    differs = ~F.col("font_name").eqNullSafe(F.lit(target_font))
    return cells.select(
        *[c for c in cells.columns if c not in ("font_name", "font_size")],
        F.lit(target_font).alias("font_name"),
        F.when(differs, rescaled_size(F.col("font_size"))).otherwise(F.col("font_size").cast("double")).alias("font_size"),
        differs.alias("changed"),
    )


def changed_counts(cells: DataFrame) -> DataFrame:
    """Number of touched cells per sheet."""
    return cells.groupBy("sheet").agg(F.count_if("changed").alias("n_changed"))
