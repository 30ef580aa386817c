"""CSV records from lines.

A CSV file is read as lines, in splits, like any other text. A quoted cell may
span lines, so whether a line starts inside quotes depends on all lines before it.
For each line two facts are independent of that: whether it ends inside quotes if
it starts outside (``_opens``), and if it starts inside (``_stays``). Their running
combination is computed in pieces of a file and then over the small table of
pieces, and only for files in which some line opens a cell at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import reversed_keys
from ..operators.parse import finish_records, mapping_records
from ..session import lookup_join, materialize
from .lines import present

PIECE_BITS = 20
_PIECE = ["source", "_piece"]
_DIALECT = ["delimiter", "quote", "skip_space"]


def _quoting(delimiter: str, quote: str, skip_space: bool) -> tuple[str, str]:
    """Patterns of lines that end inside quotes: started outside, started inside."""
    d, q = re.escape(delimiter), re.escape(quote)
    blank = " *+" if skip_space else ""
    inside = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    cell = rf"(?:{blank}(?:{q}{inside}{q}[^{d}]*+|[^{q}{d}][^{d}]*+|){d})*+"
    opened = rf"{cell}{blank}{q}{inside}$"
    return rf"^{opened}", rf"^{inside}(?:{q}[^{d}]*+{d}{opened}|$)"


def _by_dialect(dialects: list, value) -> Column:
    """The expression ``value(dialect)`` of each row's own dialect."""
    chosen = None
    for dialect in dialects:
        same = (
            (F.col("delimiter") == dialect["delimiter"])
            & (F.col("quote") == dialect["quote"])
            & (F.col("skip_space") == dialect["skip_space"])
        )
        branch = value(dialect)
        chosen = F.when(same, branch) if chosen is None else chosen.when(same, branch)
    return chosen


def parsed_cells(records: DataFrame, dialects: list, width: int) -> DataFrame:
    """``records`` with the first ``width`` cells of their ``value`` as ``cells``, each row
    in its own dialect."""
    names = [f"c{index}" for index in range(max(width, 1))]

    def cells(dialect) -> Column:
        options = {
            "sep": dialect["delimiter"],
            "quote": dialect["quote"],
            "escape": dialect["quote"],
            "maxColumns": str(width + 20_480),
            "ignoreLeadingWhiteSpace": str(dialect["skip_space"]).lower(),
        }
        return F.from_csv("value", ", ".join(f"{name} string" for name in names), options)

    parsed = records.withColumn("_row", _by_dialect(dialects, cells))
    return parsed.withColumn("cells", F.array(*(F.col(f"_row.{name}") for name in names))).drop("_row")


def line_states(lines: DataFrame, dialects: list) -> DataFrame:
    def pattern(index: int, without_quote: bool) -> Column:
        return _by_dialect(
            dialects,
            lambda dialect: F.when(
                F.col("value").contains(dialect["quote"]),
                F.rlike("value", F.lit(_quoting(*(dialect[name] for name in _DIALECT))[index])),
            ).otherwise(F.lit(without_quote)),
        )

    return lines.withColumns({"_opens": pattern(0, False), "_stays": pattern(1, True)})


def stitch_lines(lines: DataFrame) -> DataFrame:
    """Join the lines of each record: source, line_number (last line), arrival,
    first_line, value.

    ``lines`` has source, line_number, arrival, value, _opens and _stays.
    """
    placed = lines.withColumn("_piece", F.shiftright(F.col("line_number") - 1, PIECE_BITS))
    in_piece = Window.partitionBy(*_PIECE).orderBy("line_number")
    so_far = in_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_file = Window.partitionBy("source").orderBy("_piece")
    file_so_far = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    flips = (F.col("_opens") & ~F.col("_stays")).cast("int")
    settled = F.when(
        F.col("_opens") == F.col("_stays"), (F.col("_opens").cast("int") + F.col("_flips")) % 2
    )
    scanned = placed.withColumn("_flips", F.sum(flips).over(so_far)).withColumn(
        "_settled", F.last(settled, ignorenulls=True).over(so_far)
    )
    ends = scanned.groupBy(*_PIECE).agg(
        F.max("_flips").alias("_flips"), F.max_by("_settled", "line_number").alias("_settled")
    )
    ends = ends.withColumn("_all", F.sum("_flips").over(file_so_far))
    known = (F.col("_settled") + F.col("_flips") + F.col("_all")) % 2
    ends = ends.withColumn("_known", F.last(known, ignorenulls=True).over(file_so_far))
    after = (F.coalesce("_known", F.lit(0)) + F.col("_all")) % 2
    starts = ends.withColumn("_after", after).select(
        *_PIECE, F.lag("_after", 1, 0).over(in_file).alias("_start")
    )

    entered = lookup_join(
        scanned, materialize(starts, "csv-starts"), _PIECE, F.col("line_number"), how="inner"
    )
    ends_inside = (F.coalesce("_settled", "_start") + F.col("_flips")) % 2
    states = entered.withColumn("_ends_inside", ends_inside).withColumn(
        "_starts_inside", F.coalesce(F.lag("_ends_inside").over(in_piece), "_start")
    )
    begun = F.when(F.col("_starts_inside") == 0, F.col("line_number"))
    states = materialize(
        states.withColumn("_begun", F.last(begun, ignorenulls=True).over(so_far)).select(
            *_PIECE, "line_number", "arrival", "value", "_starts_inside", "_ends_inside", "_begun"
        ),
        "csv-states",
    )
    carried = (
        states.groupBy(*_PIECE)
        .agg(F.max("_begun").alias("_begun"))
        .withColumn(
            "_carried",
            F.last("_begun", ignorenulls=True).over(
                in_file.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*_PIECE, "_carried")
    )
    single = (F.col("_starts_inside") == 0) & (F.col("_ends_inside") == 0)
    whole = states.where(single).select(
        "source",
        "line_number",
        "arrival",
        F.col("line_number").alias("first_line"),
        "value",
    )
    parts = lookup_join(
        states.where(~single),
        materialize(carried, "csv-carried"),
        _PIECE,
        F.col("line_number"),
        how="inner",
    ).withColumn("first_line", F.coalesce("_begun", "_carried"))
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("line_number", "value"))),
        lambda part: part["value"],
    )
    joined = parts.groupBy("source", "first_line").agg(
        F.max("line_number").alias("line_number"),
        F.max("arrival").alias("arrival"),
        F.array_join(text, "\n").alias("value"),
    )
    return whole.unionByName(joined)


def csv_rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of cells: source, line_number, arrival, header, keys, cells.

    ``lines`` are numbered lines of CSV files, ``heads`` the dialects and headers.
    """
    dialects = heads.where(F.size("header") > 0).select(*_DIALECT).distinct().collect()
    width = heads.select(F.max(F.size("header")).alias("width")).first()["width"]
    # Keys are brought into shape once per file.
    about = heads.select("source", *_DIALECT, "header", reversed_keys(F.col("header")).alias("keys"))
    known = lookup_join(lines, about, ["source"], F.col("line_number"))
    known = known.withColumn("delimiter", present("delimiter")).where(F.size("header") > 0)
    states = line_states(known, dialects)
    opening = materialize(states.where("_opens").select("source").distinct(), "csv-opening")
    records = states.select(
        "source",
        "line_number",
        "arrival",
        F.col("line_number").alias("first_line"),
        "value",
        *_DIALECT,
        "header",
        "keys",
    )
    if not opening.isEmpty():
        marked = opening.withColumn("_spans", F.lit(True))
        by_source = ["source"]
        states = lookup_join(states, marked, by_source, F.col("line_number"))
        spans = F.col("_spans").isNotNull()
        stitched = stitch_lines(
            states.where(spans).select(
                "source", "line_number", "arrival", "value", "_opens", "_stays"
            )
        )
        stitched = lookup_join(stitched, about, by_source, F.col("line_number"), how="inner")
        simple = lookup_join(records, marked, by_source, F.col("line_number")).where(
            F.col("_spans").isNull()
        )
        records = simple.drop("_spans").unionByName(stitched)

    data = records.where((F.col("first_line") > 1) & (F.col("value") != ""))
    return parsed_cells(data, dialects, width or 0).select(
        "source",
        "line_number",
        "arrival",
        "header",
        "keys",
        F.slice("cells", F.lit(1), F.size("header")).alias("cells"),
    )


def csv_records(lines: DataFrame, heads: DataFrame, default_timezone: str = "UTC") -> DataFrame:
    """Records of CSV files, with one dead letter for each file without a header."""
    without = heads.where(F.size("header") == 0).select("source", "sample")
    missing = lookup_join(
        lines.where(F.col("line_number") == 1), without, ["source"], F.col("line_number"), "inner"
    ).select(
        "source",
        "line_number",
        "arrival",
        *(
            F.lit(None).cast("string").alias(name)
            for name in ("_time_text", "_level_text", "service", "message", "correlation_id")
        ),
        F.lit(None).cast("map<string,string>").alias("fields"),
        F.lit("CSV header is missing").alias("_shape_reason"),
        F.col("sample").alias("_preview_text"),
    )
    records = finish_records(missing, default_timezone)
    if heads.where(F.size("header") > 0).isEmpty():
        return records
    rows = csv_rows(lines, heads)
    preview = F.array_join(
        F.zip_with(
            "header",
            "cells",
            lambda key, cell: F.concat(key, F.lit("="), F.coalesce(cell, F.lit(""))),
        ),
        ", ",
    )
    shaped = rows.select(
        "source",
        "line_number",
        "arrival",
        "header",
        "keys",
        "cells",
        F.lit(None).cast("string").alias("_shape_reason"),
    )
    parsed = mapping_records(shaped, F.col("keys"), F.col("cells"), preview, default_timezone)
    return parsed.drop("header", "keys", "cells").unionByName(records)
