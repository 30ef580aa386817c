"""Format of input files: by suffix, else by a look at the first lines.

All files are looked into together. Counts of lines and of filled lines per chunk of rows
tell which chunks hold the first lines of each file; only these are looked at. How often
each candidate delimiter occurs in the lines of a file's bounded sample, and next to how
many quoted cells, is counted, and the best candidate chosen by an aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BLANKS, CSV_DELIMITERS, FIELD_ALIASES, SNIFF_CHARS, SNIFF_LINES
from ..session import lookup_join, materialize
from .csv_lines import line_states, parsed_cells
from .lines import files_table, list_files, read_lines

FORMATS = ["plain", "jsonl", "csv"]
_SUFFIXES = {"jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "log": "plain", "txt": "plain"}
_SUFFIX = r"(?i)[^/]\.(jsonl|ndjson|csv|log|txt)(?:\.gz)?$"
#: Rows of a chunk, as bits of the row key.
HEAD_BITS = 10
#: Share of the lines that have a delimiter equally often, if no quoted cell tells more.
REGULAR = 0.9
SAMPLE_CHARS = 200
DEFAULT = {"delimiter": ",", "quote": '"', "skip_space": False}
_HEAD = ["source", "context"]
_DIALECT = ["delimiter", "quote", "skip_space"]


def suffix_format(file_name: Column) -> Column:
    """Format that a file name or path stands for, NULL if its suffix says nothing."""
    table = F.create_map(*(F.lit(text) for pair in _SUFFIXES.items() for text in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(file_name, _SUFFIX, 1)))


def format_of_name(file_name: str) -> str | None:
    """The same for one name."""
    found = re.search(_SUFFIX, "/" + file_name)
    return _SUFFIXES[found[1].lower()] if found else None


def name_has_format(name: str) -> Column:
    """Condition on the file's metadata: its suffix stands for this format."""
    suffixes = "|".join(suffix for suffix, fmt in _SUFFIXES.items() if fmt == name)
    return F.col("_metadata.file_name").rlike(rf"(?i)[^/]\.({suffixes})(?:\.gz)?$")


def name_needs_look() -> Column:
    """Condition on the file's metadata: its first lines decide on format or dialect."""
    return ~name_has_format("plain") & ~name_has_format("jsonl")


def head_lines(lines: DataFrame) -> DataFrame:
    """The lines that a look at the files needs: ``source``, ``place`` (from 0) and ``value``.

    These are the first ``SNIFF_CHARS`` lines, as a line has a character at least, and those
    with the first filled lines, however many blank ones come before.
    """
    chunk = ["source", "block_start", "chunk"]
    keyed = lines.withColumn("chunk", F.shiftright("row_key", HEAD_BITS))
    filled = F.count_if(F.col("value").rlike(r"(?U)\S"))
    counts = keyed.groupBy(*chunk).agg(F.min("row_key").alias("first_key"), F.count("*").alias("n"), filled.alias("filled"))
    earlier = Window.partitionBy("source").orderBy("block_start", "chunk").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    needed = (F.col("before") < SNIFF_CHARS) | ((F.col("filled_before") < SNIFF_LINES) & (F.col("filled") > 0))
    placed = counts.withColumns({"before": before("n"), "filled_before": before("filled")}).where(needed)
    chosen = materialize(placed.select(*chunk, "first_key", "before"), "head-chunks")
    place = F.col("before") + F.col("row_key") - F.col("first_key")
    return lookup_join(keyed, chosen, chunk, F.col("row_key"), "inner").select("source", place.alias("place"), "value")


def samples(heads: DataFrame) -> DataFrame:
    """What dialects are told by: the first characters of a file (``context`` head), and its
    first filled lines (``context`` filled). ``sample`` is the line as far as it counts."""
    order = Window.partitionBy("source").orderBy("place")
    ahead = F.sum(F.char_length("value") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    room = F.lit(SNIFF_CHARS) - F.coalesce("ahead", F.lit(0))
    first = heads.where(F.col("place") < SNIFF_CHARS).withColumn("ahead", ahead).select(
        "source", F.lit("head").alias("context"), "place", "value",
        F.when(room > 0, F.left("value", room.cast("int"))).alias("sample"),
    )
    filled = heads.where(F.col("value").rlike(r"(?U)\S")).withColumn("rank", F.row_number().over(order))
    few = filled.where(F.col("rank") <= SNIFF_LINES).select(
        "source", F.lit("filled").alias("context"), "place", "value", F.col("value").alias("sample")
    )
    return first.unionByName(few)


def _traces(delimiter: str) -> Column:
    """What a sample says for a delimiter: how often each of its lines has it outside of
    quotes, and the cells in quotes next to it."""
    d = f"[{re.escape(delimiter)}]" if delimiter != "\t" else r"\t"
    text = F.col("text")

    def cell(quote: str) -> str:
        return f"{quote}(?:[^{quote}]++|{quote}{quote})*+{quote}"

    def times(value: Column, part: str) -> Column:
        return F.regexp_count(value, F.lit(f"(?m){part}"))

    def beside(quote: str) -> str:
        return f"^ ?{cell(quote)}(?={d})|{d} ?{cell(quote)}(?={d}|$)"

    any_cell = f"(?:{cell('"')}|{cell("'")})"
    bare = F.regexp_replace(text, f"(?m)(^|{d}) ?{any_cell}(?={d}|$)", "$1")
    lines = F.filter(F.split(bare, "\n"), lambda line: line != "")
    return F.struct(
        F.lit(delimiter).alias("delimiter"),
        F.transform(lines, lambda line: F.size(F.split(line, d, -1)) - 1).alias("times"),
        times(text, beside('"')).alias("double"),
        times(text, beside("'")).alias("single"),
        times(text, f"{d} {any_cell}(?={d}|$)").alias("spaced"),
        times(text, f"{d}{any_cell}(?={d}|$)").alias("close"),
        (times(F.get(lines, F.lit(0)), d) == times(F.get(lines, F.lit(0)), f"{d} ")).alias("first_spaced"),
    )


def dialects(sampled: DataFrame) -> DataFrame:
    """``delimiter``, ``quote`` and ``skip_space`` of each file and context that show one.

    The delimiter next to the most quoted cells wins, else the one that the most lines have
    equally often, if nine of ten do; ties go to the comma, tab, semicolon and bar.
    """
    parts = F.sort_array(F.collect_list(F.struct("place", "sample")))
    texts = sampled.where(F.col("sample") != "").groupBy(*_HEAD).agg(F.array_join(parts["sample"], "\n").alias("text"))
    each = F.explode(F.array(*(_traces(d) for d in CSV_DELIMITERS))).alias("x")
    told = texts.select(*_HEAD, each).select(*_HEAD, "x.*")
    counted = told.select("*", F.explode("times").alias("count"))
    about = ["delimiter", "double", "single", "spaced", "close", "first_spaced"]
    histogram = counted.groupBy(*_HEAD, *about, "count").agg(F.count("*").alias("n"))
    candidates = histogram.groupBy(*_HEAD, *about).agg(
        F.max(F.when(F.col("count") > 0, F.col("n"))).alias("regular"), F.sum("n").alias("n")
    )
    quoted = F.greatest("double", "single")
    share = F.col("regular") / F.col("n")
    order = F.array_position(F.array(*map(F.lit, ",\t;|")), F.col("delimiter"))
    spaced = F.when(quoted > 0, (F.col("spaced") > 0) & (F.col("close") == 0)).otherwise(F.col("first_spaced"))
    best = candidates.where((quoted > 0) | (share >= REGULAR)).groupBy(*_HEAD).agg(
        F.max_by(
            F.struct(
                "delimiter",
                F.when(F.col("single") > F.col("double"), "'").otherwise('"').alias("quote"),
                spaced.alias("skip_space"),
            ),
            F.struct(quoted, F.coalesce(share, F.lit(0.0)), -order),
        ).alias("best")
    )
    return best.select(*_HEAD, "best.*")


def headers(rows: DataFrame) -> DataFrame:
    """The first record of each file and context: ``header``, its cells.

    ``rows`` are the lines with their dialect. A cell in quotes may go on in later lines.
    """
    used = rows.select(*_DIALECT).distinct().collect()
    if not used:
        return rows.select(*_HEAD, F.array().cast("array<string>").alias("header"))
    order = Window.partitionBy(*_HEAD).orderBy("place")
    states = line_states(rows, used).withColumn("rank", F.row_number().over(order))
    open_ = F.when(F.col("rank") == 1, F.col("_opens")).otherwise(F.col("_stays"))
    ended = F.min(F.when(~open_, F.col("rank"))).over(Window.partitionBy(*_HEAD))
    first = states.withColumn("ended", ended).where(F.col("rank") <= F.coalesce("ended", F.lit(SNIFF_CHARS)))
    record = first.groupBy(*_HEAD, *_DIALECT).agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("parts"))
    record = record.select(*_HEAD, *_DIALECT, F.array_join("parts.value", "\n").alias("value"))
    outside = F.when(F.col("quote") == "'", F.regexp_replace("value", "'[^']*'", "")).otherwise(
        F.regexp_replace("value", '"[^"]*"', "")
    )
    delimiters = F.char_length(outside) - F.char_length(F.replace(outside, F.col("delimiter"), F.lit("")))
    counted = materialize(record.withColumn("width", F.when(F.col("value") == "", 0).otherwise(delimiters + 1)), "headers")
    widest = counted.select(F.max("width").alias("width")).first()["width"] or 0
    cells = F.transform("cells", lambda cell: F.coalesce(cell, F.lit("")))
    return parsed_cells(counted, used, widest).select(*_HEAD, F.slice(cells, F.lit(1), F.col("width")).alias("header"))


def _names_a_log(header: Column) -> Column:
    keys = F.transform(header, lambda key: F.replace(F.lower(F.btrim(key, F.lit(BLANKS))), F.lit(" "), F.lit("_")))

    def some(field: str) -> Column:
        return F.arrays_overlap(keys, F.array(*map(F.lit, FIELD_ALIASES[field])))

    return some("timestamp") & some("message")


def sniff_heads(lines: DataFrame, log_format: str | None = None) -> DataFrame:
    """Format, dialect and header of files from their lines (see ``lines.read_lines``):
    ``source``, ``format``, ``delimiter``, ``quote``, ``skip_space``, ``header`` and
    ``sample``. Dialects are those of CSV files only. Empty files give no row.

    ``log_format`` or a telling suffix settles the format before the first lines do.
    """
    sampled = materialize(samples(materialize(head_lines(lines), "first-lines")), "heads")
    found = materialize(dialects(sampled), "dialects")
    known = materialize(
        sampled.join(found, _HEAD, "left").withColumns({name: F.coalesce(name, F.lit(x)) for name, x in DEFAULT.items()}),
        "head-lines",
    )
    header = materialize(headers(known.select(*_HEAD, "place", "value", *_DIALECT)), "header-cells")
    parts = F.sort_array(F.collect_list(F.when(F.col("place") < SAMPLE_CHARS, F.struct("place", "sample"))))
    start = F.array_join(F.transform(parts, lambda part: F.concat(part["sample"], F.lit("\n"))), "")
    first = F.min_by(F.ltrim(F.col("value"), F.lit(BLANKS)), "place")
    heads = sampled.where("context = 'head'").groupBy("source").agg(F.left(start, F.lit(SAMPLE_CHARS)).alias("sample"))
    filled = sampled.where("context = 'filled'").groupBy("source").agg(first.startswith("{").alias("is_json"))
    looks = found.where("context = 'filled'").join(header, _HEAD).select("source", _names_a_log(F.col("header")).alias("is_csv"))
    told = F.when(F.col("is_json"), "jsonl").when(F.col("is_csv"), "csv").otherwise("plain")
    settled = F.lit(log_format) if log_format else suffix_format(F.col("source"))
    files = heads.join(filled, "source", "left").join(looks, "source", "left").select(
        "source", F.coalesce(settled, told).alias("format"), "sample"
    )
    dialect = known.where("context = 'head'").select("source", *_DIALECT).distinct()
    own = header.where("context = 'head'").select("source", "header")
    described = files.join(dialect, "source", "left").join(own, "source", "left")
    shown = [F.when(F.col("format") == "csv", F.col(name)).alias(name) for name in (*_DIALECT, "header", "sample")]
    return described.select("source", "format", *shown)


def detect_formats(files: DataFrame, heads: DataFrame) -> DataFrame:
    """``files`` with their format; a file without any text counts as plain."""
    sniffed = heads.select("source", F.col("format").alias("sniffed"), "delimiter")
    detected = F.coalesce(suffix_format(F.col("file_name")), "sniffed", F.lit("plain"))
    joined = files.join(sniffed, "source", "left").withColumn("format", detected)
    return joined.select("source", "ordinal", "format", "delimiter")


def detect_format(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Format of each input file: source, ordinal, format, delimiter."""
    files = list_files(spark, paths)
    return detect_formats(files_table(spark, files), sniff_heads(read_lines(spark, paths, name_needs_look())))
