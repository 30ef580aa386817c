"""Benchmark passages in documents: a prefix-filtered set join, in DataFrame functions.

Items are cut into windows of ten consecutive words (shorter items are one window). To be
inside a document, a window needs every one of its words there, so its rarest word is a
sufficient prefix: rarity is counted over all documents. Document words join the prefixes;
the place of the word in the window tells where the window would start (positional
bound), and it must fit into the document (length bound). What passes is verified on the
document's words over a stretch of the window's size, first by hash, then word by word.

The joins with prefixes and windows broadcast them only if their measured size allows
(``session.lookup_join``); beyond that they shuffle with the documents' side salted.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.

Cases: null and empty texts have no words; items without words have no window; several
items may have the same window; rows without ID and repeated rows are documents of their
own; an empty benchmark leaves every document clean; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup_join
from .common import DOC, blank, documents, identified, materialize, table
from .registry import query

WINDOW = 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed: what separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z only: a text in ASCII may take the quicker general function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``wid``, ``window`` (its words) and ``items`` that have it."""
    words = benchmark.select("item_id", words_of(blank("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(window), F.lit(0))
    cut = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "item_id", F.slice("words", F.col("i") + 1, F.lit(window)).alias("window")
    )
    return cut.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("wid", F.xxhash64("window"))


def prefixes(windows: DataFrame, docs_words: DataFrame) -> DataFrame:
    """The rarest word of every window that can occur: ``word``, its place ``o``, ``wid``, ``size``."""
    places = windows.select("wid", F.size("window").alias("size"), F.posexplode("window").alias("o", "word"))
    vocabulary = places.select("word").distinct()
    found = lookup_join(docs_words, vocabulary, ["word"], F.col("p"), how="inner")
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A word that no document has ends its windows.
    rarest = places.join(counts, "word", "left").groupBy("wid", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "o")).alias("best")
    )
    return rarest.filter("best.n > 0").select(F.col("best.word").alias("word"), F.col("best.o").alias("o"), "wid", "size")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_doc``, ``n_words``, ``n_hit`` and ``items`` (IDs of items with windows inside).

    ``docs`` has ``_doc`` (see ``common.identified``) and ``text``.
    """
    windows = materialize(item_windows(benchmark, window), "windows")
    listed = docs.select(DOC, words_of(blank("text")).alias("words"))
    each = listed.select(DOC, F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    keys = materialize(prefixes(windows, each.select("p", "word")), "prefixes")
    start = F.col("p") - F.col("o")
    candidates = (
        lookup_join(each, keys, ["word"], F.xxhash64(DOC, "p"), how="inner")
        .filter((start >= 0) & (start + F.col("size") <= F.col("n")))
        .select(DOC, F.struct(start.alias("start"), "size", "wid").alias("c"))
        .groupBy(DOC)
        .agg(F.collect_list("c").alias("candidates"))
    )

    def stretch(c: Column) -> Column:
        return F.slice("words", c["start"] + 1, c["size"])

    same = F.filter("candidates", lambda c: F.xxhash64(stretch(c)) == c["wid"])
    with_words = F.transform(
        same, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), c["wid"].alias("wid"), stretch(c).alias("found"))
    )
    checked = materialize(
        listed.join(candidates, DOC, "left").select(
            DOC, F.size("words").cast("long").alias("n_words"), with_words.alias("hits")
        ),
        "passages",
    )
    hits = lookup_join(
        checked.select(DOC, F.explode("hits").alias("h")).select(DOC, "h.*"), windows, ["wid"], F.xxhash64(DOC, "start"), how="inner"
    ).filter(F.col("found") == F.col("window"))
    # Words up to the furthest end so far are counted already.
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy(DOC).orderBy("start", "size", "wid").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = hits.withColumn("new", new).groupBy(DOC).agg(
        F.sum("new").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    return checked.select(DOC, "n_words").join(covered, DOC, "left").select(
        DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(covered.schema["items"].dataType)).alias("items"),
    )


OP5_SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS seq
  FROM b, unnest(range(1, greatest(len(words) - 8, 2))) AS t(i) WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS seq
  FROM d, sizes, unnest(range(1, greatest(len(words) - size + 2, 1))) AS t(i)
), hits AS (
  SELECT doc_id, i, bw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.seq = bw.seq
), hit_words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(10)) AS t(j) WHERE j < size GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""


@query("op5_contamination", OP5_SQL)
def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", "text"))
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.join(docs.select(DOC, "doc_id"), DOC).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
