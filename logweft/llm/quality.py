"""Quality rules with robust outliers, in DataFrame functions.

Base rules look at one text: its words, symbols, repeated lines and repeated windows of
eight words. On top, documents whose statistics are far from all others of the same
language and source are rejected. Location and scatter of a group come from the minimum
covariance determinant (P. Rousseeuw, K. Van Driessen, 1999), in its regularized form
(K. Boudt and others, 2020): concentration steps take the ``CORE`` share of rows with the
smallest distances and compute mean and covariance again, until no determinant changes any
more or for ``STEPS`` steps. They begin twice, with spreads of each statistic by itself and
with the covariance of spatial signs; of both ends, that with the smaller determinant
counts. A row is rejected if its squared Mahalanobis distance is over ``LIMIT``.

Quantiles come from counts of fine bins, combined on the map side, so a group that holds
a third of all rows is never gathered. Spreads have a floor (``FLOORS``): most clean
texts have no symbol and no repeat at all, and a single one is no outlier.

Every row that passes the base rules is judged by the estimate of its own language and
source. As a few rows tell little, ``PRIOR`` rows like those of the language count beside
the group's own in mean and covariance, and ``PRIOR`` rows like all beside those of a
language: an estimate moves from the common one to the group's own as the group grows,
without a size at which the rule changes. A language or source that is null is a group of
its own.

Cases: null and empty texts have no words and fail the base rules; repeated rows and rows
without ID are rows like others (see ``common.identified``); an empty table gives no row;
other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup_join
from .common import DOC, blank, documents, identified, materialize
from .registry import query

SPACE = r"[\x20\x09-\x0D]+"
REPEAT = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Share of rows that the estimates rest on, and the steps.
CORE = 0.75
STEPS = 6
#: The core is stable when no logarithm of a determinant changes by more.
STABLE = 1e-6
#: Rows of the wider group that count beside a group's own.
PRIOR = 100
#: Bins of one quantile: this many to a unit.
BINS = 64
#: Smallest standard deviation of each statistic.
STATISTICS = ("length", "word_length", "symbols", "dup_lines", "repeats")
FLOORS = (0.5, 0.15, 0.06, 0.5, 0.2)
#: Limit of the squared distance: about 1e-4 of a normal distribution in five dimensions is
#: beyond it (``normal_limit``).
LIMIT = 25.0
#: A core of 75 % underestimates the variance of five normal statistics by this factor.
CONSISTENCY = 1.46
OWN = ("g_lang", "g_source")
#: What an estimate is made over: a language and source, a language (1) or all rows (2).
GROUP = ("g_level", *OWN)
#: One of the two estimates of each.
STARTED = (*GROUP, "g_start")
PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
MEANS = [f"m_{i}" for i in range(len(STATISTICS))]
SCATTER = [f"c_{i}_{j}" for i, j in PAIRS]
FACTORS = [f"l_{i}_{j}" for i, j in PAIRS]


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` and ``n_chars_``, all from ``text``."""
    text = F.col("text")
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    size = F.char_length(text)
    first = docs.select(
        *keep,
        words.alias("words"),
        size.alias("n_chars_"),
        F.char_length(F.regexp_replace(text, SPACE, "")).alias("word_chars"),
        (size - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    )
    own = [*keep, "n_chars_", "word_chars", "n_symbols", "n_dup_lines"]
    # Hashes of 1, 2, 4 and 8 words; the last ones of a text that lack words stay out.
    step = first.select(*own, F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    own.append("n_words")
    for reach in (1, 2, 4):
        # Later hashes mix in earlier ones, so a window is one value.
        step = step.select(*own, F.transform("h", _joined("h", reach)).alias("h"))
    windows = step.select(*own, F.slice("h", F.lit(1), F.greatest(F.col("n_words") - (REPEAT - 1), F.lit(0))).alias("h"))
    some = F.size("h") > F.size(F.array_distinct("h"))
    placed = F.when(some, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = windows.select(*own, placed.alias("s"))

    def repeated(x: Column, k: Column) -> Column:
        before, behind = F.get("s", k - 1)["h"], F.get("s", k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == behind, F.lit(False))

    starts = F.array_sort(F.transform(F.filter("s", repeated), lambda x: x["i"]))
    marked = ordered.select(*own, starts.alias("starts"))
    # Each start adds the words up to the next one, eight at most.
    new = F.transform("starts", lambda i, k: F.least(F.lit(REPEAT), F.coalesce(F.get("starts", k + 1) - i, F.lit(REPEAT))))
    total = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    return marked.select(*own, F.coalesce(total, F.lit(0)).alias("n_repeat_words"))


def _joined(column: str, reach: int):
    return lambda h, i: F.xxhash64(h, F.get(F.col(column), i + reach))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words").cast("long") > REPEAT_PERCENT * F.col("n_words").cast("long")
    )


def transformed() -> list[Column]:
    """Statistics on scales on which clean texts are roughly normal."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("length"),
        F.log1p(F.col("word_chars") / words).alias("word_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("n_chars_"), F.lit(1))).alias("symbols"),
        F.log1p("n_dup_lines").alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    ]


def _quantile(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Upper edge of the bin (``bin``) in which the share of the rows of each key is reached."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    reached = counts.withColumn("sum", F.sum("n").over(order)).withColumn("total", total)
    return reached.filter(F.col("sum") >= share * F.col("total")).groupBy(*keys).agg(
        ((F.min("bin") + 1) / F.lit(float(BINS))).alias("value")
    )


def _by_statistic(rows: DataFrame, values: list[Column]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(v * BINS).alias("bin")) for k, v in enumerate(values))))
    return rows.select(*GROUP, each.alias("x")).select(*GROUP, "x.*")


def _spread_out(values: DataFrame, name: str) -> DataFrame:
    return values.groupBy(*GROUP).agg(
        *(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"{name}_{k}") for k in range(len(STATISTICS)))
    )


def _with(rows: DataFrame, small: DataFrame) -> DataFrame:
    return lookup_join(rows, small, list(GROUP), F.col(DOC), how="left")


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from columns ``m_i`` and the Cholesky factor ``l_i_j``."""
    solved: list[Column] = []
    for i, name in enumerate(STATISTICS):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for z in solved:
        total = total + z * z
    return total


def _factored(estimates: DataFrame) -> DataFrame:
    """Cholesky factor and ``log_det`` of the scatter ``c_i_j`` of each estimate; floors are
    added to the variances, so the factor always exists."""
    out = estimates
    for i, j in PAIRS:
        value = F.col(f"c_{i}_{j}")
        if i == j:
            value = value + FLOORS[i] ** 2
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(value) if i == j else value / F.col(f"l_{j}_{j}"))
    log_det = 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(len(STATISTICS))), F.lit(0.0))
    return out.select(*STARTED, *MEANS, *FACTORS, log_det.alias("log_det"))


def _shrunk(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """Means and scatter of groups with ``PRIOR`` rows of the wider group ``on`` counted in."""
    values = [*MEANS, *SCATTER]
    wider = wider.select(*on, *(F.col(c).alias(f"wider_{c}") for c in values))
    share = F.col("n") / (F.col("n") + F.lit(float(PRIOR)))
    return lookup_join(own, wider, on, F.col("g_source")).select(
        *STARTED, *((share * F.col(c) + (1 - share) * F.col(f"wider_{c}")).alias(c) for c in values)
    )


def _estimate(core: DataFrame) -> DataFrame:
    """The next estimates, from the rows of the core."""
    means = [F.avg(name).alias(m) for m, name in zip(MEANS, STATISTICS, strict=True)]
    scatter = [
        (F.covar_pop(STATISTICS[i], STATISTICS[j]) * CONSISTENCY).alias(c) for c, (i, j) in zip(SCATTER, PAIRS, strict=True)
    ]
    raw = materialize(core.groupBy(*STARTED).agg(F.count(F.lit(1)).alias("n"), *means, *scatter), "cores")
    level = F.col("g_level")
    whole = raw.filter(level == 2).select(*STARTED, *MEANS, *SCATTER)
    langs = materialize(_shrunk(raw.filter(level == 1), whole, ["g_start"]), "languages")
    groups = _shrunk(raw.filter(level == 0), langs, ["g_lang", "g_start"])
    return materialize(_factored(whole.unionByName(langs).unionByName(groups)), "estimates")


def _at_level(level: Column) -> list[Column]:
    """The key of ``GROUP`` at a level, from the language and source of a row."""
    return [
        level.alias("g_level"),
        F.when(level < 2, F.col("g_lang")).otherwise("").alias("g_lang"),
        F.when(level < 1, F.col("g_source")).otherwise("").alias("g_source"),
    ]


def _starts(rows: DataFrame) -> DataFrame:
    """The two first estimates of each group, both about the medians."""
    medians = materialize(_spread_out(_quantile(_by_statistic(rows, [F.col(s) for s in STATISTICS]), [*GROUP, "k"], 0.5), "m"), "medians")
    apart = [F.abs(F.col(s) - F.col(m)) for m, s in zip(MEANS, STATISTICS, strict=True)]
    spreads = _spread_out(_quantile(_by_statistic(_with(rows, medians), apart), [*GROUP, "k"], 0.5), "s")
    n = range(len(STATISTICS))
    scales = materialize(
        medians.join(spreads, list(GROUP)).select(
            *GROUP, *MEANS, *(F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(FLOORS[i])).alias(f"s_{i}") for i in n)
        ),
        "scales",
    )
    alone = scales.select(
        *GROUP,
        F.lit(0).alias("g_start"),
        *MEANS,
        *((F.col(f"s_{i}") if i == j else F.lit(0.0)).alias(l) for l, (i, j) in zip(FACTORS, PAIRS, strict=True)),
        (2 * sum((F.log(F.col(f"s_{i}")) for i in n), F.lit(0.0))).alias("log_det"),
    )
    # Signs: each row as a direction, so that none counts more for being far away.
    scaled = _with(rows, scales).select(*GROUP, *((F.col(s) - F.col(MEANS[i])) / F.col(f"s_{i}") for i, s in enumerate(STATISTICS)))
    scaled = scaled.toDF(*GROUP, *(f"z_{i}" for i in n))
    size = F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in n), F.lit(0.0)), F.lit(1e-12))
    signs = scaled.withColumn("size", size).groupBy(*GROUP).agg(
        *(F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("size")).alias(c) for c, (i, j) in zip(SCATTER, PAIRS, strict=True))
    )
    together = scales.join(signs, list(GROUP)).select(
        *GROUP,
        F.lit(1).alias("g_start"),
        *MEANS,
        *(
            (len(STATISTICS) * F.col(c) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(c)
            for c, (i, j) in zip(SCATTER, PAIRS, strict=True)
        ),
    )
    return materialize(alone.unionByName(_factored(together)), "starts")


def _change(estimate: DataFrame, before: DataFrame) -> float:
    """The largest change of the logarithm of a determinant."""
    old = before.select(*STARTED, F.col("log_det").alias("old"))
    return estimate.join(old, list(STARTED)).agg(F.max(F.abs(F.col("log_det") - F.col("old"))).alias("x")).first()["x"] or 0.0


def outliers(rows: DataFrame) -> DataFrame:
    """``_doc`` and ``distance`` of all rows."""
    judged = rows.select(DOC, *_at_level(F.lit(0)), *STATISTICS)
    levels = F.explode(F.array(*(F.lit(level) for level in range(3))))
    rows = rows.select(DOC, *OWN, *STATISTICS, levels.alias("level"))
    rows = rows.select(DOC, *_at_level(F.col("level")), *STATISTICS)
    estimate = _starts(rows)
    for _ in range(STEPS):
        # Roots of distances: their bins are fine where the core ends.
        measured = _with(rows, estimate).select(DOC, *STARTED, *STATISTICS, F.sqrt(_distance()).alias("d"))
        edge = _quantile(measured.withColumn("bin", F.floor(F.col("d") * BINS)), list(STARTED), CORE)
        edge = materialize(edge, "edges-of-core")
        core = lookup_join(measured, edge, list(STARTED), F.col(DOC)).filter(F.col("d") < F.col("value"))
        before, estimate = estimate, _estimate(core)
        if _change(estimate, before) <= STABLE:
            break
    own = estimate.filter(F.col("g_level") == 0)
    best = own.groupBy(*GROUP).agg(F.min_by(F.struct(*MEANS, *FACTORS), F.struct("log_det", "g_start")).alias("best"))
    best = materialize(best.select(*GROUP, "best.*"), "best-estimates")
    return _with(judged, best).select(DOC, _distance().alias("distance"))


def quality(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Statistics of every document, ``base_failed``, ``distance`` and ``kept``.

    ``docs`` has ``_doc`` (see ``common.identified``), ``text``, ``lang`` and ``source``.
    """
    missing = "\u0000"
    ready = docs.select(
        DOC,
        blank("text").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(missing)).alias("g_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit(missing)).alias("g_source"),
    )
    measured = text_statistics(ready, [DOC, *OWN]).withColumn("base_failed", base_failed())
    rows = materialize(measured.select("*", *transformed()), "statistics")
    # Rows that fail the base rules would only blur the estimates.
    far = outliers(rows.filter(~F.col("base_failed")).select(DOC, *OWN, *STATISTICS))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return rows.join(far, DOC, "left").withColumn("kept", kept)


def normal_limit(share: float, dimensions: int = len(STATISTICS)) -> float:
    """The squared distance beyond which a normal distribution has about ``share``
    (Wilson and Hilferty); to choose ``LIMIT`` by."""
    low, high = 0.0, 40.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) / 2 > share else (low, middle)
    part = 2 / (9 * dimensions)
    return dimensions * (1 - part + low * math.sqrt(part)) ** 3


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality(docs).join(docs.select(DOC, "doc_id"), DOC).select(
        "doc_id", *counts, "base_failed", "kept", "distance"
    )
