"""Secrets in texts, with multipart credentials, in DataFrame functions.

Base patterns give assignments, access identifiers and long hex strings. Weak patterns
give parts that alone mean little: names of accounts, short or unnamed secrets, endpoints.
A weak part is reported only if complementary parts lie in its scope, the ``SCOPE`` code
points around it in the same document: an identifier or an endpoint needs a secret, a
secret needs an identifier or an endpoint. Base spans count as parts too.

The interval join of parts sweeps over them by start, per document: the furthest end of a
role so far and the next start of a role tell whether one lies in scope. No pair of parts
is ever made, so a document with very many parts costs no more than sorting them.

Where a pattern matches is found by marking the matches in the text, splitting at the
marks and summing up lengths; only documents with matches take part in that.

Cases: a null or empty text has no spans; the mark character in a text is replaced by one
like it before; repeated rows and rows without ID are documents of their own (see
``common.identified``); an empty table gives no row; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC, blank, documents, identified
from .registry import query

SCOPE = 256
MARK, OTHER = "", ""
# The base patterns. Shorter runs than asked for cannot be part of a longer
# match in the last two, so their minimum is in the pattern.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ASSIGN_CHARS = 8
WEAK = {
    "weak_id": r"""\b(?i:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account)["']?\x20{0,3}[:=]\x20{0,3}["']?[A-Za-z0-9@._-]{3,64}""",
    "weak_secret": r"""\b(?i:pwd|pass|passphrase|private_?key|credentials?|auth)["']?\x20{0,3}[:=]\x20{0,3}["']?[^\s"']{4,128}|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]{0,39}[0-9])(?=[0-9a-z+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])""",
    "endpoint": r"""\b(?i:https?|ftp|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,256}|\b(?i:host|endpoint|server)["']?\x20{0,3}[:=]\x20{0,3}["']?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}""",
}
KINDS = [*BASE, *WEAK]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def _pieces(kind: str, pattern: str) -> Column:
    """Lengths of what lies between matches and of the matches, in turn. The sign tells a
    match that counts: a failing one only takes its place."""
    pieces = F.split(F.regexp_replace("text", f"({pattern})", f"{MARK}$1{MARK}"), MARK)

    def length(piece: Column, i: Column) -> Column:
        size = F.char_length(piece)
        hit = i % 2 == 1
        if kind == "assign":
            hit &= F.char_length(F.regexp_extract(piece, pattern, 1)) >= ASSIGN_CHARS
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), size.alias("size"), hit.alias("hit"))

    none = F.array().cast("array<struct<kind:int,i:int,size:int,hit:boolean>>")
    return F.when(F.col("text").rlike(pattern), F.transform(pieces, length)).otherwise(none)


def find_parts(docs: DataFrame) -> DataFrame:
    """All base and weak matches: ``_doc``, ``kind`` (its place in ``KINDS``), ``start``, ``end``."""
    text = F.replace(blank("text"), F.lit(MARK), F.lit(OTHER))
    pieces = F.concat(*(_pieces(kind, pattern) for kind, pattern in (BASE | WEAK).items()))
    rows = docs.select(DOC, text.alias("text")).select(DOC, F.explode(pieces).alias("x")).select(DOC, "x.*")
    end = F.sum("size").over(Window.partitionBy(DOC, "kind").orderBy("i"))
    placed = rows.withColumn("end", end).filter("hit")
    return placed.select(DOC, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: base ones, and weak ones with a complementary part in scope."""
    names = F.array(*(F.lit(ROLES[kind]) for kind in KINDS))
    rows = parts.withColumn("role", F.get(names, F.col("kind")))
    order = Window.partitionBy(DOC).orderBy("start", "end", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    to_come = order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("id", "secret", "endpoint"):
        rows = rows.withColumn(f"{role}_end", F.max(F.when(F.col("role") == role, F.col("end"))).over(so_far))
        rows = rows.withColumn(f"{role}_start", F.min(F.when(F.col("role") == role, F.col("start"))).over(to_come))
        before = F.coalesce(F.col(f"{role}_end") >= F.col("start") - scope, F.lit(False))
        behind = F.coalesce(F.col(f"{role}_start") <= F.col("end") + scope, F.lit(False))
        near[role] = before | behind
    complete = F.when(F.col("role") == "secret", near["id"] | near["endpoint"]).otherwise(near["secret"])
    reported = (F.col("kind") < len(BASE)) | complete
    return rows.filter(reported).select(DOC, "kind", "start", "end")


def secrets(docs: DataFrame) -> DataFrame:
    """``_doc`` and ``spans`` (by start, then kind) of the documents that have any.

    ``docs`` has ``_doc`` (see ``common.identified``) and ``text``.
    """
    linked = link_parts(find_parts(docs))
    return linked.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identified(documents(spark, sf_dir).select("doc_id", "text"))
    names = F.array(*(F.lit(kind) for kind in KINDS))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = F.coalesce("spans", none)
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        own = F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    return docs.select(DOC, "doc_id").join(secrets(docs), DOC, "left").select(
        "doc_id", *(count(kind) for kind in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans")
    )
