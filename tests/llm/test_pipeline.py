"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import brute
import pyarrow.parquet as pq
import test_line_dedup
import test_native
import test_near_dups
import test_quality
import test_tokens

import corpus_pipeline


def plain_texts(rows):
    """ID and text of what the stages before packing keep of (ID, text, language, source)."""
    good = test_quality.plain_kept(rows)
    rows = [r[:2] for r in rows if good[r[0]]]
    holders: dict = {}
    keyed = []
    for doc_id, text in rows:
        lines = text.split("\n")
        keys = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        keyed.append((doc_id, lines, keys))
        for key in keys:
            holders.setdefault(key, set()).add(doc_id)
    rows = []
    for doc_id, lines, keys in keyed:
        gone = [len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != doc_id for k in keys]
        rows.append((doc_id, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    kept = {r[0] for r in test_near_dups.plain(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{brute.SF_DIR}/benchmark.parquet").to_pylist()]
    clean = {r[0] for r in test_native.plain_passages(rows, items) if not r[5]}
    return [r for r in rows if r[0] in clean]


def test_pipeline(spark):
    table = pq.read_table(f"{brute.SF_DIR}/documents.parquet").to_pylist()
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in table]
    want = plain_texts(rows)
    passed = sum(not test_quality.plain([r[:2]])[0][-1] for r in rows)
    assert 0 < len(want) < sum(test_quality.plain_kept(rows).values()) < passed < len(rows)
    test_tokens.check_packing(want, corpus_pipeline.run(spark, brute.SF_DIR).collect())
    assert test_line_dedup.LONG


def test_stages_keep_columns_and_take_empty_tables(spark):
    rows = [(1, "word " * 3), (None, None), (2, " ".join(map(str, range(40)))), (2, " ".join(map(str, range(40))))]
    for own in (rows, []):
        # Names that the stages use themselves, and a type that cannot be sorted.
        docs = brute.frame(spark, own).selectExpr("*", "'c' AS cleaned", "1 AS label", "2 AS _key", "map('a', 1) AS extras")
        seen = {r["_doc"]: r for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, brute.SF_DIR)
            assert out.columns == docs.columns, name
            for row in out.collect():
                before = seen[row["_doc"]].asDict()
                after = row.asDict() if name == "line dedup" else None
                assert (after | {"n_chars": None, "text": None} == before | {"n_chars": None, "text": None}) if after else row.asDict() == before
        assert corpus_pipeline.STAGES[-1][1](spark, docs, brute.SF_DIR).count() == len(own)
