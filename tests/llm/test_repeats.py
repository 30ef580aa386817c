"""Removal of repeated bytes and words against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.llm import recompression, repeats, suffix_dedup, suffix_groups
from logweft.llm.queries import QUERIES


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def covered(symbols, width, seen):
    gone = [False] * len(symbols)
    for i in range(len(symbols) - width + 1):
        window = symbols[i : i + width]
        if window in seen:
            gone[i : i + width] = [True] * width
        seen.add(window)
    return gone


def plain_bytes(rows):
    out, seen = [], set()
    for doc_id, text in ordered(rows):
        data = (text or "").encode()
        gone = covered(data, 100, seen)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((doc_id, len(data), sum(gone), runs, brute.sha(kept)))
    return sorted(out, key=repr)


def plain_words(rows):
    out, seen = [], set()
    for doc_id, text in ordered(rows):
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        gone = covered(words, 20, seen)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), brute.sha(kept.encode())))
    return sorted(out, key=repr)


def made(seed: int) -> list[tuple]:
    """Texts with shared passages, edits, runs and periods."""
    rng = random.Random(seed)
    words = ["a", "é", "bb", "the", "of", "and", "word", "x" * 300, "y" * 300]
    passage = " ".join(rng.choice(words[:7]) for _ in range(60))
    rows: list[tuple] = [(None, passage), (3, None), (4, ""), (5, passage), (5, passage), (6, "a " * 80), (7, "a " * 50)]
    rows += [(8, "ab" * 200), (9, "ab" * 120 + "é"), (10, "a b " * 60), (11, " \n" + "z" * 99), (12, "z" * 100), (13, "z" * 100)]
    for k in range(20, 50):
        own = passage.split(" ")
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        cut = rng.randrange(30)
        rows.append((k, " ".join([rng.choice(words) for _ in range(cut)] + own[cut // 2 :] + [str(k)])))
    rng.shuffle(rows)
    return rows


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("rows", [made(1), made(2), []])
def test_bytes_cases(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_groups, "TEXT", 4000)
    got = suffix_dedup.remove_repeated_bytes(brute.frame(spark, rows))
    got = got.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
    assert brute.collected(got, *BYTES) == plain_bytes(rows)


@pytest.mark.parametrize("rows", [made(3), made(4), []])
def test_words_cases(spark, rows):
    got = recompression.remove_repeated_words(brute.frame(spark, rows))
    got = got.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")
    assert brute.collected(got, *WORDS) == plain_words(rows)


def test_bytes_query(spark):
    want = plain_bytes(brute.documents())
    assert brute.collected(QUERIES["op2_suffix_dedup"](spark, brute.SF_DIR), *BYTES) == want
    assert any(row[2] for row in want)


def test_words_query(spark):
    want = plain_words(brute.documents())
    assert brute.collected(QUERIES["op10_recompression"](spark, brute.SF_DIR), *WORDS) == want
    assert any(row[2] for row in want)


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(500):
        alphabet = [0, 1, 1, 2, 2, 3][: rng.randint(2, 6)]
        text = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))] + [0]
        order = suffix_groups.suffix_array(text)
        suffixes = [text[i : text.index(0, i)] for i in order]
        assert sorted(order) == list(range(len(text))) and suffixes == sorted(suffixes)


def test_equal_windows_choose_equal_symbols():
    """Whatever stands around a window, it is represented by the same symbol."""
    rng = random.Random(5)
    for _ in range(200):
        window = [rng.choice("abc") for _ in range(20)]
        found = set()
        for _ in range(5):
            before = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
            behind = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
            names = recompression.word_hashes(" ".join(before + window + behind).encode())
            level, symbol, start, size = recompression.chosen_symbols(names)
            k = len(before)
            found.add((int(level[k]), int(symbol[k]), int(start[k]) - k, int(size[k])))
        assert len(found) == 1


def test_windows_are_rarely_represented_by_one_word():
    sizes = Counter()
    for _, text in brute.documents():
        names = recompression.word_hashes((text or "").encode())
        if len(names) >= 20:
            sizes.update(recompression.chosen_symbols(names)[3].tolist())
    assert sizes[1] < 0.05 * sizes.total() and max(sizes) <= 20


def one_word_everywhere(n: int) -> list[tuple]:
    """Documents whose windows often share one word and little else; some passages recur."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(24)] for _ in range(5)]
    rows = []
    for k in range(n):
        own = [x for i in range(12) for x in ("common", *rng.sample(words, 6))]
        rows.append((k, " ".join(own + rng.choice(passages) + ["common", f"own{k}"])))
    return rows


@pytest.mark.parametrize("sample", [1, 4000])
def test_words_of_wide_keys(spark, sample, monkeypatch):
    """Windows under one word meet by their content, in many tasks, with the same result."""
    rows = one_word_everywhere(120) + made(6)
    limit = 500
    monkeypatch.setattr(repeats, "SAMPLE", sample)

    def resolve(own, hashes):
        for key in set(own["key"].tolist()):
            mine = own[own["key"] == key]
            # A record of several windows is never of a wide key.
            if (mine["n"] > 1).any() and repeats.symbols_of(mine, 20).sum() > limit:
                raise ValueError("a wide key was gathered")
        return recompression.resolve(own, hashes)

    windows = recompression.WORD_WINDOWS._replace(limit=limit, resolve=resolve)
    monkeypatch.setattr(recompression, "WORD_WINDOWS", windows)
    frame = brute.frame(spark, rows)
    if sample > len(rows):
        docs = frame.na.fill("").withColumn("_doc", F.monotonically_increasing_id())
        assert len(repeats.wide_keys(docs, windows))
    got = recompression.remove_repeated_words(frame)
    got = got.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")
    assert brute.collected(got, *WORDS) == plain_words(rows)


@pytest.mark.parametrize("sample", [1, 4000])
def test_bytes_of_wide_keys(spark, sample, monkeypatch):
    """A footer between different texts makes no suffix array over all of them."""
    rng = random.Random(7)
    letters = "abcdefghijklmnop"
    shared = ["".join(rng.choice(letters) for _ in range(150)) for _ in range(4)]
    footer = "".join(rng.choice(letters) for _ in range(60))
    rows = []
    for k in range(150):
        own = ["".join(rng.choice(letters) for _ in range(120)) for _ in range(2)]
        rows.append((k, own[0] + footer + own[1] + (rng.choice(shared) + footer + rng.choice(shared) if k % 3 else "")))
    rows += made(8)
    limit = 4000
    monkeypatch.setattr(repeats, "SAMPLE", sample)

    def resolve(own, strings):
        for key in set(own["key"].tolist()):
            mine = own[own["key"] == key]
            if (mine["n"] > 1).any() and repeats.symbols_of(mine, 100).sum() > limit:
                raise ValueError("a wide key was gathered")
        return suffix_groups.resolve(own, strings)

    windows = suffix_dedup.BYTE_WINDOWS._replace(limit=limit, resolve=resolve)
    monkeypatch.setattr(suffix_dedup, "BYTE_WINDOWS", windows)
    got = suffix_dedup.remove_repeated_bytes(brute.frame(spark, rows))
    got = got.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
    assert brute.collected(got, *BYTES) == plain_bytes(rows)


def test_arrays_over_repeats_only():
    """Leaving out windows of their own hash changes nothing, wherever the repeats lie."""
    rng = random.Random(3)
    width = suffix_groups.WIDTH
    letters = lambda n: bytes(rng.choice(b"abcdefgh\xff\0") for _ in range(n))
    passages = [letters(n) for n in (width, width + 1, 180, 400)]
    strings = [letters(150), letters(width)]
    for _ in range(12):
        strings.append(b"".join(x for p in rng.sample(passages, 3) for x in (letters(rng.choice((0, 5, width, 2 * width + 7))), p)))
    strings += [passages[0], strings[4]]
    rows = np.zeros(len(strings), repeats.RECORD)
    rows["key"] = [1 + i % 2 for i in range(len(strings))]
    rows["doc"] = [7 * i % 5 for i in range(len(strings))]
    rows["first"] = [1000 * i for i in range(len(strings))]
    rows["n"] = [len(x) - width + 1 for x in strings]
    for key in (1, 2):
        own = np.flatnonzero(rows["key"] == key)
        at: dict = {}
        for i in own:
            for w in range(rows["n"][i]):
                at.setdefault(strings[i][w : w + width], []).append((rows["doc"][i], rows["first"][i] + w, i, w))
        want = {place[2:] for places in at.values() for place in sorted(places)[1:]}
        record, window = suffix_groups.resolve(rows[own], [strings[i] for i in own])
        assert want and {(own[r], w) for r, w in zip(record, window)} == want
        assert len(record) == len(want)
        *_, parts = suffix_groups.suspected(rows[own], [strings[i] for i in own])
        assert sum(map(len, parts)) < sum(len(strings[i]) for i in own)
