"""Quality rules against plain versions."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest

from logweft.llm import quality
from logweft.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
WORD = r"[^\x20\x09-\x0D]+"


def plain(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(WORD, text)
        lines = [line for line in text.split("\n") if re.search(WORD, line)]
        at: dict = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        hit = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(8)}
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed))
    return sorted(out, key=repr)


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a b c d e f g h " * 3),
    (5, "é#x\n\né#x \né#x\n" + " ".join(map(str, range(30)))),
    (5, "é#x\n\né#x \né#x\n" + " ".join(map(str, range(30)))),
    (None, "w " * 2000 + "\n|<>&"),
    (6, " ".join(map(str, range(100))) + " " + " ".join(map(str, range(5, 14))) + " x " + " ".join(map(str, range(50, 58)))),
    (7, "\x0b".join(map(str, range(25)))),
]


@pytest.mark.parametrize("rows", [ROWS, [], None])
def test_base(spark, rows, monkeypatch):
    rows = brute.documents() if rows is None else rows
    monkeypatch.setattr(quality, "documents", lambda *_: brute.frame(spark, rows))
    got = QUERIES["op9_quality_rules"](spark, "")
    assert brute.collected(got, *COLUMNS) == plain(rows)
    assert not got.filter("base_failed AND kept").count()


def binned(x: np.ndarray, share: float) -> np.ndarray:
    """Upper edges of the bins in which the share of each column is reached."""
    bins = np.sort(np.floor(x * quality.BINS), axis=0)
    return (bins[int(np.ceil(share * len(x))) - 1] + 1) / quality.BINS


def exact(x: np.ndarray, share: float) -> np.ndarray:
    return np.quantile(x, share, axis=0)


def squared(x: np.ndarray, middle: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    apart = x - middle
    return (apart @ np.linalg.inv(scatter) * apart).sum(axis=1)


def reference_distances(x: np.ndarray, keys: list[tuple], quantile=exact) -> np.ndarray:
    """The same estimates in numpy, by language and source (``keys``), with exact medians and
    quantiles if not told otherwise."""
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    groups = {k: np.array([own[: len(k)] == k for own in keys]) for k in {own[:n] for own in keys for n in range(3)}}
    now = {}
    for k, mine in groups.items():
        middle = quantile(x[mine], 0.5)
        scale = np.maximum(1.4826 * quantile(np.abs(x[mine] - middle), 0.5), quality.FLOORS)
        z = (x[mine] - middle) / scale
        signs = (z.T @ (z / np.maximum((z**2).sum(axis=1), 1e-12)[:, None])) / len(z)
        now[k, 0] = middle, np.diag(scale**2)
        now[k, 1] = middle, len(floors) * signs * np.outer(scale, scale) + floors
    log_det = lambda scatter: np.linalg.slogdet(scatter)[1]
    for _ in range(quality.STEPS):
        before, bare = now, {}
        for k, start in sorted(now, key=lambda y: (len(y[0]), y[1])):
            mine = x[groups[k]]
            d = np.sqrt(squared(mine, *now[k, start]))
            core = mine[d < quantile(d, quality.CORE)] if quantile is binned else mine[d <= quantile(d, quality.CORE)]
            middle, scatter = core.mean(axis=0), np.cov(core.T, bias=True) * quality.CONSISTENCY
            if k:
                share = len(core) / (len(core) + quality.PRIOR)
                wider = bare[k[:-1], start]
                middle, scatter = share * middle + (1 - share) * wider[0], share * scatter + (1 - share) * wider[1]
            bare[k, start] = middle, scatter
        now = {key: (middle, scatter + floors) for key, (middle, scatter) in bare.items()}
        if max(abs(log_det(now[key][1]) - log_det(before[key][1])) for key in now) <= quality.STABLE:
            break
    out = np.empty(len(x))
    for k in {tuple(own) for own in keys}:
        start = min((0, 1), key=lambda start: (log_det(now[k, start][1]), start))
        out[groups[k]] = squared(x[groups[k]], *now[k, start])
    return out


def plain_kept(rows) -> dict:
    """Whether each document (ID, text, language, source) stays."""
    kept, judged = {}, []
    for (doc_id, text, lang, source), own in ((r, plain([r[:2]])[0]) for r in rows):
        kept[doc_id] = not own[-1]
        if not own[-1]:
            _, n, chars, symbols, lines, repeated, _ = own
            x = (np.log1p(n), np.log1p(chars / n), (symbols / len(text)) ** 0.5, np.log1p(lines), (repeated / n) ** 0.5)
            judged.append((doc_id, (lang, source), x))
    ids, keys, x = zip(*judged)
    for doc_id, d in zip(ids, reference_distances(np.array(x), list(keys), binned), strict=True):
        kept[doc_id] = bool(d <= quality.LIMIT)
    return kept


def test_outliers(spark, monkeypatch):
    """Planted junk is rejected, clean texts stay, distances agree with numpy."""
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(5, 0.6)) + 20))) for i in range(900)]
    junk = [(1000 + i, " ".join("#$%|&" * 6 for _ in range(200 + i))) for i in range(20)]
    junk = [(k, " ".join(f"{w}{i}" for i, w in enumerate(t.split(" ")))) for k, t in junk]
    rows = [(i, t, "en", "s") for i, t in clean + junk]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    monkeypatch.setattr(quality, "documents", lambda *_: frame)
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, "").collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in junk)
    stats = spark.createDataFrame([tuple(got[i])[:6] for i in got], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    chars = {i: len(t) for i, t, *_ in rows}
    ids = [r["doc_id"] for r in stats.collect()]
    x = np.array(
        [
            [np.log1p(r["n_words"]), np.log1p(r["word_chars"] / r["n_words"]), (r["n_symbols"] / chars[r["doc_id"]]) ** 0.5, np.log1p(r["n_dup_lines"]), (r["n_repeat_words"] / r["n_words"]) ** 0.5]
            for r in stats.collect()
        ]
    )
    want = reference_distances(x, [("en", "s")] * len(x))
    mine = np.array([got[i]["distance"] for i in ids])
    assert np.corrcoef(want, mine)[0, 1] > 0.999 and (np.abs(mine - want) < 0.1 + 0.1 * want).all()


def test_native_plan(spark):
    plan = QUERIES["op9_quality_rules"](spark, brute.SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("n_clean", [60, 300, 900])
def test_small_groups_are_judged(spark, n_clean, monkeypatch):
    """Junk in sources and languages of a few rows goes, whatever the size of the table."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(5, 0.6)) + 20))
    junk = " ".join(f"{'#$%|&' * 6}{i}" for i in range(200))
    rows = [(i, text(), "en", ("hot", "b", "c")[i % 3]) for i in range(n_clean)]
    small = [("en", "tiny"), ("en", None), ("xx", "tiny"), (None, None)]
    rows += [(1000 + 10 * k + i, text(), *key) for k, key in enumerate(small) for i in range(3)]
    rows += [(2000 + k, junk, *key) for k, key in enumerate(small)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    monkeypatch.setattr(quality, "documents", lambda *_: frame)
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, "").collect()}
    assert len(got) == len(rows) and all(r["distance"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {2000 + k for k in range(len(small))}


def test_estimates_of_groups(spark):
    """Groups of any size agree with numpy, row by row; a group of one row has an estimate, too."""
    rng = np.random.default_rng(5)
    keys, parts = [], []
    for k, (lang, source, n) in enumerate([("en", "a", 260), ("en", "b", 40), ("fr", "a", 199), ("fr", "c", 200), ("xx", "a", 1), ("xx", "b", 2)]):
        mixed = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 0.3 + rng.normal(size=5)
        mixed[: n // 10] += 6
        parts.append(np.abs(mixed) if k % 2 else mixed)
        keys += [(lang, source)] * n
    x = np.concatenate(parts)
    columns = ", ".join(f"{c} double" for c in quality.STATISTICS)
    rows = [(i, *key, *map(float, own)) for i, (key, own) in enumerate(zip(keys, x))]
    frame = spark.createDataFrame(rows, f"_doc long, g_lang string, g_source string, {columns}").repartition(3)
    got = {r["_doc"]: r["distance"] for r in quality.outliers(frame).collect()}
    want = reference_distances(x, keys, binned)
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want, rtol=1e-6)
    assert (want[:26] > quality.LIMIT).mean() > 0.5
