"""Personal data: base patterns by plain regular expressions, disguises by example."""

from __future__ import annotations

import random
import re

import brute
import pyarrow as pa
import pytest

from logweft.llm import personal_data as pd_
from logweft.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pd_.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ROWS = [
    (1, None),
    (2, ""),
    (3, "a@b.c@d.e x@y 1.2.3.4.5.6.7.8 256.1.1.1 000001.2.3.4 4111 1111 1111 1111 +49 (30) 1234-567 é a@b.co.uk."),
    (3, "a@b.c"),
    (None, "+1 2 +123456789 4111111111111111"),
    (4, "1" * 2000 + "@" + "a" * 2000),
]


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_personal_data"](spark, brute.SF_DIR).collect()}
    texts = dict(brute.documents())
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        want = plain(text)
        assert got[doc_id]["base_sha256"] == brute.sha(",".join(want).encode())
        assert set(want) <= set(filter(None, got[doc_id]["spans"].split(",")))
        for kind in PLAIN:
            assert got[doc_id][f"n_{kind}"] == sum(x.startswith(kind) for x in want)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_cases(spark, rows):
    got = pd_.personal_data(brute.frame(spark, rows)).collect()
    found = sorted(
        (repr(r["doc_id"]), [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]]) for r in got
    )
    assert found == sorted((repr(i), plain(t or "")) for i, t in rows)


def added(text):
    return [(k, text[s:e]) for k, s, e, base in pd_.find_spans(text) if not base]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail jane.doe [at] host (dot) org now", "email", "jane.doe [at] host (dot) org"),
        ("mail jane at host dot co dot uk now", "email", "jane at host dot co dot uk"),
        ("écrire à jаne@hоst.org ici", "email", "jаne@hоst.org"),
        ("ｊａｎｅ＠ｈｏｓｔ．ｏｒｇ", "email", "ｊａｎｅ＠ｈｏｓｔ．ｏｒｇ"),
        ("ja​ne@ho​st.org", "email", "ja​ne@ho​st.org"),
        ("ip ١٠.٠.٠.١ end", "ip", "١٠.٠.٠.١"),
        ("call plus four nine one seven one two three four five now", "phone", "plus four nine one seven one two three four five"),
        ("mail alice [at] example dot com now", "email", "alice [at] example dot com"),
        ("mail alice@example dot co dot uk, now", "email", "alice@example dot co dot uk"),
        ("host 10 dot 0 dot 0 dot 1 is down", "ip", "10 dot 0 dot 0 dot 1"),
        ("mail Alice (At) mail.example DOT com", "email", "Alice (At) mail.example DOT com"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four" + " one" * 15),
    ],
)
def test_disguises(text, kind, span):
    assert (kind, span) in [(k, t) for k, t in added(text)]
    assert pd_.batch_spans(pa.array([text])) == [pd_.find_spans(text)]


def test_batches():
    """The tests of batches leave out nothing that the finders find."""
    rng = random.Random(4)
    bits = ["1", "23", "256", ".", "..", "+", "@", "a", "é", "-", " ", "  ", "4111111111111111", "\n", "[at]", "( DOT )", " dot ", "_dot_"]
    bits += ["\u00a0", "\u2003", "one ", "Four-", "seven,", "ſix ", "\u0430", "\u200b", "(", ")", "\U0001d7ce", "x@y.z", "10.0.0.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    assert pd_.batch_spans(pa.array(texts)) == [pd_.find_spans(text) for text in texts]


@pytest.mark.parametrize(
    "text",
    ["look at host.org please", "one two three", "a dot on the map", "we met at noon (at home) [dot]", "Привет, мир"],
)
def test_clean(text):
    assert not pd_.find_spans(text)
