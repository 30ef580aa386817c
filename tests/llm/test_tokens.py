"""Token files and packing against the tokenizers library."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweft.llm import packing, token_files
from logweft.llm.encoding import Encoder
from logweft.llm.queries import QUERIES

ODD = [
    (5, None),
    (3, ""),
    (9, "  two  spaces \n and\t tabs\n\n"),
    (None, "no id"),
    (4, "same row"),
    (4, "same row"),
    (7, "end. Next, word.\nLine, É é ſ İ K Σς  <|endoftext|> 's don't"),
    (6, "one <|endoftext|> two<|ENDOFTEXT|>, <|startoftext|>.<|StartOfText|>\nA<|endoftext|>\n<|startoftext|> B <| C |> ſ"),
    (10, "<|endoftext|>"),
    (11, " <|endoftext|>  <|endoftext|> \n"),
    (8, "x" * 5000),
    (1, "word " * 6000),
]


def ids_of(path: str, texts: list[str], end: int) -> list[list[int]]:
    tool = Tokenizer.from_file(path)
    return [x.ids + [end] for x in tool.encode_batch(texts, add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_files(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = ids_of(public_tokenizers.path("byte_bpe_50k.json"), [text or "" for _, text in rows], 2)
    start, out = 0, []
    for (doc_id, _), own in zip(rows, ids, strict=True):
        out.append((doc_id, start, len(own), crc(own)))
        start += len(own)
    return sorted(out, key=repr)


def test_token_files_query(spark):
    got = brute.collected(QUERIES["op1_token_files"](spark, brute.SF_DIR), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expected_files(brute.documents())


def test_token_files_cases(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_files.write_token_files(brute.frame(spark, ODD), str(tmp_path / "t"), path, 2)
    got = token_files.read_token_files(shards)
    rows = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got.collect()]
    assert sorted(rows, key=repr) == expected_files(ODD)
    empty = token_files.write_token_files(brute.frame(spark, []), str(tmp_path / "e"), path, 2)
    assert token_files.read_token_files(empty).count() == 0


def test_short_document_access(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{brute.SF_DIR}/documents.parquet")
    shards = token_files.write_token_files(docs, str(tmp_path / "t"), path, 2).collect()
    assert len(shards[0]["dictionary"]) > 1000
    texts = dict(brute.documents())
    for shard in shards:
        with token_files.ShardReader(shard["uri"], shard["dictionary"]) as reader:
            last = len(reader.index) - 1
            own = np.frombuffer(reader.ids(last), "<u4").tolist()
            assert own == ids_of(path, [texts[int(reader.index[last]["id"])]], 2)[0]
        with pytest.raises(ValueError):
            token_files.ShardReader(shard["uri"], b"another")


def check_packing(rows, got):
    ids = ids_of(public_tokenizers.path("word_bpe_49k.json"), [text or "" for _, text in rows], 1)
    left = [(doc_id, own) for (doc_id, _), own in zip(rows, ids, strict=True)]
    by_doc: dict = {}
    for row in got:
        by_doc.setdefault(row["doc_id"], []).append(row)
    wanted: dict = {}
    for doc_id, own in left:
        for start in range(0, len(own), 2048):
            part = own[start : start + 2048]
            wanted.setdefault(doc_id, []).append((start, len(part), crc(part), len(own)))
    assert {k: sorted(v) for k, v in wanted.items()} == {
        k: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in v) for k, v in by_doc.items()
    }
    sequences: dict = {}
    for row in got:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_packing_query(spark):
    got = QUERIES["op8_packing"](spark, brute.SF_DIR).collect()
    sequences = check_packing(brute.documents(), got)
    assert len(sequences) <= sum(r["length"] for r in got) / 2048 + 8


def test_packing_cases(spark):
    check_packing(ODD, packing.packed(brute.frame(spark, ODD)).collect())
    assert packing.packed(brute.frame(spark, [])).count() == 0


def test_best_fit():
    """The tree finds the same window as a search through all of them."""
    rng = np.random.default_rng(1)
    tree, rooms = packing.OpenWindows(64), {}
    for number, length in enumerate(rng.integers(1, 65, 2000)):
        found = tree.take(int(length))
        fits = [room for room in rooms.values() if room >= length]
        assert (found is None) == (not fits)
        window, room = found or (number, 64)
        assert room == (min(fits) if fits else 64) and rooms.get(window, 64) == room
        rooms[window] = room - int(length)
        tree.put(room - int(length), window)


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_units_go_as_one_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{i * 7}," for i in range(2000)), "é\tè a<|endoftext|> b\n\nc. Ġ Ġd \x1cx ü\u3000 y", *(t or "" for _, t in ODD)]
    tool = Encoder(path, spaced=True)
    want = [np.array(ids[:-1], "<u4").tobytes() for ids in ids_of(path, texts, 0)]
    tool.tokenizer = Counted(tool.tokenizer)
    assert tool.encode(texts) == want and tool.tokenizer.texts < 200
    assert Encoder(path, spaced=True)._joined(["a", "b c"]) is None


def test_known_words_need_no_library():
    """Commas, stops and line ends do not make new units of known words."""
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        tool = Encoder(path, spaced=spaced)
        tool.encode(["alpha beta étage gamma\nalpha\nbeta\nétage\ngamma", "alpha, x. x\nalpha"])
        texts = ["alpha beta, étage. gamma\nbeta.\nalpha gamma, beta", "gamma, alpha.\nétage, beta"]
        texts.append("9, a!. b ,c ., d,\n\ne. \nf\n g.\n")
        want = [np.array(ids[:-1], "<u4").tobytes() for ids in ids_of(path, texts, 0)]
        assert tool.encode(texts) == want
        tool = Encoder(path, spaced=spaced)
        tool.encode(["alpha beta étage gamma\nalpha\nbeta\nétage\ngamma", "alpha, x. x\nalpha"])
        tool.tokenizer = Counted(tool.tokenizer)
        assert tool.encode(texts[:2]) == want[:2] and tool.tokenizer.texts <= 2


def test_latin_words_go_as_one_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"né{a}{b}ü" for a in "abcdefghij" for b in "klmnopqr"), *(t or "" for _, t in ODD)]
    tool = Encoder(path, spaced=False, width=2)
    want = [np.array(ids[:-1], "<u2").tobytes() for ids in ids_of(path, texts, 0)]
    assert tool.encode(texts) == want
    # Odd letters among them make the library read all of them one by one.
    tool = Encoder(path, spaced=False, width=2)
    tool.tokenizer = Counted(tool.tokenizer)
    assert tool.encode(texts[:1]) == want[:1] and tool.tokenizer.texts == 1


def test_tests_of_whole_texts():
    """What the encoder looks for in every text, against plain patterns; a search skips to a rare character."""
    import random
    import re

    tool = Encoder(public_tokenizers.path("byte_bpe_50k.json"), spaced=True)
    unsafe = re.compile(r"\s ")
    loose = re.compile(r"[^A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ][,.][ \n]|\n\s|\s\n|^\n|\n$")
    chance = random.Random(3)
    texts = ["".join(chance.choices("aZ1\n\n  ,.\t\x0b\r\x85\xa0 \xe9\xd7ɐ-<", k=k % 8)) for k in range(100_000)]
    for text in [*texts, ",\n", ". a", "a.\n", "a\n"]:
        assert tool._is_unsafe(text) == bool(unsafe.search(text)), text
        assert tool._is_loose(text) == bool(loose.search(text)), text
    assert all(search.__self__.pattern[:2] in (r"\n", r"\.") or search.__self__.pattern[0] == "," for search in tool.loose)
