"""Token IDs of whole texts, by a tokenizer file of the ``tokenizers`` library.

Most words of a corpus occur again and again. A text is cut where no token can reach
across, each distinct unit is encoded once by the library, and the IDs of a text are
those of its units in order: the same IDs as of the whole text. Strings of special tokens
are encoded as the library does by default: as those tokens.

A worker keeps up to ``MEMO_UNITS`` units, about 200 bytes each.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Units kept in a worker, and the longest one worth keeping.
MEMO_UNITS = 1_000_000
MEMO_LENGTH = 40

#: Units that the library encodes as one text, few enough for what it notes to stay in a cache.
JOINED_UNITS = 512

#: Marks a unit without a space in front. No unit of UTF-8 text begins with it.
_FIRST = "\udfff"

_ENCODERS: dict[tuple, "Encoder"] = {}


class Encoder:
    """``spaced``: a unit begins with the space before it (byte-level BPE, whose tokens
    take a space only in front). Otherwise white space only separates units (BPE with
    word ends). ``width`` is 2 or 4 bytes per ID, little-endian."""

    def __init__(self, path: str, spaced: bool, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.kind = f"<u{width}"
        self.memo: dict[str, bytes] = {}
        # A space after white space may belong to the same token as that.
        self.unsafe = re.compile(r"[^\S \n] ")
        self.cut = re.compile(r"(?<=\S)(?= )")
        # After anything but a letter, a comma or stop may belong to a longer token, and so may
        # a line end beside white space. Each begins with one rare character, which a search skips to.
        letters = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
        marks = [rf"{mark}[ \n](?<=[^{letters}]{mark}[ \n])" for mark in (",", r"\.")]
        self.loose = [re.compile(x).search for x in (r"\n(?:\s|(?<=\s\n))", *marks)]
        self.near = re.compile(r"^\n|\n$|\s\n|\n\s")
        self.ends = frozenset(",.")
        self.letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        # Tokens that begin with a space, which byte-level BPE writes so, or end a word.
        vocabulary = self.tokenizer.get_vocab()
        self.edges = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        is_edge = (lambda token: token[:1] == "\u0120") if spaced else (lambda token: token[-4:] == "</w>")
        self.edges[[i for token, i in vocabulary.items() if is_edge(token)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        # Without offsets, which nobody reads here.
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x.ids for x in encoded]
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        width, at, out = int(self.kind[-1]), 0, []
        for row in ids:
            end = at + width * len(row)
            out.append(flat[at:end])
            at = end
        return out

    def _joined(self, units: list[str]) -> list[bytes] | None:
        """IDs of units that ``_is_plain``, encoded as one text: each begins where a token begins
        with a space, or ends where a token ends a word. Nothing if the tokens tell otherwise."""
        text = " ".join(units)
        encoded = self.tokenizer.encode_batch_fast([" " + text if self.spaced else text], add_special_tokens=False)
        ids = np.array(encoded[0].ids)
        edges = np.flatnonzero(self.edges[ids])
        if len(edges) != len(units):
            return None
        flat, width = ids.astype(self.kind).tobytes(), int(self.kind[-1])
        cuts = [*(width * edges).tolist(), len(flat)] if self.spaced else [0, *(width * (edges + 1)).tolist()]
        return [flat[at:end] for at, end in zip(cuts, cuts[1:])]

    def _is_plain(self, unit: str) -> bool:
        """With a space in front and none inside, or a word of Latin letters alone."""
        if not self.spaced:
            return unit.isalpha() and (unit.isascii() or max(unit) < "\u0250")
        return unit != "" and unit[0] != _FIRST and " " not in unit and not (unit[0].isspace() or unit[-1].isspace())

    def _encoded(self, plain: list[str], others: set[str]) -> dict[str, bytes]:
        """IDs of units, of plain ones as parts of one text."""
        rest, out = list(others), {}
        for at in range(0, len(plain), JOINED_UNITS):
            part = plain[at : at + JOINED_UNITS]
            ids = self._joined(part)
            if ids is None:
                rest += part
            else:
                out.update(zip(part, ids, strict=True))
        if rest:
            out.update(zip(rest, self._library([self._whole(u) for u in rest]), strict=True))
        return out

    def _is_unsafe(self, text: str) -> bool:
        """Whether a space follows white space."""
        return "  " in text or "\n " in text or self.unsafe.search(text) is not None

    def _is_loose(self, text: str) -> bool:
        """Whether a comma, stop or line end may belong to a longer token."""
        return text[:1] == "\n" or text[-1:] == "\n" or any(search(text) for search in self.loose)

    def _units(self, text: str) -> list[str]:
        """The first unit is marked if it has no space before it where others have one."""
        if not self.spaced:
            if "<|" in text:
                # Upper-case strings that only look like special tokens must not become ones.
                return text.replace("\n", " ").split(" ")
            # The tokenizer lower-cases; doing so for ASCII first makes more words alike.
            return text.encode("utf-8", "replace").lower().decode().replace("\n", " ").split(" ")
        if self._is_unsafe(text):
            first, *rest = self.cut.split(text)
            return [_FIRST + first, *[x[1:] for x in rest]]
        if not self._is_loose(text):
            # Words are the same units with and without a comma, stop or line end behind them.
            text = text.replace("\n", f" {_FIRST}\n {_FIRST}")
            text = text.replace(", ", f" {_FIRST}, ").replace(". ", f" {_FIRST}. ")
        units = text.split(" ")
        units[0] = _FIRST + units[0]
        return units

    def _whole(self, unit: str) -> str:
        """The text that a unit stands for; the space before it is not part of its name."""
        if not self.spaced:
            return unit
        return unit[1:] if unit[:1] == _FIRST else " " + unit

    def _named(self, text: str) -> str:
        """The unit that stands for a text."""
        if not self.spaced:
            return text
        return text[1:] if text[:1] == " " else _FIRST + text

    def _atoms(self, unit: str) -> list[str]:
        """Smaller units in ``unit``: line ends between words, a comma or stop at the end."""
        if "\n" not in unit:
            return [unit[:-1], unit[-1]] if unit[-2:-1] in self.letters else [unit]
        words = [unit]
        if not self.near.search(unit):
            words = [x for part in unit.split("\n") for x in (part, "\n")][:-1]
        out = []
        for word in words:
            if word[-1:] in self.ends and word[-2:-1] in self.letters:
                out += [word[:-1], word[-1]]
            else:
                out.append(word)
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """IDs of units that the worker does not know. Those that are not plain may be made of
        smaller ones, which it often knows, and are put together from them."""
        plain = [u for u in missing if self._is_plain(u)]
        made, fresh = {}, set()
        for unit in missing.difference(plain):
            parts = self._atoms(self._whole(unit)) if unit[-1:] in self.ends or "\n" in unit else ()
            if len(parts) > 1:
                made[unit] = parts = [self._named(x) for x in parts]
                fresh.update(parts)
            else:
                fresh.add(unit)
        known = {u: ids for u in fresh if (ids := self.memo.get(u)) is not None}
        fresh.difference_update(known)
        fresh.difference_update(plain)
        plain += [u for u in fresh if self._is_plain(u)]
        known.update(self._encoded(plain, fresh.difference(plain)))
        known.update((u, b"".join([known[x] for x in parts])) for u, parts in made.items())
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO_UNITS:
            memo.clear()
        units, sizes = [], []
        for text in texts:
            own = self._units(text)
            units += own
            sizes.append(len(own))
        # One look at the memo for each unit of a text.
        found = list(map(memo.get, units))
        gaps = [at for at, ids in enumerate(found) if ids is None]
        if gaps:
            wanted = {units[at] for at in gaps}
            learnt = self._learn(wanted)
            for at in gaps:
                found[at] = learnt[units[at]]
            memo.update({u: learnt[u] for u in wanted if len(u) <= MEMO_LENGTH})
        out, at = [], 0
        for size in sizes:
            out.append(b"".join(found[at : at + size]))
            at += size
        return out


def encoder(path: str, spaced: bool, width: int = 4) -> Encoder:
    """The encoder of this worker; tasks that follow find its units again."""
    key = (path, spaced, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaced, width)
    return _ENCODERS[key]
