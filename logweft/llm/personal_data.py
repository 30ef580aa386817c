"""Personal data in texts, also where it is disguised.

Plain patterns give the base spans. Then a text with signs of disguise is normalised by
transducers that keep, for every character they emit, the span of source characters it
stands for: look-alike letters and digits become ASCII, invisible characters vanish,
bracketed or spelled "at" and "dot" become ``@`` and ``.``, and runs of spelled digits
become digits. The same patterns run over the normalised text, and what they find is
mapped back. A span found there is added unless it overlaps a base span of its kind. Most
texts hold nothing: tests in linear time over whole batches choose what the finders and the
transducers look at, and they hold for every text where these can find anything.

Cases: a null or empty text has no spans; rows without ID and repeated rows each give a
row; the patterns take time in proportion to a text, however long; other columns of the
input do not matter; an empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, documents, slices
from .registry import query

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails from its first digit fails from every later one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ν",
    "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。", "-": "‐‑‒–−﹣", "+": "﹢",
}
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str]:
    """Look-alikes, plus the compatibility forms and decimal digits of Unicode that stand
    for one ASCII character."""
    table = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
    for low, high in ((0x0660, 0x0E60), (0x1D400, 0x1D800), (0x24B6, 0x24EA), (0xFF01, 0xFF5F)):
        for code in range(low, high):
            digit = unicodedata.decimal(chr(code), None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and "!" <= plain <= "~":
                table[code] = plain
    return table


FOLD = _fold_table()
_STRANGE = "".join(re.escape(chr(code)) for code in sorted(FOLD)) + INVISIBLE
_WORD = "|".join(DIGIT_WORDS) + "|oh"
_DIGIT_RUN = rf"(?:(?:{_WORD}|[0-9])[ ,.-]{{0,2}}){{6,}}(?:{_WORD}|[0-9])"
SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ -]?)?{_DIGIT_RUN}(?![A-Za-z])", re.IGNORECASE)
AT = r"\s{0,3}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,3}"
DOT = r"\s{0,3}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,3}"
#: Bare words count only together: "name at host dot org".
BARE = re.compile(
    r"(?<=[A-Za-z0-9])[ _]at[ _](?=[A-Za-z0-9-]{1,63}(?:[ _]dot[ _][A-Za-z0-9-]{1,63}){1,5}(?![A-Za-z0-9]))",
    re.IGNORECASE,
)
BARE_DOT = re.compile(r"[ _]dot[ _](?=[A-Za-z0-9])", re.IGNORECASE)
BRACKETS = re.compile(rf"(?P<at>{AT})|(?P<dot>{DOT})", re.IGNORECASE)
STRANGE = re.compile(f"[{_STRANGE}]")
#: An address or number whose bare dots are spelled: "name@host dot org", "10 dot 0 dot 0 dot 1".
DOTTED = re.compile(
    r"@[A-Za-z0-9-]{1,63}(?:(?:[ _]dot[ _]|\.)[A-Za-z0-9-]{1,63}){1,6}"
    r"|(?<![0-9])[0-9]{1,3}(?:[ _]dot[ _][0-9]{1,3}){3}(?![0-9])",
    re.IGNORECASE,
)
# Tests of whole batches, in the linear-time syntax of Arrow's regular expressions: true for
# every text in which a finder, or a transducer, can do anything.
_GAP = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{0,2}"
MAY_HOLD = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_STRANGE_RANGE = "".join(rf"\x{{{ord(c):x}}}" for c in sorted({*map(chr, FOLD), *INVISIBLE}))
MAY_HIDE = (
    rf"(?i)[{_STRANGE_RANGE}]|[\[({{<]{_GAP}(?:at|dot|@|\.){_GAP}[\])}}>]|[ _]dot[ _]"
    rf"|(?:zero|one|two|three|four|five|six|seven|eight|nine)[ ,.-]{{1,2}}(?:{_WORD}|[0-9])"
)
_PART = re.compile(rf"plus|{_WORD}|[0-9]", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` has one possible start: that of the run of local characters before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in IP.finditer(text):
        parts = [part.lstrip("0") for part in found[0].split(".")]
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            yield found.span()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in CARD.finditer(text):
        if 16 <= found.end() - found.start() <= 37:
            digits = found[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in found[0]) <= 15:
                yield found.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


class Normalised:
    """A text with, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = range(len(text))
        self.ends = range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put one character, or none, in the place of each span; spans are in order."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for start, end, put in edits:
            parts += [self.text[at:start], put]
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if put:
                starts.append(self.starts[start])
                ends.append(self.ends[end - 1])
            at = end
        parts.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        self.text, self.starts, self.ends = "".join(parts), starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _digit(part: str) -> str:
    low = part.casefold()  # the patterns take the long s for an s
    return "+" if low == "plus" else "0" if low == "oh" else str(DIGIT_WORDS.index(low)) if low in DIGIT_WORDS else part


def normalise(text: str) -> Normalised:
    out = Normalised(text)
    if STRANGE.search(text):
        out.replace([(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]", out.text)])
        out.text = out.text.translate(FOLD)
    out.replace([(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETS.finditer(out.text)])
    edits = []
    for found in BARE.finditer(out.text):
        edits.append((found.start(), found.end(), "@"))
        at = found.end()
        # The dots that follow the host, as the look-ahead has seen them.
        while word := re.compile(r"[A-Za-z0-9-]{1,63}").match(out.text, at):
            dot = BARE_DOT.match(out.text, word.end())
            if not dot:
                break
            edits.append((dot.start(), dot.end(), "."))
            at = dot.end()
    edits = [e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1]]
    out.replace(edits)
    dots = [d for m in DOTTED.finditer(out.text) for d in BARE_DOT.finditer(out.text, m.start(), m.end())]
    out.replace([(d.start(), d.end(), ".") for d in dots])
    edits = []
    for run in SPELLED.finditer(out.text):
        parts = list(_PART.finditer(out.text, run.start(), run.end()))
        if any(part[0].isalpha() for part in parts):
            for k, part in enumerate(parts):
                if k and parts[k - 1].end() < part.start():
                    edits.append((parts[k - 1].end(), part.start(), ""))
                edits.append((part.start(), part.end(), _digit(part[0])))
    out.replace(edits)
    return out


def find_spans(text: str, kinds: Iterable[str] = KINDS, hidden: bool = True) -> list[tuple[str, int, int, bool]]:
    """Kind, start, end and whether it is a base span, by kind as listed, then start.

    ``kinds`` are those that may have base spans, ``hidden`` whether there may be disguises.
    """
    base = {kind: list(FINDERS[kind](text)) if kind in kinds else [] for kind in KINDS}
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if hidden:
        plain = normalise(text)
        if plain.text != text:
            for kind, finder in FINDERS.items():
                for found in finder(plain.text):
                    start, end = plain.source(*found)
                    if not any(start < e and s < end for s, e in base[kind]):
                        added[kind].append((start, end))
    out = []
    for kind in KINDS:
        rows = [(s, e, True) for s, e in base[kind]] + [(s, e, False) for s, e in added[kind]]
        out += [(kind, *row) for row in sorted(rows)]
    return out


def batch_spans(texts: pa.Array) -> list[list[tuple[str, int, int, bool]]]:
    """``find_spans`` of each text, after tests of the whole batch."""
    may = {kind: pc.match_substring_regex(texts, pattern).to_pylist() for kind, pattern in MAY_HOLD.items()}
    hidden = pc.match_substring_regex(texts, MAY_HIDE).to_pylist()
    out = []
    for i, hides in enumerate(hidden):
        kinds = [kind for kind in KINDS if may[kind][i]]
        out.append(find_spans(texts[i].as_py(), kinds, hides) if kinds or hides else [])
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ID and ``spans`` of every row: kind, start, end (code points) and base."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [
                [dict(zip(("kind", "start", "end", "base"), span, strict=True)) for span in found]
                for found in batch_spans(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), blank(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        own = F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
