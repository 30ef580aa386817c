"""All queries of this subpackage."""

from . import (
    contamination,
    hard_negatives,
    line_dedup,
    near_dups,
    packing,
    personal_data,
    prefix_trie,
    quality,
    recompression,
    secrets,
    simhash,
    suffix_dedup,
    token_files,
)
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "contamination",
    "hard_negatives",
    "line_dedup",
    "near_dups",
    "packing",
    "personal_data",
    "prefix_trie",
    "quality",
    "recompression",
    "secrets",
    "simhash",
    "suffix_dedup",
    "token_files",
]
