"""Substring dedup of words: seed and extend.

Documents meet on winnowed anchors: of the k-word sequences in every stretch of `length` words, the
one of least hash. From an anchor matches are extended both ways, and every stretch of at least
`length` words that also starts in a document with a smaller doc_id goes (see _repeats).

Defined results: null, empty and blank texts have no words; texts shorter than the length keep all;
repeated rows of one doc_id don't match each other; rows with a null doc_id are kept whole and
match nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tamarack.llm import _repeats

LENGTH = 50
#: Words of an anchor: 50 - 24 + 1 = 27 anchors to choose from in each stretch.
ANCHOR = 24


def _kept_words(data, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], int]:
    words = data.to_pybytes().split()
    n, kept, at = len(words), [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept += words[at:a]
        at = min(b, n)
    return (kept + words[at:] if at else words), n


def digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of every row."""

    def finish(data, starts, ends):
        kept, n = _kept_words(data, starts, ends)
        return n, n - len(kept), len(starts), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _repeats.repeats(docs, _repeats.word_symbols, finish, "doc_id long,n_words long,n_removed long,n_spans long,kept_sha256 string", length=length, k=anchor)


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id and the text of the words that are kept, joined by one space."""

    def finish(data, starts, ends):
        return (b" ".join(_kept_words(data, starts, ends)[0]).decode("utf-8", "replace"),)

    return _repeats.repeats(docs, _repeats.word_symbols, finish, "doc_id long,text string", length=length, k=anchor)
