"""Text functions in DuckDB's dialect, for the SQL that queries must agree with."""

from __future__ import annotations

from tamarack.functions import lexicon as lx


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower({x}), '—–', '--'), '[^\p{{L}}\p{{N}}+#./-]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_count(padded: str, term: str) -> str:
    return f"(length({padded}) - length(replace({padded}, ' {term} ', ''))) // {len(term) + 2}"


def sql_rewritten(x: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    for pattern, put in [*lx.PHRASES, *lx.NUMBERS.items()]:
        for _ in range(2):  # neighbours share an edge
            x = rf"regexp_replace({x}, '(^|{edge})(?:{pattern})({edge}|$)', '\1{put}\2', 'gi')"
    return x
