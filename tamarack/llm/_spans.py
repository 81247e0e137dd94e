"""Matches of a pattern in a text, with their places and what stands around them, by built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.llm._shared import let

#: A character that texts to be searched have no more, and what stands for it.
MARK, OTHER = "\x01", "\x02"
#: Matches of a text that are gathered together, so that a text with very many isn't copied once for each.
CHUNK = 256


def searchable(text) -> F.Column:
    """A text without MARK, null as empty; code points stay in their places."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, OTHER)


def found(text, pattern: str, keep, make, kind: str) -> F.Column:
    """An array of make(start, end, token, before, after) for each match that keep(token) holds for.

    text: what searchable() returned. before and after: what is between the match and its neighbours, or the text's ends. kind: make's type.
    """
    cut_up = F.split(F.regexp_replace(text, F.lit(f"(?:{pattern})"), F.lit(f"{MARK}$0{MARK}")), F.lit(MARK), -1)
    place = "struct<start:int,end:int,k:int>"
    empty = F.array().cast(f"array<{place}>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(f"array<array<{place}>>").alias("full"), empty.alias("out"))

    def step(acc, part):
        end = (acc["at"] + F.length(part)).cast("int")
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), acc["k"].alias("k")))
        whole = F.size(acc["out"]) >= CHUNK
        full = F.when(whole, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"])
        out = F.when(whole, empty).otherwise(acc["out"])
        hit = (acc["k"] % 2 == 1) & keep(part)
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), full.alias("full"), F.when(hit, F.concat(out, one)).otherwise(out).alias("out"))

    def done(acc):
        return F.when(F.size(acc["full"]) > 0, F.concat(F.flatten(acc["full"]), acc["out"])).otherwise(acc["out"])

    def made(p):
        places = F.aggregate(p, zero, step, done)
        return F.transform(places, lambda m: make(m["start"], m["end"], F.get(p, m["k"]), F.get(p, m["k"] - 1), F.get(p, m["k"] + 1)))

    return F.when(text.rlike(pattern), let(cut_up, made)).otherwise(F.array().cast(f"array<{kind}>"))
