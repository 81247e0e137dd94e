"""Text normalisation, tokens and phrase matching as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions import lexicon as lx

#: Java's \w is ASCII and, with (?U), keeps combining marks; these classes are the ones meant.
_WORD = r"[\p{L}\p{N}_]"
_BEFORE, _AFTER = rf"(?<!{_WORD})", rf"(?!{_WORD})"
#: Fixed value: a token. Possessive in Spark, where a plain repeated group would overflow the stack on long texts; SQL has the same without.
TOKEN = r"[a-z0-9]++(?:[+#.][a-z0-9]++)*+"
TOKEN_SQL = r"[a-z0-9]+(?:[+#.][a-z0-9]+)*"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once also where use refers to it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """A literal array; one expression however long, where a literal each would be built call by call."""
    listed = ", ".join(map(quoted, values))
    return F.expr(f"array({listed})") if listed else F.expr("cast(array() AS array<string>)")


_PAIRS = [(pattern, put) for pattern, put in (*lx.PHRASES, *lx.NUMBERS.items())]


def _pairs() -> Column:
    """(words that a pattern may begin with, pattern, what it becomes)."""
    each = []
    for pattern, put in _PAIRS:
        heads = ", ".join(quoted(alternative.split(r"\s")[0]) for alternative in pattern.split("|"))
        each.append(f"struct(array({heads}) AS w, {quoted(rf'(?i){_BEFORE}(?:{pattern}){_AFTER}')} AS p, {quoted(put)} AS r)")
    return F.expr(f"array({', '.join(each)})")


def rewritable(text: Column) -> Column:
    """The words of a text with which a phrase or number word of the lexicon may begin."""
    heads = strings(sorted({alternative.split(r"\s")[0] for pattern, _ in _PAIRS for alternative in pattern.split("|")}))
    return F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), heads)


def phrases_and_numbers(text: Column) -> Column:
    """Rewrite the romanised phrases and number words of the lexicon, whole words only, in any case.

    A text's words tell which patterns can match, mostly none; no replacement makes a word that another seeks.
    """
    held = rewritable(text)

    def rewritten(words: Column) -> Column:
        useful = F.filter(_pairs(), lambda x: F.arrays_overlap(words, x["w"]))
        return F.aggregate(useful, text, lambda t, x: F.regexp_replace(t, x["p"], x["r"]))

    return let(held, rewritten)


def squeeze(text: Column) -> Column:
    """Lower-case; keep letters, digits and + # . / -; one space for anything else."""
    dashed = F.lower(text)
    for dash in "—–":
        dashed = F.replace(dashed, F.lit(dash), F.lit("-"))
    return F.trim(F.regexp_replace(dashed, r"[^\p{L}\p{N}+#./-]+", " "))


def nfkc(text: Column) -> Column:
    """A text in NFKC, by the ICU that comes with Spark; texts that are ASCII throughout, which is the rule, pass as they are."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def clean(text: Column, rewrite: bool = True) -> Column:
    """The normal form of a text: NFKC, romanised phrases rewritten, squeezed; empty for null."""
    text = let(F.coalesce(text.cast("string"), F.lit("")), nfkc)
    return squeeze(let(text, phrases_and_numbers) if rewrite else text)


def tokens(cleaned: Column) -> Column:
    """ASCII tokens of a cleaned text, with inner + # and . kept."""
    return F.regexp_extract_all(cleaned, F.lit(TOKEN), F.lit(0))


def words(cleaned: Column) -> Column:
    """The words between spaces."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def padded(cleaned: Column) -> Column:
    return F.concat(F.lit(" "), cleaned, F.lit(" "))


def found(cleaned: Column, terms: Iterable[str]) -> Column:
    """The terms that stand between spaces in a cleaned text, each once, in no particular order.

    The text's words are hashed once: a term of one word is one of them, and a longer one is only sought where its first word is.
    """
    terms = sorted({t for t in terms if t})
    longer = [t for t in terms if " " in t]
    heads = strings(sorted({t.split(" ")[0] for t in terms}))
    pairs = F.expr("array(" + ", ".join(f"struct({quoted(t.split(' ')[0])} AS h, {quoted(t)} AS t)" for t in longer) + ")") if longer else None

    def of(few: Column) -> Column:
        short = F.array_intersect(few, strings(t for t in terms if " " not in t))
        if pairs is None:
            return short
        hits = F.filter(pairs, lambda x: F.array_contains(few, x["h"]) & F.contains(padded(cleaned), padded(x["t"])))
        return F.concat(short, F.transform(hits, lambda x: x["t"]))

    return let(F.array_intersect(F.split(cleaned, " "), heads), of)


def has_any(held: Column, terms: Iterable[str]) -> Column:
    """Whether any term is among those that found() gave."""
    return F.arrays_overlap(held, strings(t for t in terms if t))


def present(held: Column, terms: Iterable[str]) -> Column:
    """The terms that are among those that found() gave, as listed."""
    return F.array_intersect(strings(terms), held)


def named(held: Column, groups: dict[str, Iterable[str]]) -> Column:
    """Names of the groups of which found() gave any term, as listed."""
    listed = ", ".join(f"struct({quoted(n)} AS n, array({', '.join(quoted(t) for t in terms if t)}) AS t)" for n, terms in groups.items())
    hits = F.filter(F.expr(f"array({listed})"), lambda g: F.arrays_overlap(held, g["t"]))
    return F.transform(hits, lambda g: g["n"])


def phrase_count(padded_text: Column, term: str) -> Column:
    """How often a term stands between spaces; of neighbours that share a space every other counts."""
    return phrase_counts(padded_text, strings([term]))


def phrase_counts(padded_text: Column, terms: Column) -> Column:
    """The sum of phrase_count over an array of terms."""

    def one(total: Column, term: Column) -> Column:
        return total + ((F.length(padded_text) - F.length(F.replace(padded_text, padded(term), F.lit("")))) / (F.length(term) + 2)).cast("int")

    return F.aggregate(terms, F.lit(0), one)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def number(value: Column) -> Column:
    """A finite double, or null."""
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def day(value: Column) -> Column:
    """The date that the first ten characters spell as yyyy-MM-dd, or null."""
    head = F.substring(value.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def sentences(text: Column) -> Column:
    """Sentences of a text, without dashes, blanks and separators at their ends."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    parts = F.split(flat, r"(?<=[.!?;])\s+|\s+\|\s+")
    return F.transform(F.filter(parts, lambda s: F.trim(s) != ""), lambda s: F.btrim(s, F.lit(" -;,.")))


def flatten(column: Column, kind: T.DataType) -> Column:
    """A nested value as text: fields by lower-cased name, each scalar cleaned, blanks between; empty for null."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.lower())
        return _joined([flatten(column[f.name], f.dataType) for f in fields])
    if isinstance(kind, T.ArrayType):
        each = F.transform(F.coalesce(column, F.array().cast(kind)), lambda x: flatten(x, kind.elementType))
        return F.array_join(F.filter(each, lambda x: x != ""), " ")
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(F.lower(e["key"].cast("string")).alias("k"), e["value"].alias("v"))))
        each = F.transform(entries, lambda e: flatten(e["v"], kind.valueType))
        return F.coalesce(F.array_join(F.filter(each, lambda x: x != ""), " "), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.when(column, F.lit("true")).when(~column, F.lit("false")), F.lit(""))
    return clean(column)


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ") if parts else F.lit("")


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns whose values are computed once a row.

    Spark puts a projection's expressions in place of the names that the next one uses, and inside lambdas it
    does so for each use; not so where an expression counts as one that may vary, as with the partition's number in it.
    """
    return df.withColumns({k: F.when(F.spark_partition_id() >= 0, v) for k, v in columns.items()})
