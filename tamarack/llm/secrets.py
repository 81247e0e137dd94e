"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns (an assignment to a secret's name, an access key, long hex).
The battery looks at every longest run of 16 or more token characters. It infers the encoding
(hex, base32 or base64), and tests the symbols against uniform random ones:

* alphabet uniformity: chi-squared over the alphabet, taken as the count K of equal pairs of
  symbols, which determines it; K is compared with its mean on the square-root scale, so that
  short tokens with few expected pairs get a fair p-value;
* runs of symbols from the upper and the lower half of the alphabet (Wald-Wolfowitz);
* lag-one serial correlation of the symbols' ranks.

Three times the least of the three p-values, 1 at most, tells how random a token looks. How
often ordinary words look as random depends on their length, so p-values against ordinary text
come from the corpus: for each class of lengths, the share of plain words of that length or
shorter that look at least as random. Benjamini and Hochberg's rule within each class, on these,
gives the tokens that count as secrets; PRIOR_WORDS words that don't look random are added to the
corpus' own, so that a small or wordless table is judged too. Both counts are over all documents, by class and by
forty bins of the score, so 500 rows at most reach the driver, whatever the input.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans;
repeated rows each give a row; a null doc_id stays null; an empty table gives an empty result;
other columns are ignored by scan() and kept by redact(), whatever their names but those that begin with _.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _spans
from tamarack.llm._shared import cut, let

# The base patterns and the least lengths of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: Shortest token that may be found by the battery; shorter ones only count as plain words.
LEAST_RANDOM = 20
LENGTHS = (20, 24, 32, 48, 64)
BINS = 40
#: A token whose battery p-value is lower than 10 ** (-WORST_BIN / 4) is never taken for random.
WORST_BIN = 12
FALSE_DISCOVERIES = 0.05
#: Plain words that count as seen in each class beside the corpus' own, none of them random, so that few words don't blind the rule.
PRIOR_WORDS = 100
MASK = "[REDACTED]"

_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SPAN = "struct<start:int,end:int>"


def _matches(text, pattern: str, keep) -> F.Column:
    """(start, end, token) of the matches that keep(token) holds for; texts without a match are only looked through."""
    return _spans.found(text, pattern, keep, lambda start, end, token, *_: F.struct(start.alias("start"), end.alias("end"), token.alias("token")), "struct<start:int,end:int,token:string>")


def _keeps(kind: str):
    if kind == "assign":
        return lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= LEAST[kind]
    return lambda x: F.length(x) >= LEAST[kind]


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}


def _upper_tail(z) -> F.Column:
    """P(Z > z) of the standard normal, by Abramowitz and Stegun's 26.2.17 (error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + x * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(F.exp(-x * x / 2) / F.lit((2 * 3.141592653589793) ** 0.5) * poly, F.lit(1e-300))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _count(text, sub: str) -> F.Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sub), F.lit("")))) / len(sub)


def _battery(token) -> F.Column:
    """Three times the least p-value of the battery under randomness, 1 at most."""
    return let(F.regexp_replace(token, "=+$", ""), _battery_of_bare)


def _battery_of_bare(bare) -> F.Column:
    kind = F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(1)).when(bare.rlike("^[A-Z2-7]+$"), F.lit(2)).otherwise(F.lit(3))

    def encoded(k) -> F.Column:
        body = F.when(k == 1, F.lower(bare)).when(k == 2, bare).otherwise(F.translate(bare, "-_=", "+//"))
        alphabet = F.when(k == 1, F.lit(_HEX)).when(k == 2, F.lit(_B32)).otherwise(F.lit(_B64))
        return let(F.struct(body.alias("body"), alphabet.alias("alphabet")), lambda e: _battery_of(e["body"], e["alphabet"], k))

    return let(kind, encoded)


def _battery_of(body, alphabet, kind) -> F.Column:
    size = F.length(alphabet).cast("double")
    n = F.length(body).cast("double")

    def uniform(chars) -> F.Column:
        def equal_pairs(acc, c):
            return acc + let(n - F.length(F.replace(body, c, F.lit(""))), lambda k: k * (k - 1) / 2)

        expected = n * (n - 1) / 2 / size
        pairs = F.aggregate(F.array_distinct(chars), F.lit(0.0), equal_pairs)
        return let(2 * (F.sqrt(pairs + 0.375) - F.sqrt(expected + 0.375)), _upper_tail)

    def halves(a: str):
        return F.translate(body, a, "0" * (len(a) // 2) + "1" * (len(a) // 2))

    def runs(bits) -> F.Column:
        counts = F.struct(_count(bits, "0").alias("low"), (1 + _count(bits, "01") + _count(bits, "10")).alias("runs"))

        def of(c) -> F.Column:
            mean = 2 * c["low"] * (n - c["low"]) / n + 1
            var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
            return F.when(var > 0, let(F.abs(c["runs"] - mean) / F.sqrt(var), lambda z: 2 * _upper_tail(z))).otherwise(F.lit(0.0))

        return let(counts, of)

    def serial(rank) -> F.Column:
        def added(values):
            return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

        squares = F.transform(rank, lambda x: x * x)
        lagged = F.zip_with(rank, F.concat(F.slice(rank, 2, F.size(rank)), F.slice(rank, 1, 1)), lambda x, y: x * y)
        sums = F.struct(added(rank).alias("total"), added(squares).alias("squares"), added(lagged).alias("lagged"))

        def of(s) -> F.Column:
            spread = n * s["squares"] - s["total"] * s["total"]
            r = (n * s["lagged"] - s["total"] * s["total"]) / spread
            return F.when(spread > 0, let(F.abs(r + 1 / (n - 1)) * F.sqrt(n), lambda z: 2 * _upper_tail(z))).otherwise(F.lit(0.0))

        return let(sums, of)

    chars = F.filter(F.split(body, "", -1), lambda c: c != "")
    bits = F.when(kind == 1, halves(_HEX)).when(kind == 2, halves(_B32)).otherwise(halves(_B64))
    p_chi = let(chars, uniform)
    p_runs = let(bits, runs)
    p_serial = let(F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")), serial)
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _bin(token) -> F.Column:
    return F.least(F.lit(BINS), F.floor(-4 * F.log10(F.greatest(_battery(token), F.lit(1e-290))))).cast("int")


def _length_class(token) -> F.Column:
    found = F.lit(0)
    for k, least in enumerate(LENGTHS):
        found = F.when(F.length(token) >= least, F.lit(k + 1)).otherwise(found)
    return found


def _plain(token) -> F.Column:
    """An ordinary word: letters of one case, the first in either."""
    return token.rlike("^(?:[A-Za-z]?[a-z]+|[A-Z]+)$")


def thresholds(counts: dict[tuple[int, int, bool], int], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """The last bin that counts as random, by length class; counts: by (length class, bin, plain word)."""
    found = {}
    for k in range(1, len(LENGTHS) + 1):
        nulls = sum(n for (c, _, plain), n in counts.items() if plain and c <= k)
        tokens = sum(n for (c, _, plain), n in counts.items() if not plain and c == k)
        for b in range(WORST_BIN + 1):
            as_random = sum(n for (c, x, plain), n in counts.items() if plain and c <= k and x <= b)
            discovered = sum(n for (c, x, plain), n in counts.items() if not plain and c == k and x <= b)
            if discovered and tokens * (1 + as_random) / (1 + nulls + PRIOR_WORDS) <= rate * discovered:
                found[k] = b
    return found


def _searched(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, the base spans by kind, and the runs that the battery judges; their names begin with _."""
    frame = docs.select(*keep, _spans.searchable(F.col("text")).alias("_text"))  # for the search alone: code points stay in their places
    columns = {kind: _matches(F.col("_text"), p, _keeps(kind)) for kind, p in _PATTERNS.items()}
    columns["runs"] = _matches(F.col("_text"), RUN, lambda x: F.lit(True))
    frame = frame.select(*keep, *[v.alias(f"_{k}") for k, v in columns.items()])
    slim = [F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"_{k}") for k in _PATTERNS]
    judged = F.transform(
        "_runs",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            _length_class(x["token"]).alias("length_class"),
            _bin(x["token"]).alias("bin"),
            _plain(x["token"]).alias("plain"),
        ),
    )
    return frame.select(*keep, *slim, judged.alias("_runs"))


def _counted(found: DataFrame) -> dict[tuple[int, int, bool], int]:
    rows = found.select(F.explode("_runs").alias("r")).groupBy("r.length_class", "r.bin", "r.plain").count().collect()
    return {(r[0], r[1], r[2]): r[3] for r in rows}


def _is_random(length_class, at, plain, limits: dict[int, int]) -> F.Column:
    found = F.lit(False)
    for k, b in limits.items():
        found = found | ((length_class == k) & (at <= b))
    return found & ~plain


def _random(limits: dict[int, int]) -> F.Column:
    """The battery's spans, where no base span overlaps."""
    base = F.concat(*[f"_{k}" for k in _PATTERNS])
    extra = F.filter("_runs", lambda x: _is_random(x["length_class"], x["bin"], x["plain"], limits) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return F.transform(extra, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame, *, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, assign, access, hex (base spans) and random (the battery's, where no base span overlaps)."""
    found = cut(_searched(docs), "secrets")
    limits = thresholds(_counted(found), rate)
    return found.select("doc_id", *[F.col(f"_{k}").alias(k) for k in _PATTERNS], _random(limits).alias("random"))


def joined_spans(kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of the spans of scan(), by start, then kind as listed, comma-joined."""

    def told(k: int, kind: str) -> F.Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    each = [told(k, kind) for k, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _masked(text, spans, mask: str) -> F.Column:
    """text with each of the spans, which are sorted and may overlap, replaced by mask."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("full"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        whole = F.size(acc["out"]) >= _spans.CHUNK
        full = F.when(whole, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"])
        out = F.when(whole, F.array().cast("array<string>")).otherwise(acc["out"])
        piece = F.array(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), full.alias("full"), F.when(fresh, F.concat(out, piece)).otherwise(out).alias("out"))

    def done(acc):
        rest = F.array(F.substr(text, acc["at"] + 1))
        return F.array_join(F.concat(F.flatten(acc["full"]), acc["out"], rest), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, done)).otherwise(text)


def redact(docs: DataFrame, *, rate: float = FALSE_DISCOVERIES, mask: str = MASK) -> DataFrame:
    """docs with every span of scan() replaced by mask, spans that overlap by one; all columns stay.

    Nothing else of a text changes; null stays null. n_chars follows the text if there is one. The texts are
    searched once, and written with their spans, as the thresholds need the counts over all of them.
    """
    found = cut(_searched(docs.withColumn("_row", F.struct(*docs.columns)), ("_row",)).withColumnRenamed("_row", "_docs"), "secrets")
    limits = thresholds(_counted(found), rate)
    spans = F.array_sort(F.concat(*[f"_{k}" for k in _PATTERNS], _random(limits)))
    out = found.select("_docs.*", spans.alias("_spans")).withColumn("text", F.when(F.col("text").isNotNull(), _masked(F.col("text"), F.col("_spans"), mask)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
