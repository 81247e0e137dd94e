"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled text. A text is parsed against each:
from where the last phrase ended, the automaton is followed as far as it goes, which gives the
longest match, and there the next phrase begins. With c phrases over n symbols against a training
text of m symbols the entropy is c * log2(m) / n; the language with the lowest wins. Texts are parsed
in lanes of LANE bytes, thousands of lanes at a time, each a state in every automaton; a text's phrases
are those of all its lanes.

Symbols: letters a-z in either case, UTF-8's bytes above 127, and one blank for anything else.

The training texts are a bounded sample: for each of at most `languages` languages (the most frequent labels), of about
`rows` labelled documents, drawn by a hash of doc_id, the first `excerpt` characters, and of these in the hash's order no more than
`symbols`, which is some 40 excerpts: an automaton's states have 15 bits. Everything else covers all texts as a whole.

A text that no language explains in fewer bits than random letters would take is no text of a known language:
noise() tells such rows by the winner's bits a symbol.

Defined results: a null text, or one without a letter, is `und` with score 0; so is any text if nothing
could be learned. Ties go to the language that sorts first. Repeated rows each give a row; a null
doc_id stays null and doesn't take part in training; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, EXCERPT, SYMBOLS = 100, 400, 16_000
#: Languages that are learned, the most frequent labels first, so that dirty labels can't fill the driver.
LANGUAGES = 200
UND = "und"
#: Bits a symbol of random letters and blanks, log2 27, and bits that a text may take beyond that, so that short ones aren't judged by a few phrases.
NOISE, GRACE = math.log2(27), 64
LANE = 256
LANES = 8192
#: Bits a symbol by which the winner must lead for a score of one half.
HALF = 0.1

_WIDTH = 128
_PAD = 127
_BREAK = 0x8000


def _symbol_table() -> np.ndarray:
    table = np.full(256, 26, np.uint8)
    for c in range(26):
        table[97 + c] = table[65 + c] = c
    for b in range(0x80, 0xC0):
        table[b] = 27 + (b & 0x3F)
    for b in range(0xC0, 0x100):
        table[b] = 91 + (b & 0x1F)
    return table


_SYMBOL = _symbol_table()


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of symbols; state 0 is its start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = state
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return goto


def parse_table(symbols: bytes) -> np.ndarray:
    """table[state * 128 + symbol]: the next state, with the top bit set where a phrase ended before the symbol.

    A symbol that the training text lacks is a phrase of its own; padding leads to the start, without a phrase.
    """
    goto = suffix_automaton(symbols)
    strange = len(goto)  # the state after a symbol that the training text lacks: whatever follows begins a phrase
    if strange >= _BREAK:
        raise ValueError(f"{len(symbols)} symbols are too many for one automaton")
    table = np.empty((strange + 1, _WIDTH), np.uint16)
    begin = np.full(_WIDTH, strange, np.uint16)
    for c, to in goto[0].items():
        begin[c] = to
    table[0] = begin
    table[1:] = begin | _BREAK
    for state, edges in enumerate(goto[1:], 1):
        for c, to in edges.items():
            table[state, c] = to
    table[:, _PAD] = 0
    return table.reshape(-1)


class Model:
    """A parse table and a bits-a-phrase figure for each language."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(k for k, v in texts.items() if v)
        self.tables = [parse_table(texts[k]) for k in self.languages]
        self.bits = np.array([math.log2(len(texts[k]) + 1) for k in self.languages])

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol of each text (bytes) against each language: [text, language]."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // LANE)
        phrases = np.zeros((len(texts), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.concatenate(([0], np.cumsum(lanes)))
        for at in range(0, len(owner), LANES):
            upto = min(len(owner), at + LANES)
            grid = np.full((upto - at, LANE), _PAD, np.uint8)
            for i in range(owner[at], owner[upto - 1] + 1):
                a, b = max(at, first[i]), min(upto, first[i + 1])
                piece = texts[i][(a - first[i]) * LANE : (b - first[i]) * LANE]
                whole = len(piece) // LANE
                grid[a - at : a - at + whole] = _SYMBOL[piece[: whole * LANE]].reshape(whole, LANE)
                if whole < b - a:
                    rest = piece[whole * LANE :]
                    grid[a - at + whole, : len(rest)] = _SYMBOL[rest]
            steps = np.ascontiguousarray(grid.T).astype(np.int32)
            mine = owner[at:upto]
            for k, table in enumerate(self.tables):
                state = np.zeros(upto - at, np.int32)
                count = np.zeros(upto - at, np.int32)
                place = np.empty(upto - at, np.int64)
                for symbols in steps:
                    np.left_shift(state, 7, out=state)
                    np.bitwise_or(state, symbols, out=place)
                    taken = table.take(place)
                    count += taken >> 15
                    state = (taken & 0x7FFF).astype(np.int32)
                # The last phrase of a lane has no break after it, the first has none before it.
                phrases[:, k] += np.bincount(mine, weights=count + 1, minlength=len(texts)).astype(np.int64)
        return phrases * self.bits / np.maximum(sizes, 1)[:, None]


def training_texts(docs: DataFrame, *, rows: int = ROWS, excerpt: int = EXCERPT, symbols: int = SYMBOLS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Symbols of the labelled sample by language; docs: doc_id, text, lang.

    What comes to the driver is bounded by languages * rows * excerpt.
    """
    labelled = docs.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return {}
    share = F.try_element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, rows / n)))]), F.col("lang"))
    place = F.xxhash64(F.lit(7), "doc_id")
    drawn = labelled.where((place.cast("double") / F.lit(float(1 << 63)) + 1) / 2 < share)
    sample = drawn.select("lang", place.alias("place"), "doc_id", F.substring("text", 1, excerpt).alias("text")).collect()
    texts: dict[str, bytearray] = {k: bytearray() for k in counts}
    for row in sorted(sample, key=lambda r: (r["place"], r["doc_id"])):
        held = texts[row["lang"]]
        if len(held) < symbols:
            data = np.frombuffer(row["text"].encode(), np.uint8)
            held += _SYMBOL[data].tobytes()[: symbols - len(held)]
    return {k: bytes(v) for k, v in texts.items()}


def _has_letter(data: np.ndarray) -> bool:
    low = data | 0x20
    if ((low >= 97) & (low <= 122) & (data < 128)).any():
        return True
    return bool((data > 127).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def predict(docs: DataFrame, texts: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, lang_pred, score and bits of every row of docs; texts is what training_texts returned.

    bits: the winner's bits a symbol beyond the first phrase, null where the text is und.
    """
    names = [*keep, "lang_pred", "score", "bits"]
    model: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            model.append(Model(texts))
        m = model[0]
        for batch in batches:
            found, scores = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            costs = np.full(batch.num_rows, np.nan)
            column = batch.column(batch.num_columns - 1)
            held, places, size = [], [], 0

            def settle():
                bits = m.entropies(held)
                best = bits.argmin(axis=1)
                for i, (place, k) in enumerate(zip(places, best.tolist(), strict=True)):
                    found[place] = m.languages[k]
                    costs[place] = bits[i, k] - m.bits[k] / len(held[i])
                    rest = np.delete(bits[i], k)
                    lead = rest.min() - bits[i, k] if len(rest) else 1.0
                    scores[place] = lead / (lead + HALF)

            for i, text in enumerate(column if m.languages else []):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                if len(data) and _has_letter(data):
                    held.append(data)
                    places.append(i)
                    size += len(data)
                if size >= LANE * LANES:
                    settle()
                    held, places, size = [], [], 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found), pa.array(scores), pa.array(costs, mask=np.isnan(costs))], names)

    frame = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return frame.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")


def noise(text="text") -> F.Column:
    """Whether a row of predict() is no text of a known language: und, or explained no better than random letters."""
    n = F.octet_length(text)
    return (F.col("lang_pred") == UND) | (F.coalesce("bits", F.lit(0.0)) * n >= NOISE * n + GRACE)


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from those that aren't held out."""
    texts = training_texts(docs.where(~held_out()))
    return predict(docs, texts).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
