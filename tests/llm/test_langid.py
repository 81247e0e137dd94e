import math
import random

import numpy as np

from tamarack.llm import langid

SYLLABLES = {"en": ["the", "ing", "tion", "and", "of"], "de": ["schen", "ung", "keit", "der", "ä"], "fr": ["eau", "ment", "ç", "les", "oui"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def greedy_phrases(text, training):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in training:
            n += 1
        count += 1
        at += n
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    training = bytes(rng.randrange(4) for _ in range(300))
    table = langid.parse_table(training)
    for _ in range(50):
        text = bytes(rng.randrange(5) for _ in range(rng.randint(1, 40)))
        state = count = 0
        for symbol in text:
            value = int(table[state * 128 + symbol])
            count += value >> 15
            state = value & 0x7FFF
        assert count + 1 == greedy_phrases(text, training)


def test_lanes_add_up():
    rng = random.Random(4)
    as_symbols = lambda t: langid._SYMBOL[np.frombuffer(t.encode(), np.uint8)].tobytes()
    model = langid.Model({k: as_symbols(prose(rng, k, 200)) for k in ("en", "de")})
    texts = [np.frombuffer(prose(rng, "en", n).encode(), np.uint8) for n in (1, 30, 400, 3000)]
    together = model.entropies(texts)
    for text, row in zip(texts, together, strict=True):
        assert np.allclose(model.entropies([text])[0], row)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, rng.randint(20, 120)), lang, lang, "?") for i, lang in enumerate(rng.choices(list(SYLLABLES), [8, 1, 1], k=400))]
    rows += [(1000, None, "en", "en", "?"), (1001, "", "en", "en", "?"), (1002, "123 -- 456", "en", "en", "?"), (1003, "ÄÖ 1", None, "x", "?"), (None, "the and of", "de", "x", "?"), (0, rows[0][1], rows[0][2], "x", "?")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string")
    got = langid.identified(frame).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    told = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    out = [r for r in told if r.held_out]
    assert out and sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.98 * len(out)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in SYLLABLES
    assert by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identified(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(frame.withColumn("lang", frame.lang.substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}


def test_predictions_agree_with_greedy_parses(spark):
    rng = random.Random(12)
    as_symbols = lambda t: langid._SYMBOL[np.frombuffer(t.encode(), np.uint8)].tobytes()
    training = {k: as_symbols(prose(rng, k, 150)) for k in ("en", "de", "fr")}
    texts = [prose(rng, rng.choice(list(SYLLABLES)), n) for n in (1, 2, 5, 60, 300, 5)] + ["€ x \U0001f600 é", "A" * 600]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), training).collect()}
    for i, text in enumerate(texts):
        symbols = as_symbols(text)
        lanes = [symbols[a : a + langid.LANE] for a in range(0, len(symbols), langid.LANE)]
        bits = {k: sum(greedy_phrases(lane, t) for lane in lanes) * math.log2(len(t) + 1) / len(symbols) for k, t in training.items()}
        best = min(sorted(bits), key=bits.get)
        lead = min(v for k, v in bits.items() if k != best) - bits[best]
        assert got[i].lang_pred == best
        assert abs(got[i].score - lead / (lead + langid.HALF)) < 1e-9
        assert abs(got[i].bits - (bits[best] - math.log2(len(training[best]) + 1) / len(symbols))) < 1e-9
