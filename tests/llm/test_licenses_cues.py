"""Statements without the word license are found, and the cues pass over no statement that reaches the threshold."""

import math
import re
from collections import Counter

from tamarack.llm import licenses

PROSE = "there is no word of law in this file, only prose that goes on and on for a while under the sun by and by"
BARE = ["CC BY-SA 4.0", "CC BY 4.0", "Released under MIT", "Distributed under CC BY-SA 4.0", "Apache Version 2.0", "GNU General Public version 3", "Mozilla Public", "a source form", "MIT"]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_every_cosine_of_the_threshold_is_found(spark):
    texts = [f"{PROSE}\n{t}\n{PROSE}" for t in BARE] + [PROSE] * 60
    frame = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    df = Counter(w for t in texts for w in set(words(t)))
    known = {w for ts in licenses.TEMPLATES.values() for t in ts for w in words(t)}

    def vector(text):
        return {w: n * (math.log((len(texts) + 1) / ((df[w] if w in known else 0) + 1)) + 1) for w, n in Counter(words(text)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    expected = {}
    for i, t in enumerate(BARE):
        best = max(cosine(vector(t), vector(x)) for xs in licenses.TEMPLATES.values() for x in xs)
        if best >= licenses.THRESHOLD:
            expected[i] = round(best, 6)
    got = {r.doc_id: r.score for r in licenses.scan(frame).where("license IS NOT NULL").collect()}
    assert got.keys() == expected.keys() and len(got) >= 4
    assert all(abs(got[i] - expected[i]) < 2e-6 for i in got)
