import math
import random
import re

import pytest

from tamarack.llm import decontamination


def shingles(text, n):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    for item, text in items:
        n = min(5, len(re.findall(r"[^\W_]+", (text or "").lower())))
        if not n:
            continue
        wanted = shingles(text, n)
        for doc, body in docs:
            shared = len(wanted & shingles(body, n))
            if shared >= math.ceil(threshold * len(wanted) - 1e-9):
                out.add((doc, item, len(wanted), shared))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        from tamarack.llm import _shared

        monkeypatch.setattr(_shared.join_checked, "__defaults__", ("left", 0, None))
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)  # so that the sieve is used
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 12, 30, 60])))) for i in range(25)]
    items += [(50, ""), (51, None), (52, "..."), (3, items[3][1])]
    docs = []
    for i in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "edited"
            body[10:10] = [w.upper() + "," for w in own]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (7, docs[7][1])]
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, hash int, item_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contained(frame, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) > 20


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (1, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f"), (1, "q r")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.containment) for r in decontamination.contained(frame, bench).collect()] == [(None, None, 1.0)]
    assert decontamination.contained(frame.limit(0), bench).count() == 0
    assert decontamination.contained(frame, bench.limit(0)).count() == 0
