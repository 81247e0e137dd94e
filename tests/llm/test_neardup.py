import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tamarack.llm import simhash


def words_of(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def brute(rows, threshold=0.8):
    """The smallest doc_id of each group of linked texts."""
    sets, root = {d: words_of(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if likeness(sets[a], sets[b]) >= threshold:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {top(x) for x in root}


@pytest.fixture(scope="module")
def rows():
    """Texts and copies of them with one to twenty words changed, on both sides of the threshold."""
    rng, rows = random.Random(3), []
    for base in range(25):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(30, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randint(0, 12)):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(2000)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(texts := [t for _, t in rows])
    return [*enumerate(texts), (900, "one two"), (901, "One  two\n"), (902, "one two three")]


def test_near_copies_that_are_not_exact(spark, rows):
    sets = [words_of(t) for _, t in rows]
    pairs = [likeness(a, b) for a, b in combinations(sets, 2)]
    assert sum(0.8 <= x < 1 for x in pairs) > 20 < sum(0.4 < x < 0.8 for x in pairs)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, frame.repartition(3), "").collect()]
    assert sorted(kept) == sorted(brute(rows)) and len(kept) < len({t for _, t in rows})


def test_parts_of_a_block_lose_no_link(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.representatives(frame, block=2).collect()
    assert sorted(r.doc_id for r in got) == sorted(brute(rows))


def test_rows_that_share_a_doc_id_or_have_none(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one, "x", "t"), (1, two, "x", "t"), (1, two, "x", "t"), (2, one + " z", "y", "t"), (None, two, "x", None), (None, three, "x", "t"), (None, three + " q", "x", "t"), (7, None, "x", "t"), (8, " \n", "x", "t"), (None, "", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, _node string").repartition(3)
    got = [tuple(r) for r in simhash.representatives(frame).collect()]
    assert set(got) - {(None, three, "x", "t"), (None, three + " q", "x", "t")} == {(1, one, "x", "t"), (1, two, "x", "t"), (7, None, "x", "t")}
    assert len(got) == 4
    assert simhash.representatives(frame.limit(0)).count() == 0


def test_near_counts_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, k).astype(np.uint64)) for k in (40, 200, 220, 210, 90, 3, 3, 5000)] + [np.empty(0, np.uint64)]
    a, b = simhash.alike(sets, 0.6)
    held = [set(s.tolist()) for s in sets]
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in combinations(range(len(sets)), 2) if (held[i] | held[j]) and likeness(held[i], held[j]) >= 0.6}
