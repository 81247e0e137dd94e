import random

import numpy as np
import pytest
import xxhash

from tamarack.llm import simhash
from tamarack.llm._components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(items, radius=2):
    """component by place, for (id, fingerprint)."""
    root = list(range(len(items)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(items))]


@pytest.mark.parametrize("text", ["", None, "one", "Two words", "a b c", "A b\tc\x0bD e É é", "la " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = [base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 8))}) for _ in range(150)] + [rng.getrandbits(64) for _ in range(47)]
    held = np.array(fps, np.uint64)
    q, lane = simhash.within(simhash.planes(held), held, len(held), radius)
    expected = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), lane.tolist(), strict=True)) == expected


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = random.Random(11)
    items, fp = [], rng.getrandbits(64)
    for i in range(60):  # a chain, each near the one before
        fp ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        items.append((i * 3 + 2, fp))
    items += [(1000 + i, rng.getrandbits(64)) for i in range(40)]
    items += [(2000 + i, items[-1][1] ^ (1 << i)) for i in range(20)]
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in items]
    frame = spark.createDataFrame(signed, "rep long, fp long")
    found = {r.node: r.component for r in components(simhash.links(frame, 2, block)).collect()}
    for (doc, _), component in zip(items, groups_of(items), strict=True):
        assert found.get(doc, doc) == component


def test_groups_with_edges(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text), (4, text), (4, text), (None, text), (7, ""), (8, None), (3, " \t"), (12, "other words here now"), (None, "lonely text of none")]
    frame = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, fp string, component int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(frame).collect()), key=str)
    items = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(items, groups_of(items), strict=True)), key=str)
    assert got == expected
    assert simhash.groups(frame.limit(0)).count() == 0
