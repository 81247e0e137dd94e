import hashlib
import random

import numpy as np
import pytest

from tamarack.llm import fingerprints
from tamarack.llm._repeats import Hashed, byte_symbols


def test_syncmers_are_context_free():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 500, dtype=np.uint8)
    found = []
    for n in (0, 37, 410):
        text = np.concatenate((rng.integers(97, 123, n, dtype=np.uint8), shared, rng.integers(97, 123, n, dtype=np.uint8)))
        _, place, hashes = fingerprints.syncmers(text, np.array([0, len(text)]))
        inside = (place >= n) & (place + fingerprints.K <= n + 500)
        found.append(list(zip((place[inside] - n).tolist(), hashes[inside].tolist(), strict=True)))
    assert found[0] == found[1] == found[2]
    assert 40 < len(found[0]) < 140


def test_chunks_and_long_texts_agree(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)).encode() for n in (0, 1, 5, 19, 20, 21, 300, 5000)]
    whole = fingerprints.sketches(texts)
    monkeypatch.setattr(fingerprints, "CHUNK", 64)
    assert (fingerprints.sketches(texts) == whole).all()
    assert not whole[0].any() and all(w.any() for w in whole[1:])


@pytest.mark.parametrize("range_bytes", [2000, 1 << 24])
def test_neighbours(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    rng = random.Random(9)
    ids = rng.sample(range(10_000), 60)
    rows = [(i, "".join(rng.choice("abcdefghij é😀") for _ in range(rng.choice([0, 1, 2, 30, 400]))) if i % 9 else None) for i in ids]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, range int, ahead string")
    got = {r.doc_id: r for r in fingerprints.neighbours(frame).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        new = text[: n - n // 3] + other[: n // 3]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.printed(fingerprints.sketches([text.encode()])[0])
        assert r.edited_fingerprint == fingerprints.printed(fingerprints.sketches([new.encode()])[0])
        assert 0 <= r.near_edited <= 1 and r.near_next == fingerprints.likeness(*(fingerprints.sketches([t.encode()]) for t in (text, other)))[0]


def test_neighbour_edges(spark):
    one = spark.createDataFrame([(5, "only one text here, long enough to have k-mers")], "doc_id long, text string")
    (r,) = fingerprints.neighbours(one).collect()
    assert r.near_next == 1.0
    rows = [(5, "aaa"), (5, "aaa"), (None, "zzz"), (None, None)]
    got = fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (5, 3), (5, 3)]
    assert fingerprints.neighbours(one.limit(0)).count() == 0


def naive(text, short=False):
    """A fingerprint by loops over k-mers and their s-mers."""

    def hashed(piece):
        h = Hashed(byte_symbols(np.frombuffer(piece, np.uint8)))
        return int(h.of(np.array([0]), np.array([len(piece)]))[0])

    k, s = (fingerprints.SHORT_K, fingerprints.SHORT_S) if short else (fingerprints.K, fingerprints.S)
    text = bytes(k - 1) + text if short else text
    bins = {}
    for at in range(len(text) - k + 1):
        inner = [hashed(text[at + i : at + i + s]) for i in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            h = hashed(text[at : at + k])
            bins.setdefault(h % 128, []).append((h >> 16, at * 256 // len(text)))
    return {b: min(v)[1] for b, v in bins.items()}


@pytest.mark.parametrize("n", [1, 8, 40, 63, 64, 299, 330, 1500])
def test_sketch_agrees_with_loops(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcdef é") for _ in range(n)).encode()[:n]
    row = fingerprints.sketches([text])[0]
    for half, expected in ((row[:256], naive(text)), (row[256:], naive(text, True) if len(text.decode("utf-8", "replace")) < fingerprints.SHORT else {})):
        if expected or half is row[256:]:
            assert set(np.nonzero(half[:128])[0].tolist()) == set(expected)
            assert {b: int(half[128 + b]) for b in expected} == expected


def test_position_counts():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(800)).encode() for _ in range(2))
    one, swapped, two_thirds, other = fingerprints.sketches([a + b, b + a, (a + b)[:1067] + bytes(rng.choices(range(97, 123), k=533)), b"nothing of the kind " * 80])
    like = lambda x, y: float(fingerprints.likeness(x[None], y[None])[0])
    assert like(one, one) == 1.0 and like(one, other) < 0.05
    assert 0.35 < like(one, swapped) < 0.65 and 0.35 < like(one, two_thirds) < 0.65
    assert [fingerprints._chain(x) for x in ([], [1, 1, 2], [3, 1, 2, 0, 2])] == [0, 3, 3]


def test_short_texts_keep_some_likeness():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in range(18, 300)]
    new = [fingerprints.edited(t, o) for t, o in zip(texts, texts[1:] + texts[:1], strict=True)]
    near = fingerprints.likeness(*(fingerprints.sketches([t.encode() for t in x]) for x in (texts, new)))
    assert near.min() > 0 and near.mean() > 0.4


def test_two_thirds_unchanged_are_near_one_half():
    """For every length, and next texts of every length, also across the border of the short anchors."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    lengths = [*range(3, 200), *range(290, 310), *range(430, 460, 3), 700, 2000]
    nexts = [0, 1, 2, 5, 13, 40, 63, 64, 65, 100, 150, 200, 299, 300, 900]
    texts = [(make(n), make(m)) for n in lengths for m in nexts]
    new = [fingerprints.edited(t, o) for t, o in texts]
    mine, theirs, others = (fingerprints.sketches([t.encode() for t in x]) for x in ([t for t, _ in texts], new, [o for _, o in texts]))
    near, apart = fingerprints.likeness(mine, theirs), fingerprints.likeness(mine, others)
    assert near.min() > 0.2 and 0.45 < near.mean() < 0.65, (near.min(), near.mean())
    assert apart.max() < 0.2 and apart.mean() < 0.01
    kept = np.array([(len(t) - len(t) // 3) for t, _ in texts])
    changed = np.array([min(len(t) // 3, len(o)) for t, o in texts])
    assert np.abs(near - kept / (kept + np.array([len(t) // 3 for t, _ in texts]) + changed)).mean() < 0.06
