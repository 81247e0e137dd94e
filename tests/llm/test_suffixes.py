import hashlib
import random

import numpy as np
import pytest
from test_repeats import brute, corpus, of_bytes

from tamarack.llm import suffixes


def test_multikey_sort_sorts_strings():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [b"same" * 5] * 4
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    digits = [lambda rows, k=k: suffixes.eight(data, starts[rows] + k, ends[rows]) for k in range(0, 32, 8)]
    order, heads = suffixes.multikey_sort([*digits, lambda rows: (ends - starts)[rows].astype(np.uint64)], len(texts))
    key = lambda t: (t.ljust(32, b"\0"), len(t))
    got = [key(texts[i]) for i in order]
    assert got == sorted(map(key, texts))
    assert heads.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
    assert suffixes.multikey_sort(digits, 0)[0].tolist() == [] and suffixes.multikey_sort(digits, 1)[1].tolist() == [True]


def test_splitters_and_wide_tokens():
    starts, wide = suffixes.splitters([b"aabbcc" + b"dd" * 5, b"eeff"], 2, 5)
    assert starts.tolist() == [b"bb", b"dd"] or b"dd" in wide.tolist()
    assert b"dd" in wide.tolist()
    assert suffixes.splitters([], 2, 5)[0].tolist() == []


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize(("length", "token"), [(50, 20), (400, 24), (12, 5)])
def test_digests_agree_with_brute_force(spark, monkeypatch, small, length, token):
    """Also with many ranges, tokens that fill several of them, small flushes and texts in pieces."""
    if small:
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", 700)
        monkeypatch.setattr(suffixes, "PART_BYTES", 3000)
        monkeypatch.setattr(suffixes, "MOST_RANGES", 9)
        monkeypatch.setattr(suffixes, "SAMPLED", 200)
    docs = corpus()
    hot = "this phrase is in every text of them, word by word "
    docs = [(d, t if t is None or d % 2 else f"{t} {hot} {d} {hot}") for d, t in docs]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, kind int, `to` string").repartition(5)
    expected = brute(docs, length, of_bytes, bytes)
    rows = suffixes.digests(frame, length, token).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, removed, spans = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(of_bytes(dict(docs)[r.doc_id])), removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id
    assert sum(e[1] for e in expected.values()) > 100


def test_edges(spark):
    line = " ".join(f"t{i}" for i in range(60))
    rows = [(1, line), (1, line), (None, line), (None, None), (5, line), (5, line + " end"), (6, line), (7, "\0" * 200), (8, "\0" * 120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.digests(frame).collect())
    n = len(line)
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (5, n), (5, n), (6, n), (7, 0), (8, 120)]
    assert suffixes.digests(frame.limit(0)).count() == 0
    assert {r.doc_id: bytes(r.kept) for r in suffixes.deduplicated(frame).collect()}[8] == b""
    with pytest.raises(ValueError):
        suffixes.digests(frame, 50, 51)
