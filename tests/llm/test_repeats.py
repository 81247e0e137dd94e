import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tamarack.llm import _repeats, substrings, suffixes

SCHEMA = "doc_id long, text string, text_len int, `to` string"


def brute(docs, length, split, join):
    """(kept, removed, spans) by doc_id; docs: (doc_id, text), each id once."""
    first, out = {}, {}
    for doc, text in sorted(docs):
        seq = split(text)
        mask = np.zeros(len(seq) + 1, int)
        for i in range(len(seq) - length + 1):
            key = tuple(seq[i : i + length])
            if first.setdefault(key, doc) < doc:
                mask[i] += 1
                mask[i + length] -= 1
        gone = np.cumsum(mask)[: len(seq)] > 0
        kept = [x for x, g in zip(seq, gone, strict=True) if not g]
        out[doc] = (join(kept), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
    return out


def words(text):
    return (text or "").encode().split()


def of_bytes(text):
    return list((text or "").encode())


def corpus(seed=5, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "naïve", "x" * 70]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for i in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(body)), rng.randint(0, 30)
            body[at:at] = passage[cut : cut + rng.randint(45, 90)]
        if i % 7 == 0 and docs:
            body = docs[rng.randrange(len(docs))][1].split() if docs[-1][1] else body
            if body and i % 2:
                body[len(body) // 2] = "edit"
        docs.append((i * 2 + 1, rng.choice([" ", "\n", " \t"]).join(body)))
    docs += [(900, "la " * 300), (901, "la " * 120), (902, ""), (903, None), (904, " \n"), (905, "short")]
    return docs


def run_in_process(docs, symbols_of, length, k, n_buckets=3, n_parts=4):
    """The five steps without Spark, so that module constants can be small."""

    def grouped(tables, handle):
        by = defaultdict(list)
        for t in tables:
            for to, kind, blob in zip(*[t.column(i).to_pylist() for i in range(3)], strict=True):
                by[to].append((kind, blob))
        for to, rows in by.items():
            t = pa.table({"to": pa.array([to] * len(rows), pa.int64()), "kind": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})
            yield to, t, handle

    ids, uids = [d for d, _ in docs], [7] * len(docs)
    raw = [None if t is None else t.encode() for _, t in docs]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 9], pa.int64()), pa.array(uids[i : i + 9], pa.int32()), pa.array(raw[i : i + 9], pa.binary())], ["doc_id", "uid", "text"]) for i in range(0, len(ids), 9)]
    runs = list(_repeats._extract(symbols_of, length, k, n_buckets, n_parts)(iter(batches)))
    match = _repeats._match(n_parts)
    matches = [match((pa.scalar(to),), t) for to, t, _ in grouped(runs, match)]
    rows = [r for t in matches for r in zip(*[t.column(i).to_pylist() for i in range(3)], strict=True)]
    texts = defaultdict(list)
    for doc, uid, text in zip(ids, uids, raw, strict=True):
        texts[int(_repeats._part(np.array([doc]), np.array([uid], np.int32), n_parts)[0])].append((doc, uid, text))
    extend, settle = _repeats._extend(symbols_of, length, k, n_buckets, n_parts), _repeats._settle(n_parts)
    windows = []
    for part, held in texts.items():
        a = pa.table({"doc_id": pa.array([h[0] for h in held], pa.int64()), "uid": pa.array([h[1] for h in held], pa.int32()), "text": pa.array([h[2] for h in held], pa.binary())})
        b = [blob for to, kind, blob in rows if to == part and kind == _repeats.OPEN]
        windows.append(extend(None, a, pa.table({"blob": pa.array(b, pa.binary())})))
    settled = [settle((pa.scalar(to),), t) for to, t, _ in grouped(windows, settle)]
    rows += [r for t in settled for r in zip(*[t.column(i).to_pylist() for i in range(3)], strict=True)]
    found = defaultdict(list)
    for _, kind, blob in rows:
        if kind == _repeats.MATCHED:
            for key, places in _repeats._by_document([pa.scalar(blob, pa.binary())]).items():
                found[key[0]] += places
    return {doc: _repeats.spans(at, length, 10**9) for doc, at in found.items()}


@pytest.mark.parametrize(("symbols_of", "split", "length", "k"), [(_repeats.word_symbols, words, 50, 24), (_repeats.byte_symbols, of_bytes, 50, 20), (_repeats.word_symbols, words, 10, 3)])
@pytest.mark.parametrize("small", [False, True])
def test_steps_agree_with_brute_force(monkeypatch, symbols_of, split, length, k, small):
    if small:  # many flushes, pieces of long texts, anchors with too many classes
        monkeypatch.setattr(_repeats, "PIECE", 120)
        monkeypatch.setattr(_repeats, "FLUSH", 90)
        monkeypatch.setattr(_repeats, "MANY", 1)
    docs = corpus()
    expected = brute(docs, length, split, tuple)
    found = run_in_process(docs, symbols_of, length, k)
    for doc, _ in docs:
        starts, ends = found.get(doc, (np.empty(0, int), np.empty(0, int)))
        assert (int((ends - starts).sum()), len(starts)) == expected[doc][1:], doc
    assert sum(e[1] for e in expected.values()) > 100


def test_queries_agree_with_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    for module, split, join in ((substrings, words, b" ".join), (suffixes, of_bytes, bytes)):
        expected = brute(docs, 50, split, join)
        rows = module.digests(frame).collect()
        assert len(rows) == len(docs)
        for r in rows:
            kept, removed, spans = expected[r.doc_id]
            assert (r[2], r.n_spans, r.kept_sha256) == (removed, spans, hashlib.sha256(kept).hexdigest())
    texts = {r.doc_id: r.text for r in substrings.deduplicated(frame).collect()}
    assert texts[1] == " ".join(docs[0][1].split())


def test_edges(spark):
    line = " ".join(f"t{i}" for i in range(60))
    rows = [(1, line), (1, line), (None, line), (None, None), (5, line), (5, line + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.digests(frame).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (5, 60), (5, 60)]
    assert substrings.digests(frame.limit(0)).count() == 0
    assert suffixes.digests(spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))).count() == 0


def test_other_lengths(spark):
    """More windows to an anchor than a byte can count."""
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
    rows = [(1, text), (2, "some words before " + text + " and after"), (3, text.replace("w", "v", 1))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for length, anchor in ((400, 24), (400, 1), (499, 499), (500, 100)):
        expected = brute(rows, length, words, b" ".join)
        assert {r.doc_id: r.n_removed for r in substrings.digests(frame, length, anchor).collect()} == {d: e[1] for d, e in expected.items()}
    with pytest.raises(ValueError):
        substrings.digests(frame, 100_000, 2)
