import pytest

from tamarack.llm import mixing


def filled(sizes, weights, share, cap):
    """Targets by raising the level in small steps of exact arithmetic."""
    total, open_ = share * sum(sizes), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        level = (total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if cap * sizes[i] < level * weights[i]}
        if not over:
            for i in open_:
                targets[i] = level * weights[i]
            break
        open_ -= over
        for i in over:
            targets[i] = cap * sizes[i]
    return targets


@pytest.fixture(scope="module")
def docs():
    rows = []
    for i in range(600):
        source = None if i % 40 == 39 else "big" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, None if i % 50 == 0 else "w " * (i % 23), source, "x"))
    return rows + [(5, "w w w", "big", "x"), (5, "w w w", "big", "x")]


@pytest.mark.parametrize(("share", "cap"), [(1.5, 2.0), (0.3, 1.0), (5.0, 2.0)])
def test_targets_and_takes(spark, docs, share, cap):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, weight string")
    rows = mixing.mix(frame, share=share, max_epochs=cap, bucket_docs=20).collect()
    assert len(rows) == len(docs)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, len((t or "").split())) for d, t, *_ in docs)
    names = sorted({r.source for r in rows if r.source is not None}) + [None]
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    for s, size, target in zip(names, sizes, filled(sizes, weights, share, cap), strict=True):
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1
        assert all(0 <= r.taken <= cap * r.size for r in own)
    again = mixing.mix(frame.repartition(7), share=share, max_epochs=cap, bucket_docs=20).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_empty_and_repeats(spark):
    frame = spark.createDataFrame([(1, "a b c d", "s"), (2, None, None), (None, "a", "s")], "doc_id long, text string, source string")
    assert mixing.mix(frame.limit(0)).count() == 0
    plan = mixing.mix(frame, share=1.5, max_epochs=2.0)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    told = {}
    for r in mixing.repeated(frame.withColumn("repeats", frame.source), plan).collect():
        told[r.doc_id] = told.get(r.doc_id, 0) + r.words
    assert told == {d: t for d, t in taken.items() if t > 0}
    assert mixing.mix(frame.select("doc_id", "source", frame.text.substr(1, 0).alias("text"))).agg({"taken": "sum"}).first()[0] == 0
