"""The pipeline stage by stage against plain Python, on a small folder of tables."""

import random

import pytest
from test_decontamination import brute as contained
from test_langid import SYLLABLES, prose
from test_neardup import likeness, words_of
from test_secrets import base_spans

import corpus_pipeline
from tamarack.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(i, prose(rng, "en", 30)) for i in range(4)]
    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(20, 160))
        if i % 10 == 3:
            text = f"{text} {items[i % 4][1]} {prose(rng, 'en', 20)}"
        if i % 10 == 5:
            text += " password = hunter2hunter and " + "0af3" * 9
        if i % 10 == 7 and rows:
            text, lang = rows[rng.randrange(len(rows))][1:3]
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, 0))
    clean, dirty = prose(rng, "fr", 60), f"{prose(rng, 'de', 30)} {items[1][1]}"
    rows += [(None, clean, "fr", "s1", 0), (None, dirty, "de", "s1", 0), (9, dirty[::-1] + " der ung", "de", "s2", 0), (600, clean + " oui", None, "s1", 0), (604, prose(rng, "de", 90), "fr", "s1", 0)]
    rows += [(606, "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(300)), "en", "s1", 0)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", None, 0), (502, "12 34", None, None, 0), (3, *rows[3][1:]), (None, prose(rng, "de", 50), None, None, 0)]
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s, _ in rows]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def assert_same(got, expected):
    assert [r for r in got if r not in expected] == [] == [r for r in expected if r not in got]
    assert len(got) == len(expected)


def test_stages_agree_with_plain_python(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or "") and r[0] != 606:  # 606 is in no language that is known
            expected.append((*r[:2], {600: "fr", 604: "de"}.get(r[0], r[2] or "de"), *r[3:]))
    stages = dict(corpus_pipeline.STAGES)

    def held(df):
        return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)

    docs = stages["language_id"](spark, docs, folder)
    assert_same(held(docs), expected)

    sets, root = [words_of(r[1]) for r in expected], list(range(len(expected)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                root[top(i)] = top(j)
    best = {}
    for i, r in enumerate(expected):
        best.setdefault(top(i), []).append(r)
    before = len(expected)
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in best.values()]
    docs = stages["near_dedup"](spark, docs, folder).persist()
    assert_same(held(docs), expected)
    assert len(expected) < before

    hit = {pair[0] for pair in contained([(i, r[1]) for i, r in enumerate(expected)], items)}
    assert hit
    expected = [r for i, r in enumerate(expected) if i not in hit]
    assert any(r[0] is None for r in expected)  # a null doc_id alone condemns no row
    docs = stages["decontamination"](spark, docs, folder)
    assert_same(held(docs), expected)

    docs = stages["secret_scan"](spark, docs, folder).persist()
    got = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in expected)
    before = {(r[0], r[2], r[3]): r[1] for r in expected}
    assert any(base_spans(t) for t in before.values())
    for r in got:
        text = before[r.doc_id, r.lang, r.source]
        assert not base_spans(r.text)
        assert secrets.MASK in r.text if base_spans(text) else r.text == text
        assert r.n_chars == len(r.text)

    mixed = stages["mixing"](spark, docs, folder).collect()
    assert len(mixed) == len(expected)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_run_is_the_stages_and_repeats(spark, tables):
    folder, *_ = tables
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) for _ in range(2))
    assert once == again and once


def test_empty_tables(spark, tables, tmp_path):
    folder, *_ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
