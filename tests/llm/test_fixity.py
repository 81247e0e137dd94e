import pytest
from pyspark.sql import functions as F

from tamarack.llm import fixity


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i * 37 % 900)} é</p>", "c") for i in range(230)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, place string")


def test_files_parse_back_and_offsets_fit(pages):
    files = {r.file: bytes(r.data) for r in fixity.files(pages, 100).collect()}
    listed = {(r.file, r.offset): (r.page_id, r.length) for r in fixity.manifest(pages, file_ids=100).collect()}
    found = {(f, at): int(h["WARC-Record-ID"][10:-1]) for f, data in files.items() for at, h, _ in fixity.parse(data)}
    assert found == {k: v[0] for k, v in listed.items()}
    ends = {f: max(at + n for (g, at), (_, n) in listed.items() if g == f) for f in files}
    assert ends == {f: len(d) for f, d in files.items()}


@pytest.mark.parametrize(("leaf", "fan"), [(3, 2), (16, 16)])
def test_audit_finds_damage_alone(spark, pages, leaf, fan):
    """Lost and longer records move all offsets behind them; only they themselves are told."""
    bad = F.when(F.col("page_id").isin(0, 99, 100, 229), F.concat(F.lit("more bytes"), "html")).otherwise(F.col("html"))
    theirs = pages.where("page_id NOT IN (17, 48, 49, 50, 203)").withColumn("html", bad)
    theirs = theirs.unionByName(spark.createDataFrame([(999, "u", "h", "c")], pages.schema))
    ours, theirs = (fixity.manifest(x, file_ids=50) for x in (pages, theirs))
    got = {(r.page_id, r.status) for r in fixity.audit(ours, theirs, file_ids=50, leaf_ids=leaf, fan_out=fan).collect()}
    assert got == {(i, "missing") for i in (17, 48, 49, 50, 203)} | {(0, "corrupt"), (99, "corrupt"), (100, "corrupt"), (229, "corrupt"), (999, "extra")}
    assert fixity.audit(ours, ours, file_ids=50, leaf_ids=leaf, fan_out=fan).count() == 0


def test_one_lost_record_is_one_row(spark, pages):
    found = fixity.audit(fixity.manifest(pages), fixity.manifest(pages.where("page_id <> 100"))).collect()
    listed = {r.page_id: (r.file, r.offset, r.length) for r in fixity.manifest(pages).collect()}
    assert [tuple(r) for r in found] == [(*listed[100], 100, 1, "missing")]


def test_edges(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, None, None), (-5, "u", ""), (7, None, "z")] + [(None, "x", "y")] * 3
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = fixity.manifest(frame)
    assert sorted(r.copies for r in whole.collect()) == [1, 1, 1, 1, 2, 3]
    assert whole.select("file", "offset").distinct().count() == 6
    got = fixity.audit(whole, fixity.manifest(frame.where("page_id IS NOT NULL"))).collect()
    assert sorted((r.page_id, r.copies, r.status) for r in got) == [(None, 1, "missing"), (None, 3, "missing")]
    fewer = fixity.manifest(frame.dropDuplicates())
    assert sorted((str(r.page_id), r.copies, r.status) for r in fixity.audit(whole, fewer).collect()) == [("1", 1, "missing"), ("None", 2, "missing")]
    empty = fixity.manifest(frame.limit(0))
    assert fixity.audit(empty, empty).count() == 0
    assert fixity.audit(whole, empty).agg(F.sum("copies")).first()[0] == len(rows)
    assert fixity.audit(empty, whole).where("status = 'extra'").count() == 6
