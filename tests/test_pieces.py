"""Records cut out of files that are read in many splits, against plain parsers."""

import csv
import io
import json
import random

import pytest

from tamarack.sources import pieces, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def text(rng, n=12):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "a", " ", ":", "\\\\", "😀"]) for _ in range(rng.randint(0, n)))


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind >= 5:
        return {text(rng, 4) + str(k): value(rng, depth + 1) for k in range(rng.randint(0, 4))}
    return [text(rng, 30), rng.randint(-99, 99), None, True][kind]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("indent", [None, 2])
def test_json_as_a_plain_parser(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    rows = [value(rng, 0) if rng.random() < 0.3 else {"id": str(i), "t": text(rng, 40), "x": value(rng)} for i in range(400)]
    rows[50] = {"id": "50", "t": text(rng, 3000), "long": "y" * 9000}  # longer than several splits
    path = tmp_path / "a.json"
    path.write_text(("﻿" if seed % 2 else " \n") + json.dumps(rows, ensure_ascii=seed < 2, indent=indent) + ["", "\n", " "][seed % 3], encoding="utf-8")
    found, others = pieces.records(spark, str(path), pieces.JsonArray)
    assert others == [] and found.rdd.getNumPartitions() > 5
    got = {r["item"]: r["value"] for r in found.collect() if r["item"] >= 0}
    assert sorted(got) == list(range(400))
    assert [json.loads(got[k]) for k in range(400)] == rows
    assert readers.count_errors(spark, str(path)) == sum(not isinstance(r, dict) for r in rows)
    assert readers.read_records(spark, str(path)).count() == sum(isinstance(r, dict) for r in rows)


def test_broken_items_and_ends(spark, tmp_path, small_splits):
    good = ",".join('{"id": "%d", "t": "%s"}' % (i, "x" * 90) for i in range(40))  # noqa: UP031
    cases = {
        f"[{good}, nope, {{'a': 1}}, 3]": (40, 3), f'[{good}] trailing': (40, 1), f'[{good}, {{"id": "cut"': (40, 1), "[]": (0, 0), " [ ] ": (0, 0), "": (0, 0),
        '{"id": "alone"}': (1, 0), '{"id": "alone", "x": [1, {}]}\n': (1, 0), "7": (0, 1), "{broken": (0, 1), "[1]": (0, 1), '[{"id": "a"},]': (1, 1),
    }
    for k, (content, (records, errors)) in enumerate(cases.items()):
        path = tmp_path / f"{k}.json"
        path.write_text(content)
        assert (readers.read_records(spark, str(path)).count(), readers.count_errors(spark, str(path))) == (records, errors), content[-30:]


def test_a_folder_of_files_and_the_first_records(spark, tmp_path, small_splits):
    folder = tmp_path / "many.json"
    folder.mkdir()
    for k in range(3):
        (folder / f"part {k}.json").write_text(json.dumps([{"id": f"{k}-{i}", "t": "z" * 50} for i in range(50)]))
    (folder / "part 3.json").write_text('{"id": "3-0"}')
    df = readers.read_records(spark, str(folder))
    assert sorted(r.id for r in df.collect()) == sorted([f"{k}-{i}" for k in range(3) for i in range(50)] + ["3-0"])
    assert [r.id for r in readers.read_records(spark, str(folder), limit=60).collect()] == [f"0-{i}" for i in range(50)] + [f"1-{i}" for i in range(10)]


def field(rng):
    return "".join(rng.choice(['"', ",", "\n", "\r\n", "é", "a", " ", "'", "\\"]) for _ in range(rng.randint(0, 9)))


@pytest.mark.parametrize("seed", range(2))
def test_csv_as_a_plain_parser(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    rows = [[f"r{i}", field(rng), field(rng) + "q" * rng.choice([0, 60]), "plain"] for i in range(300)]
    rows[100][1] = "\n".join(['long "one"'] * 900)
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=["\n", "\r\n"][seed % 2]).writerows([["id", "a", "b", "c d"], *rows])
    path = tmp_path / "a.csv"
    path.write_text(out.getvalue().rstrip("\r\n") if seed == 1 else out.getvalue() + "\n", encoding="utf-8", newline="")
    df = readers.read_records(spark, str(path))
    assert df.columns == ["id", "a", "b", "c d"]
    got = {r[0]: list(r) for r in df.collect()}
    lines = list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]
    assert got == {r[0]: r for r in lines}
    assert [r[0] for r in readers.read_records(spark, str(path), limit=120).collect()] == [f"r{i}" for i in range(120)]


def test_csv_with_stray_quotes_short_rows_and_nothing(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text('id,size,note\n1,5" pipe,x\n\n2,"a ""b""",\n3,y\n' + "".join(f'{i},6" or 7",z\n' for i in range(4, 200)))
    got = {r[0]: tuple(r[1:]) for r in readers.read_records(spark, str(path)).collect()}
    assert got["1"] == ('5" pipe', "x") and got["2"] == ('a "b"', "") and got["3"] == ("y", "") and len(got) == 199
    (tmp_path / "b.csv").write_text("id,a\n")
    assert readers.read_records(spark, str(tmp_path / "b.csv")).collect() == []
