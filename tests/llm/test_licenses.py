import textwrap
from pathlib import Path

import pytest

from tamarack.llm import licenses

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
MIT_TEXT = " ".join(licenses.TEMPLATES["MIT"][i] for i in (1, 2, 4, 5))
PROSE = "there is no word of law in this file, only prose that goes on and on for a while"


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", MIT + "\n" + PROSE),
        (2, "a/x.txt", PROSE),
        (3, "a/b/c/y.txt", PROSE),
        (4, "a/b/COPYING.md", GPL),
        (5, "a/b/z.txt", PROSE + "\n" + MIT + "\n" + PROSE),
        (6, "other/q.txt", "license to be lost. " + PROSE),
        (7, "e/short", GPL),
        (10, "m/whole", "\n".join(textwrap.wrap(MIT_TEXT, 60))),
        (11, "m/n/o.txt", PROSE + " " * 70 + PROSE),
        (8, "e/f/g.txt", None),
        (9, None, ""),
        (2, "a/x.txt", PROSE),
        (None, "a/n.txt", PROSE),
    ]
    frame = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "doc_id long, path string, text string, license string, score double")
    got = [(r.doc_id or 0, r.license, r.origin) for r in licenses.scan(frame).collect()]
    assert set(got) == {
        (1, "MIT", "file"), (2, "MIT", "inherited"), (3, "GPL-3.0", "inherited"), (4, "GPL-3.0", "file"), (5, "MIT", "header"),
        (6, None, "none"), (7, "GPL-3.0", "header"), (8, None, "none"), (10, "MIT", "file"), (11, "MIT", "inherited"), (9, None, "none"), (0, "MIT", "inherited"),
    }
    assert len(got) == len(rows)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_every_template_names_its_license(spark):
    rows = [(i, f"d{i}/x", PROSE + "\n" + t, k) for i, (k, t) in enumerate((k, t) for k, ts in licenses.TEMPLATES.items() for t in ts)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string, truth string")
    told = {r.doc_id: r.license for r in licenses.scan(frame).collect()}
    assert told == {i: k for i, _, _, k in rows}


def test_very_long_texts(spark):
    rows = [(1, "a/b", "license " + "1." * 100_000), (2, "a/c", "license " * 50_000), (3, "a/d", ("; " * 50_000) + MIT)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, None), (2, None), (3, "MIT")}


COMMON = Path("/usr/share/common-licenses")
NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not all((COMMON / n).exists() for n in NAMES), reason="no license texts here")
def test_common_license_texts(spark, tmp_path):
    """Whole texts have their own names by the built-in titles; with whole templates they are files, too, without a telling name, and are inherited."""
    rows = [(i, f"d{i}/{place}", (COMMON / n).read_text(errors="replace")) for i, n in enumerate(NAMES) for place in ("text", "LICENSE")]
    rows += [(100 + i, f"d{i}/sub/code.txt", PROSE) for i in range(len(NAMES))]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    names = dict(enumerate(NAMES.values()))
    got = licenses.scan(frame).collect()
    assert [(r.path, r.license) for r in got if r.license != names[r.doc_id % 100]] == []
    assert all(r.origin == ("inherited" if r.doc_id >= 100 else "file") or (r.path.endswith("text") and r.origin == "header") for r in got)
    for n, name in NAMES.items():
        (tmp_path / f"{name}.txt").write_text((COMMON / n).read_text(errors="replace"))
    whole = licenses.whole_texts(spark, str(tmp_path))
    assert set(whole) == set(NAMES.values())
    got = licenses.scan(frame.where("path NOT LIKE '%LICENSE'"), templates=whole).collect()
    assert [(r.path, r.license, r.origin) for r in got if (r.license, r.origin) != (names[r.doc_id % 100], "inherited" if r.doc_id >= 100 else "file")] == []
