import re
from itertools import permutations

from tamarack.llm import filter_audit

DOCS = "label string, doc_id long, text string, source string, failures int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        judged.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {j[0] for j in judged}:
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                failing = [j for j in judged if j[0] == part and j[1][f]]
                shapley[f] += len(gone)
                unique = sum(sum(j[1].values()) == 1 for j in failing)
                rows.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), unique, sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def run(spark, docs, labels):
    left = spark.createDataFrame([("x", i, t, s, 1) for i, t, s in docs], DOCS).repartition(3)
    return sorted(tuple(r) for r in filter_audit.audit(left, spark.createDataFrame([(*r, "y") for r in labels], LABELS)).collect())


def rows():
    many = " ".join(f"w{i}" for i in range(250))
    texts = [many, many.upper(), many + " $", "a b c", "A b #", "x " * 300, "", None, " \t\n", "é%" * 50, many + "  x", "a\x0bb", "Ünïcode WORDS " + many]
    docs = [(k * 3, texts[k % len(texts)], [None, "", "web", "code"][k % 4]) for k in range(90)]
    docs += [(None, many, "web"), (None, many, "code"), (None, "only here", None), (0, many, "web"), (0, many, "web"), (7, many, "code"), (6, "a b c", "web")]
    labels = [(k, [0, 1, None][k % 3], [1, 0][k % 2]) for k in range(0, 200, 3)] + [(0, 0, 0), (0, 1, 1), (None, 1, 1), (6, 1, 0), (6, 1, 0)]
    return docs, labels


def test_as_by_hand(spark):
    assert run(spark, *rows()) == brute(*rows())


def test_many_parts_and_batches(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BATCH", 7)
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 2)
    docs, labels = rows()
    docs = [(i, t, f"s{k % 9}") for k, (i, t, _) in enumerate(docs)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_copies_long_texts_and_nothing(spark):
    copies = [(i, "same old text", "hot") for i in range(2000)] + [(5000, "w " * 400_000, "hot"), (5001, "W" * 300_000, "hot")]
    assert run(spark, copies, []) == brute(copies, [])
    assert run(spark, [], [(1, 1, 1)]) == []


def test_table():
    assert filter_audit.FIRST.shape == (32, 120)
    assert filter_audit.FIRST[0].tolist() == [0] * 120 and (filter_audit.FIRST[1:] > 0).all()
