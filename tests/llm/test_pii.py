import hashlib
import random
import re

import pytest

from tamarack.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "a@b.c_d@e.f x@y.z..q@w a@b@c.d é😀 %+@-.- @x.y a.b@c-d.e.f.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0001.002.3.4 1.2.3 11.22.33.44x 5..6.7.8.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 12 3  4 0000000000000 4111111111111111111 1-2-3-4-5-6-7-8-9-0-1-2-8",
    "+1 (052) 555-0934 +49.30.1234567) +1 +12345678 +1234567890123456 +1-(2) 3456789( ++33 1 23 45 67 89",
    "", None, "nothing here", "\x01+1 (052) 555-0934\x02a\x01@b.c", "mail a@b.com, call +1 (052) 555-0934 from 10.0.0.1 with 4111111111111111" * 3,
]


def test_base_spans_and_edges(spark):
    rng = random.Random(4)
    random_texts = ["".join(rng.choice("01234 ..+-()@a_é") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    texts = TEXTS + random_texts
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, email string")
    got = pii.digests(frame).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, base_spans(t))
    for r in got:
        base = want[r.doc_id]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in base) for k in PATTERNS], r
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
    assert pii.digests(frame.limit(0)).count() == 0


def account(rng):
    bare = "".join(rng.choice("0123456789") for _ in range(18))
    rest = int("".join(str(int(c, 36)) for c in bare + "DE00")) % 97
    return f"DE{98 - rest:02d}{bare}"


def planted(rng):
    """(text, the spans that it plants): personal data that no base pattern finds, and other numbers and words that look alike."""
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    given, family = rng.choice(pii.GIVEN_NAMES), rng.choice(pii.SURNAMES)
    card = next(c for c in iter(lambda: "4" + digits(15), None) if luhn(c))
    real = [
        ("phone", "call", f"({rng.randint(200, 999)}) 555-{digits(4)}"), ("phone", "tel.", f"0{rng.randint(20, 99)} {digits(4)} {digits(4)}"), ("email", "contact", f"{given.lower()} [at] mail{digits(1)} [dot] com"),
        ("name", "my name is", f"{given} {family}"), ("name", "signed", f"Dr. {given} {family}"), ("ident", "iban", account(rng)), ("ident", "ssn", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        ("card", "card", ".".join(card[i : i + 4] for i in range(0, 16, 4))),
    ]
    other = [
        ("phone", "order no", f"{digits(3)} {digits(3)} {digits(4)}"), ("phone", "version", f"{digits(2)}.{digits(3)}.{digits(3)}"), ("ident", "part", f"000-{rng.randint(10, 99)}-{digits(4)}"),
        ("ident", "serial", f"QX{digits(18)}"), ("card", "isbn", ".".join(digits(4) for _ in range(4))),
    ]
    text, spans = "", []
    for truth, (kind, cue, value) in rng.sample([(True, x) for x in real] + [(False, x) for x in other], 9):
        text += "".join(rng.choice(["lorem ", "ipsum ", "dolor, ", "sit. "]) for _ in range(rng.randint(3, 9))) + cue + " "
        if truth:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + rng.choice([" ", ", ", ".\n"])
    return text, spans


@pytest.mark.parametrize("n", [40, 400])
def test_finds_planted_and_leaves_the_rest(spark, n):
    rng = random.Random(n)
    rows = [planted(rng) for _ in range(n)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    hits = found = meant = 0
    for r in pii.scan(frame).collect():
        spans = {(k, s.start, s.end) for k in pii.KINDS for s in r[k]}
        hits += len(spans & set(rows[r.doc_id][1]))
        found, meant = found + len(spans), meant + len(rows[r.doc_id][1])
    assert hits >= 0.9 * meant and hits >= 0.9 * found, (hits, found, meant)


def test_reliabilities_are_learned():
    """A labeler that agrees with the others gets a sharper rate than one that votes at random."""
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = [(2 if truth else 0) if rng.random() < p else rng.choice([0, 1, 2]) for p in (0.9, 0.8, 0.8, 0.0, 0.7)]
        code = sum(v * 3**k for k, v in enumerate(votes))
        counts[0, code] = counts.get((0, code), 0) + 1
    share, rates = pii.reliabilities(counts)
    told = [r[1][2] / r[0][2] for r in rates]
    assert told[0] > 4 * told[3] and told[3] < 4 and abs(share[0] - 0.3) < 0.08


def test_long_texts(spark):
    spaced = "call +1 (052) 555-0934 or a@b.com " * 12_000
    runs = ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "1 " * 150_000, "a@b" + ".c" * 100_000, "+1" + " " * 200_000, "Ab " * 100_000, "a:" * 100_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([spaced, *runs])], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digests(frame.repartition(4)).collect()}
    assert (rows[0].n_phone, rows[0].n_email) == (12_000, 12_000) and rows[0].spans.startswith("email:26:33,")
    assert rows[5].n_email == 1 and len(rows) == 9
