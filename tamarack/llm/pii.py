"""Personal data: fixed patterns, and looser spans that weak supervision accepts.

Base spans come from four patterns (mail addresses, IP addresses, payment cards, phone numbers with a +), and always stay.
Looser candidates are mail addresses that are spelled out, IPv6 addresses, cards with other separators, national phone
numbers, identity and account numbers, and names. Five labelers vote on every candidate and base span, for (1),
against (-1), or not (0):

* form, a regex of what the kind looks like when it is written with care;
* check digits (Luhn, the remainder by 97 of account numbers);
* gazetteers: given names and surnames, top-level domains, countries of account numbers;
* context: cue words among the CONTEXT code points before, or words that tell of other numbers;
* edges: letters, digits or signs that touch the span.

Expectation-maximisation estimates, from counts by kind and votes alone, how often each labeler votes how on personal data and on other
spans, and each kind's share of personal data. Its prior (PRIOR, SHARE) weighs PRIOR_WEIGHT of the candidates, so that labelers
can't swap their meaning where all spans of a table are of one sort. The resulting probabilities train the final classifier of spans:
naive Bayes on the word before, the characters at both edges and the length, each as fractions of counts, starting from the votes' own odds.
Candidates of one half or more are added where no base span overlaps. What comes to the driver are counts by kind, votes and feature:
at most 6 * 243 * 33 rows, whatever the input.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans;
repeated rows each give a row; a null doc_id stays null; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, let
from tamarack.llm._spans import found, searchable

KINDS = ("email", "ip", "card", "phone", "ident", "name")
# The base patterns. Possessive, as none needs to give anything back; a mail address begins where its run of
# characters does, or where the last match ended: no other start in the run can match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "ident": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    "name": r"(?<!\p{L})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20)?\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+){1,2}(?!\p{L})",
}
FORM = {
    "email": r"(?:\.|dot\x20?[\])}]\x20?)[A-Za-z]{2,24}$",
    "ip": r".",
    "card": r"^[3-6]",
    "phone": r"^(?:\(?0|\(?[2-9][0-9]{2}\)?)",
    "ident": r"^(?:(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[A-Z]{2}[0-9]{2}.*)$",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)\b",
}
GIVEN_NAMES = (
    "Alexander", "Alice", "Ana", "Andrea", "Andrew", "Anna", "Anne", "Anthony", "Antonio", "Barbara", "Carlos", "Carmen", "Charles", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emily", "Emma",
    "Eva", "Francisco", "George", "Hans", "Helen", "Isabel", "Jack", "James", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "John", "Jorge", "Joseph", "Juan", "Julia", "Karen", "Klaus",
    "Laura", "Linda", "Lisa", "Louis", "Luis", "Manuel", "Maria", "Marie", "Mark", "Martin", "Mary", "Matthew", "Michael", "Miguel", "Nancy", "Nicolas", "Oliver", "Patricia", "Paul", "Pedro",
    "Peter", "Philippe", "Pierre", "Richard", "Robert", "Sarah", "Sofia", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
SURNAMES = (
    "Anderson", "Bauer", "Becker", "Bernard", "Brown", "Davis", "Dubois", "Durand", "Fernandez", "Fischer", "Garcia", "Gonzalez", "Harris", "Hernandez", "Hoffmann", "Jackson", "Johnson", "Jones", "Klein", "Lefebvre",
    "Lewis", "Lopez", "Martinez", "Meyer", "Miller", "Moore", "Moreau", "Perez", "Petit", "Robinson", "Rodriguez", "Roux", "Sanchez", "Schmidt", "Schneider", "Schulz", "Simon", "Smith", "Taylor", "Thompson",
    "Wagner", "Walker", "Weber", "White", "Williams", "Wilson", "Wright",
)
DOMAINS = ("biz", "ca", "ch", "com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "net", "nl", "org", "uk")
COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": "e-?mail|mail|contact|write|correo|courriel",
    "ip": "ip|host|client|login",
    "card": "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte",
    "phone": "phone|telephone|tel|mobile|cell|fax|call|whatsapp|telefon|handy|tel[eé]fono|m[oó]vil",
    "ident": "ssn|social security|iban|passport|account|tax id|konto|cuenta|compte",
    "name": "name|i am|my name is|signed|sincerely|regards|patient|author|born|nombre|nom",
}
AGAINST = r"(?i)(?:^|[^\p{L}])(?:version|isbn|issn|doi|order|invoice|sku|part|model|serial|page|chapter|section|figure|table|price|score|article|lot|batch|case)(?:[^\p{L}]+(?:no|nr|number))?[^\p{L}\n]*$"
CONTEXT = 48
LABELERS = ("form", "check", "gazetteer", "context", "edges")
#: How labelers vote before any is counted: shares of -1, 0 and 1 on other spans, and on personal data.
PRIOR = ((0.40, 0.55, 0.05), (0.05, 0.45, 0.50))
#: The share of personal data among candidates before any is counted, and what the priors weigh against the counts, LEAST_PRIOR candidates at least.
SHARE, PRIOR_WEIGHT, LEAST_PRIOR = 0.2, 0.5, 20
ROUNDS = 50
#: Values of the classifier's features: hashed word before, character before and after, length.
VALUES = (16, 4, 4, 8)
#: Spans that count as seen for each feature value's usual share, so that rare ones tell little.
FEATURE_PRIOR = 20

_CANDIDATE = "struct<start:int,end:int,kind:int,strict:boolean,votes:int,f0:int,f1:int,f2:int,f3:int>"
_SPAN = "array<struct<start:int,end:int>>"


def _digits(token) -> F.Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits) -> F.Column:
    """Whether at most 19 digits pass Luhn's check."""
    backwards = F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != "")

    def worth(c, i):
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(backwards, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _account(token) -> F.Column:
    """Whether an account number's check digits are right: its remainder by 97 is 1."""
    bare = F.replace(token, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "", -1), lambda c: c != "")

    def step(rest, c):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return ((rest * F.when(n > 9, 100).otherwise(10) + n) % 97).cast("int")

    return F.aggregate(turned, F.lit(0), step) == 1


def _passes(kind: str):
    """What a match of a base pattern has to be."""
    if kind == "ip":
        return lambda t: t.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return lambda t: let(_digits(t), lambda d: F.when((F.length(d) >= 13) & (F.length(d) <= 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return lambda t: F.length(_digits(t)).between(9, 15)
    return lambda t: F.lit(True)


def _candidate_kept(kind: str):
    """Names are candidates with a title or a known given name only; all other loose matches are."""
    if kind != "name":
        return lambda t: F.lit(True)
    return lambda t: t.rlike(FORM["name"]) | F.element_at(F.split(t, " "), 1).isin(*GIVEN_NAMES)


def _vote(yes, no=None) -> F.Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def votes(kind: str, strict: bool, token, before, after) -> list[F.Column]:
    """The labelers' votes, in the order of LABELERS; before and after: a few code points around."""
    form = F.lit(1) if strict else _vote(token.rlike(FORM[kind]), F.lit(kind in ("card", "phone", "ident")))
    check, known = F.lit(0), F.lit(0)
    if kind == "card":
        check = let(_digits(token), lambda d: _vote(_luhn(d), ~_luhn(d)))
    if kind == "ident":
        lettered = token.rlike("^[A-Z]")
        check = F.when(lettered, _vote(_account(token), ~_account(token))).otherwise(0)
        known = _vote(lettered & F.substr(token, F.lit(1), F.lit(2)).isin(*COUNTRIES), lettered)
    if kind == "email":
        known = _vote(F.lower(F.regexp_extract(token, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS))
    if kind == "name":
        known = _vote(F.element_at(F.split(token, " "), -1).isin(*SURNAMES))
    cue = rf"(?i)(?:^|[^\p{{L}}])(?:{CUES[kind]})(?:[^\p{{L}}\n]+\p{{L}}+){{0,2}}[^\p{{L}}\n]*$"
    context = _vote(before.rlike(cue), before.rlike(AGAINST))
    edges = _vote(F.lit(False), before.rlike(r"[\p{L}0-9_#$€£=/]$") | after.rlike(r"^[\p{L}0-9_=/]"))
    return [form, check, known, context, edges]


def _char_class(text, pattern: str) -> F.Column:
    found_ = F.regexp_extract(text, pattern, 0)
    return F.when(found_ == "", 0).when(found_.rlike(r"\s"), 1).when(found_.rlike(r"[\p{L}0-9]"), 3).otherwise(2)


def _candidates(text, kind: str, strict: bool) -> F.Column:
    number = KINDS.index(kind)

    def make(start, end, token, before, after):
        def of(near):
            code = sum((v + 1) * 3**k for k, v in enumerate(votes(kind, strict, token, near["before"], near["after"])))
            word = F.lower(F.regexp_extract(near["before"], r"(\p{L}+)[^\p{L}]*$", 1))
            features = (
                F.pmod(F.xxhash64(word), F.lit(VALUES[0])), _char_class(near["before"], r"(?s).$"),
                _char_class(near["after"], r"(?s)^."), F.least(F.lit(VALUES[3] - 1), F.floor((end - start) / 4)),
            )
            facts = [f.cast("int").alias(f"f{k}") for k, f in enumerate(features)]
            return F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("kind"), F.lit(strict).alias("strict"), code.cast("int").alias("votes"), *facts)

        return let(F.struct(F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after")), of)

    keep, pattern = (_passes(kind), BASE[kind]) if strict else (_candidate_kept(kind), LOOSE[kind])
    return found(text, pattern, keep, make, _CANDIDATE)


def _searched(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and all candidates, base ones included."""
    frame = docs.select("doc_id", searchable(F.col("text")).alias("_text"))
    base = [_candidates(F.col("_text"), k, True).alias(f"_{k}") for k in BASE]
    loose = [_candidates(F.col("_text"), k, False).alias(f"_loose_{k}") for k in LOOSE]
    frame = frame.select("doc_id", *base, *loose)
    every = F.concat(*[f"_{k}" for k in BASE], *[f"_loose_{k}" for k in LOOSE])
    slim = [F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"_{k}") for k in BASE]
    return frame.select("doc_id", *slim, every.alias("_all"))


def _votes_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**k % 3 for k in range(len(LABELERS)))


def reliabilities(counts: dict[tuple[int, int], int]) -> tuple[dict[int, float], list]:
    """(share of personal data by kind, rates[labeler][0: other spans, 1: personal data][vote + 1]), by expectation-maximisation.

    counts: candidates by (kind, code of the votes).
    """
    total = sum(counts.values())
    by_kind = {k: sum(n for (x, _), n in counts.items() if x == k) for k, _ in counts}
    weight = max(LEAST_PRIOR, PRIOR_WEIGHT * total)
    share = dict.fromkeys(by_kind, SHARE)
    rates = [[list(row) for row in PRIOR] for _ in LABELERS]
    for _ in range(ROUNDS):
        sums = [[[weight * p for p in row] for row in PRIOR] for _ in LABELERS]
        own = dict.fromkeys(by_kind, 0.0)
        for (kind, code), n in sorted(counts.items()):
            p = 1 / (1 + math.exp(-odds(kind, code, share, rates)))
            own[kind] += n * p
            for k, v in enumerate(_votes_of(code)):
                sums[k][0][v] += n * (1 - p)
                sums[k][1][v] += n * p
        rates = [[[x / sum(row) for x in row] for row in rows] for rows in sums]
        for kind, n in by_kind.items():
            w = max(LEAST_PRIOR, PRIOR_WEIGHT * n)
            share[kind] = (own[kind] + w * SHARE) / (n + w)
    return share, rates


def odds(kind: int, code: int, share: dict[int, float], rates: list) -> float:
    """Log odds that a span is personal data, by its kind and votes."""
    start = math.log(share[kind] / (1 - share[kind]))
    return start + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(_votes_of(code)))


def classifier(counts: dict[tuple[int, int, int, int], int]) -> tuple[dict[tuple[int, int], float], list[list[float]]]:
    """(log odds by kind and votes, log ratios by feature and value), which add up to a span's log odds.

    counts: candidates by (kind, code of the votes, feature, value); feature -1 counts each candidate once.
    """
    by_votes = {(k, c): n for (k, c, f, _), n in counts.items() if f < 0}
    share, rates = reliabilities(by_votes)
    start = {key: odds(*key, share, rates) for key in by_votes}
    ratios = []
    for f, size in enumerate(VALUES):
        held = [[0.0, 0.0] for _ in range(size)]
        for (k, c, g, v), n in sorted(counts.items()):
            if g == f:
                p = 1 / (1 + math.exp(-start[k, c]))
                held[v][0] += n * (1 - p)
                held[v][1] += n * p
        every = [sum(col) for col in zip(*held, strict=True)]
        usual = [(a + b + 1) / (sum(every) + size) for a, b in held]
        ratios.append([math.log((b + FEATURE_PRIOR * u) / (every[1] + FEATURE_PRIOR)) - math.log((a + FEATURE_PRIOR * u) / (every[0] + FEATURE_PRIOR)) for (a, b), u in zip(held, usual, strict=True)])
    return start, ratios


def _counted(searched: DataFrame) -> dict[tuple[int, int, int, int], int]:
    seen = searched.select(F.explode("_all").alias("c"))
    each = [F.struct(F.lit(-1).alias("f"), F.lit(0).alias("v"))] + [F.struct(F.lit(k).alias("f"), F.col(f"c.f{k}").alias("v")) for k in range(len(VALUES))]
    rows = seen.select("c.kind", "c.votes", F.explode(F.array(*each)).alias("x")).groupBy("kind", "votes", "x.f", "x.v").count().collect()
    return {tuple(r)[:4]: r["count"] for r in rows}


def _accepted(start: dict[tuple[int, int], float], ratios: list[list[float]], kind: int) -> F.Column:
    """The loose candidates of a kind that the classifier takes for personal data, where no base span overlaps."""
    by_code = [start.get((kind, c), -math.inf) for c in range(3 ** len(LABELERS))]
    tables = [F.array(*[F.lit(x) for x in row]) for row in (by_code, *ratios)]
    base = F.concat(*[f"_{k}" for k in BASE])

    def taken(c):
        score = F.get(tables[0], c["votes"])
        for k in range(len(VALUES)):
            score = score + F.get(tables[k + 1], c[f"f{k}"])
        return (c["kind"] == kind) & ~c["strict"] & (score >= 0) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))

    return F.transform(F.filter("_all", taken), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base_email, base_ip, base_card, base_phone (base spans), and email, ip ... name (all spans of the kind, by start)."""
    searched = cut(_searched(docs), "pii")
    start, ratios = classifier(_counted(searched))
    columns = [F.col(f"_{k}").alias(f"base_{k}") for k in BASE]
    for number, kind in enumerate(KINDS):
        extra = _accepted(start, ratios, number) if any(k == number for k, _ in start) else F.array().cast(_SPAN)
        columns.append((F.array_sort(F.concat(f"_{kind}", extra)) if kind in BASE else extra).alias(kind))
    return searched.select("doc_id", *columns)


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def joined_spans(columns: dict[str, str]) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined; columns: a kind's name and the column of its spans."""
    told = [F.transform(column, _named(kind)) for kind, column in columns.items()]
    return F.array_join(F.concat(*told), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of every document."""
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    base, every = joined_spans({k: f"base_{k}" for k in BASE}), joined_spans({k: k for k in KINDS})
    return scan(docs).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
