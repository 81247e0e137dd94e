"""The query document: one free text, parsed on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from tamarack.functions import lexicon as lx

_EDGE_BEFORE, _EDGE_AFTER = r"(?<!\w)", r"(?!\w)"


def clean(text: str | None) -> str:
    """The driver's counterpart of functions.text.clean, for a single text."""
    value = unicodedata.normalize("NFKC", str(text or ""))
    for pattern, put in (*lx.PHRASES, *lx.NUMBERS.items()):
        value = re.sub(rf"\b(?:{pattern})\b", put, value, flags=re.I)
    value = value.lower().translate({ord("—"): "-", ord("–"): "-", ord("_"): " ", ord("|"): " "})
    return " ".join(re.sub(r"[^\w\s+#./-]+", " ", value).split())


def mentions(text: str, term: str) -> bool:
    """Whether a cleaned text has a term with no word character at either side."""
    sought = clean(term)
    return bool(sought) and re.search(_EDGE_BEFORE + re.escape(sought) + _EDGE_AFTER, text) is not None


def _any(text: str, terms) -> bool:
    return any(f" {clean(t)} " in f" {text} " for t in terms)


@dataclass(frozen=True)
class Query:
    """What scoring uses of a query document, and what reports tell of it."""

    text: str
    normalized: str
    required: list[str]
    preferred: list[str]
    seniority: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    experience: list[tuple[int, int | None]] = field(default_factory=list)

    @property
    def skills(self) -> list[str]:
        return [s for s in lx.SKILLS if s in {*self.required, *self.preferred}]

    def of_group(self, group) -> list[str]:
        return [s for s in self.skills if s in group]

    @property
    def tokens(self) -> list[str]:
        """Words that relevance is measured on: longer than two characters, no stopwords."""
        return sorted({w for w in self.normalized.split() if len(w) > 2} - set(lx.STOPWORDS))


def _experience(text: str) -> list[tuple[int, int | None]]:
    found = [tuple(int(g) for g in m.groups()) for p in lx.STATED_EXPERIENCE for m in re.finditer(p, text, re.I)]
    return list(dict.fromkeys((f[0], f[1] if len(f) > 1 else None) for f in found))


def parse(text: str | None) -> Query:
    """A skill is preferred if every segment that mentions it says so, else required."""
    text = text or ""
    whole = clean(text)
    segments = [s for s in map(clean, re.split(r"[\r\n.!?;]+", text)) if s]
    required, preferred = [], []
    for skill, aliases in lx.SKILLS.items():
        if not any(mentions(whole, a) for a in aliases):
            continue
        own = [s for s in segments if any(mentions(s, a) for a in aliases)]
        wished = own and all(any(m in s for m in lx.PREFERRED_MARKERS) for s in own)
        (preferred if wished else required).append(skill)
    listed = {k: [w for w in words if mentions(whole, w)] for k, words in (("seniority", lx.SENIORITY_KEYWORDS), ("domains", lx.DOMAIN_KEYWORDS), ("locations", lx.LOCATIONS))}
    return Query(text, whole, required, preferred, experience=_experience(text), **listed)


def parse_file(path: str) -> Query:
    with open(path, encoding="utf-8-sig") as f:
        return parse(f.read())


@dataclass(frozen=True)
class Constraints:
    required: list[str]
    preferred: list[str]
    archetype: str
    production_heavy: bool
    retrieval_heavy: bool
    evaluation_heavy: bool
    negatives: list[str]
    top_terms: list[str]
    disqualifiers: list[str]


def constraints(query: Query) -> Constraints:
    text = query.normalized
    required = [s for s in query.required if s in lx.CORE_HARD_SKILLS] or query.required[:6]
    preferred = list(dict.fromkeys(query.preferred + [s for s in query.required if s not in required]))
    hits = {name: sum(_any(text, [t]) for t in terms) for name, terms in lx.ARCHETYPES.items()}
    best = max(hits, key=hits.get)
    heavy = {k: _any(text, terms) for k, terms in (("production", lx.PRODUCTION_HEAVY), ("retrieval", lx.RETRIEVAL_HEAVY), ("evaluation", lx.EVALUATION_HEAVY))}
    negatives = ["keyword_only_without_evidence", "missing_must_have_skill"]
    negatives += ["research_only_without_production", "no_production_evidence"] * heavy["production"]
    negatives += ["shallow_project_evidence", "no_retrieval_or_ranking_evidence"] * heavy["retrieval"]
    negatives += ["no_evaluation_evidence"] * heavy["evaluation"]
    top = [s for group in (lx.RETRIEVAL_SKILLS, lx.EVALUATION_SKILLS, lx.PRODUCTION_SKILLS) for s in query.of_group(group)]
    return Constraints(
        required, preferred, best if hits[best] else "unknown", heavy["production"], heavy["retrieval"], heavy["evaluation"],
        negatives, list(dict.fromkeys(top)), [t for t in lx.DISQUALIFIERS if t in text],
    )
