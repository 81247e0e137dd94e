"""SQL, in DuckDB's dialect, that the profile queries must agree with.

It is put together from the lexicon, and says again, over the same tables, what features, light proof, light
score and the 27 rules are. A field called description counts as a summary too, also that of a career's stations. Rounding goes by decimal text, half up, as Spark's does.
"""

from __future__ import annotations

from tamarack.functions import lexicon as lx
from tamarack.functions import text as tx
from tamarack.operators.evidence import ALIASES
from tamarack.operators.query import Query, clean
from tamarack.plans import profile_data as data
from tamarack.plans.sql_text import sql_rewritten, sql_squeeze, sql_words


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return f"[{', '.join(map(q, values))}]::VARCHAR[]"


def cleaned(x: str) -> str:
    return sql_squeeze(sql_rewritten(f"coalesce({x}, '')"))


def rounded(x: str, n: int = 4) -> str:
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 18), {n})::DOUBLE"


def clamped(x: str, most: float = 1.0) -> str:
    return f"greatest(0.0::DOUBLE, least({most}::DOUBLE, {x}))"


def has(p: str, terms) -> str:
    return "(" + " OR ".join(f"contains({p}, {q(f' {t} ')})" for t in terms if t) + ")"


def named(p: str, groups: dict) -> str:
    """Names of the groups of which any term is in p."""
    return "list_filter([" + ", ".join(f"CASE WHEN {has(p, terms)} THEN {q(n)} END" for n, terms in groups.items()) + "], lambda x: x IS NOT NULL)"


def how_many(p: str, terms) -> str:
    return "(" + " + ".join(f"contains({p}, {q(f' {t} ')})::INT" for t in dict.fromkeys(terms)) + ")"


def counted(p: str, term: str) -> str:
    return f"(length({p}) - length(replace({p}, {q(f' {term} ')}, ''))) // {len(term) + 2}"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(tx.TOKEN_SQL)})"


def firsts(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def d(x) -> str:
    return f"{x}::DOUBLE"


def depth(p: str, group: str, target: int) -> str:
    return clamped(f"{how_many(p, lx.CAREER_TERMS[group])} / {d(float(target))}")


_TECH = ", ".join(f"CASE WHEN {has('p', terms)} THEN {{'n': {q(n)}, 'k': {q(clean(n))}}} END" for n, terms in lx.TECHNICAL_TERMS.items())
_TECH_COUNT = " + ".join(counted("p", a) for terms in lx.TECHNICAL_TERMS.values() for a in terms)
_ALIAS_KEYS = listed(clean(n) for n in ALIASES)
_LEVELS = "list_filter([" + ", ".join(f"CASE WHEN contains(' ' || title_norm || ' ', {q(f' {t} ')}) THEN {q(t)} END" for t in lx.SENIORITY) + "], lambda x: x IS NOT NULL)"

FEATURES = f"""
WITH rec AS MATERIALIZED ({data.RECORDS_SQL}),
t1 AS MATERIALIZED (
  SELECT *, {cleaned('title')} AS title_norm, array_to_string(all_k, ' ') AS t_skills,
    {cleaned('told')} AS summary, CASE WHEN told IS NULL THEN '' ELSE {cleaned('told')} || ' 2015 to 2021' END AS career FROM rec),
t2 AS MATERIALIZED (SELECT *, substr(array_to_string(list_filter([summary, title_norm, t_skills, career], lambda x: x <> ''), ' '), 1, 12000) AS raw FROM t1),
t3 AS MATERIALIZED (SELECT *, {cleaned('raw')} AS raw_norm, {cleaned('career')} AS career_norm, coalesce(title, '') || ' ' || career AS shown FROM t2),
t4 AS MATERIALIZED (
  SELECT *, ' ' || raw_norm || ' ' AS p, len({tokens('raw_norm')}) AS n_tok, {tokens('career_norm')} AS c_tok, ' ' || career_norm || ' ' AS cp, {cleaned('shown')} AS shown_norm,
    ' ' || trim(title_norm || ' ' || career_norm) || ' ' AS strong FROM t3),
t5 AS MATERIALIZED (
  SELECT *, CASE WHEN n_tok > 0 THEN {clamped(f'({_TECH_COUNT}) / n_tok')} ELSE 0.0::DOUBLE END AS dens, ' ' || shown_norm || ' ' AS sp,
    CASE WHEN n_tok > 0 THEN list_filter([{_TECH}], lambda x: x IS NOT NULL) ELSE [] END AS tech FROM t4),
t6 AS MATERIALIZED (
  SELECT *, list_transform(tech, lambda x: x.n) AS tech_n, list_concat(explicit_n, list_transform(list_filter(tech, lambda x: NOT list_contains(explicit_k, x.k)), lambda x: x.n)) AS claims_n,
    list_concat(explicit_k, list_transform(list_filter(tech, lambda x: NOT list_contains(explicit_k, x.k)), lambda x: x.k)) AS claims_k,
    {firsts(f"list_transform(regexp_extract_all(shown, {q(lx.TITLE_PATTERN)}, 0), lambda x: trim(x))")} AS parsed,
    list_sort(list_distinct(list_transform(regexp_extract_all(shown, {q(lx.CALENDAR_PATTERN)}, 0), lambda x: x::INT))) AS calendar,
    len(regexp_extract_all(shown || ' ' || raw, {q(lx.EXPERIENCE_PATTERN)}, 1)) AS n_mentions,
    coalesce(({_LEVELS})[-1], 'unknown') AS level FROM t5),
t7 AS MATERIALIZED (
  SELECT *, len(parsed) + (coalesce(title, '') <> '' AND NOT list_contains(parsed, title))::INT AS n_titles, len(calendar) > 0 AS dated, list_max(calendar) - list_min(calendar) AS span,
    (years IS NOT NULL)::INT + n_mentions AS n_years,
    len(list_filter(claims_k, lambda s: contains(cp, ' ' || s || ' ') OR (len(list_filter({tokens('s')}, lambda t: length(t) > 1)) > 0
      AND len(list_filter({tokens('s')}, lambda t: length(t) > 1 AND NOT list_contains(c_tok, t))) = 0))) AS n_hinted FROM t6),
f AS MATERIALIZED (
  SELECT *, {rounded('dens')} AS density, {rounded("CASE WHEN len(claims_k) > 0 AND career_norm <> '' THEN n_hinted / len(claims_k) ELSE 0.0::DOUBLE END")} AS hint,
    {rounded("(2 + (summary <> '')::INT + (title IS NOT NULL)::INT + (t_skills <> '')::INT + (career <> '')::INT + (years IS NOT NULL)::INT + (loc IS NOT NULL)::INT + sig::INT) / 10.0::DOUBLE")} AS completeness,
    {rounded(clamped(f"0.35::DOUBLE * least(len({sql_words('shown_norm')}) / 160.0::DOUBLE, 1.0::DOUBLE) + 0.20::DOUBLE * least(n_titles / 3.0::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * least(n_years / 2.0::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * {depth('sp', 'projects', 4)} + 0.15::DOUBLE * {depth('sp', 'leadership', 4)}"))} AS career_depth,
    {rounded(depth('sp', 'production', 6))} AS d_production, {rounded(depth('sp', 'evaluation', 4))} AS d_evaluation, {rounded(depth('sp', 'retrieval', 5))} AS d_retrieval,
    {rounded(clamped(f"0.5::DOUBLE + CASE WHEN years IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN dated THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN dated AND years > span + 7 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN level IN ({', '.join(map(q, lx.SENIOR_LEVELS))}) AND years < 2 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END"))} AS consistency
  FROM t7)"""

FINGERPRINTS = f"""{FEATURES}
SELECT 'P' || doc_id AS candidate_id, coalesce(title, '') AS current_title, years AS years_of_experience, completeness AS profile_completeness_score, density AS keyword_density_score,
  hint AS skill_evidence_hint_score, array_to_string(claims_n, '|') AS claimed, array_to_string(tech_n, '|') AS terms, career_depth AS career_depth_score, d_production AS production_depth_score,
  d_evaluation AS evaluation_depth_score, d_retrieval AS retrieval_depth_score, consistency AS career_consistency_score, level AS seniority_level FROM f"""


def _group(p: str, names) -> str:
    hits = " + ".join(f"{has(p, ALIASES.get(n, [clean(n)]))}::INT" for n in names)
    return clamped(f"greatest({hits}, len(list_intersect(known, {listed(names)}))) / {d(float(max(1, min(4, len(names)))))}")


PROOF = f"""{FEATURES},
g1 AS MATERIALIZED (SELECT *, {named('strong', {clean(n): a for n, a in ALIASES.items()})} AS hit_k FROM f),
g2 AS MATERIALIZED (
  SELECT *, list_filter(claims_n, lambda n, i: list_contains(hit_k, claims_k[i]) OR (NOT list_contains({_ALIAS_KEYS}, claims_k[i]) AND contains(strong, ' ' || claims_k[i] || ' '))) AS supported FROM g1),
g3 AS MATERIALIZED (SELECT *, list_distinct(list_concat(tech_n, supported)) AS known, len(claims_n) AS n_claims, len(supported) AS n_supported FROM g2),
g AS MATERIALIZED (
  SELECT *, {rounded(f"CASE WHEN n_claims > 0 THEN {clamped('n_supported / n_claims')} ELSE 0.0::DOUBLE END")} AS alignment,
    {rounded(f"greatest({_group('strong', lx.RETRIEVAL_SKILLS)}, d_retrieval)")} AS retrieval, {rounded(f"greatest({_group('strong', lx.EVALUATION_SKILLS)}, d_evaluation)")} AS evaluation,
    {rounded(f"greatest({_group('strong', (*lx.PRODUCTION_SKILLS, 'Deployment', 'Scale'))}, d_production)")} AS production FROM g3)"""


def risk(deep: bool, source: str) -> str:
    """CTEs that end in `risked`: findings, risk, level, disqualification and penalty of the rows of source."""
    none_known = "(NOT sig AND loc IS NULL)"
    stale = "date_diff('day', last_day::DATE, DATE '2026-12-31')"
    ai_career, ai_claims = has("cp", lx.RULE_TERMS["ai"]), has("claim_p", lx.RULE_TERMS["ai"])
    title = lambda group: has("(' ' || title_norm || ' ')", lx.RULE_TERMS[group])
    research = f"(({title('research')} OR {has('cp', lx.RULE_TERMS['research'])} OR {has('tcp', lx.RULE_TERMS['research'])}) AND NOT {has('cp', lx.RULE_TERMS['production'])})"
    claimed = lambda group: has("claimed_p", lx.RULE_TERMS[group])
    found = [  # flag, condition, severity, weight
        ("zero_duration_expert_claim", f"regexp_matches(raw, {q(lx.ZERO_EXPERT_PATTERN)})", "'severe'", 0.25, False),
        ("excessive_keyword_density", "density >= 0.18", "CASE WHEN density >= 0.30 THEN 'high' ELSE 'medium' END", 0.15, False),
        ("buzzword_stuffing", "density >= 0.12 AND alignment < 0.20", "'high'", 0.15, False),
        ("many_claimed_skills_weak_evidence", "n_claims >= 12 AND alignment < 0.25", "'high'", 0.18, False),
        ("generic_ai_keyword_spam", "len(tech) >= 10 AND len(c_tok) < 35", "'medium'", 0.10, False),
        ("missing_availability_signals", none_known, "'low'", 0.03, False),
        ("low_response_signal", f"NOT {none_known} AND rr < 0.10", "'medium'", 0.07, False),
        ("stale_activity_signal", f"NOT {none_known} AND {stale} > 180", "'medium'", 0.06, False),
        ("unclear_notice_period", f"NOT {none_known} AND notice IS NULL", "'low'", 0.02, False),
        ("negative_experience", "years < 0", "'severe'", 0.50, True),
        ("suspiciously_high_experience", "years > 25", "CASE WHEN years > 45 THEN 'severe' ELSE 'high' END", "CASE WHEN years > 45 THEN 0.40::DOUBLE ELSE 0.20::DOUBLE END", True),
        ("impossible_years_of_experience", "coalesce(list_max(text_years) - years >= 8, false) OR coalesce(years > 2026 - list_min(all_years) + 5, false)", "'severe'", 0.40, True),
        ("senior_title_without_experience", f"{title('senior')} AND (years IS NULL OR years < 2)", "'high'", 0.20, True),
        ("unrealistic_experience_for_title", f"{title('junior')} AND years >= 10", "'high'", 0.18, True),
        ("experience_missing_for_senior_role", f"{title('senior')} AND years IS NULL", "'medium'", 0.10, True),
        ("title_skill_mismatch", f"{title('ai')} AND NOT {ai_career} AND alignment < 0.20", "'high'", 0.12, True),
        ("non_technical_title_with_deep_ai_claims", f"{title('non_technical')} AND {ai_claims} AND NOT {ai_career}", "'high'", 0.18, True),
        ("seniority_evidence_mismatch", f"{title('senior')} AND alignment < 0.15 AND {ai_claims}", "'high'", 0.15, True),
        ("research_only_for_production_jd", research, "'medium'", 0.08, True),
        ("shallow_project_evidence", f"{ai_claims} AND len(c_tok) < 45 AND n_supported <= 2 AND greatest(production, retrieval, evaluation) < 0.25", "'medium'", 0.06, True),
        ("unsupported_required_skill", "n_lacking > 0", "CASE WHEN n_lacking >= 3 THEN 'high' ELSE 'medium' END", 0.20, True),
        ("weak_proof_alignment", "n_claims > 0 AND alignment < 0.15", "CASE WHEN n_claims >= 8 THEN 'high' ELSE 'medium' END", 0.15, True),
        ("high_skill_claim_low_evidence", "n_claims >= 10 AND n_supported <= 2", "'high'", 0.18, True),
        ("retrieval_claim_without_evidence", f"{claimed('retrieval_claims')} AND retrieval = 0", "'high'", 0.15, True),
        ("evaluation_claim_without_evidence", f"{claimed('evaluation_claims')} AND evaluation = 0", "'medium'", 0.10, True),
        ("production_claim_without_evidence", f"{claimed('production_claims')} AND production = 0", "'medium'", 0.10, True),
        ("empty_profile_text", "raw = ''", "'severe'", 0.50, False),
    ]
    rows = ", ".join(f"CASE WHEN {c} THEN {{'flag': {q(n)}, 'severity': {s}, 'weight': {w if isinstance(w, str) else d(w)}}} END" for n, c, s, w, is_deep in found if deep or not is_deep)
    any_of = lambda *names: f"list_has_any(flags, {listed(names)})"
    return f"""
r0 AS MATERIALIZED (SELECT *, ' ' || {cleaned("array_to_string(list_concat(claims_n, tech_n), ' ')")} || ' ' AS claim_p, ' ' || {cleaned("array_to_string(claims_n, ' ')")} || ' ' AS claimed_p,
    ' ' || title_norm || ' ' || career_norm || ' ' AS tcp, career || ' ' || raw AS both_texts FROM {source}),
r1 AS MATERIALIZED (SELECT *, list_filter(list_transform(regexp_extract_all(both_texts, {q(lx.CALENDAR_PATTERN)}, 0), lambda x: x::INT), lambda y: y >= 1970 AND y <= 2027) AS all_years,
    list_concat(list_transform(regexp_extract_all(both_texts, {q(lx.RANGE_PATTERN)}, 1), lambda x: x::DOUBLE), list_transform(regexp_extract_all(both_texts, {q(lx.RANGE_PATTERN)}, 2), lambda x: x::DOUBLE),
      list_transform(regexp_extract_all(both_texts, {q(lx.SINGLE_PATTERN)}, 1), lambda x: x::DOUBLE)) AS text_years FROM r0),
r2 AS MATERIALIZED (SELECT *, list_filter([{rows}], lambda x: x IS NOT NULL) AS found FROM r1),
r3 AS MATERIALIZED (SELECT *, list_transform(found, lambda x: x.flag) AS flags, len(list_filter(found, lambda x: x.severity = 'high')) AS n_high, len(list_filter(found, lambda x: x.severity = 'severe')) AS n_severe,
    coalesce(list_reduce(list_prepend(0.0::DOUBLE, list_transform(found, lambda x: x.weight)), lambda a, b: a + b), 0.0::DOUBLE) AS total FROM r2),
r4 AS MATERIALIZED (SELECT *, {clamped("total + 0.05::DOUBLE * greatest(0, n_high - 1)")} AS risk FROM r3),
r5 AS MATERIALIZED (SELECT *, CASE WHEN risk <= 0.24::DOUBLE THEN 'low' WHEN risk <= 0.49::DOUBLE THEN 'medium' WHEN risk <= 0.74::DOUBLE THEN 'high' ELSE 'severe' END AS risk_level FROM r4),
risked AS MATERIALIZED (SELECT *, risk_level = 'severe' AND (n_severe >= 2 OR {any_of('empty_profile_text', 'negative_experience', 'impossible_years_of_experience')}
    OR ({any_of('zero_duration_expert_claim')} AND {any_of('buzzword_stuffing', 'many_claimed_skills_weak_evidence', 'weak_proof_alignment')})
    OR ({any_of('unsupported_required_skill')} AND {any_of('buzzword_stuffing')} AND alignment < 0.10)) AS disqualified,
    {rounded(clamped('''CASE WHEN risk < 0.25::DOUBLE THEN least(0.03::DOUBLE, greatest(risk * 0.10::DOUBLE, total * 0.15::DOUBLE))
      WHEN risk < 0.50::DOUBLE THEN least(0.10::DOUBLE, greatest(0.04::DOUBLE, 0.04::DOUBLE + (risk - 0.25::DOUBLE) * 0.24::DOUBLE, total * 0.30::DOUBLE))
      WHEN risk < 0.75::DOUBLE THEN least(0.25::DOUBLE, greatest(0.11::DOUBLE, 0.11::DOUBLE + (risk - 0.50::DOUBLE) * 0.56::DOUBLE, total * 0.45::DOUBLE))
      ELSE greatest(0.30::DOUBLE, 0.30::DOUBLE + (risk - 0.75::DOUBLE) * 0.80::DOUBLE, total * 0.60::DOUBLE) END''', 0.5))} AS penalty FROM r5)"""


AUDIT = f"""{PROOF}, h AS (SELECT *, 0 AS n_lacking FROM g), {risk(True, 'h')}
SELECT 'P' || doc_id AS candidate_id, {rounded('risk')} AS risk_score, risk_level, disqualified, array_to_string(flags, '|') AS flags, penalty FROM risked"""


def scored(query: Query, source: str = "g") -> str:
    """CTEs that end in `scored`: the light base score of the rows of source."""
    skills = list(dict.fromkeys([*query.required, *query.preferred]))
    present = named("lp", {n: ALIASES[n] for n in lx.SKILLS})
    credit = " + ".join(f"CASE WHEN list_contains(supported, {q(s)}) THEN 1.0::DOUBLE WHEN list_contains(present, {q(s)}) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END" for s in query.required)
    lacking = " + ".join(f"(NOT list_contains(supported, {q(s)}))::INT" for s in query.required)
    signals = ["rr", "icr", "1.0::DOUBLE - notice / 180.0::DOUBLE"]
    parts = [f"CASE WHEN {x.split(' - ')[-1].split(' /')[0]} IS NOT NULL THEN {clamped(x)} END" for x in signals]
    parts += ["CASE WHEN open_now THEN 1.0::DOUBLE WHEN NOT open_now THEN 0.35::DOUBLE END", "CASE WHEN moves THEN 0.8::DOUBLE WHEN NOT moves THEN 0.5::DOUBLE END"]
    conditions = {
        "empty_profile_text": "raw = ''", "extremely_high_keyword_density": "dens >= 0.25 AND n_tok >= 20", "missing_skills": "len(explicit_n) = 0", "missing_experience": "years IS NULL AND career = ''",
    }
    cost = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {conditions[k]} THEN {d(v)} ELSE 0.0::DOUBLE END" for k, v in lx.PROFILE_PENALTIES.items())])
    names = {"jd_relevance": "lexical", "must_have_skill": "must", "proof_alignment": "alignment", "retrieval_evaluation_depth": "depth_score", "production_readiness": "production", "hireability": "hire"}
    total = " + ".join(f"{d(w)} * {names[k]}" for k, w in lx.SCORE_WEIGHTS.items())
    text = "coalesce(title, '') || ' ' || raw || ' ' || array_to_string(tech_n, ' ')"
    return f"""
s1 AS MATERIALIZED (SELECT *, {cleaned(text)} AS lt FROM {source}),
s2 AS MATERIALIZED (SELECT *, ' ' || lt || ' ' AS lp, len(list_intersect(list_distinct({sql_words('lt')}), {listed(query.tokens)})) / {d(float(len(query.tokens)))} AS overlap,
    list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS signals FROM s1),
s3 AS MATERIALIZED (SELECT *, {present} AS present FROM s2),
s4 AS MATERIALIZED (SELECT *, {clamped(f"0.55::DOUBLE * overlap + 0.45::DOUBLE * (len(list_intersect(present, {listed(skills)})) / {d(float(len(skills)))})")} AS lexical,
    {clamped(f"({credit}) / {d(float(len(query.required)))}")} AS must, {lacking} AS n_lacking, {clamped("0.65::DOUBLE * retrieval + 0.35::DOUBLE * evaluation")} AS depth_score,
    CASE WHEN len(signals) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, signals), lambda a, b: a + b) / len(signals) ELSE 0.5::DOUBLE END AS hire, {cost} AS cost FROM s3),
scored AS MATERIALIZED (SELECT *, {rounded(clamped(f"{total} - cost"), 6)} AS final_score FROM s4)"""


def scores(query: Query) -> str:
    return f"""{PROOF}, {scored(query)}, {risk(False, 'scored')}
SELECT 'P' || doc_id AS candidate_id, final_score, {rounded('lexical')} AS jd_relevance_score, {rounded('must')} AS must_have_skill_score, {rounded('depth_score')} AS retrieval_evaluation_depth_score,
  {rounded('hire')} AS hireability_score, {rounded('cost')} AS penalty_score, alignment AS proof_alignment_score, array_to_string(flags, '|') AS light_flags,
  {rounded(f"CASE WHEN disqualified THEN 0.0::DOUBLE ELSE {clamped('final_score - penalty')} END", 6)} AS risk_adjusted_score FROM risked"""
