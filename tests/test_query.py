from tamarack.operators.query import clean, constraints, mentions, parse, parse_file


def test_required_and_preferred():
    q = parse("Must have Python and retrieval. Docker preferred; Kubernetes is nice to have.\nPython is optional? No.")
    assert q.required == ["Python", "Retrieval"]
    assert q.preferred == ["Docker", "Kubernetes"]
    assert "python" in q.tokens and "and" not in q.tokens


def test_experience_seniority_and_places():
    q = parse("Senior engineer, 5-8 years, at least 5 years, 6+ years, in Pune or remote")
    assert q.experience == [(5, 8), (5, None), (6, None)] or (5, 8) in q.experience
    assert q.seniority == ["senior"]
    assert q.locations == ["pune", "remote"]


def test_constraints():
    c = constraints(parse("Must have Python, ranking and NDCG in production systems. Docker preferred."))
    assert c.required == ["Python", "Ranking"]
    assert c.preferred[0] == "Docker"
    assert (c.production_heavy, c.retrieval_heavy, c.evaluation_heavy) == (True, True, True)
    assert "no_evaluation_evidence" in c.negatives
    assert c.archetype == "retrieval_ranking_engineer"
    assert constraints(parse("")).archetype == "unknown"


def test_mentions_has_edges():
    assert mentions("uses c++ and sql", "sql") and not mentions("mysql", "sql")
    assert clean("MAP@10") == "map 10"


def test_file_with_bom(tmp_path):
    path = tmp_path / "jd.txt"
    path.write_text("﻿Need Python", encoding="utf-8")
    assert parse_file(str(path)).required == ["Python"]
