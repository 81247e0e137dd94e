"""Profiles that stream in: features and light scores are stateless, so the batch functions serve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tamarack.operators import evidence, scoring
from tamarack.operators.query import Query


def light_scores(fingerprints: DataFrame, query: Query) -> DataFrame:
    """candidate_id and score of fingerprints, streaming or not."""
    df = scoring.base(evidence.proof(fingerprints), query)
    return df.select("candidate_id", "score.final_score", "score.jd_relevance_score")


def ranked_batches(scores: DataFrame, top_k: int, sink: Callable[[DataFrame, int], None]):
    """A stream writer that gives sink each micro-batch's top_k."""

    def one(batch: DataFrame, number: int) -> None:
        sink(batch.orderBy(batch["final_score"].desc(), "candidate_id").limit(top_k), number)

    return scores.writeStream.foreachBatch(one)
