"""Scores of retrieved points; all plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score by authority level, and by rank within level 1.
LEVEL_SCORES = {1: 0.84, 2: 0.62, 3: 0.40, 4: 0.20}
RANK_SCORES = {1: 1.00, 2: 0.92, 3: 0.84, 4: 0.76}
#: Weights of evidence, authority and jurisdiction.
WEIGHTS = (0.68, 0.20, 0.12)
#: Fixed value: score of a federal source where the state is asked for, and the other way round.
OTHER_JURISDICTION = 0.25


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def evidence_score(logit: Column) -> Column:
    """Logistic function of a logit held within 30."""
    return 1 / (1 + F.exp(-clamp(logit, -30.0, 30.0)))


def authority_score(level: Column, rank: Column) -> Column:
    """By level; within level 1 by normative rank, where unknown as the lowest."""
    first = F.when(rank == 1, RANK_SCORES[1]).when(rank == 2, RANK_SCORES[2]).when(rank == 3, RANK_SCORES[3]).otherwise(RANK_SCORES[4])
    return F.when(level == 1, first).when(level == 2, LEVEL_SCORES[2]).when(level == 3, LEVEL_SCORES[3]).when(level == 4, LEVEL_SCORES[4]).otherwise(0.10)


def jurisdiction_score(asked: Column, own: Column) -> Column:
    """Half where nothing is asked or known, one for the same, a quarter for the federal against the state."""
    differ = ((asked == "federal") & (own == "estadual_sp")) | ((asked == "estadual_sp") & (own == "federal"))
    return F.when(asked.isNull() | own.isNull(), 0.5).when(asked == own, 1.0).when(differ, OTHER_JURISDICTION).otherwise(0.5)


def quality_score(confidence: Column) -> Column:
    """Extraction confidence within 0 and 1; unknown counts in full."""
    return clamp(F.coalesce(confidence.cast("double"), F.lit(1.0)))


def retrieval_score(evidence: Column, quality: Column, authority: Column, jurisdiction: Column) -> Column:
    """Weighted sum within 0 and 1."""
    e, a, j = WEIGHTS
    return clamp(F.lit(e) * evidence * quality + F.lit(a) * authority + F.lit(j) * jurisdiction)
