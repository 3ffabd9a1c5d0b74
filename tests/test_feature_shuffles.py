"""Evidence features: distinct counts as sums of marks, gaps from one shuffle of the features by member."""

import re

import pytest
from pyspark.sql import functions as F

from caregap.operators import evidence, gaps
from tests.test_state import PERIODS, random_rows

NAMES = [*evidence.GAP, "diagnosis_count", "unique_claim_count", "unique_event_count", "distinct_sources", "principal_diagnosis_count"]


def plan_of(df):
    """The plan as made before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def repr_set(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_features_send_rows_three_times_and_never_once_per_count(spark):
    rows = random_rows(spark, 3).select(*gaps.PAIR, "event_date", "claim_id", "event_id", "source", "code", "is_principal")
    plan = plan_of(evidence.evidence_features(rows))
    assert "Expand" not in plan
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 3


@pytest.mark.parametrize("blanks_count", [False, True])
def test_features_equal_plain_distinct_counts(spark, blanks_count):
    rows = random_rows(spark, 4, 900).unionByName(random_rows(spark, 5, 300)).withColumn("gap_type", F.lit("EMERGING"))
    plain = evidence.with_day_counts(rows.groupBy(*evidence.GAP).agg(*evidence.feature_columns(blanks_count=blanks_count)))
    got = evidence.evidence_features(rows, evidence.GAP, blanks_count)
    assert got.columns == plain.columns
    assert repr_set(got) == repr_set(plain)


@pytest.mark.parametrize("latest_is_current", [False, True])
def test_gaps_of_features_equal_gaps_joined_to_features(spark, latest_is_current):
    features = evidence.period_features(random_rows(spark, 6, 120).unionByName(random_rows(spark, 7, 40)), PERIODS)
    assert features.filter("bene_id IS NULL").count() > 0
    found = gaps.gaps_from_presence(evidence.presence_from_features(features), None, latest_is_current)
    joined, got = evidence.with_features(found, features), evidence.gaps_of_features(features, latest_is_current)
    assert got.columns == joined.columns and got.count() > 0
    assert repr_set(got) == repr_set(joined)
    assert len(re.findall(r"\bExchange hashpartitioning", plan_of(got))) == 1


def test_gaps_and_their_features_take_three_shuffles(spark):
    """Events, claims, members: pairs need no shuffle between the claims and the members."""
    rows = random_rows(spark, 8, 60)
    plan = plan_of(evidence.gaps_of_features(evidence.window_features(rows, PERIODS)))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 3
