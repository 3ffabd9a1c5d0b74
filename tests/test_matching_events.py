"""Matching events against plain loops, with repeated and missing keys; every event is sent once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caregap.operators import review

TIMELINE = (
    "bene_id string, event_date date, event_type string, code string, hcc_v28 string, source string, claim_id string, "
    "event_id string, is_principal boolean"
)
SUSPECTS = "suspect_id string, bene_id string, hcc_v28 string, diagnosis_codes array<string>"


def sample(spark):
    r = random.Random(5)
    pick = lambda prefix, n: r.choice([None, *[f"{prefix}{i}" for i in range(n)]])
    events = [(pick("b", 6), None, "diagnosis", pick("d", 5), pick("h", 4), "X", pick("c", 9), f"e{i}", None) for i in range(150)]
    events += events[:20]
    # s3 belongs to two members; one suspect has no codes at all.
    suspects = [(f"s{i}", f"b{i % 5}", f"h{i % 4}", [f"d{i % 5}", None]) for i in range(9)]
    suspects += suspects[:2] + [("s3", "b5", None, None), ("s20", None, "h1", ["d1"])]
    claims = [(f"s{r.randrange(10)}", pick("c", 9)) for _ in range(25)]
    make = spark.createDataFrame
    return (events, suspects, claims), (make(events, TIMELINE).repartition(3), make(suspects, SUSPECTS), make(claims, "suspect_id string, claim_id string"))


def plain(events, suspects, claims):
    found = set()
    for at, e in enumerate(events):
        for s, bene, hcc, codes in suspects:
            by_claim = e[6] is not None and (s, e[6]) in claims
            by_value = (hcc is not None and e[4] == hcc) or (e[3] is not None and e[3] in (codes or []))
            if bene is not None and e[0] == bene and (by_claim or by_value):
                found.add((at, s))
    return sorted((s, events[at][7]) for at, s in found)


@pytest.mark.parametrize("with_member", [False, True])
def test_equals_plain_loops(spark, with_member):
    values, (timeline, suspects, claims) = sample(spark)
    if with_member:
        claims = suspects.select("suspect_id", "bene_id").distinct().join(claims, "suspect_id")
    got = review.matching_events(timeline, suspects, claims).select("suspect_id", "event_id").collect()
    assert sorted(map(tuple, got)) == plain(*values) and got


def test_events_are_sent_once(spark):
    _, (timeline, suspects, claims) = sample(spark)
    joined = suspects.select("suspect_id", "bene_id").distinct().join(claims, "suspect_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = review.supporting_events(timeline, suspects, joined, group=("bene_id", "suspect_id"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for the events with the claims and one for the suspects by member; two and a distinct make the claims of this test.
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 5


def test_group_by_member_keeps_the_ranks(spark):
    _, (timeline, suspects, claims) = sample(spark)
    own = suspects.filter("bene_id <> 'b5'").distinct()
    ranks = [
        sorted(map(repr, review.supporting_events(timeline.coalesce(1), own, claims, 4, group).drop("row").select(F.col("*")).collect()))
        for group in (("suspect_id",), ("bene_id", "suspect_id"))
    ]
    assert ranks[0] == ranks[1] and ranks[0]
