"""Evidence state kept between runs: scoring a batch reads only the buckets of its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.operators import evidence, gaps, timeline
from caregap.operators.evidence import GAP
from caregap.operators.gaps import PAIR
from caregap.schemas import EMERGING, RECAPTURE, Periods
from caregap.session import materialize
from caregap.streaming.store import BUCKETS, TableStore

MEMBER = "bene_id"
# What makes two diagnosis rows the same event; copies differ in source and principal flag only.
EVENT = ["bene_id", "event_date", "hcc_v28", "claim_id", "code", "event_id"]
PARTIAL = [*PAIR, "year", "source"]
PARTS = ("events", "partials")
# Batches that a bucket takes before it is written anew as one layer.
LAYERS = 8


def news(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """``fresh`` events that are not stored yet or change a stored one, each with the stored source and flag.

    Both sides may hold copies; they meet in one grouping, where nulls are values like any other.
    """
    def side(rows: DataFrame, is_fresh: bool) -> DataFrame:
        def only(c: str, here: bool) -> Column:
            return F.when(F.lit(here), F.col(c))

        return rows.select(
            *EVENT, only("source", is_fresh).alias("source"), only("is_principal", is_fresh).alias("is_principal"), F.lit(is_fresh).alias("fresh"),
            only("source", not is_fresh).alias("old_source"), only("is_principal", not is_fresh).alias("old_flag"), F.lit(not is_fresh).alias("known"),
        )

    met = side(fresh, True).unionByName(side(stored, False)).groupBy(*EVENT).agg(
        *[F.min(c).alias(c) for c in ("source", "old_source")], *[F.max(c).alias(c) for c in ("is_principal", "old_flag", "fresh", "known")]
    )
    same = F.least("source", "old_source").eqNullSafe(F.col("old_source")) & F.greatest("is_principal", "old_flag").eqNullSafe(F.col("old_flag"))
    return met.filter("fresh").filter(~(F.col("known") & same)).drop("fresh")


def changes(new: DataFrame) -> DataFrame:
    """What ``news`` change in the partials.

    A new event counts once under its source. A copy of a stored event may lower
    its source (the smallest counts) or make it principal: then the old
    contribution is taken back and the new one added.
    """
    def number(flag: str) -> Column:
        return F.coalesce(F.col(flag), F.lit(False)).cast("bigint")

    met = new.withColumns({"principal": number("is_principal"), "old_principal": number("old_flag")})
    source, flag = F.least("source", "old_source"), F.greatest("principal", "old_principal")
    added = F.struct(source.alias("source"), F.lit(1).cast("bigint").alias("n"), flag.alias("principal"))
    taken = F.struct(F.col("old_source").alias("source"), F.lit(-1).cast("bigint").alias("n"), (-F.col("old_principal")).alias("principal"))
    same_as_before = source.eqNullSafe(F.col("old_source")) & (flag == F.col("old_principal"))
    moves = F.when(~F.col("known"), F.array(added)).when(~same_as_before, F.array(added, taken))
    return (
        met.select(*PAIR, F.year("event_date").alias("year"), "event_date", "code", F.explode(moves).alias("move"))
        .select(*PAIR, "year", F.col("move.source").alias("source"), "move.n", "move.principal", "event_date", "code")
        .groupBy(*PARTIAL)
        .agg(F.sum("n").alias("n"), F.sum("principal").alias("principal"), F.array_sort(F.collect_set("code")).alias("codes"),
             F.array_sort(F.collect_set("event_date")).alias("days"))
    )


def deltas(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """What ``fresh`` events change in the partials, given the events stored so far.

    Events that change nothing give no row, so a repeated batch adds nothing.
    """
    return changes(news(fresh, stored))


def _union_of(c: str) -> Column:
    """Union of few arrays of bounded vocabularies (codes of a category, days of a year)."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)


def merged(*partials: DataFrame) -> DataFrame:
    """Sum of partials; the order and grouping of the parts do not matter.

    A source whose events all moved to another stays as a row with n = 0: its
    codes and days are still those of the pair.
    """
    rows = partials[0]
    for more in partials[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*PARTIAL).agg(F.sum("n").alias("n"), F.sum("principal").alias("principal"), _union_of("codes"), _union_of("days"))


def side_of(year: Column, periods: Periods) -> Column:
    """The gap side that evidence of a year supports."""
    return F.when(year == periods.current, EMERGING).when(year.isin(list(periods.historical)), RECAPTURE).otherwise("LATEST")


def features(partials: DataFrame, events: DataFrame, periods: Periods) -> DataFrame:
    """Evidence features of every pair and window, equal to those computed from all events at once.

    Counts, sources, codes and days come from the partials. Claim and event ids
    have no bound per pair and may lie in two years of a window, so their distinct
    counts come from the stored events, spread by value before they are added up.
    """
    years = list(periods.loaded_years)
    per_source = partials.filter(F.col("year").isin(years)).withColumn("gap_type", side_of(F.col("year"), periods)).groupBy(
        *GAP, "source"
    ).agg(F.sum("n").alias("n"), F.sum("principal").alias("principal"), _union_of("codes"), _union_of("days"))
    summed = per_source.groupBy(*GAP).agg(
        F.sum("n").alias("diagnosis_count"),
        F.count_if((F.col("n") > 0) & F.col("source").isNotNull()).alias("distinct_sources"),
        F.sum("principal").alias("principal_diagnosis_count"),
        _union_of("codes").alias("supporting_diagnosis_codes"),
        _union_of("days").alias("evidence_days"),
    ).withColumns({
        "first_evidence_date": F.array_min("evidence_days"),
        "last_evidence_date": F.array_max("evidence_days"),
        "distinct_evidence_months": F.size(F.array_distinct(F.transform("evidence_days", lambda d: F.trunc(d, "MM")))).cast("bigint"),
    })
    year = F.year("event_date")
    ids = events.filter(year.isin(years)).withColumn("gap_type", side_of(year, periods)).groupBy(*GAP).agg(
        F.count_distinct("claim_id").alias("unique_claim_count"), F.count_distinct("event_id").alias("unique_event_count")
    )
    return evidence.with_day_counts(summed.join(ids, GAP))


# Copies of an event, and parts of a partial, that lie in several layers of a bucket become one row.
MERGED = {"events": evidence.deduplicate_events, "partials": merged}


class EvidenceState:
    """Deduplicated events and mergeable partial aggregates of all batches so far, in buckets of the member id.

    ``partials`` hold, per member, category, year and source, the number of events and
    of principal ones and the sets of codes and days; windows of any years are sums of
    them. A batch adds a layer to the buckets of its members: the events that are new or
    change a stored one, and what they change in the partials. Readers merge the layers;
    a bucket with ``LAYERS`` of them is written anew as one. Both parts are published as
    one version, so a lost run or a second writer leaves neither of them ahead of the
    other, and a batch that is absorbed again changes nothing. Categories are those of
    the time a batch was absorbed.
    Defined cases: rows without a member, date or category are no evidence; null claim ids,
    event ids, codes and sources are values like any other in telling events apart,
    and are left out of distinct counts; an empty batch makes no version.
    """

    def __init__(self, store: TableStore, table: str = "evidence_state", buckets: int = BUCKETS):
        self.store, self.table, self.new_buckets = store, table, buckets

    def _manifest(self) -> tuple[int, dict | None]:
        version = self.store.latest_version(self.table)
        return version, self.store._manifest(self.table, version) if version else None

    def _layers(self, part: dict, numbers: set[int] | None = None) -> DataFrame:
        """Rows of all layers of some buckets, not merged."""
        return self.store._read_folders(part["schema"], [f for b, fs in part["folders"].items() if numbers is None or int(b) in numbers for f in fs])

    def _of_members(self, manifest: dict, members: DataFrame) -> dict[str, DataFrame]:
        numbers = self.store.bucket_numbers(members, MEMBER, manifest["buckets"])
        return {p: self._layers(manifest["parts"][p], numbers).join(members, MEMBER, "left_semi") for p in PARTS}

    def parts(self, members: DataFrame | None = None) -> dict[str, DataFrame]:
        """Both parts of one version; with ``members``, only their buckets are read. Empty before the first batch."""
        _, manifest = self._manifest()
        if manifest is None:
            return {}
        rows = {p: self._layers(manifest["parts"][p]) for p in PARTS} if members is None else self._of_members(
            manifest, members.select(MEMBER).distinct())
        return {p: MERGED[p](r) for p, r in rows.items()}

    def absorb(self, rows: DataFrame) -> int:
        """Add timeline rows to the state and return its version; reads only the buckets of their members and writes what is new."""
        version, old = self._manifest()
        count = old["buckets"] if old else self.new_buckets
        fresh = materialize(evidence.deduplicate_events(gaps.diagnoses(rows).filter(F.col(MEMBER).isNotNull())))
        numbers = self.store.bucket_numbers(fresh, MEMBER, count)
        if not numbers and old:
            return version
        if old:
            # Equal events have equal dates, so stored events of other dates need not meet the batch.
            first, last = fresh.agg(F.min("event_date"), F.max("event_date")).first()
            stored = self._layers(old["parts"]["events"], numbers).filter(F.col("event_date").between(F.lit(first), F.lit(last)))
            new = materialize(news(fresh, stored))
        else:
            nothing = {"old_source": F.lit(None).cast("string"), "old_flag": F.lit(None).cast("boolean"), "known": F.lit(False)}
            new = fresh.withColumns(nothing)
        manifest: dict = {"buckets": count, "parts": {}}
        for name, part in {"events": new.select(*fresh.columns), "partials": changes(new)}.items():
            layers = dict(old["parts"][name]["folders"]) if old else {}
            full = {int(b) for b, fs in layers.items() if int(b) in numbers and len(fs) >= LAYERS}
            if full:
                part = MERGED[name](part.unionByName(self._layers(old["parts"][name], full)))
            for bucket, folder in self.store.write_buckets(part, f"{self.table}/{name}", MEMBER, count).items():
                layers[str(bucket)] = [*([] if bucket in full else layers.get(str(bucket), [])), folder]
            manifest["parts"][name] = {"schema": part.schema.jsonValue(), "folders": layers}
        self.store._commit(self.table, version + 1, manifest)
        return version + 1

    def events(self, members: DataFrame) -> DataFrame:
        """Stored events of some members as timeline rows."""
        return self.parts(members)["events"].withColumn("event_type", F.lit("diagnosis"))

    def score(self, members: DataFrame, prescriptions: DataFrame, baseline: DataFrame, mapping: DataFrame, periods: Periods) -> DataFrame:
        """Gaps and scores of some members, equal to ``evidence.run_batch_engine`` over all rows absorbed so far."""
        members = materialize(members.select(MEMBER).distinct())
        _, manifest = self._manifest()
        if manifest is None:
            raise ValueError("the evidence state holds no rows yet")
        # Sums, unions and distinct counts need no merged layers.
        stored = self._of_members(manifest, members)
        scoped = [t.join(members, MEMBER, "left_semi") for t in (prescriptions, baseline)]
        return evidence.batch_priority(
            evidence.suspects_from_features(materialize(features(stored["partials"], stored["events"], periods)), *scoped, mapping, periods, True)
        )


def absorb_claims(state: EvidenceState, claims: DataFrame, mapping: DataFrame) -> int:
    """Add one claims batch to the state, mapped to categories on the way."""
    return state.absorb(timeline.claim_rows(claims, mapping))
