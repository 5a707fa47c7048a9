"""A part of a saved result computed anew, with everything else left as it was."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.config import Models, Settings
from emberflow.operators import decision, governance, peers
from emberflow.operators.clustering import checkpointed

# The columns that each refresh writes, and those that peer scores are computed from.
INTERPRETATION = ("decision", "decision_basis", "source_context", "score_status", "score_reason")
PEER_TEXTS = ("evidence_score", "score_status", "score_reason", "score_interpretation", "decision_basis")
PEER_INPUTS = ("latitude", "longitude", "start_time", "end_time", "context_label", "worldcover_dominant", "worldcover_coverage", "data_quality", "model_sensor", "model_daynight", "frp_peak_mw", "brightness_temperature_difference_max", "detection_peak")
EVIDENCE = "sentinel_"


class Refused(ValueError):
    """The saved parts don't fit together, so nothing is computed."""


def agreed(events: DataFrame, mapped: DataFrame, inputs: tuple[str, ...], key: str = "event_id") -> None:
    """Both saved forms have the same identifiers once each, and equal values of ``inputs`` (those that the events have)."""
    if not governance.duplicates(events, key).isEmpty() or not governance.duplicates(mapped, key).isEmpty():
        raise Refused("an identifier is there twice")
    values = [c for c in inputs if c in events.columns]
    if lacking := sorted(set(values) - set(mapped.columns)):
        raise Refused(f"the other form lacks {lacking}")
    if (issue := governance.key_agreement(events, mapped, key, values or [key]).first()) is not None:
        raise Refused(f"the two forms disagree: {issue.issue}, {issue.n} rows")


def _only(events: DataFrame, revised: DataFrame, fields: set[str]) -> DataFrame:
    """The revised rows with the columns of ``events`` in their order, then the new ones among ``fields``."""
    new = [c for c in revised.columns if c in fields and c not in events.columns]
    return revised.select(*events.columns, *new)


def interpretation(events: DataFrame, saved: dict[str, Any], m: Models, mapped: DataFrame | None = None) -> DataFrame:
    """Events with the columns of ``INTERPRETATION`` anew. Refused if ``saved``, the models of the run, differ from ``m``, or
    the mapped form has other identifiers or scores."""
    if saved != asdict(m):
        raise Refused("the models of the saved run differ or are missing")
    if mapped is not None:
        agreed(events, mapped, ("anomaly_score",))
    kept = events.drop(*INTERPRETATION)
    revised = decision.decide(kept, m)
    others = [c for c in revised.columns if c not in INTERPRETATION and c not in kept.columns]
    return _only(events, revised.drop(*(c for c in others if c not in events.columns)), set(INTERPRETATION))


def peer_scores(events: DataFrame, mapped: DataFrame, settings: Settings) -> DataFrame:
    """Events with peer scores and what is said of them anew; scores of sites and everything measured stay. Refused if the mapped
    form doesn't hold the very values that the scores are computed from."""
    agreed(events, mapped, (*PEER_INPUTS, "anomaly_score"))
    site = F.col("site_anomaly_score") if "site_anomaly_score" in events.columns else F.col("anomaly_score")
    bare = events.drop("score_method", *(c for c in events.columns if c.startswith("peer_"))).withColumn("anomaly_score", site)
    scored = peers.score_peers(checkpointed(bare), settings.peers, settings.area)
    before = [c for c in ("decision", "source_context", "incident_verification") if c in events.columns]
    told = decision.decide(scored.drop(*PEER_TEXTS), settings.models)
    own = events.select(F.col("event_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in before))
    told = told.join(own, F.col("event_id") == F.col("_id")).withColumns({c: F.col(f"_{c}") for c in before})
    fields = {*PEER_TEXTS, "score_method", "site_anomaly_score", *(c for c in told.columns if c.startswith("peer_"))}
    return _only(events, told, fields)


def evidence(events: DataFrame, found: DataFrame, m: Models) -> DataFrame:
    """Events with the imagery columns of ``found`` (event_id, sentinel_*) in place of their earlier ones, and decisions that name them.

    Each event stays, with nulls where nothing was found. Of rows that repeat an event, the smallest counts.
    """
    columns = [c for c in found.columns if c.startswith(EVIDENCE)]
    one = found.groupBy("event_id").agg(F.min(F.struct(*columns)).alias("s")).select("event_id", "s.*")
    return decision.decide(events.drop(*(c for c in events.columns if c.startswith(EVIDENCE))).join(one, "event_id", "left"), m)


def changed(before: DataFrame, after: DataFrame, but: tuple[str, ...], key: str = "event_id") -> DataFrame:
    """(issue, n): identifiers gained or lost, and rows of which a column outside ``but`` changed; a check for ``governance.publish``."""
    same = [c for c in before.columns if c not in but and c != key]
    return governance.key_agreement(before, after, key, [key, *same])
