"""Why a score is missing, what an event is taken for, and on what grounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.config import Models

# The decisions for industrial and mining context by what is known.
DECISIONS = {
    "industrial": ("industrial_associated_unscored", "suspected_abnormal_industrial_associated_event", "routine_persistent_industrial_thermal_source"),
    "mining": ("mining_associated_unscored", "suspected_abnormal_mining_associated_event", "mining_associated_thermal_source"),
}


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def score_gate(df: DataFrame, m: Models) -> Column:
    """A struct (status, reason): scored, or the first thing that stands in the way."""
    score = _column(df, "anomaly_score", "double")
    peer = _column(df, "peer_status", "string")
    site = _column(df, "site_id", "string")
    history, features, calibration = (_column(df, c, "bigint") for c in ("history_event_count", "model_feature_count", "calibration_event_count"))
    gates = [
        (score.between(0, 1) & ~F.isnan(score), F.lit("scored"), F.lit(None).cast("string")),
        (score.isNotNull() & ~F.isnan(score), F.lit("invalid_score"), F.lit("The stored score lies outside [0, 1] and has to be checked.")),
        ((_column(df, "context_label", "string") == "vegetation_associated") & ~peer.isin("not_applicable", "scored"), peer, F.coalesce(_column(df, "peer_reason", "string"), F.lit("No suitable comparison with vegetation peers."))),
        (F.trim(F.coalesce(site, F.lit(""))) == "" if "site_id" in df.columns else F.lit(False), F.lit("no_recurrent_site"), F.lit("The event belongs to no recurrent site, so there is no history to compare with.")),
        (history < m.min_history_events, F.lit("insufficient_site_history"), F.format_string(f"%d comparable earlier events at the site, {m.min_history_events} are needed.", history)),
        (features < 3, F.lit("insufficient_features"), F.format_string("%d features can be compared, 3 are needed.", features)),
        (_column(df, "model_daynight", "string") == "unknown", F.lit("unknown_daynight"), F.lit("The phase of the day is unknown, so there is no calibration group.")),
        (calibration < m.min_calibration_events, F.lit("insufficient_calibration"), F.format_string(f"%d earlier events to calibrate on, {m.min_calibration_events} are needed.", calibration)),
    ]
    out = F.struct(F.lit("diagnostics_unavailable").alias("status"), F.lit("No score was recorded, and the diagnostics don't tell why.").alias("reason"))
    for cond, status, reason in reversed(gates):
        out = F.when(F.coalesce(cond, F.lit(False)), F.struct(status.alias("status"), reason.alias("reason"))).otherwise(out)
    return out


def source_context(label: Column, kind: Column) -> Column:
    """The context label; industry at a mapped quarry is mining."""
    quarry = F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "landuse=quarry"
    return F.when((label == "industrial_associated") & quarry, "mining_quarry").otherwise(label)


def decision(label: Column, source: Column, status: Column, score: Column, threshold: float) -> Column:
    def of(names: tuple[str, str, str]) -> Column:
        return F.when(status != "scored", names[0]).when(score >= threshold, names[1]).otherwise(names[2])

    return F.when(source == "mining_quarry", of(DECISIONS["mining"])).when(label == "industrial_associated", of(DECISIONS["industrial"])).when(label == "vegetation_associated", "likely_vegetation_fire").otherwise("mixed_or_unknown")


def decide(events: DataFrame, m: Models) -> DataFrame:
    """Events with evidence_score, score_status, score_reason, source_context, decision and decision_basis. Imagery never changes a score."""
    score = F.col("anomaly_score")
    kind = _column(events, "nearest_facility_kind", "string")
    out = events.withColumns({"evidence_score": F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))), "_gate": score_gate(events, m), "source_context": source_context(F.col("context_label"), kind)})
    out = out.withColumns({"score_status": F.col("_gate.status"), "score_reason": F.col("_gate.reason")}).drop("_gate")
    out = out.withColumn("decision", decision(F.col("context_label"), F.col("source_context"), F.col("score_status"), F.col("evidence_score"), m.anomaly_percentile))
    method, refs, past, imagery = _column(events, "score_method", "string"), _column(events, "peer_reference_count", "bigint"), _column(events, "history_event_count", "bigint"), _column(events, "sentinel_evidence", "string")
    told = lambda c: F.coalesce(c.cast("string"), F.lit("unrecorded"))
    compared = F.when(method == "vegetation_peer", F.concat(F.lit("comparison=vegetation_peers; references="), told(refs))).otherwise(F.concat(F.lit("history_events="), told(past)))
    basis = F.when(F.col("score_status") == "scored", F.concat(F.lit("context="), F.col("source_context"), F.lit("; "), compared, F.lit("; evidence_score="), F.format_string("%.3f", F.col("evidence_score")), F.lit("; sentinel="), F.coalesce(imagery, F.lit("unavailable"))))
    without = F.concat(F.lit("context="), F.col("source_context"), F.lit("; anomaly score unavailable; reason="), F.col("score_status"), F.lit("; "), F.coalesce("score_reason", F.lit("")))
    out = out.withColumn("decision_basis", basis.otherwise(without))
    if "incident_verification" not in events.columns:
        out = out.withColumn("incident_verification", F.lit("unverified"))
    return out.withColumn("score_interpretation", F.lit("A relative order for review, neither a probability of fire nor of damage."))


def provisional(events: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Events with whether they may still grow at ``as_of``."""
    return events.withColumn("provisional", F.timestamp_add("SECOND", F.lit(int(hours * 3600)), F.col("end_time")) > F.lit(as_of).cast("timestamp_ntz"))


def interpretation_summary(events: DataFrame, m: Models) -> DataFrame:
    """(kind, value, n): counts by status, by method, by source context, and by the latter of events at or over the review cutoff."""
    review = (F.col("score_status") == "scored") & (F.col("anomaly_score") >= m.anomaly_percentile)
    kinds = [("score_status", F.col("score_status")), ("score_method", _column(events, "score_method", "string")), ("source_context", F.col("source_context")), ("review_context", F.when(review, F.col("source_context")))]
    rows = events.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds))).alias("x"))
    return rows.select("x.*").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
