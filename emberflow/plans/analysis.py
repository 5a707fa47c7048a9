"""The whole analysis as one composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberflow.config import Settings
from emberflow.operators import context, decision, forest, peers, refresh, scores
from emberflow.operators.clustering import checkpointed
from emberflow.operators.events import cluster_events, discover_sites


def score(events: DataFrame, settings: Settings, isolation: bool = True) -> DataFrame:
    """Events with history, calibrated and fused scores, and peer scores where the site has none."""
    m = settings.models
    out = scores.baselines(scores.prepared(events), m)
    out = scores.calibrated(out, m)
    if isolation:
        out = forest.with_isolation(out, m)
    return peers.score_peers(checkpointed(scores.fused(out)), settings.peers, settings.area)


def run(detections: DataFrame, facilities: DataFrame, settings: Settings, as_of: str, landcover: DataFrame | None = None, imagery: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, events, sites) from clean detections; ``landcover`` has the land-cover columns and ``imagery``
    the sentinel_* columns by event_id."""
    rows, events = cluster_events(detections, settings)
    events, sites = discover_sites(events, settings)
    near = context.nearest_facility(events, facilities)
    events = events.join(near, "event_id")
    if landcover is not None:
        events = events.join(landcover, "event_id", "left")
    else:
        from pyspark.sql import functions as F

        events = events.withColumns({"worldcover_dominant": F.lit(None).cast("string"), "worldcover_coverage": F.lit(0.0), **{c: F.lit(None).cast("double") for c in ("vegetation_fraction", "built_fraction", "bare_fraction")}})
    events = context.assign_context(events, settings.context)
    events = score(events, settings)
    events = decision.decide(events, settings.models) if imagery is None else refresh.evidence(events, imagery, settings.models)
    events = decision.provisional(events, as_of, settings.models.event_temporal_hours)
    return rows.join(events.select("event_id", "site_id", "decision"), "event_id", "left"), events, sites
