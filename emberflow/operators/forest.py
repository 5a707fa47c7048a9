"""Isolation forest on past z-scores, refitted as time goes on; each score only uses what had ended before its day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.config import Models
from emberflow.operators.scores import FEATURES, STRATUM


def average_path(n: np.ndarray | int) -> np.ndarray:
    """The expected path of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random cuts on random samples; the score is 2 ** (-mean depth / expected depth).

    All trees grow together, level by level, in heap order: the children of node i are 2i + 1 and 2i + 2.
    """

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        m = self.sample = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(m, 2)))))
        rows = x[np.argsort(rng.random((trees, len(x))), axis=1)[:, :m]].reshape(trees * m, -1)
        tree = np.repeat(np.arange(trees), m)
        shape = (trees, (2 << self.depth) - 1)
        self.feature, self.cut, self.length = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        node = np.zeros(trees * m, int)
        live = np.arange(trees * m)
        for level in range(self.depth + 1):
            if not len(live):
                break
            key = tree[live] * shape[1] + node[live]
            live = live[np.argsort(key, kind="stable")]
            key = tree[live] * shape[1] + node[live]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([start, [len(key)]]))
            low, high = np.minimum.reduceat(rows[live], start), np.maximum.reduceat(rows[live], start)
            varying = high > low
            split = (count > 1) & varying.any(1) & (level < self.depth)
            t, i = tree[live[start]], node[live[start]]
            self.length[t, i] = level + average_path(count)
            f = np.where(varying, rng.random(varying.shape), -1.0).argmax(1)
            k = np.arange(len(start))
            c = low[k, f] + rng.random(len(start)) * (high[k, f] - low[k, f])
            self.feature[t[split], i[split]], self.cut[t[split], i[split]] = f[split], c[split]
            of = np.repeat(k, count)
            goes = split[of]
            live, of = live[goes], of[goes]
            node[live] = 2 * node[live] + 1 + (rows[live, f[of]] > c[of])

    def score(self, x: np.ndarray) -> np.ndarray:
        t, n = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), int)
        for _ in range(self.depth):
            f = self.feature[t, at]
            at = np.where(f >= 0, 2 * at + 1 + (x[n, np.maximum(f, 0)] > self.cut[t, at]), at)
        mean = self.length[t, at].mean(1)
        return 2.0 ** (-mean / max(float(average_path(self.sample)), 1e-9))


def _scored(pdf: pd.DataFrame, m: Models) -> pd.DataFrame:
    pdf = pdf.sort_values(["start_time", "event_id"], kind="stable").reset_index(drop=True)
    z = pdf[[f"past_z_{f}" for f in FEATURES]].to_numpy(float)
    x = np.concatenate([np.nan_to_num(np.clip(z, -20, 20)), np.isnan(z).astype(float)], 1)
    day = pdf["start_time"].dt.floor("D")
    started, ended, fit = pdf["start_time"].to_numpy(), pdf["end_time"].to_numpy(), pdf["fit_eligible"].to_numpy(bool)
    out = pdf[["event_id"]].assign(isolation_anomaly_raw=np.nan, isolation_anomaly_percentile=np.nan, isolation_training_events=0, isolation_training_end=pd.NaT)
    model = fitted = ranks = None
    for d, test in pdf.groupby(day).groups.items():
        past = fit & (ended < d.to_datetime64()) & (started >= (d - pd.Timedelta(days=m.history_window_days)).to_datetime64())
        n = int(past.sum())
        if n < max(m.min_calibration_events, m.isolation_min_training_events):
            continue
        if model is None or (d - fitted).days >= m.isolation_refit_days:
            rows = np.flatnonzero(past)[-m.isolation_max_training_events :]
            model = IsolationForest(x[rows], m.isolation_trees, seed=m.random_state)
            ranks, fitted, size, until = np.sort(model.score(x[rows])), d, len(rows), pdf["end_time"].iloc[rows].max()
        raw = model.score(x[test])
        out.loc[test, "isolation_anomaly_raw"] = raw
        out.loc[test, "isolation_anomaly_percentile"] = (np.searchsorted(ranks, raw, "left") + np.searchsorted(ranks, raw, "right") + 1) / (2 * (len(ranks) + 1))
        out.loc[test, "isolation_training_events"] = size
        out.loc[test, "isolation_training_end"] = until
    return out


SCHEMA = "event_id {0}, isolation_anomaly_raw double, isolation_anomaly_percentile double, isolation_training_events bigint, isolation_training_end timestamp_ntz"


def isolation_scores(events: DataFrame, m: Models) -> DataFrame:
    """(event_id, isolation_*) of events with a raw score and a known phase, by sensor and phase.

    The refits of a stratum follow one another in time, so a stratum is one group: strata are as many as sensors and phases,
    and a row is eight doubles. Only the models' training is capped, by ``isolation_max_training_events``.
    """
    valid = F.col("robust_anomaly_raw").isNotNull() & (F.col("model_daynight") != "unknown")
    rows = events.where(valid).select("event_id", *STRATUM, "start_time", "end_time", "fit_eligible", *(f"past_z_{f}" for f in FEATURES))
    kind = events.schema["event_id"].dataType.simpleString()
    return rows.groupBy(*STRATUM).applyInPandas(lambda pdf: _scored(pdf, m), SCHEMA.format(kind))


def with_isolation(events: DataFrame, m: Models) -> DataFrame:
    out = events.join(isolation_scores(events, m), "event_id", "left")
    return out.withColumn("isolation_training_events", F.coalesce("isolation_training_events", F.lit(0)))
