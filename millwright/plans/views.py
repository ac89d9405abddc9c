"""Frames several registered plans start from, analysed once per data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, dims, events, grid, kpi, predict
from ..session import stage
from ..sources import tables
from .fixtures import Plant

GRID_S = 3600


def _memo(fn):
    def get(p: Plant) -> DataFrame:
        return p.memo(f"view:{fn.__name__}", lambda: fn(p))

    return get


@_memo
def master(p):
    return dims.machine_master(p.unit, p.device, p.monitor_unit)


@_memo
def signals(p):
    return dims.signal_map(p.monitor_reading_def, p.monitor_unit, master(p), p.mes_reading_def)


@_memo
def roles(p):
    return dims.role_uid_map(signals(p))


@_memo
def instances(p):
    return dims.machine_instance(p.mes_reading_def, master(p))


@_memo
def stops(p):
    return events.stoppage_events(p.stops)


@_memo
def alerts(p):
    return events.alert_events(p.alerts)


@_memo
def offline(p):
    return events.offline_events(p.status, instances(p))


@_memo
def base_day(p):
    return kpi.oee_baseline(p.oee_daily, p.unit, 1)


def baseline(p: Plant, level: int | None = 1) -> DataFrame:
    return base_day(p) if level == 1 else kpi.oee_baseline(p.oee_daily, p.unit, level)


@_memo
def readings(p):
    return tables.feature_scan(p.telemetry, roles(p))


@_memo
def outages(p):
    return grid.offline_intervals(p.status, instances(p))


@_memo
def feature_grid(p):
    return stage(grid.feature_grid(readings(p), outages(p), GRID_S), "grid")


@_memo
def unplanned(p):
    return events.unplanned(stops(p))


@_memo
def significant(p):
    return events.unplanned(stops(p), 15.0)


@_memo
def live_grid(p):
    """Grid rows the supervised features are computed on: online and outside significant stops."""
    online = feature_grid(p).where(~F.col("is_offline"))
    return predict.drop_active_stops(online, significant(p))


@_memo
def split_scored(p):
    return predict.chrono_split(p.scored, 0.6, ties=("event_id",))


@_memo
def labels(p):
    return anomaly.label_windows(p.stops, p.alerts)


@_memo
def offline_windows(p):
    return anomaly.offline_windows(p.stops, p.status)


@_memo
def labelled_grid(p):
    """The grid with a flag for buckets inside a labelled incident."""
    return stage(anomaly.flag_intervals(feature_grid(p), labels(p), out="in_label", everyone=False), "labelled")


@_memo
def envelopes(p):
    return stage(anomaly.fit_envelopes(labelled_grid(p), grid.FEATURES, "in_label"), "envelopes")


@_memo
def deviations(p):
    return stage(anomaly.deviations(feature_grid(p), envelopes(p), grid.FEATURES), "deviations")


@_memo
def machine_scores(p):
    return stage(anomaly.machine_scores(deviations(p)), "scores")


@_memo
def scores(p):
    return anomaly.fuse(feature_grid(p), machine_scores(p))


@_memo
def windows30(p):
    z = anomaly.zscores(labelled_grid(p), envelopes(p), grid.FEATURES, keep=("in_label",))
    return anomaly.sliding_windows(z, "in_label")


@_memo
def supervised(p):
    return stage(predict.supervised(feature_grid(p), unplanned(p), ["cycle_time_mean", "run_state_duty"]), "supervised")


@_memo
def split_supervised(p):
    return stage(predict.chrono_split(supervised(p), 0.6), "split")
