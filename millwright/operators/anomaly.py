"""Weak labels, robust envelopes, deviation scores, lead time and event precision / recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.timex import US_PER_HOUR, US_PER_MIN, half_up, hours, us
from .scan import asof, attach, ewma, in_any_interval, percentiles, range_max, rank_share, row_blocks, row_index, slice_seconds

MAD_SCALE = 1.4826
MIN_FIT = 20


def label_windows(stops: DataFrame, alerts: DataFrame) -> DataFrame:
    """Unplanned, non-offline stops and alarms; only ever used to validate or to exclude from fitting."""
    s = stops.where(~F.col("is_planned") & ~rules.is_offline_reason("display_text")).select(
        "machine", "started_on", "ended_on", F.lit("stoppage").alias("source"),
        F.col("display_text").alias("label_text"), hours("duration_milliseconds").alias("dur_h"),
    )
    end = F.col("ended_on") if "ended_on" in alerts.columns else F.lit(None)
    a = alerts.select(
        "machine", "started_on", end.cast("timestamp").alias("ended_on"), F.lit("alert").alias("source"),
        F.trim("value").alias("label_text"), hours("duration_milliseconds").alias("dur_h"),
    )
    return s.unionByName(a).dropna(subset=["machine", "started_on"])


def offline_windows(stops: DataFrame, status: DataFrame) -> DataFrame:
    """Connectivity windows; instance outages carry no machine and apply to every machine."""
    s = stops.where(rules.is_offline_reason("display_text")).select(
        "machine", "started_on", "ended_on", F.lit("stoppage_offline").alias("source"),
        F.lit(None).cast("string").alias("instance_id"),
    )
    t = status.where(~F.col("is_online")).select(
        F.lit(None).cast("string").alias("machine"), "started_on", "ended_on",
        F.lit("status_offline").alias("source"), "instance_id",
    )
    return s.unionByName(t).dropna(subset=["started_on"])


def flag_intervals(rows: DataFrame, windows: DataFrame, *, ts: str = "ts", out: str = "inside", everyone: bool = True) -> DataFrame:
    """Point-in-any-window flag; windows without a machine apply to all (swept by time slice alone, in finer slices)."""
    own = in_any_interval(
        rows, windows.where(F.col("machine").isNotNull()), ["machine"], us(ts), us("started_on"), us("ended_on"), out="__own"
    )
    if not everyone:
        return own.withColumnRenamed("__own", out)
    fine = max(1, slice_seconds(rows, None) // 24)
    both = in_any_interval(
        own, windows.where(F.col("machine").isNull()), [], us(ts), us("started_on"), us("ended_on"), slice_s=fine, out="__all"
    )
    return both.withColumn(out, F.col("__own") | F.col("__all")).drop("__own", "__all")


def drop_intervals(rows: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    return flag_intervals(rows, windows, ts=ts, out="__hit").where(~F.col("__hit")).drop("__hit")


def melt(grid: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("machine", "ts")) -> DataFrame:
    """One row per feature value; absent values stay as NULL rows (their position matters to the EWMA)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return grid.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) AS (feature, value)"))


def fit_envelopes(
    grid: DataFrame, columns: Sequence[str], exclude: DataFrame | str | None = None, *, running_only: bool = True
) -> DataFrame:
    """Median, robust sigma and 5/95 % bounds per (machine, feature) from clean buckets, 20 at least.

    `exclude` is a frame of windows, or the name of a flag column already on the grid.
    """
    clean = grid.where(~F.coalesce(F.col("is_offline"), F.lit(False)))
    if running_only:
        clean = clean.where(~F.coalesce(F.col("is_idle"), F.lit(False)))
    if isinstance(exclude, str):
        clean = clean.where(~F.col(exclude))
    elif exclude is not None:
        clean = drop_intervals(clean, exclude)
    keys = ["machine", "feature"]
    long = melt(clean, columns, ("machine",)).where(F.col("value").isNotNull())
    q = percentiles(long, keys, "value", {"median": 0.5, "q05": 0.05, "q95": 0.95}, count="n_fit")
    q = q.where(F.col("n_fit") >= MIN_FIT)
    dev = long.join(q.select(*keys, "median"), keys).withColumn("ad", F.abs(F.col("value") - F.col("median")))
    mad = percentiles(dev, keys, "ad", {"mad": 0.5})
    sd = dev.groupBy(*keys).agg(F.stddev_samp("value").alias("sd"))
    j = q.join(mad, keys).join(sd, keys)
    robust = F.col("mad") * MAD_SCALE
    sigma = F.when(robust > 1e-9, robust).when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)
    return j.select(*keys, "median", sigma.alias("sigma"), "q05", "q95", "n_fit")


def deviations(grid: DataFrame, envelopes: DataFrame, columns: Sequence[str], alpha: float = 0.05, *, block: int = 4096) -> DataFrame:
    """Point and drift deviation of every bucket and fitted feature; dev_score is the larger magnitude."""
    numbered = row_index(grid.select("machine", "ts", *columns), ["machine"], "ts")
    long = melt(numbered, columns, ("machine", "ts", "rn")).join(
        envelopes.select("machine", "feature", "median", "sigma"), ["machine", "feature"]
    )
    e = ewma(long, ["machine", "feature"], "rn", "value", alpha, block=block)
    rz = (F.col("value") - F.col("median")) / F.col("sigma")
    ez = (F.col("ewma") - F.col("median")) / F.col("sigma")
    return e.select(
        "machine", "ts", "feature", "value", rz.alias("robust_z"), ez.alias("ewma_z"),
        F.when(rz.isNotNull() & ez.isNotNull(), F.greatest(F.abs(rz), F.abs(ez))).alias("dev_score"),
    )


def machine_scores(dev: DataFrame, top: int = 3) -> DataFrame:
    """95th percentile over a bucket's features (a handful), ranked to 0..100 per machine, with the top features."""
    item = F.when(
        F.col("dev_score").isNotNull(),
        F.struct(F.col("dev_score"), F.col("feature"), F.when(F.col("robust_z") >= 0, "up").otherwise("down").alias("direction")),
    )
    g = dev.groupBy("machine", "ts").agg(
        F.percentile("dev_score", F.lit(0.95)).alias("score_raw"),
        F.slice(F.sort_array(F.collect_list(item), asc=False), 1, top).alias("t"),
    )
    roles = F.transform(
        F.col("t"),
        lambda x: F.struct(x["feature"].alias("role"), half_up(x["dev_score"], 3).alias("dev_score"), x["direction"].alias("direction")),
    )
    ranked = rank_share(g.withColumn("top_roles", roles).drop("t"), ["machine"], "score_raw", steps=64)
    return ranked.select("machine", "ts", "score_raw", half_up(F.col("pct") * 100, 2).alias("score_baseline"), "top_roles")


def fuse(grid: DataFrame, baseline: DataFrame, recon: DataFrame | None = None) -> DataFrame:
    """Scores on the grid: the larger of the available detectors."""
    out = grid.select("machine", "ts", "is_idle", "is_offline").join(
        baseline.select("machine", "ts", "score_baseline", "top_roles"), ["machine", "ts"], "left"
    )
    if recon is not None:
        r = rank_share(recon, ["machine"], "recon_err", steps=64)
        out = out.join(r.select("machine", "ts", (F.col("pct") * 100).alias("score_ae"), "per_feature_err"), ["machine", "ts"], "left")
    else:
        out = out.withColumn("score_ae", F.lit(None).cast("double"))
    return out.withColumn("transferred", F.lit(False)).withColumn("score", F.greatest("score_baseline", "score_ae"))


def lead_time(scores: DataFrame, labels: DataFrame, thresh: float, horizon_min: int = 360, score: str = "score") -> DataFrame:
    """Minutes from the earliest crossing inside [event - horizon, event] to the event; NULL is a miss.

    The earliest crossing of the window is simply the first one at or after its lower end.
    """
    hot = scores.where(F.col(score) >= thresh).select("machine", us("ts").alias("__t"))
    t = us("started_on")
    hit = asof(labels, hit_frame(hot), ["machine"], t - horizon_min * US_PER_MIN, F.col("__t"), [], direction="forward", out="__x")
    first = F.when(F.col("__x.t") <= t, F.col("__x.t"))
    return hit.select(*labels.columns, ((t - first) / float(US_PER_MIN)).alias("lead_time_min"))


def hit_frame(hot: DataFrame) -> DataFrame:
    """One row per instant is enough to look instants up."""
    return hot.groupBy("machine", "__t").agg(F.lit(1).alias("one"))


def event_pr(
    scores: DataFrame, labels: DataFrame, thresholds: Sequence[float] | None = None, match_min: int = 30, score: str = "score"
) -> DataFrame:
    """Precision of flagged buckets and recall of events over several thresholds, in one pass each.

    Whether an event follows a bucket, and the highest score before an event, do not depend on the
    threshold; both are computed once and then compared with every threshold in one aggregation.
    """
    levels = [50 + i * 49 / 9 for i in range(10)] if thresholds is None else list(thresholds)
    span = match_min * US_PER_MIN
    starts = labels.select("machine", us("started_on").alias("__s"))
    known = starts.groupBy("machine").agg(F.lit(1).alias("x"))
    sc = scores.select("machine", "ts", F.col(score).alias("s")).join(known, "machine", "left_semi")
    buckets = asof(sc, starts, ["machine"], us("ts"), F.col("__s"), [], direction="forward", tolerance_us=span, out="ev")
    events = range_max(starts, scores, ["machine"], F.col("__s"), us("ts"), F.col(score), span, strict=False, out="best")
    n = len(levels)
    pos = buckets.agg(
        *[F.count_if(F.col("s") >= x).alias(f"f{i}") for i, x in enumerate(levels)],
        *[F.count_if((F.col("s") >= x) & F.col("ev").isNotNull()).alias(f"t{i}") for i, x in enumerate(levels)],
    )
    rec = events.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("best") >= x).alias(f"m{i}") for i, x in enumerate(levels)]
    )
    wide = attach(pos, rec)
    parts = ", ".join(f"CAST({x!r} AS DOUBLE), f{i}, t{i}, m{i}" for i, x in enumerate(levels))
    long = wide.select("total", F.expr(f"stack({n}, {parts}) AS (thresh, flags, tp, matched)"))
    return long.select(
        half_up("thresh", 1).alias("thresh"), F.try_divide(F.col("tp"), F.col("flags")).alias("precision"),
        F.try_divide(F.col("matched"), F.col("total")).alias("recall"), "flags",
    )


def summary(scores: DataFrame, labels: DataFrame, offline: DataFrame, thresh: float = 90.0, score: str = "score") -> DataFrame:
    """Per labelled machine: events, median lead and share of events warned, offline buckets removed."""
    lt = lead_time(drop_intervals(scores, offline), labels, thresh, score=score)
    g = lt.groupBy("machine").agg(
        F.count(F.lit(1)).alias("n_events"),
        half_up(F.avg(F.col("lead_time_min").isNotNull().cast("double")) * 100, 1).alias("pct_with_warning"),
    )
    med = percentiles(lt, ["machine"], "lead_time_min", {"m": 0.5})
    return g.join(med, "machine", "left").select("machine", "n_events", half_up("m", 1).alias("median_lead_min"), "pct_with_warning")


def signature(scores: DataFrame, incidents: DataFrame, key: str, *, before_min: int = 30, after_min: int = 10, top: int = 5) -> DataFrame:
    """Mean deviation and majority direction per role around each incident (`at` column), strongest first."""
    lo, hi = us("at") - before_min * US_PER_MIN, us("at") + after_min * US_PER_MIN
    w = incidents.select(key, "machine", lo.alias("w0"), hi.alias("w1"))
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("w0") / US_PER_HOUR), F.floor(F.col("w1") / US_PER_HOUR))))
    s = scores.select("machine", us("ts").alias("t"), F.explode("top_roles").alias("r"))
    s = s.withColumn("bin", F.floor(F.col("t") / US_PER_HOUR))
    hit = w.join(s, ["machine", "bin"]).where("t >= w0 AND t <= w1")
    g = hit.groupBy(key, F.col("r.role").alias("role")).agg(
        half_up(F.avg("r.dev_score"), 2).alias("dev"), F.count_if(F.col("r.direction") == "up").alias("up"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("dev") > 0.05)
    direction = F.when(F.col("up") * 2 >= F.col("n"), "up").otherwise("down")
    pos = F.row_number().over(Window.partitionBy(key).orderBy(F.col("dev").desc(), F.col("role")))
    return g.select(key, "role", "dev", direction.alias("direction"), pos.alias("position")).where(
        F.col("position") <= top
    )


def zscores(grid: DataFrame, envelopes: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Clipped standard scores (NULL as 0); a feature without envelope falls back to its own median and deviation."""
    long = melt(grid, columns, ("machine",)).where(F.col("value").isNotNull())
    keys = ["machine", "feature"]
    own = percentiles(long, keys, "value", {"m": 0.5}).join(long.groupBy(*keys).agg(F.stddev_pop("value").alias("sd")), keys)
    e = envelopes.select(*keys, F.col("median").alias("em"), F.col("sigma").alias("es"))
    st = own.join(e, keys, "left").select(
        *keys, F.coalesce("em", "m").alias("c"),
        F.coalesce("es", F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)).alias("s"),
    )
    wide = st.groupBy("machine").agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("c", "s"))).alias(f"__{c}") for c in columns]
    )
    j = grid.join(wide, "machine", "left")

    def z(c: str) -> Column:
        v = (F.col(c).cast("double") - F.col(f"__{c}.c")) / F.col(f"__{c}.s")
        return F.coalesce(F.greatest(F.least(v, F.lit(10.0)), F.lit(-10.0)), F.lit(0.0))

    return j.select("machine", "ts", "is_offline", *keep, F.array(*[z(c) for c in columns]).alias("z"))


def sliding_windows(z: DataFrame, labels: DataFrame | str | None = None, *, length: int = 30, stride: int = 5, block: int = 4096) -> DataFrame:
    """Windows of `length` consecutive rows every `stride` rows: end instant, matrix row by row, normal flag."""
    rows = z.withColumn("bad", F.coalesce(F.col("is_offline"), F.lit(False)))
    if isinstance(labels, str):
        rows = rows.withColumn("bad", F.col("bad") | F.col(labels))
    elif labels is not None:
        rows = flag_intervals(rows, labels, out="__lab").withColumn("bad", F.col("bad") | F.col("__lab")).drop("__lab")
    numbered = row_index(rows, ["machine"], "ts")
    b = row_blocks(numbered, "rn", max(block, length), length)
    w = Window.partitionBy("machine", "__b").orderBy("rn").rowsBetween(1 - length, 0)
    full = b.select(
        "machine", "ts", "rn", "__own", F.flatten(F.collect_list("z").over(w)).alias("x"),
        F.max("bad").over(w).alias("any_bad"),
    )
    keep = (F.col("rn") >= length) & (F.pmod(F.col("rn") - length, F.lit(stride)) == 0)
    return full.where(F.col("__own") & keep).select("machine", "ts", "x", (~F.col("any_bad")).alias("is_normal"))


def recon_scores(windows: DataFrame, columns: Sequence[str], k: int = 8, length: int = 30) -> DataFrame:
    """Reconstruction error of a linear bottleneck fitted on normal windows only.

    A principal-component projection is the optimal linear autoencoder of that width. Nothing is
    scored unless at least ten normal windows exist.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = windows.withColumn("v", array_to_vector("x"))
    normal = vec.where("is_normal")
    d = len(columns)
    schema_err = "array<double>"
    if normal.limit(10).count() < 10:
        empty = F.lit(None).cast("double")
        return windows.where(F.lit(False)).select("machine", "ts", empty.alias("recon_err"), F.lit(None).cast("map<string,double>").alias("per_feature_err"))
    model = PCA(k=min(k, d * length), inputCol="v", outputCol="p").fit(normal)
    pc = model.pc.toArray()
    proj = model.transform(vec).withColumn("p", vector_to_array("p"))
    # the loading matrix has length * features x k entries: a model constant, not data
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in pc])
    hat = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    err = F.zip_with(F.col("x"), hat, lambda a, b: (a - b) * (a - b)).cast(schema_err)
    e = proj.select("machine", "ts", err.alias("e"))

    def feature_error(j: int) -> Column:
        mine = F.filter(F.col("e"), lambda v, i: i % d == j)
        return F.aggregate(mine, F.lit(0.0), lambda s, v: s + v) / float(length)

    per = F.array(*[feature_error(j) for j in range(d)])
    e = e.withColumn("per", per)
    total = F.aggregate(F.col("per"), F.lit(0.0), lambda s, v: s + v) / float(d)
    return e.select(
        "machine", "ts", total.alias("recon_err"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.transform("per", lambda v: half_up(v, 4))).alias("per_feature_err"),
    )
