"""Implausible readings in measurement series: a hidden Markov model per series.

States are normal, spike, stuck and out-of-range. What a normal reading looks like is taken from the series itself:
a running median (which follows daily cycles, drift and lasting changes of level) and the robust spread around it,
both re-estimated without the readings that a first pass finds odd. Hard bounds (possible values of the metric, length
of a run and share of repeats of the series) enter the emissions of the states out-of-range and stuck; forward-backward
gives the probability of each state at each reading, which assigns the flags.

Series are cut into blocks of time with a margin on both sides where one is very long, so that a series holding a
third of all rows is spread over tasks, and a task reads its sorted rows as a stream in bounded pieces. What describes a
series is taken over the whole of it all the same: runs and repeats before (the runs at the ends of blocks are joined),
the spread of its normal readings in a pass of its own over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

#: Readings in a block of a long series, and those of a piece that is held in memory; margin in readings.
BLOCK_READINGS, PIECE_READINGS, MARGIN = 4_000, 20_000, 64
#: Half width of the running median, spread at which a lone reading is as likely a spike as normal, stuck run.
HALF, THRESHOLD, STUCK_RUN = 4, 6.3, 8

#: Possible values of a metric: (least, most); others must only be finite.
BOUNDS = {"completeness": (0.0, 1.0), "validity": (0.0, 1.0), "consistency": (0.0, 1.0), "quality": (0.0, 1.0), "row_count": (0.0, np.inf), "lag_seconds": (0.0, np.inf)}

NORMAL, SPIKE, STUCK, RANGE = range(4)
STATES = ["normal", "spike", "stuck", "out_of_range"]
_STEP = np.log(np.array([[0.985, 0.006, 0.004, 0.005], [0.50, 0.44, 0.03, 0.03], [0.10, 0.01, 0.88, 0.01], [0.60, 0.05, 0.02, 0.33]]))
_START = np.log(np.array([0.98, 0.01, 0.005, 0.005]))
_NEVER = -60.0
_FLAT = -(THRESHOLD**2) / 2 - 0.919 + 2 * np.log(0.985) - np.log(0.006 * 0.5)


def running_median(v: np.ndarray, half: int = HALF) -> np.ndarray:
    """Median of the finite values within ``half`` readings; of the whole series where none is near."""
    padded = np.concatenate([np.full(half, np.nan), v, np.full(half, np.nan)])
    w = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
    n = np.isfinite(w).sum(axis=1)
    rows = np.arange(len(v))
    mid = (w[rows, np.maximum(n - 1, 0) // 2] + w[rows, np.minimum(n // 2, 2 * half)]) / 2
    rest = v[np.isfinite(v)]
    return np.where(n > 0, mid, np.median(rest) if len(rest) else 0.0)


def _spread(residual: np.ndarray, steps: np.ndarray, level: float) -> float:
    """Robust spread of normal readings; never less than the grid that a coarse series moves on."""
    if not len(residual):
        return 1.0
    a = np.abs(residual)
    moved = steps[steps > 0]
    coarse = len(moved) < 0.5 * max(1, len(steps))
    grid = 0.75 * float(np.median(moved)) if coarse and len(moved) else 0.0
    return max(1.4826 * float(np.median(a)), float(np.quantile(a, 0.9)) / 1.645, grid, 1e-7 * abs(level), 1e-12)


def forward_backward(emit: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Posterior of each state for a batch of padded series: ``emit`` is (series, readings, states) in logs."""
    n, t, k = emit.shape
    alpha = np.empty_like(emit)
    alpha[:, 0] = _START + emit[:, 0]
    for i in range(1, t):
        a = alpha[:, i - 1, :, None] + _STEP
        top = a.max(axis=1)
        alpha[:, i] = np.log(np.exp(a - top[:, None]).sum(axis=1)) + top + emit[:, i]
        alpha[:, i] -= alpha[:, i].max(axis=1, keepdims=True)
    beta = np.zeros_like(emit)
    for i in range(t - 2, -1, -1):
        b = _STEP + (emit[:, i + 1] + beta[:, i + 1])[:, None, :]
        top = b.max(axis=2)
        nxt = np.log(np.exp(b - top[:, :, None]).sum(axis=2)) + top
        nxt -= nxt.max(axis=1, keepdims=True)
        beta[:, i] = np.where(valid[:, i + 1, None], nxt, 0.0)
    post = alpha + beta
    post = np.exp(post - post.max(axis=2, keepdims=True))
    return post / post.sum(axis=2, keepdims=True)


def _runs(v: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each reading belongs to."""
    if not len(v):
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])
    return np.repeat(np.diff(edge), np.diff(edge))


def _emissions(v: np.ndarray, bad: np.ndarray, odd: np.ndarray, stuck: np.ndarray, fixed: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, float]:
    good = np.where(bad | odd, np.nan, v)
    base = running_median(good)
    kept = good[np.isfinite(good)]
    resid = np.where(bad, 0.0, v - base)
    same = np.r_[False, v[1:] == v[:-1]] & ~bad
    if fixed:
        spread, rate = fixed
    else:
        spread = _spread(resid[np.isfinite(good)], np.abs(np.diff(kept)), float(np.median(kept)) if len(kept) else 0.0)
        rate = float(same.mean()) if len(same) else 0.0
    rate = min(0.95, max(0.02, rate))
    z = resid / spread
    repeat = np.where(same, np.log(rate), np.log(1 - rate))
    emit = np.full((len(v), 4), _NEVER)
    emit[:, NORMAL] = -0.5 * np.minimum(z * z, 240.0) - 0.919 + repeat
    emit[:, SPIKE] = _FLAT + repeat
    emit[stuck] = [2 * _NEVER, 2 * _NEVER, 0.0, 2 * _NEVER]
    emit[bad] = [2 * _NEVER, 2 * _NEVER, 2 * _NEVER, 0.0]
    return emit, base, spread


def stuck_readings(v: np.ndarray) -> np.ndarray:
    """Readings of a whole series in runs of ``STUCK_RUN`` or more where fewer than half of the other readings repeat."""
    runs = _runs(v)
    same = np.r_[False, v[1:] == v[:-1]]
    out = np.zeros(len(v), bool)
    for length in np.unique(runs[runs >= STUCK_RUN]):
        others = len(v) - length
        if others > 0 and (same.sum() - (length - 1)) / others < 0.5:
            out |= runs == length
    return out


def judge(series: list[tuple[str, np.ndarray]], stuck: list[np.ndarray] | None = None, fixed: list[tuple[float, float] | None] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(state, probability that it is odd, baseline, spread) for each series of (metric, values in time order, no nulls).

    ``stuck`` tells which readings are stuck, ``fixed`` the spread and the share of repeats, where the values are only a
    part of their series.
    """
    bads = []
    for metric, v in series:
        lo, hi = BOUNDS.get((metric or "").strip().lower(), (-np.inf, np.inf))
        with np.errstate(invalid="ignore"):
            bads.append(~np.isfinite(v) | (v < lo) | (v > hi))
    held = [s & ~b for s, b in zip(stuck or [stuck_readings(v) for _, v in series], bads)]
    odds = [np.zeros(len(v), bool) for _, v in series]
    longest = max((len(v) for _, v in series), default=0)
    valid = np.zeros((len(series), longest), bool)
    for _ in range(3):
        emit = np.zeros((len(series), longest, 4))
        fits = []
        for k, (_, v) in enumerate(series):
            e, base, spread = _emissions(v, bads[k], odds[k], held[k], fixed[k] if fixed else None)
            emit[k, : len(v)], valid[k, : len(v)] = e, True
            fits.append((base, spread))
        post = forward_backward(emit, valid) if longest else emit
        odds = [post[k, : len(v), SPIKE] > 0.5 for k, (_, v) in enumerate(series)]
    out = []
    for k, (_, v) in enumerate(series):
        p = post[k, : len(v)]
        far = np.abs(np.where(bads[k], 0.0, v - fits[k][0])) > THRESHOLD * fits[k][1]
        likely = p.argmax(axis=1)
        state = np.where((likely == STUCK) | (likely == RANGE), likely, np.where((p[:, SPIKE] > 0.5) | (far & (p[:, NORMAL] < 0.5)), SPIKE, NORMAL))
        out.append((state, 1 - p[:, NORMAL], *fits[k]))
    return out


_OUT = "_anomaly_id string, _source_id string, _metric string, _detected_at timestamp, _value double, _baseline double, _stddev double, probability double, state string"


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Groups (series, block) of the sorted stream, in pieces of bounded length with a margin; mask of rows to report."""
    held, carried = [], 0

    def cut(final: bool):
        nonlocal held, carried
        g = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        report = ~g["margin"].to_numpy()
        report[:carried] = False
        if final:
            held, carried = [], 0
            return g, report
        report[len(g) - MARGIN :] = False
        start = max(0, len(g) - 2 * MARGIN)
        held, carried = [g.iloc[start:]], len(g) - MARGIN - start
        return g, report

    last = None
    for f in frames:
        if not len(f):
            continue
        key = f["group"].to_numpy()
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(edge[:-1], edge[1:]):
            if held and key[a] != last:
                yield cut(True)
            held.append(f.iloc[a:b])
            last = key[a]
            if sum(map(len, held)) >= max(PIECE_READINGS, 4 * MARGIN):
                yield cut(False)
    if held:
        yield cut(True)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[pd.DataFrame, np.ndarray]]]:
    """Pieces in batches that forward-backward takes together."""
    batch: list = []
    for piece in _pieces(frames):
        batch.append(piece)
        if len(batch) >= 64 or sum(len(g) for g, _ in batch) >= PIECE_READINGS:
            yield batch
            batch = []
    if batch:
        yield batch


def _judged(batch: list[tuple[pd.DataFrame, np.ndarray]]):
    def fixed(g: pd.DataFrame) -> tuple[float, float] | None:
        spread, rate = g["fit_spread"].iloc[0], g["fit_rate"].iloc[0]
        return None if np.isnan(spread) else (float(spread), float(rate))

    values = [g["_value"].to_numpy(dtype=np.float64) for g, _ in batch]
    stuck = [stuck_readings(v) if pd.isna(g["stuck"].iloc[0]) else g["stuck"].to_numpy(dtype=bool) for v, (g, _) in zip(values, batch)]
    return judge([(g["_metric"].iloc[0], v) for v, (g, _) in zip(values, batch)], stuck, [fixed(g) for g, _ in batch])


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _batches(frames):
        rows = []
        for (g, mask), (state, prob, base, spread) in zip(batch, _judged(batch)):
            o = g.loc[mask, ["_anomaly_id", "_source_id", "_metric", "_detected_at", "_value"]].copy()
            o["_baseline"], o["_stddev"], o["probability"] = base[mask], spread, prob[mask]
            o["state"] = np.array(STATES, object)[state[mask]]
            rows.append(o)
        yield pd.concat(rows, ignore_index=True)


_FIT = "series string, resid double, step double, level double"


def _residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distance of each normal reading to the baseline and to the normal reading before it."""
    for batch in _batches(frames):
        rows = []
        for (g, mask), (state, _, base, _) in zip(batch, _judged(batch)):
            v = g["_value"].to_numpy(dtype=np.float64)
            good = np.flatnonzero((state == NORMAL) | (state == STUCK))
            step = np.abs(np.diff(v[good], prepend=np.nan))
            keep = mask[good]
            rows.append(pd.DataFrame({"series": g["series"].iloc[0], "resid": np.abs(v[good] - base[good])[keep], "step": step[keep], "level": v[good][keep]}))
        yield pd.concat(rows, ignore_index=True)


def _series_spread(ready: DataFrame) -> DataFrame:
    """``series, fit_spread`` over whole series that are cut into blocks."""
    fits = ready.mapInPandas(_residuals, _FIT)
    step = F.when(~F.isnan("step"), F.col("step"))
    moved = F.when(step > 0, step)
    per = fits.groupBy("series").agg(*[F.percentile_approx(c, p, 10_000).alias(n) for n, c, p in (("mid", F.col("resid"), 0.5), ("high", F.col("resid"), 0.9), ("grid", moved, 0.5), ("level", F.col("level"), 0.5))], F.count(moved).alias("n_moved"), F.count(step).alias("n_steps"))
    coarse = F.when(F.col("n_moved") < 0.5 * F.greatest(F.lit(1), F.col("n_steps")), 0.75 * F.col("grid"))
    return per.select("series", F.greatest(1.4826 * F.col("mid"), F.col("high") / 1.645, F.coalesce(coarse, F.lit(0.0)), 1e-7 * F.abs("level"), F.lit(1e-12)).alias("fit_spread"))


def _starts(value: str, before: Column) -> Column:
    """Whether a run begins; NaN equals nothing."""
    return F.coalesce((F.col(value) != before) | F.isnan(value), F.lit(True))


def mark_stuck(placed: DataFrame) -> DataFrame:
    """Adds ``stuck`` and ``fit_rate``, the share of repeats, to rows with ``series`` and ``block``: stuck is what lies in a run of ``STUCK_RUN`` or more, in a series where fewer than half of the other readings repeat."""
    block = Window.partitionBy("series", "block")
    order = block.orderBy("_detected_at", "_anomaly_id")
    runs = placed.withColumn("run", F.sum(_starts("_value", F.lag("_value").over(order)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = materialise(runs.withColumn("length", F.count("*").over(Window.partitionBy("series", "block", "run"))), "runs")
    last = F.max_by(F.struct(F.lit(1).alias("side"), F.col("_value").alias("v"), F.col("length")), "run")
    first = F.min_by(F.struct(F.lit(0).alias("side"), F.col("_value").alias("v"), F.col("length")), "run")
    ends = runs.groupBy("series", "block").agg(F.count("*").alias("n"), F.max("run").alias("n_runs"), first.alias("first"), last.alias("last"))
    ends = ends.select("series", "block", "n", "n_runs", F.inline(F.array_compact(F.array("first", F.when(F.col("n_runs") > 1, F.col("last"))))))
    w = Window.partitionBy("series").orderBy("block", "side")
    ends = ends.withColumn("starts", (F.col("side") == 1) | _starts("v", F.lag("v").over(w)))
    ends = ends.withColumn("joined", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("total", F.sum("length").over(Window.partitionBy("series", "joined")))
    blocks = ends.groupBy("series", "block").agg(F.first("n").alias("n"), F.first("n_runs").alias("n_runs"), F.count_if(~F.col("starts")).alias("n_joins"), *[F.max(F.when(F.col("side") == k, F.col("total"))).alias(x) for k, x in enumerate(("first", "last"))])
    whole = Window.partitionBy("series")
    blocks = blocks.select("series", "block", "n_runs", "first", "last", F.sum("n").over(whole).alias("all"), F.sum(F.col("n_runs") - F.col("n_joins")).over(whole).alias("all_runs"))
    length = F.when(F.col("run") == 1, F.col("first")).when(F.col("run") == F.col("n_runs"), F.col("last")).otherwise(F.col("length"))
    others = F.col("all") - length
    stuck = (length >= STUCK_RUN) & (others > 0) & (2 * (F.col("all") - F.col("all_runs") - (length - 1)) < others)
    return runs.join(blocks, ["series", "block"]).withColumn("stuck", stuck).withColumn("fit_rate", 1 - F.col("all_runs") / F.col("all")).select(*placed.columns, "stuck", "fit_rate")


def flag_readings(readings: DataFrame) -> DataFrame:
    """State of every reading: the columns of ``_OUT``.

    ``_baseline`` and ``_stddev`` are estimated here, whatever the table's own say. Null values are left out (never a
    case), identical rows count once, ties in time are ordered by id, a null source or metric is a series of its own.
    Empty tables give no rows; other columns are not read.
    """
    rows = readings.select("_anomaly_id", "_source_id", "_metric", F.col("_detected_at").cast("timestamp").alias("_detected_at"), F.col("_value").cast("double").alias("_value")).where("_value is not null").distinct()
    at = F.unix_micros("_detected_at")
    series = F.concat_ws("\u0001", F.coalesce("_source_id", F.lit("\u0002")), F.coalesce("_metric", F.lit("\u0002")))
    rows = rows.withColumn("series", series).withColumn("at", F.coalesce(at, F.lit(0)))
    long = materialise(rows.groupBy("series").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).where(F.col("n") > BLOCK_READINGS), "long")
    blocks = F.ceil(F.col("n") / (BLOCK_READINGS / 2))
    wide = long.select("series", "lo", F.greatest(F.lit(1), ((F.col("hi") - F.col("lo")) / blocks).cast("bigint") + 1).alias("width"))

    def sorted_blocks(df: DataFrame) -> DataFrame:
        ready = df.select("_anomaly_id", "_source_id", "_metric", "_detected_at", "_value", "stuck", "fit_rate", "fit_spread", "series", "group", "margin")
        return ready.repartition("group").sortWithinPartitions("group", "_detected_at", "_anomaly_id")

    # a series in one block: its task sees the whole of it and takes runs, repeats and spread there, by the same rules
    number, none = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    short = rows.join(wide.select("series"), "series", "left_anti")
    one = sorted_blocks(short.withColumns({"group": F.col("series"), "margin": F.lit(False), "stuck": none, "fit_rate": number, "fit_spread": number})).mapInPandas(_run, _OUT)
    if long.isEmpty():
        return one
    offset = (F.col("at") - F.col("lo")) / F.col("width")
    placed = mark_stuck(rows.join(wide, "series").withColumn("block", F.floor(offset)))
    block = F.col("block")
    part = offset - block
    edge = 2 * MARGIN / (BLOCK_READINGS / 2)
    own = F.struct(block.alias("block"), F.lit(False).alias("margin"))
    ahead = F.when(part >= 1 - edge, F.struct((block + 1).alias("block"), F.lit(True).alias("margin")))
    behind = F.when(part < edge, F.struct((block - 1).alias("block"), F.lit(True).alias("margin")))
    cut = placed.withColumn("to", F.explode(F.array_compact(F.array(own, ahead, behind)))).withColumns({"group": F.concat_ws("\u0001", "series", F.col("to.block").cast("string")), "margin": F.col("to.margin")})
    fits = materialise(_series_spread(sorted_blocks(cut.withColumn("fit_spread", number))), "fits")
    return one.unionByName(sorted_blocks(cut.join(fits, "series", "left")).mapInPandas(_run, _OUT))
