"""Column profiles of loads, exact: null rates, distinct counts, ranges, quantiles, patterns, Kolmogorov-Smirnov distances.

Values of all columns are unpivoted and sorted by range: a column of a source is cut into pieces of about
``PIECE_VALUES`` values at its quantiles, and each piece is sorted in one task. Counts per piece and load, summed up
over the preceding pieces, turn positions inside a piece into exact ranks in the whole column, for the load and for
all loads of the source; from those come quantiles, distinct counts and the largest gap between the cumulative curve
of a load and the merged curve of the other loads. Values travel packed: one row holds the distinct values and counts
of a load, column and piece, so a value that a third of all rows share is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

PIECE_VALUES, SALT_ROWS, MAX_SPLITS = 200_000, 50_000, 1_000_000
#: Loads of one piece that are compared in one task; a piece of few values may be shared by very many loads.
PIECE_LOADS = 50_000
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Loads of fewer values do not tell what range and distinct count are usual.
TYPICAL_ROWS = 30
#: Tests against what is usual, which other departing loads do not move.
ROBUST = ("range", "fewer")


@dataclass(frozen=True)
class ProfileSpec:
    """What is profiled: numeric columns (dates as days), text columns, and the pattern a text should match."""

    numeric: tuple[str, ...]
    text: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)


def _shape(values: pa.Array) -> pa.Array:
    """Form of a text: runs of letters and digits by a sign each, what follows an @ in full."""
    local = pc.replace_substring_regex(values, r"@.*$", "")
    rest = pc.replace_substring_regex(values, r"^[^@]*", "")
    local = pc.replace_substring_regex(pc.replace_substring_regex(local, r"\p{L}+", "a"), r"[0-9]+", "9")
    return pc.binary_join_element_wise(local, rest, "")


def _text_hash(values: np.ndarray) -> np.ndarray:
    """Texts have no natural order here; they are sorted by this hash, then by themselves, in however many pieces."""
    return pd.util.hash_array(values, categorize=False)


_PACK = "src string, col string, piece int, load string, nums array<double>, strs array<string>, counts array<int>, n bigint, n_null bigint, n_bad bigint"


def _pack(spec: ProfileSpec, pieces: int, splits: dict[tuple[str, str], list[float]]):
    names = [f.split(" ")[0] for f in _PACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            src, load = b["__src"].to_pylist(), b["__load"].to_pylist()
            where = np.flatnonzero(np.r_[True, [x != y for x, y in zip(load[1:], load[:-1])]])
            group = np.repeat(np.arange(len(where)), np.diff(np.r_[where, len(load)]))
            g_src, g_load = [src[i] for i in where], [load[i] for i in where]
            out: dict[str, list] = {n: [] for n in names}

            def emit(col: str, values: np.ndarray, ok: np.ndarray, piece: np.ndarray, bad: np.ndarray | None, text: bool):
                total = np.bincount(group, minlength=len(where))
                good = np.bincount(group[ok], minlength=len(where))
                wrong = np.bincount(group[ok], weights=bad, minlength=len(where)).astype(np.int64) if bad is not None else np.zeros(len(where), np.int64)
                for g in range(len(where)):
                    for k, v in zip(names, (g_src[g], col, -1, g_load[g], None, None, None, 0, int(total[g] - good[g]), int(wrong[g]))):
                        out[k].append(v)
                if not len(values):
                    return
                v, gi = values, group[ok]
                if text:
                    v, inverse = np.unique(v, return_inverse=True)
                    code = inverse
                else:
                    code = v
                order = np.lexsort((code, piece, gi))
                gs, ps, cs = gi[order], piece[order], code[order]
                new = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (ps[1:] != ps[:-1]) | (cs[1:] != cs[:-1])])
                count = np.diff(np.r_[new, len(order)]).astype(np.int32)
                gs, ps, cs = gs[new], ps[new], cs[new]
                vals = v[cs] if text else cs
                edge = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (ps[1:] != ps[:-1])])
                for a, z in zip(edge, np.r_[edge[1:], len(gs)]):
                    row = (g_src[gs[a]], col, int(ps[a]), g_load[gs[a]], None if text else vals[a:z], vals[a:z].tolist() if text else None, count[a:z], int(count[a:z].sum()), 0, 0)
                    for k, x in zip(names, row):
                        out[k].append(x)

            for c in spec.numeric:
                v = b[c].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                ok = np.isfinite(v)
                piece = np.zeros(int(ok.sum()), np.int32)
                if pieces > 1:
                    for g in np.unique(group[ok]):
                        rows = group[ok] == g
                        piece[rows] = np.searchsorted(splits.get((g_src[g], c), []), v[ok][rows], "right")
                emit(c, v[ok] + 0.0, ok, piece, None, False)
            for c in spec.text:
                trimmed = pc.utf8_trim_whitespace(b[c])
                ok = pc.fill_null(pc.greater(pc.utf8_length(trimmed), 0), False)
                raw = b[c].filter(ok)
                ok = ok.to_numpy(zero_copy_only=False)
                bad = None
                if c in spec.patterns:
                    bad = (~pc.match_substring_regex(raw, spec.patterns[c]).to_numpy(zero_copy_only=False).astype(bool)).astype(float)
                for name, values in ((c, raw), *(((f"{c}#form", _shape(raw)),) if c in spec.patterns else ())):
                    v = np.array(values.to_pylist(), dtype=object)
                    piece = ((_text_hash(v) >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int32) if pieces > 1 and len(v) else np.zeros(len(v), np.int32)
                    emit(name, v, ok, piece, bad if name == c else None, True)
            yield pa.RecordBatch.from_arrays([pa.array(out["src"], pa.string()), pa.array(out["col"], pa.string()), pa.array(out["piece"], pa.int32()), pa.array(out["load"], pa.string()), pa.array(out["nums"], pa.list_(pa.float64())), pa.array(out["strs"], pa.list_(pa.string())), pa.array(out["counts"], pa.list_(pa.int32())), pa.array(out["n"], pa.int64()), pa.array(out["n_null"], pa.int64()), pa.array(out["n_bad"], pa.int64())], names)

    return run


_VALUES = "array<struct<num:double,str:string,count:bigint>>"
_PART = "src string, col string, load string, up double, down double, n_distinct bigint, lo string, hi string, lo_num double, hi_num double, q array<double>"


def _piece(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial results of one piece, or of a group of its loads.

    ``left`` packed rows; ``right`` counts before the piece and totals per load, and for a group of loads a row without
    load that holds the counts of all values of the piece.
    """
    names = [f.split(" ")[0] for f in _PART.split(", ")]
    empty = {n: [] for n in names}
    types = [pa.string()] * 3 + [pa.float64()] * 2 + [pa.int64()] + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.list_(pa.float64())]
    schema = pa.schema(list(zip(names, types)))
    if not left.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, types)}, schema=schema)
    left, right = left.combine_chunks(), right.combine_chunks()
    whole = right.filter(pc.is_null(right["load"]))
    right = right.filter(pc.is_valid(right["load"]))
    text = left["nums"].null_count == left.num_rows
    codes = {x: i for i, x in enumerate(right["load"].to_pylist())}
    lists = left["strs" if text else "nums"]
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    load = np.repeat([codes[x] for x in left["load"].to_pylist()], sizes)
    values = pc.list_flatten(lists)
    values = np.array(values.to_pylist(), dtype=object) if text else values.to_numpy(zero_copy_only=False)
    count = pc.list_flatten(left["counts"]).to_numpy(zero_copy_only=False).astype(np.int64)
    if whole.num_rows:
        every = whole["values"][0].as_py()
        known = np.array([v["str" if text else "num"] for v in every], dtype=object if text else float)
        distinct, place = np.unique(known, return_inverse=True)
        total = np.bincount(place, weights=[v["count"] for v in every], minlength=len(distinct)).astype(np.int64)
        code = np.searchsorted(distinct, values)
    else:
        distinct, code = np.unique(values, return_inverse=True)
        total = None
    if text and len(distinct):
        by_hash = np.argsort(_text_hash(distinct), kind="stable")
        place = np.empty(len(distinct), np.int64)
        place[by_hash] = np.arange(len(distinct))
        distinct, code = distinct[by_hash], place[code]
        total = total[by_hash] if total is not None else None
    key = code.astype(np.int64) * len(codes) + load
    key, back = np.unique(key, return_inverse=True)
    count = np.bincount(back, weights=count).astype(np.int64)
    code, load = key // len(codes), key % len(codes)
    before_load, before_all, n_load, n_all = (right[c].to_numpy() for c in ("before_load", "before_all", "n_load", "n_all"))
    per_value = np.bincount(code, weights=count, minlength=len(distinct)).astype(np.int64) if total is None else total
    upto = np.cumsum(per_value)
    all_le, all_lt = before_all[load] + upto[code], before_all[load] + (upto - per_value)[code]
    order = np.argsort(load, kind="stable")
    lo = np.flatnonzero(np.r_[True, load[order][1:] != load[order][:-1]])
    run = np.cumsum(count[order])
    base = np.repeat(run[lo] - count[order][lo], np.diff(np.r_[lo, len(order)]))
    own = run - base
    ld = load[order]
    le = before_load[ld] + own
    lt = le - count[order]
    nl, others = n_load[ld].astype(float), np.maximum(n_all[ld] - n_load[ld], 1).astype(float)
    alone = n_all[ld] == n_load[ld]
    at = le / nl - (all_le[order] - le) / others
    under = lt / nl - (all_lt[order] - lt) / others
    up = np.where(alone, 0.0, np.maximum(at, under))
    down = np.where(alone, 0.0, np.maximum(-at, -under))
    vals = distinct[code[order]]
    ends = np.r_[lo[1:], len(order)]
    loads = right["load"].to_pylist()
    out = empty
    src, col = left["src"][0].as_py(), left["col"][0].as_py()
    ups, downs = np.maximum.reduceat(up, lo), np.maximum.reduceat(down, lo)
    for i, (a, z) in enumerate(zip(lo, ends)):
        q = None
        if not text:
            ranks = np.ceil(np.array(QUANTILES) * nl[a])
            hit = np.searchsorted(le[a:z], ranks)
            q = [float(vals[a + h]) if h < z - a and lt[a + h] < r else None for h, r in zip(hit, ranks)]
        first, last = (min(vals[a:z]), max(vals[a:z])) if text else (vals[a], vals[z - 1])
        for k, x in zip(names, (src, col, loads[ld[a]], max(ups[i], 0.0), max(downs[i], 0.0), int(z - a), str(first) if text else None, str(last) if text else None, None if text else float(first), None if text else float(last), q)):
            out[k].append(x)
    return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types)}, schema=schema)


def crowded(sized: DataFrame) -> DataFrame:
    """Pieces that more than ``PIECE_LOADS`` loads share, and into how many groups of loads each is split."""
    loads = sized.groupBy("src", "col", "piece").agg(F.count("*").alias("n"))
    return loads.where(F.col("n") > PIECE_LOADS).select("src", "col", "piece", F.ceil(F.col("n") / PIECE_LOADS).cast("int").alias("salts"))


def profile(rows: DataFrame, row_id: str, load: str, source: Column, spec: ProfileSpec) -> DataFrame:
    """One row per load and column.

    Columns: ``src, load, col, n_rows, n_null`` (null, blank or not finite), ``n_distinct, n_bad`` (pattern violated),
    ``lo, hi`` (text) and ``lo_num, hi_num, q`` (numbers, exact quantiles), ``ks`` and ``kuiper`` (distance of the
    load's cumulative curve to that of the source's other loads), and for the other loads ``o_rows, o_null, o_bad,
    o_distinct, o_loads``. What is usual for the source is taken over its loads of ``TYPICAL_ROWS`` values or more so that
    up to a third of bad ones does not move it: ``typ_lo, typ_hi`` (lower and upper third of the loads' ends),
    ``typ_distinct`` and ``typ_least, typ_most`` (thirds of distinct counts and of sizes); ``n_outside`` values of the
    load lie outside ``typ_lo`` to ``typ_hi``. Identical rows count once. Rows without a load are left out. For a text column with a
    pattern a further column ``name#form`` profiles the form of its values.
    """

    def number(c: str) -> Column:
        return (F.unix_date(c) if rows.schema[c].dataType.typeName() == "date" else F.col(c)).cast("double").alias(c)

    base = rows.where(F.col(load).isNotNull()).select(F.coalesce(source, F.lit("?")).alias("__src"), F.col(load).cast("string").alias("__load"), F.xxhash64(row_id).alias("__id"), *[number(c) for c in spec.numeric], *[F.col(c).cast("string").alias(c) for c in spec.text])
    total = rows.count()
    pieces = max(1, -(-total // PIECE_VALUES))
    splits: dict[tuple[str, str], list[float]] = {}
    if pieces > 1:
        sources = base.select("__src").distinct().count()
        pieces = max(1, min(pieces, MAX_SPLITS // max(1, sources * len(spec.numeric))))
        probs = [k / pieces for k in range(1, pieces)]
        cuts = base.groupBy("__src").agg(*[F.percentile_approx(F.when(F.isnan(c), None).otherwise(F.col(c)), probs, 2000).alias(c) for c in spec.numeric])
        for r in cuts.collect():  # at most MAX_SPLITS numbers
            splits.update({(r["__src"], c): sorted(set(r[c] or [])) for c in spec.numeric})
    large = base.groupBy("__load").count().where(F.col("count") > SALT_ROWS).select("__load", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("__salts"))
    salted = base.join(large, "__load", "left").withColumn("__salt", F.pmod("__id", F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    once = salted.repartition("__load", "__salt").distinct().sortWithinPartitions("__load")
    packed = materialise(once.mapInArrow(_pack(spec, pieces, splits), _PACK), "packed")

    sized = packed.where("piece >= 0").groupBy("src", "col", "piece", "load").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("src", "col", "load")
    per_load = sized.select("*", (F.sum("n").over(w.orderBy("piece")) - F.col("n")).alias("before_load"), F.sum("n").over(w).alias("n_load"))
    per_piece = sized.groupBy("src", "col", "piece").agg(F.sum("n").alias("n_piece"), F.count("*").alias("n_loads"))
    wp = Window.partitionBy("src", "col")
    per_piece = per_piece.select("src", "col", "piece", (F.sum("n_piece").over(wp.orderBy("piece")) - F.col("n_piece")).alias("before_all"), F.sum("n_piece").over(wp).alias("n_all"))
    counts = per_load.join(per_piece, ["src", "col", "piece"]).select("src", "col", "piece", "load", "before_load", "before_all", "n_load", "n_all").toDF("src_", "col_", "piece_", "load", "before_load", "before_all", "n_load", "n_all")
    keys = ["src", "col", "piece"]
    left = packed.where("piece >= 0").select(*keys, "load", "nums", "strs", "counts").withColumn("salt", F.lit(0))
    right = counts.withColumn("salt_", F.lit(0)).withColumn("values", F.lit(None).cast(_VALUES))
    shared = crowded(sized).collect()  # one row per PIECE_LOADS loads of a piece at most
    if shared:
        hot = F.broadcast(packed.sparkSession.createDataFrame([tuple(r) for r in shared], "src string, col string, piece int, salts int"))
        totals = left.join(hot, keys).select(*keys, "salts", F.explode(F.arrays_zip(F.coalesce("nums", F.array_repeat(F.lit(None).cast("double"), F.size("counts"))).alias("num"), F.coalesce("strs", F.array_repeat(F.lit(None).cast("string"), F.size("counts"))).alias("str"), F.col("counts").alias("count"))).alias("v"))
        totals = totals.groupBy(*keys, "salts", F.col("v.num").alias("num"), F.col("v.str").alias("str")).agg(F.sum("v.count").alias("count")).groupBy(*keys, "salts").agg(F.collect_list(F.struct("num", "str", "count")).alias("values"))
        spread = totals.select(F.col("src").alias("src_"), F.col("col").alias("col_"), F.col("piece").alias("piece_"), "values", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_"))
        left = left.join(hot, keys, "left").withColumn("salt", F.pmod(F.hash("load"), F.coalesce("salts", F.lit(1)))).drop("salts")
        hot_ = hot.toDF("src_", "col_", "piece_", "salts")
        right = right.join(hot_, ["src_", "col_", "piece_"], "left").withColumn("salt_", F.pmod(F.hash("load"), F.coalesce("salts", F.lit(1)))).drop("salts").unionByName(spread, allowMissingColumns=True)
    parts = left.groupBy(*keys, "salt").cogroup(right.groupBy("src_", "col_", "piece_", "salt_")).applyInArrow(_piece, _PART)
    values = parts.groupBy("src", "col", "load").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.sum("n_distinct").alias("n_distinct"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_num").alias("lo_num"), F.max("hi_num").alias("hi_num"), F.array(*[F.max(F.get("q", F.lit(i))) for i in range(len(QUANTILES))]).alias("q"))
    values = materialise(values, "values")  # one row a load and column; what is usual and the profile both come from it
    usual = values.join(sized.groupBy("src", "col", "load").agg(F.sum("n").alias("filled")), ["src", "col", "load"]).where(F.col("filled") >= TYPICAL_ROWS)
    usual = usual.groupBy("src", "col").agg(F.count("*").alias("typ_loads"), *[F.percentile_approx(c, p, 10_000).alias(x) for x, c, p in (("typ_lo", "lo_num", 0.34), ("typ_hi", "hi_num", 0.66), ("typ_distinct", "n_distinct", 0.34), ("typ_least", "filled", 0.34), ("typ_most", "filled", 0.66))])
    usual = materialise(usual, "usual")
    beyond = F.aggregate(F.arrays_zip(F.col("nums").alias("x"), F.col("counts").alias("c")), F.lit(0).cast("bigint"), lambda a, v: a + F.when((v["x"] < F.col("typ_lo")) | (v["x"] > F.col("typ_hi")), v["c"]).otherwise(0))
    outside = packed.where("piece >= 0 and nums is not null").join(usual.select("src", "col", "typ_lo", "typ_hi"), ["src", "col"]).groupBy("src", "col", "load").agg(F.sum(beyond).alias("n_outside"))
    values = values.join(outside, ["src", "col", "load"], "left")
    cells = packed.groupBy("src", "col", "load").agg((F.sum("n") + F.sum("n_null")).alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum("n_bad").alias("n_bad"))
    both = cells.join(values, ["src", "col", "load"], "left").fillna(0, ["up", "down", "n_distinct"])
    totals = both.groupBy("src", "col").agg(F.sum("n_rows").alias("t_rows"), F.sum("n_null").alias("t_null"), F.sum("n_bad").alias("t_bad"), F.sum("n_distinct").alias("t_distinct"), F.count("*").alias("t_loads"))
    joined = both.join(totals, ["src", "col"]).join(usual, ["src", "col"], "left")
    return joined.select("src", "load", "col", "n_rows", "n_null", "n_bad", "n_distinct", "lo", "hi", "lo_num", "hi_num", "q", F.greatest("up", "down").alias("ks"), (F.col("up") + F.col("down")).alias("kuiper"), *[(F.col(f"t_{x}") - F.col(f"n_{x}")).alias(f"o_{x}") for x in ("rows", "null", "bad", "distinct")], (F.col("t_loads") - 1).alias("o_loads"), "n_outside", "typ_loads", "typ_lo", "typ_hi", "typ_distinct", "typ_least", "typ_most")


def departures(profiled: DataFrame, min_rows: int = 50) -> DataFrame:
    """``load, col, reasons`` and the profile of the columns of loads of at least ``min_rows`` rows that clearly depart from the source's other loads.

    Each test needs a large effect and one that chance hardly gives: the null share or the share of pattern violations
    by a binomial deviation, the share of values outside the usual range (a value of any other load lies there about once
    a load and side at most, whatever the distribution), the distinct share of nearly unique columns, fewer distinct values
    than the usual count scaled down to the load's size, and the distance of the cumulative curves scaled by the sizes of
    both sides (Kuiper's for texts, which have no natural order). Where other loads of the source seem to depart too, what
    they can have added to the effect is taken off, so that one bad load among few does not make its neighbours look bad;
    of two loads alone neither is called bad.

    The bounds by chance: five binomial deviations (6e-7 a test), 2.4 for the scaled Kolmogorov-Smirnov distance
    (2 exp(-2 * 2.4 ** 2) = 2e-5) and 2.9 for Kuiper's (2 (4 * 2.9 ** 2 - 1) exp(-2 * 2.9 ** 2) = 3e-6), so that a million
    columns of loads give a few dozen false reports at most, and those only where the least effect is exceeded too. The
    least effects (0.12 of the rows for nulls and patterns, 0.15 of distinct values, 0.17 and 0.2 of the curves, 0.05 of
    the values out of range, 0.4 of the distinct values gone) say what "clearly" means for large loads; they are choices.
    """
    profiled = materialise(profiled, "profile")
    n, o = F.col("n_rows").cast("double"), F.greatest(F.col("o_rows").cast("double"), F.lit(1.0))
    filled, ofilled = F.col("n_rows") - F.col("n_null"), F.col("o_rows") - F.col("o_null")

    def gap(x: str) -> Column:
        return F.abs(F.col(f"n_{x}") / n - F.col(f"o_{x}") / o)

    def noise(x: str) -> Column:
        theirs = F.col(f"o_{x}") / o
        return F.sqrt(F.greatest(theirs * (1 - theirs), F.lit(0.01)) * (1 / n + 1 / o))

    share, oshare = F.col("n_distinct") / F.greatest(filled, F.lit(1)), F.col("o_distinct") / F.greatest(ofilled, F.lit(1))
    weight = F.sqrt(filled * ofilled / F.greatest(filled + ofilled, F.lit(1)))
    text = F.col("lo_num").isNull()
    enough = (filled >= 30) & (ofilled >= 30)
    effects = {
        "nulls": (gap("null"), F.lit(0.12), F.lit(True), noise("null") * 5),
        "pattern": (gap("bad"), F.lit(0.12), F.lit(True), noise("bad") * 5),
        "distinct": (oshare - share, F.lit(0.15), (filled >= 30) & (oshare >= 0.8), F.lit(0.0)),
        "distribution": (F.when(text, F.col("kuiper")).otherwise(F.col("ks")), F.when(text, 0.2).otherwise(0.17), enough, F.when(text, 2.9).otherwise(2.4) / F.greatest(weight, F.lit(1e-9))),
    }
    usual = (F.col("typ_loads") >= 3) & (filled >= 30)
    rare = F.lit(1.0) / F.greatest(F.col("typ_least"), F.lit(1))
    distinct = F.col("typ_distinct") * F.least(F.lit(1.0), filled / F.greatest(F.col("typ_most"), F.lit(1)))
    effects |= {
        "range": (F.col("n_outside") / F.greatest(filled, F.lit(1)), F.lit(0.05), usual & ~text, rare + 5 * F.sqrt(rare / F.greatest(filled, F.lit(1)))),
        "fewer": (1 - F.col("n_distinct") / F.greatest(distinct, F.lit(1.0)), F.lit(0.4), usual, 5 / F.sqrt(F.greatest(distinct, F.lit(1.0)))),
    }
    able = profiled.where((n >= min_rows) & (F.col("o_loads") > 0) & (F.col("o_rows") >= min_rows))
    for k, (effect, least, when, by_chance) in effects.items():
        able = able.withColumns({f"e_{k}": effect, f"need_{k}": F.greatest(least, by_chance), f"on_{k}": when})
        able = able.withColumn(f"hit_{k}", F.coalesce(F.col(f"on_{k}") & (F.col(f"e_{k}") >= F.col(f"need_{k}")), F.lit(False)))
    some = able.where(" or ".join(f"hit_{k}" for k in effects))
    sums = some.groupBy(F.col("src").alias("src_"), F.col("col").alias("col_")).agg(*[F.sum(F.when(F.col(f"hit_{k}"), n * F.col(f"e_{k}")).otherwise(0.0)).alias(f"sum_{k}") for k in effects])
    checked = some.join(sums, (F.col("src") == F.col("src_")) & (F.col("col") == F.col("col_"))).drop("src_", "col_")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"hit_{k}") & (F.lit(k in ROBUST) | (F.col(f"e_{k}") - (F.col(f"sum_{k}") - n * F.col(f"e_{k}")) / o >= F.col(f"need_{k}"))), k) for k in effects]))
    return checked.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(*profiled.columns, "reasons")
