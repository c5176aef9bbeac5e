"""Filling containers of fixed capacity by minimum bin slack.

Items of one length are interchangeable, so the plan is made for the histogram of lengths, which has at most
``capacity`` entries however many items there are. Each step takes the largest remaining length and adds the
multiset of remaining lengths whose sum comes closest to the capacity, found by a bitset subset-sum; the step is
repeated as often as the remaining counts of its lengths allow. The plan is then laid over the items by their rank
within their length, which is counted in salted groups, so no length is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import count_tokens
from millrace.session import materialise

#: Items of one length that are ranked in one group, about.
GROUP_ROWS = 200_000


def fill(remaining: dict[int, int], capacity: int) -> dict[int, int]:
    """One container: the largest length and the multiset of other lengths that leaves the least slack."""
    largest = max(remaining)
    room = capacity - largest
    steps: list[tuple[int, int, int]] = []
    reach, goal, mask = 1, 1 << room, (1 << (room + 1)) - 1
    for length in sorted(remaining, reverse=True):
        left = min(remaining[length] - (length == largest), room // length)
        k = 1
        while left > 0 and not reach & goal:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach & goal:
            break
    used = {largest: 1}
    total = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if total and not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in decreasing order over the histogram: equal containers are filled together."""
    kinds: dict[tuple[tuple[int, int], ...], int] = {}
    room: dict[tuple[tuple[int, int], ...], int] = {}

    def put(kind: tuple, space: int, length: int, per: int, times: int) -> None:
        new = (*kind, (length, per))
        kinds[new] = kinds.get(new, 0) + times
        room[new] = space - length * per

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for kind in sorted((k for k in kinds if room[k] >= length), key=room.__getitem__):
            per = room[kind] // length
            times = min(kinds[kind], left // per)
            rest = left - times * per
            one = 1 if times < kinds[kind] and 0 < rest < per else 0
            if times:
                put(kind, room[kind], length, per, times)
            if one:
                put(kind, room[kind], length, rest, 1)
            left = rest * (1 - one)
            kinds[kind] -= times + one
            if not kinds[kind]:
                del kinds[kind]
            if not left:
                break
        per = capacity // length
        if left >= per:
            put((), capacity, length, per, left // per)
        if left % per:
            put((), capacity, length, left % per, 1)
    return [(dict(kind), n) for kind, n in kinds.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container contents (length -> count) and how many containers are filled that way, for all items.

    By least slack; where very large items rule, that can use a few containers more than best fit, and the plan with
    fewer containers is taken.
    """
    remaining = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while remaining:
        used = fill(remaining, capacity)
        times = min(remaining[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            remaining[n] -= k * times
            if not remaining[n]:
                del remaining[n]
    other = best_fit({n: c for n, c in histogram.items() if c > 0}, capacity)
    return other if sum(t for _, t in other) < sum(t for _, t in out) else out


def _slots(steps: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted keys (length, first rank), and for each the count per container and the first container."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for used, times in steps:
        for n, k in used.items():
            rows.append((n, taken.get(n, 0), k, base))
            taken[n] = taken.get(n, 0) + k * times
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3], base


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Containers of ``items(doc_id bigint, n_tokens)``: ``container_id, doc_id, part_no, token_start, n_tokens``.

    Items beyond ``capacity`` alone are split, into full parts and a rest. Items of no or null size take no place
    and are in no container. Equal rows are different items. No items give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    parts = items.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("int").alias("size"))
    parts = parts.select("doc_id", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))).alias("part_no"))
    parts = parts.select("doc_id", "part_no", (F.col("part_no") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("size") - F.col("part_no") * capacity).cast("int").alias("n_tokens"))
    parts = materialise(parts, "parts")
    histogram = {r[0]: r[1] for r in parts.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    lengths, starts, each, first, _ = _slots(plan(histogram, capacity))
    salts = int(min(65_536, max(1, -(-max(histogram.values(), default=1) // GROUP_ROWS))))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = counts.select("n_tokens", "salt", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("before"))
    w = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part_no")
    ranked = salted.withColumn("row", F.row_number().over(w)).join(before, ["n_tokens", "salt"]).select("doc_id", "part_no", "token_start", "n_tokens", (F.col("before") + F.col("row") - 1).alias("rank"))

    names = ["container_id", "doc_id", "part_no", "token_start", "n_tokens"]
    kind = items.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.searchsorted(lengths, np.arange(capacity + 2)), np.searchsorted(lengths, np.arange(capacity + 2), "right")
        for b in batches:
            n, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                rows = n == length
                s = starts[lo[length] : hi[length]]
                at[rows] = lo[length] + np.searchsorted(s, rank[rows], "right") - 1
            container = first[at] + (rank - starts[at]) // each[at]
            yield pa.RecordBatch.from_arrays([pa.array(container), b["doc_id"], b["part_no"], b["token_start"], b["n_tokens"]], names)

    return ranked.mapInArrow(place, f"container_id bigint, doc_id {kind}, part_no int, token_start int, n_tokens int")


def pack_texts(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """:func:`pack` of texts sized in tokens of a public tokenizer."""
    return pack(count_tokens(docs, id_col, text_col, path).withColumnRenamed(id_col, "doc_id"), capacity)
