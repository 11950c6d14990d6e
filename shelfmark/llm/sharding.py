"""Histogram sort: rows into shards of nearly equal bytes.

Rows are ordered by (hash of the text, doc_id), so equal texts stand side by side. Each
round counts the exact bytes and rows below every probe key, in one pass over narrow
keys that returns one row per probe and task; probes are then set closer around each
wanted boundary until it is met within the tolerance. After that, rows move once, to
their slice, are sorted there and numbered. A boundary falls between groups of equal
texts as long as that meets the tolerance; a larger group is split by doc_id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions, staged

PROBES = 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Splitter:
    """First key of a slice, and what stands below it."""

    hash: int
    id: int
    bytes: int
    rows: int


def rank(hashes: np.ndarray, ids: np.ndarray, key_hash: np.ndarray, key_id: np.ndarray) -> np.ndarray:
    """How many of the sorted keys (key_hash, key_id) are at or below each (hash, id)."""
    left, right = np.searchsorted(key_hash, hashes, "left"), np.searchsorted(key_hash, hashes, "right")
    tied = np.flatnonzero(left < right)
    for lo in np.unique(left[tied]):
        at = tied[left[tied] == lo]
        hi = right[at[0]]
        right[at] = lo + np.searchsorted(key_id[lo:hi], ids[at], "right")
    return right


def splitters(keys: DataFrame, wanted: int, tolerance: float, coarse: int = 1) -> list[Splitter]:
    """The wanted - 1 boundaries that cut keys (h, id, size) into parts of equal bytes.

    Every coarse-th boundary is met within tolerance times the size of coarse parts, the others
    within a tenth of a part; both as far as single rows allow. An empty table gives none.
    """
    total = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min("h"), F.max("h"), F.min("id"), F.max("id")).first()
    if not total[1]:
        return []
    all_bytes, rows, low, high, low_id, high_id = total
    known = [Splitter(low, LEAST, 0, 0), Splitter(MOST, MOST, all_bytes, rows)]
    open_, found = list(range(1, wanted)), {}
    part = all_bytes / wanted
    while open_:
        probes, still = set(), []
        for k in open_:
            target = part * k
            at = bisect_right(known, target, key=lambda s: s.bytes)
            lo, hi = known[at - 1], known[min(at, len(known) - 1)]
            near = min(lo, hi, key=lambda s: abs(s.bytes - target))
            slack = max(part * coarse * tolerance if k % coarse == 0 else part / 10, 0.5)
            new = _between(lo, hi, high, low_id, high_id)
            if abs(near.bytes - target) <= slack or hi.rows - lo.rows <= 1 or not new:
                found[k] = near
            else:
                probes |= new
                still.append(k)
        open_ = still
        if open_:
            known = sorted({(s.hash, s.id): s for s in known + _count(keys, sorted(probes))}.values(), key=lambda s: (s.hash, s.id))
    return [found[k] for k in range(1, wanted)]


def _between(lo: Splitter, hi: Splitter, high: int, low_id: int, high_id: int) -> set[tuple[int, int]]:
    """New probes in [lo, hi): by hash while that can tell rows apart, else by id."""
    top = min(hi.hash, high + 1)
    if top - lo.hash > 1:
        step = max(1, (top - lo.hash) // (PROBES + 1))
        return {(h, LEAST) for h in range(lo.hash + 1, top, step)}
    first, last = max(lo.id, low_id - 1), min(hi.id if hi.hash == lo.hash else MOST, high_id + 1)
    step = max(1, (last - first) // (PROBES + 1))
    return {(lo.hash, i) for i in range(first + 1, last, step)}


def _count(keys: DataFrame, probes: list[tuple[int, int]]) -> list[Splitter]:
    key_hash = np.array([h for h, _ in probes], dtype=np.int64)
    key_id = np.array([i for _, i in probes], dtype=np.int64)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(key_hash) + 1, np.int64), np.zeros(len(key_hash) + 1, np.int64)
        for b in batches:
            at = rank(b["h"].to_numpy(), b["id"].to_numpy(), key_hash, key_id)
            np.add.at(size, at, b["size"].to_numpy())
            np.add.at(rows, at, 1)
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"at": at, "size": size[at], "n": rows[at]})

    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    counted = keys.mapInPandas(below, "at int, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each probe at most
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    size, rows = size.cumsum(), rows.cumsum()
    return [Splitter(h, i, int(size[k]), int(rows[k])) for k, (h, i) in enumerate(probes)]


def shard_by_bytes(df: DataFrame, hash_: Column, id_: Column, size: Column, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    hash_ and id_ (bigint; null counts as the smallest) order the rows, size (bigint) is what the
    shards share evenly. Repeated rows take one slot each. Columns named shard or slot are replaced.
    Each shard is cut into slices, so that no task holds a whole shard.
    """
    spark = df.sparkSession
    slices = max(1, min(512, -(-partitions(spark) // shards)))
    h, i = F.coalesce(hash_, F.lit(LEAST)), F.coalesce(id_, F.lit(LEAST))
    keys = staged(df.select(h.alias("h"), i.alias("id"), size.cast("long").alias("size")), "shard-keys")
    cuts = splitters(keys, shards * slices, tolerance, slices)
    key_hash = np.array([s.hash for s in cuts], dtype=np.int64)
    key_id = np.array([s.id for s in cuts], dtype=np.int64)
    starts = np.array([0] + [s.rows for s in cuts], dtype=np.int64)
    before = F.lit(np.array([starts[k] - starts[k - k % slices] for k in range(len(starts))], dtype=np.int64))

    @F.pandas_udf("int")
    def slice_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(rank(a.to_numpy(), b.to_numpy(), key_hash, key_id).astype(np.int32))

    moved = df.drop("shard", "slot").withColumn("_slice", slice_of(h, i)).repartitionById(shards * slices, "_slice").sortWithinPartitions("_slice", h, i)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return moved.withColumn("slot", row + F.get(before, F.col("_slice"))).withColumn("shard", F.floor(F.col("_slice") / slices).cast("int")).drop("_slice")
