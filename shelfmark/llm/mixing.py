"""Mixing sources to target weights under a time-varying curriculum.

A source has a target of words and a schedule: its weight as a piecewise linear function
of training time 0 to 1. The integral of the schedule, scaled to the target, is the
source's cumulative demand. Documents of a source, in a fixed pseudo-random order, fill that
demand one after another, starting again when all have been used; inverting the demand at
a document's first word gives its training position, and the mix is range-sorted by it.

Running sums are taken in two steps, so that a source with most of the rows is spread:
sums by (source, bucket of the order key), then inside each bucket.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import gathered, listed, partitions, staged

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_REPEATS = 2
#: Schedules by rank of the source, repeating: weight at the ends of equal spans of time.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Sources are listed on the driver, some 200 bytes each.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, repeats: int = MOST_REPEATS) -> list[float]:
    """Words to take from each source: share times all words by weight, none above repeats times its own; the excess is reshared by weight."""
    wanted, out = share * sum(sizes), [0.0] * len(sizes)
    left, weight = wanted, sum(weights)
    for k in sorted(range(len(sizes)), key=lambda k: (Fraction(sizes[k] * repeats, weights[k]), k)):
        if left * weights[k] < repeats * sizes[k] * weight:
            # nobody further on is capped: the rest is shared by weight
            out[k] = float(left * weights[k] / weight)
        else:
            out[k] = float(repeats * sizes[k])
            left -= repeats * sizes[k]
            weight -= weights[k]
    return out


def position(words: Column, target: Column, knots: tuple[float, ...]) -> Column:
    """The time at which the source's demand reaches words; null beyond its target."""
    n = len(knots) - 1
    spans = [(a + b) / (2 * n) for a, b in zip(knots, knots[1:])]
    demand = words / target * F.lit(sum(spans))
    out: Column = F.lit(None).cast("double")
    before = [sum(spans[:i]) for i in range(n)]
    for i in reversed(range(n)):
        a, slope = knots[i], knots[i + 1] - knots[i]
        rest = (demand - F.lit(before[i])) * F.lit(float(n))
        inside = F.lit(2.0) * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
        at = (F.lit(float(i)) + inside) / F.lit(float(n))
        out = at if i == n - 1 else F.when(demand < F.lit(before[i + 1]), at).otherwise(out)
    return F.when(words < target, F.least(out, F.lit(1.0)))


def assign(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", size: Column | None = None, weights=WEIGHTS, share: Fraction = SHARE, schedules=SCHEDULES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, position and again.

    size is the row's words (bigint; null counts as 0). Sources are ranked by code point, null
    last; the rank picks weight and schedule. taken is the words that the mix takes of the row:
    whole, in part where the target is reached, or up to twice; position and again are the
    training times (0 to 1) of the first and second use, null where there is none. The order
    within a source is by md5 of the doc_id, so that reruns agree; a source without words takes
    none. Other columns of docs are kept except those named like the new ones.
    """
    spark = docs.sparkSession
    buckets = partitions(spark) * 4
    new = ("size", "source_size", "target", "taken", "position", "again")
    own = [c for c in docs.columns if c not in new]
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(*own, F.coalesce(size if size is not None else F.col("size"), F.lit(0)).cast("long").alias("size"))
    # a key that is never null, so that window and join share one exchange
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    keyed = rows.withColumn("_order", order).withColumn("_key", named).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("int"))
    sums = staged(gathered(keyed.groupBy(F.col("_key").alias("_of"), F.col("_bucket").alias("_at")).agg(F.sum("size").alias("_sum"))), "mixing-sums")
    by_source = sums.groupBy("_of").agg(F.sum("_sum").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    ranked = sorted(by_source, key=lambda r: (not r["_of"], r["_of"].encode("utf-8")))
    goal = targets([r["n"] for r in ranked], [weights[k % len(weights)] for k in range(len(ranked))], share)
    plan = listed(spark, [(r["_of"], r["n"], goal[k], k % len(schedules)) for k, r in enumerate(ranked)], "_of string, source_size long, target double, _schedule int")
    running = F.sum("_sum").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")
    offsets = sums.withColumn("_before", running).join(plan.hint("shuffle_hash"), "_of").drop("_sum")
    inner = Window.partitionBy("_key", "_bucket").orderBy("_order", doc_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("_inner", F.sum("size").over(inner) - F.col("size"))
    joined = summed.join(offsets.hint("shuffle_hash"), (F.col("_key") == F.col("_of")) & (F.col("_bucket") == F.col("_at")), "left")
    start, again = F.col("_before") + F.col("_inner"), F.col("source_size") + F.col("_before") + F.col("_inner")
    limit = F.floor("target").cast("long")
    use = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), limit - at))
    when = lambda at: _by_schedule(schedules, at)
    used = joined.withColumn("taken", (use(start) + use(again)).cast("long"))
    used = used.withColumn("position", F.when(use(start) > 0, when(start))).withColumn("again", F.when(use(again) > 0, when(again)))
    return used.select(*own, *new)


def _by_schedule(schedules, words: Column) -> Column:
    out: Column = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        out = F.when(F.col("_schedule") == k, position(words.cast("double"), F.col("target"), knots)).otherwise(out)
    return F.round(out, 9)


def training_order(assigned: DataFrame, parts: int | None = None) -> DataFrame:
    """assigned in range-sorted order of the training position; what is not taken comes last."""
    parts = parts or partitions(assigned.sparkSession)
    key = F.coalesce("position", F.lit(2.0)), F.xxhash64("doc_id")
    return assigned.repartitionByRange(parts, *key).sortWithinPartitions(*key)


def uses(assigned: DataFrame) -> DataFrame:
    """A row for each use of a row of assigned, with its position, in training order."""
    both = F.filter(F.array("position", "again"), lambda p: p.isNotNull())
    return training_order(assigned.withColumn("position", F.explode(both)).drop("again"))
