"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code is the signs of its elements. The code is cut into m segments, each with an
index from value to codes. If j of the indexes have been searched up to radius r and the others
up to r - 1, every code within m r + j - 1 has been met; a query is done once its kth verified
distance is within that. Radii grow by one for the queries that are left, in as many
segments as the kth distance so far asks for. Equal codes are one entry with its k
smallest ids, and equal queries are searched once, so a very common vector costs one search.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import staged

WORD = 64  # bits of a code in one bigint


def signs(vector: Column, dims: int) -> Column:
    """The code as an array of bigints: bit i of the whole is set where element i is positive."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(vector, w * WORD + 1, WORD), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(b),
    )
    return F.array(*[word(w) for w in range(-(-dims // WORD))])


def segments(dims: int, count: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of segments, none across words; so wide that a value has about six codes, which keeps both probes and codes met few."""
    width = max(4.0, min(20.0, math.log2(max(count, 2) / 6.5)))
    out = []
    for w in range(-(-dims // WORD)):
        bits = min(WORD, dims - w * WORD)
        parts = max(1, round(bits / width))
        cuts = [bits * k // parts for k in range(parts + 1)]
        out += [(w, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def distance(a: Column, b: Column, words: int) -> Column:
    total: Column = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return total.cast("int")


def _values(code: Column, parts: list[tuple[int, int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(F.get(code, F.lit(w)), a).bitwiseAND((1 << n) - 1) for w, a, n in parts]


def masks(spark: SparkSession, width: int, radius: int) -> DataFrame:
    """One row: all values of so many bits with radius bits set. A table, so that plans hold no long literals."""
    found = [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)]
    return spark.createDataFrame([(found,)], "m array<bigint>")


def _probes(part: int, value: Column, masks: Column, wanted: Column) -> Column:
    made = F.transform(masks, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("value")))
    return F.when(wanted, made).otherwise(F.array().cast("array<struct<part:int,value:bigint>>"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row of queries the k rows of vectors with the nearest codes: query_id, rank (from 1), neighbor_id, distance.

    Ties go to the smaller id; repeated ids count once for each distinct code. Rows with a null id or
    vector have no code and are left out; fewer than k vectors give fewer rows. A null element counts as not
    positive. All vectors have as many elements as the longest; missing ones count as not positive.
    """
    dims = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    if dims < 1:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    words = -(-dims // WORD)
    code = signs(F.transform(F.col(vector), lambda x: F.coalesce(x, F.lit(0.0))), dims)
    usable = F.col(id_).isNotNull() & F.col(vector).isNotNull()
    rows = vectors.where(usable).select(F.col(id_).alias("id"), code.alias("code"))
    asked = staged(queries.where(usable).select(F.col(id_).alias("query_id"), code.alias("code")), "mih-queries")
    # the k smallest ids of each code, first within salts
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    salted = salted.distinct()
    for by in (["code", "salt"], ["code"]):
        salted = salted.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= k)
    codes = staged(salted.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "mih-codes")
    count = codes.count()
    parts = segments(dims, count)
    index = codes.select("code", "ids", F.posexplode(F.array(*_values(F.col("code"), parts))).alias("part", "value"))
    index = staged(index, "mih-index")
    # need: the kth distance so far
    left = staged(asked.select(F.col("code").alias("q"), F.lit(dims).alias("need")).distinct(), "mih-left")
    best = None
    done = []
    for radius in range(max(n for _, _, n in parts) + 1):
        searched = F.least(F.lit(len(parts)), F.col("need") - len(parts) * radius + 1)  # segments that go to this radius
        spark = vectors.sparkSession
        held = left.withColumns({f"_m{n}": masks(spark, n, radius).scalar() for n in {n for _, _, n in parts}})
        probes = [_probes(at, _values(F.col("q"), parts)[at], F.col(f"_m{n}"), F.lit(at) < searched) for at, (_, _, n) in enumerate(parts)]
        found = held.select("q", F.explode(F.concat(*probes)).alias("p")).select("q", "p.part", "p.value")
        met = found.join(index.hint("shuffle_hash"), ["part", "value"]).select("q", "code", "ids", distance(F.col("q"), F.col("code"), words).alias("distance"))
        if best is not None:
            met = met.unionByName(best)
        met = met.dropDuplicates(["q", "code"])
        near = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
        # k codes by distance and smallest id always hold the k nearest ids
        best = staged(met.withColumn("c", F.row_number().over(near)).where(F.col("c") <= k).drop("c"), "mih-best")
        so_far = F.sum(F.size("ids")).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        kth = best.withColumn("_n", so_far).groupBy("q").agg(F.min(F.when(F.col("_n") >= k, F.col("distance"))).alias("kth"))
        state = left.join(kth.hint("shuffle_hash"), "q", "left").withColumn("covered", len(parts) * radius + searched - 1)
        over = (F.coalesce("kth", F.lit(dims)) <= F.col("covered")) | (F.col("covered") >= dims)
        state = staged(state.select("q", F.coalesce("kth", F.lit(dims)).alias("need"), over.alias("over")), "mih-left")
        done.append(best.join(state.where("over").select("q").hint("shuffle_hash"), "q", "left_semi"))
        left = state.where("not over").select("q", "need")
        if left.isEmpty():
            break
        best = best.join(left.select("q").hint("shuffle_hash"), "q", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    entries = out.select("q", "distance", F.explode("ids").alias("neighbor_id"))
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    # k entries for each code that was asked for
    lists = ranked.groupBy("q").agg(F.collect_list(F.struct("rank", "neighbor_id", "distance")).alias("r"))
    return asked.join(lists.hint("merge"), F.col("code") == F.col("q")).select("query_id", F.explode("r").alias("x")).select("query_id", "x.rank", "x.neighbor_id", "x.distance")
