"""Texts that are alike as sequences, without comparing all with all.

Like texts meet on equal pairs of letters. The sequence ratio of texts a and b is 2 M / (|a| + |b|) for M letters in matching blocks. Between two
blocks at least one of the U = |a| + |b| - 2 M letters outside of them stands, so there are U + 1 blocks at most, and in blocks of M letters at least
M - (U + 1) of the texts' pairs of neighbouring letters (each with its number among equal ones) are common. For ratios from least on that is at least
(|a| + |b|) (1.5 least - 1) - 1, and more than none for texts that differ, if least is above 0.8. So of each text only the rarest few pairs have to be met: all but
one less than what must be common.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import let
from shelfmark.functions.values import attr_key, name_score_parts, name_tokens, ratio_bound, ratio_of, sequence_ratio

#: Most frequent pairs of letters, put last where rare ones are looked for. Any order gives the same result.
FREQUENT = 20_000


def common_pairs(total: Column, least: float) -> Column:
    """The pairs of letters that two texts of total letters have in common at least."""
    return F.greatest(F.lit(1), F.ceil(total * (1.5 * least - 1) - 1 - 1e-9).cast("int"))


def letter_pairs(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, text, g: a row for each pair of neighbouring letters, numbered among equal ones of the text."""
    cut = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))
    rows = texts.where(F.length("text") > 1).select(*by, "text", F.explode(cut).alias("pair"))
    # all of a text in one place, here and where its pairs are gathered again
    rows = rows.repartition(*by, "text")
    number = F.row_number().over(Window.partitionBy(*by, "text", "pair").orderBy(F.lit(1)))
    return rows.select(*by, "text", F.concat("pair", number.cast("string")).alias("g"))


def with_rare_pairs(pairs: DataFrame, frequent: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """by, text, all (its pairs), g (each of its rarest that have to be met)."""
    ranked = pairs.join(F.broadcast(frequent), "g", "left").select(*by, "text", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g").alias("x"))
    one = ranked.groupBy(*by, "text").agg(F.array_sort(F.collect_list("x")).alias("x")).select(*by, "text", F.col("x.g").alias("all"))
    # a partner has least / (2 - least) of the letters at least
    need = common_pairs(F.ceil(F.length("text") * (2 / (2 - least)) - 1e-9), least)
    few = F.greatest(F.lit(0), F.size("all") - need + 1)
    return one.select(*by, "text", "all", F.explode(F.slice("all", F.lit(1), few)).alias("g"))


def candidates(left: DataFrame, right: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """by, a, b: distinct pairs of different texts (left: by, text; right: by, text) whose ratio may be least or more, by lengths, common pairs of letters and common letters."""
    if not 0.8 < least <= 1:
        raise ValueError("least has to be above 0.8")
    cut = [letter_pairs(t.select(*by, "text").where("text is not null").distinct(), by) for t in (left, right)]
    counts = cut[0].select("g").unionAll(cut[1].select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.orderBy(F.desc("n"), "g").limit(FREQUENT)
    a, b = (with_rare_pairs(c, frequent, by, least) for c in cut)
    a, b = a.withColumnsRenamed({"text": "a", "all": "all_a"}), b.withColumnsRenamed({"text": "b", "all": "all_b"})
    met = a.join(b.hint("shuffle_hash"), [*by, "g"]).where(F.col("a") != F.col("b"))
    n, m = F.length("a"), F.length("b")
    met = met.where((2 * F.least(n, m) >= least * (n + m) - 1e-9) & (F.size(F.array_intersect("all_a", "all_b")) >= common_pairs(n + m, least)))
    return met.select(*by, "a", "b").distinct().where(ratio_bound(F.col("a"), F.col("b")) >= least)


def alike(left: DataFrame, right: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """by, a, b, ratio of all pairs of a text of left and one of right, equal in by, whose sequence ratio is least (above 0.8) or more. Equal texts have 1; nulls have no partner."""
    near = candidates(left, right, by, least).withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    own = [t.select(*by, "text").where("text is not null").distinct() for t in (left, right)]
    equal = own[0].join(own[1].hint("shuffle_hash"), [*by, "text"]).select(*by, F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("ratio"))
    return near.unionByName(equal)


def best_entries(names: DataFrame, entries: Column, k: int, fuzzy: bool = True) -> DataFrame:
    """For names (name) the k best of entries (array<struct<id, key, tokens>>, a reference table beside every name): name, best (array<struct<score, id>>, best first, ties by id) and
    asked (how many sequences were compared).

    Scores are those of mapping_score. Equal and contained words decide natively; words and letters in common bound the rest. Entries that
    k others surely beat do not go on; those left are tried from the highest bound on, until the kth best is out of reach. fuzzy off: only equal and contained words score, others have 0.
    """
    # each value is computed once for a name, not once for an entry: Spark would put what a column stands for into every place that names it
    names = names.select("name", entries.alias("_entries"))
    parts = lambda x, p: F.transform("_entries", lambda e: F.struct(e["id"].alias("id"), e["key"].alias("key"), name_score_parts(x, e["tokens"], p, e["key"]).alias("p")))
    own = lambda body: let(attr_key(F.col("name")), lambda p: let(name_tokens(F.col("name")), lambda x: let(parts(x, p), body)))
    if not fuzzy:
        scored = lambda e: F.struct(F.when(e["p"]["known"], -e["p"]["low"]).otherwise(0.0).alias("s"), e["id"].cast("bigint").alias("id"))
        top = own(lambda all_: F.slice(F.array_sort(F.transform(all_, scored)), 1, k))
        return names.select("name", F.transform(top, lambda e: F.struct((-e["s"]).alias("score"), e["id"].alias("id"))).alias("best"), F.lit(0).alias("asked"))
    slim = lambda e: F.struct((-e["p"]["high"]).alias("bound"), e["id"].alias("id"), e["p"]["low"].alias("low"), e["p"]["known"].alias("known"), e["key"].alias("key"))
    floor = lambda all_: F.coalesce(F.get(F.sort_array(F.transform(all_, lambda e: e["p"]["low"]), asc=False), F.lit(k - 1)), F.lit(0.0))
    tries = own(lambda all_: let(floor(all_), lambda least: F.array_sort(F.transform(F.filter(all_, lambda e: e["p"]["high"] >= least), slim))))
    # as a generated row the value stays a column of its own, which is all that goes to Python
    made = names.select("name", attr_key(F.col("name")).alias("_key"), F.explode_outer(F.array(tries)).alias("tries"))

    @F.pandas_udf("struct<best: array<struct<score: double, id: bigint>>, asked: int>")
    def run(keys: pd.Series, entries: pd.Series) -> pd.DataFrame:
        out = []
        for key, own in zip(keys, entries):
            best: list[tuple[float, int]] = []  # negative score, id
            asked = 0
            for t in own:
                if len(best) == k and -t["bound"] < -best[-1][0]:
                    break
                score = t["low"]
                if not t["known"]:
                    asked += 1
                    score = min(0.99, 0.48 * ratio_of(key, t["key"]) + score)
                best = sorted([*best, (-score, int(t["id"]))])[:k]
            out.append(([{"score": -s, "id": i} for s, i in best], asked))
        return pd.DataFrame(out, columns=["best", "asked"])

    return made.select("name", run("_key", "tries").alias("r")).select("name", "r.best", "r.asked")
