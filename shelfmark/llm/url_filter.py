"""URL verdicts by host and path rules, and by a Bloom filter cascade over listed domains.

The cascade knows every key that can be asked for (the host suffixes of the corpus).
Level 1 encodes the listed keys; level 2 the unlisted keys that level 1 lets through;
level 3 the listed keys that level 2 lets through; and so on, until no key is left
over. Over that universe the answer is exact, and a page is judged by bit tests in a
projection: no join, no shuffle of pages. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, staged

#: (host, path, verdict). A rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Domains listed as unwanted, with all their subdomains, where no rule speaks.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)

#: Most bits of a level, 16 MB: the words of a level pass through the driver.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def has(self, key: Column) -> Column:
        words = F.lit(np.array(self.words, dtype=np.int64))
        tests = [F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1 for at in self.positions(key)]
        return reduce(lambda a, b: a & b, tests)

    def positions(self, key: Column) -> list[Column]:
        return [F.xxhash64(key, F.lit(self.salt), F.lit(j)).bitwiseAND(self.bits - 1) for j in range(self.hashes)]


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or where '://' is absent."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Levels for the column key of both tables; keys listed but absent from the universe need no bits.

    Nulls are no keys. An empty list gives no level. A level over max_bits raises ValueError:
    such a list has to be split by key hash into several cascades.
    """
    tagged = universe.select("key", F.lit(True).alias("seen"), F.lit(False).alias("listed")).unionByName(
        listed.select("key", F.lit(False).alias("seen"), F.lit(True).alias("listed"))
    )
    keys = tagged.where("key is not null").groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed")).where("seen").select("key", "listed")
    keys = staged(keys, "cascade-keys")
    count = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside, outside = keys.where("listed"), keys.where("not listed")
    n_in, n_out = count.get(True, 0), count.get(False, 0)
    levels: list[Level] = []
    while n_in:
        # the first level lets through about as many as it encodes, the later ones half
        rate = min(0.5, n_in / max(n_out, 1)) if not levels else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = 1 << max(6, math.ceil(math.log2(n_in * hashes / math.log(2))))
        if bits > max_bits:
            raise ValueError(f"a level needs {bits} bits, more than {max_bits}; split the list by key hash")
        empty = Level(bits, hashes, len(levels), ())
        at = inside.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
        words = np.zeros(bits // 64, dtype=np.int64)
        one = F.lit(1).cast("bigint")
        set_bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
        for r in set_bits.collect():  # at most bits / 64 rows
            words[r["word"]] = r["bits"]
        levels.append(Level(bits, hashes, len(levels), tuple(words.tolist())))
        through = outside.where(levels[-1].has(F.col("key")))
        inside, outside = through, inside
        n_in, n_out = through.count(), n_in
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out: Column = F.lit(False)
    for level in reversed(levels):
        out = level.has(key) & ~out
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to pages.

    The longest rule that fits gives the verdict; without one, 'block' if the host or a parent
    domain is listed, else 'allow'. Null or odd urls have an empty host and path and are allowed.
    Columns of pages that are named host, path, rule or verdict are replaced. Repeated rows stay.
    """
    hosts = pages.select(host_of(F.col(url)).alias("host"))
    universe = hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    levels = build_cascade(universe, listed)
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    rule: Column = F.lit(None).cast("string")
    for name, start, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        rule = F.when(((host == name) | host.endswith("." + name)) & path.startswith(start), F.lit(name + start)).otherwise(rule)
    verdict: Column = F.when(F.exists(suffixes(host), lambda s: listed_in(levels, s)), F.lit("block")).otherwise(F.lit("allow"))
    for name, start, said in rules:
        verdict = F.when(F.col("rule") == name + start, F.lit(said)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("verdict", verdict)
