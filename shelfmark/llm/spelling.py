"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by pairs of trie nodes.

All words are laid into a trie, and all reversed words into another; every node has an integer number. A word with
position i left out is the pair (node of its first i code points, node of what follows i), a word with a gap
before position i the pair (node of its first i, node of the rest). Two words differ by a replaced code point if they have an
equal pair with a position left out, by an inserted one if the pair of the longer with a position left out is the pair
of the shorter with a gap. So all near words of a word meet on equal pairs of integers, and nothing else does: a pair holds
one word with a gap at most, and one for each letter with a position left out.

Tries are numbered in the sorted order of their words: a word's node is the one of the word before it as far as both have
the same letters, and new from there on. Partitions are numbered at once; the letters that the first word of a partition shares
with the last of the one before are put right afterwards, from one row for each partition. A node below which there is only one
word pairs with nothing, so only the nodes above are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, partitions, staged

#: Code points of a letter; A-Z become small.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_TIMES = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: One in so many (document, word) pairs loses a code point.
DAMAGE = 31
#: Bits of a node number below the partition's number.
LOCAL = 40


def damaged(word: Column, doc_id: Column) -> Column:
    """The word, without one code point where the crc32 of doc_id:word is divisible by DAMAGE."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts (null: none) of enough code points and occurrences. A null doc_id is hashed as an empty one."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(RUN + "{%d,}" % LEAST_LENGTH), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run"))
    words = found.select(damaged(ascii_lower(F.col("run")), F.col("doc_id")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def paths(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[int], int]]:
    """(row, numbers of the nodes on the way to its word from the root on, how many letters of it are shared with the word before or after) of rows that
    start with their words, in order. The first and the last row count as shared to their ends: what is beyond them is not known."""
    row, path, made, before = None, [0], 0, 0
    for after in rows:
        if row is None:
            row, path, made, before = after, list(range(len(after[0]) + 1)), len(after[0]), len(after[0])
            continue
        n = common_start(row[0], after[0])
        shared = max(before, n)
        yield row, path[: shared + 1], shared
        new = len(after[0]) - n
        path = path[: n + 1] + list(range(made + 1, made + new + 1))
        row, made, before = after, made + new, n
    if row is not None:
        yield row, path, len(row[0])


def numbered(words: DataFrame, by: str, path: str) -> DataFrame:
    """words with the array path: the numbers of the trie nodes of column by, from the root to the last that other words share; and with part and at, the row's place in the order of by."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    names = [by, *(c for c in words.columns if c != by)]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, columns = TaskContext.get().partitionId(), [*names, path, "at", "part"]
        rows = (r for batch in batches for r in batch[names].itertuples(index=False, name=None))
        held = []
        for at, (row, nodes, _) in enumerate(paths(rows)):
            held.append((*row, nodes, at, part))
            if len(held) == 5000:
                yield pd.DataFrame(held, columns=columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    spark = words.sparkSession
    dealt = words.repartitionByRange(partitions(spark), by).sortWithinPartitions(by)
    local = staged(dealt.mapInPandas(number, f"{schema}, {path} array<bigint>, at bigint, part int"), f"spelling-{path}")
    # one row for each partition reaches the driver
    ends = local.groupBy("part").agg(F.min_by(by, "at").alias("first"), F.max_by(F.struct(F.col(by).alias("word"), F.col(path).alias("path")), "at").alias("last")).orderBy("part").collect()
    carried, known, before = [], [0], ""
    for e in ends:
        n = common_start(before, e["first"])
        carry = known[: n + 1]
        carried.append((e["part"], carry))
        known = [carry[x] if x <= n else (e["part"] << LOCAL) + x for x in e["last"]["path"]]
        before = e["last"]["word"]
    carry = F.broadcast(spark.createDataFrame(carried, "part int, carry array<bigint>"))
    resolved = F.transform(path, lambda x: F.when(x < F.size("carry"), F.get("carry", x.cast("int"))).otherwise(F.shiftleft(F.col("part").cast("bigint"), LOCAL) + x))
    return local.join(carry, "part").withColumn(path, resolved).drop("carry")


def near(words: DataFrame) -> DataFrame:
    """For words (word, n; each once): id, word, n, n_near (how many words are near) and best, the near word's (n, -id) of largest n, smallest word, if that n is RATIO times the own.

    id grows with the word. Words without near words have n_near 0.
    """
    ahead = numbered(words, "word", "ahead").withColumn("id", F.shiftleft(F.col("part").cast("bigint"), LOCAL) + F.col("at"))
    ahead = ahead.select("id", "word", "n", "ahead").withColumn("drow", F.reverse("word"))
    both = staged(numbered(ahead, "drow", "back").drop("drow", "part", "at"), "spelling-nodes")
    length = F.length("word")
    # a position is of use if other words share both of its nodes
    first, last = (lambda cut: F.greatest(F.lit(0), length - F.size("back") + 1 - cut)), (lambda cut: F.least(F.size("ahead") - 1, length - cut))
    letters = F.split("word", "")
    pair = lambda i, cut, new: F.struct(F.get("ahead", i).alias("p"), F.get("back", length - cut - i).alias("s"), new.alias("kind"))
    # of a run of one letter only its first is left out for insertions: the others give the same word
    start = lambda i: F.when((i > 0) & (F.get(letters, i) == F.get(letters, i - 1)), F.lit(0)).otherwise(F.lit(1))
    none = F.array().cast("array<struct<p:bigint,s:bigint,kind:int>>")
    places = lambda cut, kind: F.when(first(cut) <= last(cut), F.transform(F.sequence(first(cut), last(cut)), lambda i: pair(i, cut, kind(i)))).otherwise(none)
    made = F.concat(places(1, start), places(0, lambda i: F.lit(2)))
    pairs = both.select("id", "n", F.explode(made).alias("x")).select("x.*", "id", "n")
    # a pair of nodes holds a word for each letter at most, and one more
    of_pair = Window.partitionBy("p", "s")
    count = lambda of: F.count_if(of).over(of_pair)
    met = pairs.withColumns({"out": count(F.col("kind") < 2), "starts": count(F.col("kind") == 1), "gap": count(F.col("kind") == 2), "top": F.max(F.struct("n", (-F.col("id")).alias("other"))).over(of_pair)})
    met = met.where(F.col("out") + F.col("gap") > 1)
    others = F.when(F.col("kind") == 2, F.col("starts")).otherwise(F.col("out") - 1 + F.when(F.col("kind") == 1, F.col("gap")).otherwise(F.lit(0)))
    # the top of a pair that is the word itself is never RATIO times as frequent
    form = F.when(F.col("top.n") >= RATIO * F.col("n"), F.col("top"))
    sums = met.select("id", others.alias("others"), form.alias("form")).groupBy("id").agg(F.sum("others").alias("n_near"), F.max("form").alias("best"))
    out = both.select("id", "word", "n").join(sums.hint("shuffle_hash"), "id", "left")
    return staged(out.withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long")), "spelling-near")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for forms (id, form): where the way from id by forms ends. Every step follows a way twice as far; a form is RATIO times as frequent, so ways are short."""
    ways = staged(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-ways")
    while not ways.where("open").isEmpty():
        on = ways.select(F.col("id").alias("root"), F.col("root").alias("next"))
        ways = ways.join(on.hint("shuffle_hash"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        ways = staged(ways, "spelling-ways")
    return ways.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row for each word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Null and empty texts hold no words; a null doc_id is hashed as an empty one; texts and words may be of any length; repeated rows
    count again. Of near words that are equally frequent the smallest in code-point order is the form. An empty table gives an empty one; other columns
    are not looked at.
    """
    words = staged(counted(docs.select("doc_id", "text")), "spelling-words")
    found = near(words)
    forms = found.where("best is not null").select("id", (-F.col("best.other")).alias("form"), F.col("best.n").alias("form_n"))
    ends = roots(forms).hint("shuffle_hash")
    named = lambda c: found.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    said = forms.join(ends, "id").hint("shuffle_hash")
    said = named("form").join(said, "form").hint("shuffle_hash")
    said = named("root").join(said, "root").select("id", "form_word", "root_word", "form_n").hint("shuffle_hash")
    out = found.join(said, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
