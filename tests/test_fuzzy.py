"""Like texts and best fields against comparing all with all."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import attributes, fuzzy

WORDS = "скорость отжима барабана вращения цвет корпуса глубина ширина загрузка белья тип управления класс энергии шум уровень stainless door depth color мин ед".split()


def texts(rng, n, alphabet):
    base = ["".join(rng.choices(alphabet, k=rng.randint(1, 16))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(alphabet)]])
        out.append("".join(w))
    return out


def ratio(a, b, least):
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


@pytest.mark.parametrize("least,alphabet", [(0.82, "abcdefgh "), (0.88, "abcdefghijklmnop"), (0.82, "ab")])
def test_alike_against_all_pairs(spark, least, alphabet):
    rng = random.Random(int(least * 100))
    n = 700 if len(alphabet) > 2 else 120
    left = [(rng.randint(1, 2), t) for t in texts(rng, n, alphabet)]
    right = [(rng.randint(1, 2), t) for t in texts(rng, n // 2, alphabet) + [t for _, t in rng.sample(left, n // 2)]]
    left += [(1, ""), (1, None), (2, "x"), left[0], (None, "abc"), (1, alphabet * 30), (1, "aa" * 120)]
    right += [(1, ""), (2, "x"), (None, "abc"), (1, alphabet * 30 + "b"), (1, "aa" * 121)]
    make = lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], "field_id int, text string, n int, g int")
    got = {(r["field_id"], r["a"], r["b"]): round(r["ratio"], 9) for r in fuzzy.alike(make(left), make(right), ["field_id"], least).collect()}
    want = {(f, a, b): round(r, 9) for f, a in set(left) for g, b in set(right) if f is not None and f == g and a is not None and b is not None and (r := ratio(a, b, least)) >= least}
    assert got == want and len(want) > n / 4
    if len(alphabet) > 10:
        sent = fuzzy.candidates(make(left), make(right), ["field_id"], least).count()
        assert sent <= 0.01 * len(left) * len(right)


def test_plan_has_no_all_pairs(spark):
    df = spark.range(50).select(F.lit(1).alias("field_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    plan = fuzzy.alike(df, df, ["field_id"], 0.88)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert fuzzy.alike(df, df.limit(0), ["field_id"], 0.88).count() == 0


def names(rng, n):
    return sorted({" ".join(rng.sample(WORDS, rng.randint(1, 4))) + rng.choice(["", "", " 2", ", об/мин"]) for _ in range(n)} | {"", "Макс.", "ё"})


def test_best_fields_against_all_scores(spark, monkeypatch):
    rng = random.Random(8)
    known, asked = names(rng, 60), names(rng, 150) + [None]
    fields = spark.createDataFrame([(k + 1, n, 5) for k, n in enumerate(known)], "field_id int, name string, id int")
    attrs = spark.createDataFrame([(n, 1) for n in asked], "name string, id int")
    pairs = attrs.select("name").where("name is not null").crossJoin(F.broadcast(fields.select("field_id", F.col("name").alias("f")))).withColumn("score", values.mapping_score(F.col("name"), F.col("f")))
    every = {}
    for r in pairs.collect():
        every.setdefault(r["name"], []).append((-r["score"], r["field_id"]))
    for most in (attributes.MAX_DIMENSION, 25):  # one reference value, several
        monkeypatch.setattr(attributes, "MAX_DIMENSION", most)
        got = {(r["name"], r["rank"]): (round(r["score"], 9), r["field_id"]) for r in attributes.best_fields(attrs, fields, 4).collect()}
        assert got == {(n, k + 1): (round(-s, 9), f) for n, own in every.items() for k, (s, f) in enumerate(sorted(own)[:4])}
    entries = fields.select(F.col("field_id").alias("id"), values.attr_key(F.col("name")).alias("key"), values.name_tokens(F.col("name")).alias("tokens"))
    value = entries.agg(F.array_sort(F.collect_list(F.struct("id", "key", "tokens")))).scalar()
    total = fuzzy.best_entries(attrs.where("name is not null"), value, 4).agg(F.sum("asked")).first()[0]
    assert total < 0.35 * len(known) * len(asked)


def test_mapping_score_is_as_defined(spark):
    rng = random.Random(3)
    own = names(rng, 40)
    df = spark.createDataFrame([(a, b) for a in own for b in own[:20]], "a string, b string")
    key, tokens = values.attr_key, values.name_tokens
    for r in df.select("a", "b", key(F.col("a")).alias("p"), key(F.col("b")).alias("q"), tokens(F.col("a")).alias("x"), tokens(F.col("b")).alias("y"), values.mapping_score(F.col("a"), F.col("b")).alias("s")).collect():
        x, y = set(r["x"]), set(r["y"])
        if r["p"] == r["q"]:
            want = 1.0
        elif x and y and (x <= y or y <= x):
            want = 0.96
        else:
            both = len(x & y)
            want = min(0.99, 0.48 * SequenceMatcher(None, r["p"], r["q"]).ratio() + (0.37 * both / min(len(x), len(y)) + 0.15 * both / len(x | y) if x and y else 0))
        assert abs(r["s"] - want) < 1e-9
