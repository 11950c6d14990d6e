"""Character references against Python's own decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from shelfmark.functions import keys, text
from shelfmark.operators import pages


def test_unescape_equals_the_standard_decoder(spark):
    rng = random.Random(1)
    names = list(html5)
    parts = ["&", "&&", "&;", "&#", "&#x", "&#;", ";", "x", " ", "<b>", "&amp", "&ampfoo;", "&notit;", "&notin;", "&lt", "&LT;", "&#45;", "&#045", "&#x2D;", "&#X2dg", "&#128;", "&#159;", "&#0;", "&#13;", "&#11;", "&#55296;", "&#1114112;", "&#99999999999999;", "&#x10FFFF;", "&#64976;", "&#128512;", "&#xFFFE;", "&#127;", "&#9;", "é", "&é;", "&µx;", "&a" * 3, "&" + "z" * 40 + ";"]
    texts = ["&" + n for n in names] + ["".join(rng.choices(parts + ["&" + n for n in rng.sample(names, 20)], k=rng.randint(1, 8))) for _ in range(5000)] + ["", "no reference", "R&D"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = {r["id"]: r["u"] for r in df.select("id", text.unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_null_is_empty(spark, value):
    assert value(text.unescape, None) == ""


def test_names_with_references(spark, value):
    whole = lambda f: lambda c: f(text.unescape(c))
    assert value(whole(text.technical_clean), "MX&#45;5 &deg;C &#8482; &amp;lt; caf&eacute;") == "MX-5 °C ™ < café"
    assert value(whole(keys.compare_key), "mx&#45;5&reg;") == value(keys.compare_key, "MX-5®") == "MX-5®"
    assert value(pages.extract_name, "<h1>Model &lt;X5&gt; &reg; caf&eacute;</h1>") == "Model <X5> ® café"
    assert value(lambda c: text.apply_rules(text.unescape(c), "X|Y"), "&copy X &hellip;") == "© Y …"
