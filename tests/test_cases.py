"""Cases that the driver's tables do not have."""

import pytest
from pyspark.sql import functions as F

from shelfmark import storage
from shelfmark.functions import candidates, urls, values
from shelfmark.operators import attributes, dedupe, match, pages
from shelfmark.sources import grid


def test_unit_words(value):
    assert value(lambda c: candidates.is_model_token(c), "700W") and value(lambda c: candidates.is_model_token(c), "12L")
    assert not value(lambda c: candidates.is_model_token(c), "700ВТ") and not value(lambda c: candidates.is_model_token(c), "5КГ/3кг")
    assert value(lambda c: candidates.model_candidates(c, F.lit("")), "700W") == []


def test_name_headers(spark):
    cells = [["Name", "Модель", "Цена", "Наименование товара"], ["no", "A-1", "5", "Чайник"]]
    g = spark.createDataFrame([("f", 1, "", k + 1, c) for k, c in enumerate(cells)], "file string, sheet_index int, sheet_name string, row_number int, cells array<string>")
    assert [r["name"] for r in grid.read_price_file(g, "модель", "цена").collect()] == ["Чайник"]


def test_formats(spark):
    rows = [
        ("xml16", " <a/>".encode("utf-16")), ("xml16be", b"\xfe\xff" + "\n<a/>".encode("utf-16-be")), ("csv16", "a;b".encode("utf-16")), ("xml8", b"\xef\xbb\xbf\r\n<a/>"), ("zip", b"PK\x03\x04 mimetype"),
        ("xlsx", b"PK\x03\x04 .. xl/workbook.xml"), ("csv", b"a;<b>"), ("none", b""),
    ]
    got = dict(tuple(r) for r in grid.detect_format(spark.createDataFrame(rows, "path string, content binary")).collect())
    assert got == {"xml16": "xml", "xml16be": "xml", "csv16": "csv", "xml8": "xml", "zip": "csv", "xlsx": "xlsx", "csv": "csv", "none": "csv"}


def test_numbers_after_dedupe(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "STEP", 3)
    rows = [(s, n, f"M{n % 4}", "U" if n % 2 else "u") for s in ("a", None) for n in (2, 5, 7, 8, 20, 21, 22)]
    df = spark.createDataFrame(rows, "source string, row_number int, source_model string, url string")
    got = dedupe.number_offers(df).orderBy("row_number").collect()
    assert [(r["row_number"], r["source_model"]) for r in got if r["source"] is None] == [(k + 1, f"M{n % 4}") for k, n in enumerate((2, 5, 7, 8, 20, 21, 22))]
    assert dedupe.number_offers(df.limit(0)).count() == 0
    assert dedupe.dedupe_offers(df.where("source = 'a'")).orderBy("row_number").select("row_number").collect() == [(2,), (5,), (7,), (8,)]


def test_host_rules(spark):
    df = spark.createDataFrame([("https://a.test/x/y",), ("https://A.test/z",), ("https://b.test/",), (None,)], "url string")
    rules = spark.createDataFrame([("https://a.test/x", None), ("https://c.test/x", "a.test"), ("", "b.test")], "prefix string, host string")
    got = {r["url"]: (r["prefix"], r["host"]) for r in dedupe.longest_prefix(df, rules).collect()}
    assert got == {"https://a.test/x/y": ("https://a.test/x", None), "https://A.test/z": ("https://c.test/x", "a.test"), "https://b.test/": ("", "b.test"), None: (None, None)}


def test_glob_sets(value):
    hit = lambda pattern, text: value(lambda c: c.rlike(urls.glob(pattern)), text)
    assert hit("*/[ab]?/*", "x/b1/y") and not hit("*/[!ab]?/*", "x/b1/y") and hit("[a-c].x", "b.x") and not hit("[a-c].x", "bxx")
    assert hit("a[", "a[") and hit("[]]", "]") and hit(r"[\^]", "^") and not hit("[&&a]", "b")


def test_ampersand_brands(spark):
    names = spark.createDataFrame([("tv A&B 7",), ("tv a  &  b",), ("tv A B",), ("tvA&B",)], "name string")
    got = dict(tuple(r) for r in match.detect_brand(names, spark.createDataFrame([("A & B",)], "brand string")).collect())
    assert got == {"tv A&B 7": "A & B", "tv a  &  b": "A & B", "tv A B": "", "tvA&B": ""}


def test_item_values(spark):
    items = [{"vendorcode": " A-1 ", "sku": "S", "name": "x"}, {"name": "Чайник MX-1/2 белый"}, {"title": "Кран Z-9", "name": " "}, {"url": "u"}, {}]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(items)], "k int, item map<string,string>")
    got = {r["k"]: r["v"] for r in df.select("k", match.item_values(F.col("item")).alias("v")).collect()}
    assert got[0] == ["A-1", "S"] and got[1][0] == "MX-1/2" and got[2][0] == "Z-9" and got[3] == got[4] == []


def test_open_values(spark):
    v = spark.createDataFrame([(1, "approved", True, ""), (2, "ambiguous", True, "x"), (3, "approved", True, "-"), (4, "missing", False, "")], "product_id int, status string, is_in_template boolean, final_value string")
    got = {r["product_id"]: (r["status"], r["open_values"]) for r in attributes.product_status(v).collect()}
    assert got == {1: ("review", 1), 2: ("review", 1), 3: ("ready", 0), 4: ("ready", 0)}
    assert attributes.batch_totals(v).first().asDict() == {"products": 4, "ready": 2, "needs_review": 2, "filled": 1, "missing": 1, "conflicts": 0, "suggestions": 0}


def test_social_titles(value):
    name = lambda html: value(pages.extract_name, html)
    assert name("<meta content='A &amp; B' property='og:title'><h1>h</h1>") == "A & B"
    assert name('<meta name="twitter:title" content="it\'s"><h1>h</h1>') == "it's" and name('<meta name="other" content="x"><h1>h</h1>') == "h"


def test_ratio_bound(spark):
    texts = ["", "brand 12", "brannd 12", "21 dnarb", "скорость", "скорости", "xyz"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select(values.sequence_ratio(F.col("a"), F.col("b")).alias("r"), values.ratio_bound(F.col("a"), F.col("b")).alias("m")).collect():
        assert r["r"] <= r["m"] + 1e-12


def test_reference_tables_beyond_one_value(spark, monkeypatch):
    monkeypatch.setattr(attributes, "MAX_DIMENSION", 3)
    rows, reference = spark.range(2), spark.range(10).withColumnRenamed("id", "k")
    got = attributes.against(rows, reference, F.struct("k"), "k").select("id", "e.k").collect()
    assert sorted(map(tuple, got)) == [(i, k) for i in range(2) for k in range(10)]


def test_storage(spark):
    with storage.setting(spark, "spark.sql.shuffle.partitions", "3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    staged = storage.staged(spark.range(3), "x")
    assert staged.count() == 3

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
