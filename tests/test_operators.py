import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.keys import key_texts
from shelfmark.operators import attributes, changes, dedupe, entities, logs, match, pages, report
from shelfmark.plans import jobs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("a", "Feed A", 1), ("b", "Feed B", 2)], "source string, label string, position int")


@pytest.fixture(scope="module")
def feed_keys(spark):
    items = spark.createDataFrame([("a", "i1", 1, ["ABC-1"]), ("a", "i2", 2, ["ABC 1", "Z9"]), ("b", "i3", 1, ["АВС 7"])], "source string, item string, position int, texts array<string>")
    return match.feed_index(items, F.col("texts"))


def test_first_item_wins(feed_keys):
    assert rows(feed_keys.where("key = 'ABC1'"), "source", "item", "reason") == [("a", "i1", "compact")]
    assert rows(feed_keys.where("key = 'ABC7'"), "source", "item", "reason") == [("b", "i3", "visual")]


def test_missing_feeds(spark, feeds, feed_keys):
    r = spark.createDataFrame([(1, ["ABC-1"]), (2, ["abc7"]), (3, ["none"]), (4, [])], "row_id int, texts array<string>")
    keyed = r.withColumn("keys", F.array_distinct(F.flatten(F.transform("texts", key_texts))))
    assert rows(match.missing_feeds(keyed, feeds, feed_keys)) == [(1, ["Feed B"]), (2, ["Feed A"]), (3, ["Feed A", "Feed B"]), (4, ["Feed A", "Feed B"])]
    assert rows(match.missing_feeds(keyed, feeds, feed_keys, "none"), "row_id") == [(1,), (2,), (3,)]
    assert rows(match.missing_everywhere(keyed, feed_keys), "row_id") == [(3,), (4,)]
    assert match.present_everywhere(keyed, feeds, feed_keys).count() == 0


def test_best_match_order(spark, feeds, feed_keys):
    r = spark.createDataFrame([(1, ["zz", "z9", "ABC-1"]), (2, ["abc1"])], "row_id int, candidates array<string>")
    assert rows(match.best_match(r, feed_keys, feeds)) == [(1, "z9", "matched:original", "a", "i2"), (2, "abc1", "matched:original", "a", "i1")]


def test_brands(spark):
    names = spark.createDataFrame([("Плита Bosch Home 7",), ("Boschx",), ("LG & Co TV",)], "name string")
    brands = spark.createDataFrame([("Bosch",), ("Bosch Home",), ("LG & Co",), ("LG",)], "brand string")
    assert rows(match.detect_brand(names, brands)) == [("Boschx", ""), ("LG & Co TV", "LG & Co"), ("Плита Bosch Home 7", "Bosch Home")]


def test_long_brands_and_other_scripts(spark):
    names = spark.createDataFrame([("Kettle A.B.C. & D-E 7",), ("One Two Three Four Five Six Seven",), ("冰箱 東芝 7",), ("東芝X",), ("Kettle ABC",), (None,), ("",)], "name string")
    brands = spark.createDataFrame([("A.B.C. & D-E",), ("Two Three Four Five Six Seven",), ("Two",), ("東芝",), (None,)], "brand string")
    got = dict(tuple(r) for r in match.detect_brand(names, brands).collect())
    assert got == {"Kettle A.B.C. & D-E 7": "A.B.C. & D-E", "One Two Three Four Five Six Seven": "Two Three Four Five Six Seven", "冰箱 東芝 7": "東芝", "東芝X": "", "Kettle ABC": "", None: "", "": ""}
    assert {r["detected_brand"] for r in match.detect_brand(names, brands.limit(0)).collect()} == {""}


def test_dedupe_products(spark):
    p = spark.createDataFrame([(1, "u1", "M"), (2, "u1", "N"), (3, "", "K"), (4, "u2", "K"), (5, "", "k"), (6, "u3", "m")], "pos int, url string, model string")
    assert rows(dedupe.dedupe_products(p), "pos") == [(1,), (3,), (6,)]


def test_log_pages(spark):
    log = spark.createDataFrame([(i, "info") for i in range(1, 11)], "id int, level string")
    assert rows(dedupe.log_page(log, 2, 3), "id") == [(5,), (6,), (7,)]
    assert rows(dedupe.log_delta(log, 8), "id") == [(10,), (9,)]
    assert dedupe.log_delta(log, 99).count() == 10
    assert dedupe.log_delta(log.limit(0), 1).count() == 0


def test_logs(spark):
    log = spark.createDataFrame([(1, "ERROR", "a", dt.datetime(2026, 1, 1)), (2, "odd", "B", dt.datetime(2026, 1, 9))], "id int, level string, message string, created_at timestamp_ntz")
    out = logs.log_rows(log)
    assert rows(logs.log_counts(out)) == [("error", 1), ("info", 1)]
    assert rows(logs.search_logs(out, "", "b"), "id") == [(2,)]
    assert rows(logs.prune(out, F.lit(dt.datetime(2026, 1, 10)).cast("timestamp_ntz")), "id") == [(2,)]
    assert tuple(logs.log_meta(log.limit(0)).first()) == (0, 0, "0:0")


def test_due(spark):
    t = dt.datetime(2026, 8, 4, 5, 0)
    b = [("due", True, "completed", t), ("disabled", False, "", t), ("future", True, "", t + dt.timedelta(hours=1)), ("orphan", True, "", t), ("late", True, "", t - dt.timedelta(hours=1))]
    brands = spark.createDataFrame([(i, *x, "daily", None) for i, x in enumerate(b)], "id int, name string, enabled boolean, status string, run_at timestamp_ntz, schedule_type string, last_scan_at timestamp_ntz")
    donors = spark.createDataFrame([(0,), (1,), (2,), (4,)], "brand_id int")
    now = F.lit(t + dt.timedelta(seconds=30)).cast("timestamp_ntz")
    assert rows(logs.due(brands, donors, now), "name") == [("due",)]


CHANGE = "revision int, item_id string, kind string, payload map<string,string>"


def test_collapse(spark):
    c = spark.createDataFrame([(1, "x", "state", {"s": "1"}), (2, "x", "state", {"s": "2", "t": None}), (3, "y", "upsert", {"a": "1"}), (4, "y", "state", {"a": "2"}), (5, "z", "state", {"a": "1"}), (6, "z", "remove", {}), (7, "w", "remove", {}), (8, "w", "state", {"q": "1"})], CHANGE)
    got = {r["item_id"]: (r["revision"], r["kind"], r["payload"]) for r in changes.collapse(c, 0).collect()}
    assert got == {"x": (2, "state", {"s": "2", "t": None}), "y": (4, "upsert", {"a": "2"}), "z": (6, "remove", {}), "w": (8, "state", {"q": "1"})}
    assert changes.collapse(c, 8).count() == 0


def test_diff_and_apply(spark):
    schema = "id string, fields map<string,string>, state map<string,string>"
    p = spark.createDataFrame([("a", {"n": "1"}, {"s": "1", "g": "1"}), ("b", {"n": "1"}, {}), ("c", {}, {})], schema)
    c = spark.createDataFrame([("a", {"n": "1"}, {"s": "2"}), ("b", {"n": "2"}, {}), ("d", {}, {"s": "1"})], schema)
    got = {r["id"]: (r["kind"], r["payload"]) for r in changes.diff(p, c).collect()}
    assert got == {"a": ("state", {"s": "2", "g": None}), "b": ("upsert", {"n": "2"}), "c": ("remove", {}), "d": ("upsert", {"state.s": "1"})}
    cur = spark.createDataFrame([("a", {"x": "1"}), ("c", {})], "item_id string, payload map<string,string>")
    delta = spark.createDataFrame([(1, "a", "state", {"y": "2"}), (2, "c", "remove", {}), (3, "n", "upsert", {"z": "3"}), (4, "m", "state", {"q": "1"})], CHANGE)
    assert {r["item_id"]: r["payload"] for r in changes.apply_delta(cur, delta).collect()} == {"a": {"x": "1", "y": "2"}, "n": {"z": "3"}}


def test_entities(spark):
    d = spark.createDataFrame([(1, 7, "completed", 5), (2, 7, "error", 3), (3, 8, "odd", 1)], "id int, brand_id int, status string, last_scan_at int")
    assert rows(entities.brand_state(d)) == [(7, "error", 5), (8, "odd", 1)]
    b = spark.createDataFrame([(7, 2), (8, 2), (9, None)], "id int, primary_id int")
    assert rows(entities.primary_donor(b, d)) == [(7, 2), (8, 3), (9, None)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(entities.merge_membership(ids(1, 2, 5), ids(1, 2, 3), ids(1, 3, 4))) == [(1,), (4,), (5,)]


CARDS = '<div class="card"><a href="/p/1">x</a><b>ABC-1</b><i>1 990 руб.</i></div><div class="card"><b>K</b><i>5 руб.</i></div><div class="card"><a href="/p/2">x</a><b></b><i>10 руб.</i></div>'
RULES = pages.PageRules(card_open='<div class="card">', url='href="([^"]*)"', model="<b>(.*?)</b>", price="<i>(.*?)</i>")


def test_listing(spark):
    p = spark.createDataFrame([("https://s.test/c", CARDS), ("https://s.test/c2", CARDS), ("https://s.test/e", None)], "url string, html string")
    got = jobs.crawl_result(p.where("html is not null"), RULES, pages.PageRules())
    # the card without a link counts by its model, once for both pages
    assert rows(got) == [("", "K", "5 руб."), ("https://s.test/p/1", "ABC-1", "1 990 руб.")]


def test_blocked(spark, value):
    assert value(pages.is_blocked, "<body>captcha</body>")
    assert not value(pages.is_blocked, "<body>captcha 100 руб.</body>")
    assert not value(pages.is_blocked, "<body>" + "word " * 80 + "</body>")


def test_page_data(spark):
    html = """<nav class="breadcrumb"><a>A</a><a>B</a><a>A</a></nav><h1>Имя</h1><table><tr><th>Модель</th><td>X-1</td></tr><tr><td>один</td></tr></table><dl><dt>Цвет</dt><dd>Белый</dd></dl> Нет в наличии"""
    p = spark.createDataFrame([("u", html)], "url string, html string")
    assert rows(pages.extract_pairs(p), "name", "value") == [("Модель", "X-1"), ("Цвет", "Белый")]
    assert rows(pages.page_fallbacks(p)) == [("u", "A > B", "X-1")]
    assert p.select(pages.extract_name(F.col("html")), pages.extract_availability(F.col("html"))).first()[:] == ("Имя", "в наличии")


def test_attribute_conflict(spark):
    c = spark.createDataFrame([(1, 1, "Белый", "s", 0, 95, 0), (1, 1, "Чёрный", "t", 1, 99, 1), (2, 1, "Белый", "s", 1, 99, 0), (2, 1, "белый", "t", 0, 90, 1)], "product_id int, field_id int, value string, source string, priority int, confidence int, pos int")
    assert rows(attributes.resolve_candidates(c, True)) == [(1, 1, "conflict", "", "", 99), (2, 1, "approved", "белый", "t", 90)]


def test_types(spark):
    cells = [(0, "Цвет (Основные)", "Белый"), (1, "Скорость", "1200"), (1, "Скорость", "800,5"), (2, "Габариты (Размеры)", "60x45"), (3, "Список программ (Режимы)", "Хлопок/Быстрая")]
    df = spark.createDataFrame(cells, "column_pos int, header string, value string")
    assert rows(attributes.infer_types(df)) == [(0, "select", False), (1, "number", False), (2, "dimensions", False), (3, "select", True)]


def test_mapping(spark):
    fields = spark.createDataFrame([(1, "g", "Максимальная скорость отжима об./мин."), (2, "g", "Цвет"), (3, "h", "Цвет")], "field_id int, group_name string, name string")
    attrs = spark.createDataFrame([("Скорость отжима, об/мин",), ("Цвет",), ("xyz",)], "name string")
    got = {r["name"]: (r["field_id"], r["status"]) for r in attributes.map_attributes(attrs, fields).collect()}
    assert got == {"Скорость отжима, об/мин": (1, "mapped"), "Цвет": (2, "mapped"), "xyz": (None, "unknown")}


def test_values_to_dictionary(spark):
    fields = spark.createDataFrame([(1, "select", False), (2, "select", True), (3, "number", False)], "field_id int, value_type string, is_composite boolean")
    allowed = spark.createDataFrame([(1, "Белый", "белый"), (2, "Хлопок", "хлопок"), (2, "Шерсть", "шерсть")], "field_id int, value string, normalized_value string")
    syn = spark.createDataFrame([(1, "Белый", "white")], "field_id int, value string, normalized_synonym string")
    vals = spark.createDataFrame([(1, "БЕЛЫЙ"), (1, "White"), (1, "Серый"), (1, "белыйй"), (2, "шерсть / хлопок"), (2, "хлопок/x"), (3, "45,60"), (3, "x")], "field_id int, value string")
    got = {(r["field_id"], r["value"]): (r["mapped"], r["confidence"]) for r in attributes.map_values(vals, fields, allowed, syn).collect()}
    assert got[(1, "БЕЛЫЙ")] == ("Белый", 100) and got[(1, "White")] == ("Белый", 98) and got[(1, "Серый")] == (None, 0) and got[(1, "белыйй")][0] == "Белый"
    assert got[(2, "шерсть / хлопок")] == ("Хлопок/Шерсть", 100) and got[(2, "хлопок/x")] == (None, 0) and got[(3, "45,60")] == ("45.6", 96) and got[(3, "x")] == (None, 0)


def test_export_refuses_open_values(spark):
    v = spark.createDataFrame([(1, 1, "g", "n", "", "", True, "missing", 0)], "product_id int, id int, group_name string, name string, final_value string, current_value string, is_in_template boolean, status string, sort_order int")
    with pytest.raises(ValueError):
        attributes.export_attributes(v)


def test_totals_on_empty(spark):
    empty = spark.createDataFrame([], "supplier string, status string")
    assert tuple(report.import_totals(empty).first()) == (0, 0, 0, 0, 0, 0)
    assert report.comparison_totals(empty).count() <= 1
