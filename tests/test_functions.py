import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import candidates, keys, text, times, urls, values


@pytest.mark.parametrize("raw, want", [("49 490", "49490"), ("49 490Р", "49490"), ("49590руб", "49590"), ("11674.16", "1167416"), (None, "")])
def test_price_digits(value, raw, want):
    assert value(text.price_digits, raw) == want


@pytest.mark.parametrize("raw, want", [("12 990 руб.", "12 990 руб."), ("от 12 990 ₽ за шт", "12 990 ₽"), ("12990", "12 990 ₽"), ("7", ""), ("цена 5", ""), (None, "")])
def test_price_display(value, raw, want):
    assert value(text.price_display, raw) == want


def test_clean_text(value):
    assert value(text.clean_text, " a   b\n") == "a b"
    assert value(text.clean_text, None) == ""


@pytest.mark.parametrize("x, want", [(49490.0, "49490"), (0.1, "0.1"), (11674.16, "11674.16"), (float("nan"), ""), (float("inf"), ""), (None, "")])
def test_cell_text_of_floats(value, x, want):
    assert value(lambda c: text.cell_text(c, "double"), x, "double") == want


def test_cell_text_words(value):
    assert value(lambda c: text.cell_text(c, blank_words=True), "NaN") == ""
    assert value(lambda c: text.cell_text(c, "boolean"), True, "boolean") == "1"


def test_rules(value):
    rules = "{br}|,\n{reg[#(\\d+)x#i]}|<\\1>\na{skip}z|!\nq{.}|$\nx.y|.\nnothing\n{reg[#(#]}|bad"
    assert value(lambda c: text.apply_rules(c, rules), "5X\n&amp;a..z qq x.y") == "<5>,&! $ ."


def test_prepare_model(value):
    assert value(lambda c: text.prepare_model(c, "no|", True), "<b>no AB (1)</b> / 2") == "AB 1/2"


@pytest.mark.parametrize("start, end, want", [("[", "]", "b"), ("[", "", "b]c"), ("", "[", "a"), ("{", "]", ""), ("[", "}", "")])
def test_markers(value, start, end, want):
    assert value(lambda c: text.between_markers(c, start, end), "a[b]c") == want


@pytest.mark.parametrize("raw, want", [("<tag>", "tag"), ("ns:tag", "tag"), ("a/b/c", "c"), ("@id", "@id"), ("param:Цвет", "param:Цвет")])
def test_fields(value, raw, want):
    assert value(text.norm_field, raw) == want


def test_lists_and_json(value):
    assert value(text.split_list, " a, b\na,,") == ["a", "b"]
    assert value(lambda c: text.json_or(c, "k int", F.struct(F.lit(9).alias("k")))["k"], '{"k": 3}') == 3


def test_repair_and_search(value):
    broken = "Чайник".encode().decode("cp1251")
    assert value(text.repair_text, broken) == "Чайник"
    assert value(text.repair_text, "Чайник") == "Чайник"
    assert value(text.search_text, "  BEKO  ") == "beko"
    assert value(text.search_text, "БОРК") == "борк"


def test_keys(value):
    assert value(keys.compare_key, " «ms-49 / x» . ") == "MS-49/X"
    assert value(keys.compact_key, "ms-49 / x") == "MS49X"
    assert value(keys.visual_key, "МС-49") == "MC49"
    assert [r["reason"] for r in value(keys.compare_keys, "a-1")] == ["original", "compact", "visual"]
    assert value(keys.compare_keys, " . ") == []


@pytest.mark.parametrize(
    "name, first",
    [("CS6T-23038\nчерное стекло", "CS6T-23038"), ("CS6T-23038 платина", "CS6T-23038"), ("OCM64BSH Компактный духовой шкаф ASKO", "OCM64BSH"), ("Холодильник side by side RSA 1900", "RSA")],
)
def test_candidates(value, name, first):
    assert value(lambda c: candidates.model_candidates(c, F.lit("")), name)[0] == first


def test_candidates_with_brand(value):
    found = value(lambda c: candidates.model_candidates(c, F.lit("ASKO")), "Шкаф ASKO OCM 8456 S чёрный 60 СМ")
    assert found[0] == "OCM 8456 S" and len(found) <= 8 and len(set(found)) == len(found)
    assert value(lambda c: candidates.model_candidates(c, F.lit("")), "просто чайник") == []
    assert value(candidates.converter_model, "12345") == "12345"


@pytest.mark.parametrize("raw, want", [("ABC-123", "ABC-123"), ("Духовка mB-7x", "MB-7X"), ("Ls45s", "Ls45s"), ("", ""), ("Чайник", "Чайник"), ("Плита KLH 60 ED", "KLH 60 ED")])
def test_normalize_model(value, raw, want):
    assert value(candidates.normalize_model, raw) == want


def test_normalize_model_with_brand(value):
    assert value(lambda c: candidates.normalize_model(c, ["Bosch"]), "Плита Bosch hba-1 белая") == "HBA-1"


BASE = "https://example.test/catalog/list?x=1"


@pytest.mark.parametrize(
    "href, want",
    [
        ("/catalog/?page=2&utm_source=test", "https://example.test/catalog/?page=2"),
        ("HTTPS://Example.test//a//b/#top", "https://example.test/a/b/"),
        ("item", "https://example.test/catalog/item"),
        ("../up/./x", "https://example.test/up/x"),
        ("//other.test/p", "https://other.test/p"),
        ("?PAGEN_1=3", "https://example.test/catalog/list?PAGEN_1=3"),
        ("/index.php?route=product/product&path=1&product_id=5&sort=a", "https://example.test/index.php?route=product/product&path=1&product_id=5"),
        ("mailto:a@b.c", None), ("javascript:void(0)", None), ("", None), ("ftp://a/b", None), (None, None),
    ],
)
def test_normalize_url(value, href, want):
    assert value(lambda c: urls.normalize_url(c, F.lit(BASE)), href) == want


def test_url_tests(value):
    assert value(urls.normalize_feed_url, "Shop.test//a?b=1#c") == "https://shop.test/a?b=1"
    assert value(urls.is_static, "https://a/b.PDF?x")
    assert value(urls.is_service_path, "https://a//Cart/1")
    assert value(lambda c: urls.should_follow(c, ["https://a.test/shop/"]), "https://www.a.test/shop/1")
    assert not value(lambda c: urls.should_follow(c, ["https://a.test/shop/"]), "https://a.test/shopping")
    assert value(urls.canonical_product_url, "https://a.test/x/y/goods_12/p.html?q=1#f") == "https://a.test/goods_12/p.html?q=1"
    assert value(urls.feed_source, "https://WWW.a.test/x") == "a.test"
    assert value(lambda c: urls.url_excluded(c, ["/b"]), "https://a/b")
    assert value(lambda c: urls.url_excluded(c, ["*/c/?/"]), "https://a/c/1")
    assert not value(lambda c: urls.url_excluded(c, ["https://z"]), "https://a/b")
    assert value(lambda c: urls.product_url_ok(c, [], ["x"]), "https://a/b")


def test_values(value):
    assert value(values.norm_number, "45,60") == "45.6"
    assert value(values.norm_number, "100") == "100"
    assert value(values.norm_number, "1 2") is None
    assert value(values.norm_dimensions, "45,6 х 59.5 X 60") == "45.6x59.5x60"
    assert value(values.composite, "Хлопок/ Быстрая /Шерсть") == "Быстрая/Хлопок/Шерсть"
    assert value(lambda c: values.norm_value(c, "boolean"), "Имеется") == "Да"
    assert value(values.attr_key, "Скорость отжима, об/мин Ё") == "скорость отжима об мин е"
    assert value(values.attr_model, "LWR 98165 XE") == "LWR98165XE"
    assert value(lambda c: values.mapping_score(c, F.lit("Максимальная скорость отжима об./мин.")), "Скорость отжима, об/мин") >= 0.94
    assert value(lambda c: values.mapping_score(c, F.lit("abc")), "xyz") < 0.5


def test_headers_and_stacks(value):
    assert tuple(value(values.split_header, "Цвет (Основные)")) == ("Цвет", "Основные")
    assert tuple(value(values.split_header, "Цвет")) == ("Цвет", values.DEFAULT_GROUP)
    rows = value(values.parse_stack, "g|n|v|w\nbad\n\n a | b | c ")
    assert [(r["group_name"], r["name"], r["value"]) for r in rows] == [("g", "n", "v|w"), ("a", "b", "c")]
    assert value(values.parse_stack, None) == []


def test_times(value):
    ts = dt.datetime(2026, 8, 4, 5, 30)
    assert value(times.to_local_iso, ts, "timestamp_ntz") == "2026-08-04T08:30:00+03:00"
    assert value(times.parse_dt, "2026-08-04T05:30:00+00:00") == ts
    assert value(times.parse_dt, "soon") is None

    def run(kind, time, day=0, f=times.run_at):
        return value(lambda c: f(F.lit(kind), F.lit(time), F.lit(day), F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz"), c), ts, "timestamp_ntz")

    assert run("daily", "04:15") == dt.datetime(2026, 8, 4, 4, 15)
    assert run("daily", "nope") == dt.datetime(2026, 8, 4, 1, 0)
    assert run("daily", "04:15", f=times.next_run_at) == dt.datetime(2026, 8, 5, 4, 15)
    assert run("weekly", "10:00", 99) == dt.datetime(2026, 8, 9, 10, 0)  # Sunday
    assert run("once", "x") == dt.datetime(2026, 1, 1)
