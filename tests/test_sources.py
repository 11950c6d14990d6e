import os

import pytest
from pyspark.sql import functions as F

from shelfmark import storage
from shelfmark.sources import feeds, grid, sinks
from shelfmark.streaming import streams


def test_csv_feed(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿SKU;Название поставщика;Стоимость;Марка поставщика;Карточка\nA-1;Чайник;12990;MAUNFELD;https://example.test/a-1\n;x;1;;\n", "utf-8")
    g = grid.csv_grid(spark, str(tmp_path / "f.csv"))
    fields = {"model": "sku", "name": "Название поставщика", "price": "Стоимость", "brand": "Марка поставщика", "url": "Карточка"}
    assert [tuple(r)[1:] for r in grid.read_supplier_grid(g, fields).collect()] == [(2, "A-1", "Чайник", "12990", "MAUNFELD", "https://example.test/a-1")]
    assert [tuple(r)[1:] for r in grid.read_supplier_grid(g, {"model": "SKU"}).collect()] == [(2, "A-1", "A-1", "", "", "")]
    assert [r["header"] for r in grid.available_fields(g, 2).collect()] == ["sku", "название поставщика"]


def test_cp1251_and_breaks(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('Модель|Цена\n"A\n1"|5\n'.encode("cp1251"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "f.csv"))
    assert grid.detect_encoding(files).first()["encoding"] == "windows-1251"
    g = grid.csv_grid(spark, str(tmp_path / "f.csv"), encoding="windows-1251")
    assert [r["cells"] for r in grid.attr_csv(g).orderBy("row_number").collect()] == [["Модель", "Цена"], ["A\n1", "5"]]


def test_xml_feed(spark, tmp_path):
    xml = '<offers><offer id="7"><sku>A-1</sku><display>Чайник</display><cost>12990</cost><maker>M</maker><href>u</href><param name="Цвет">Белый</param><param name="Вес">1</param></offer><offer id="8"><sku></sku></offer></offers>'
    (tmp_path / "f.xml").write_text(xml, "utf-8")
    got = feeds.read_supplier_xml(spark, str(tmp_path / "f.xml"), "offer", {"model": "SKU", "name": "<display>", "price": "cost", "brand": "param:цвет", "url": "@id"})
    assert [tuple(r)[1:] for r in got.collect()] == [("A-1", "Чайник", "12990", "Белый", "7")]
    assert feeds.read_offer_xml(spark, str(tmp_path / "f.xml"), "offer").first()["item"]["cost"] == "12990"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert grid.detect_format(files).first()["format"] == "xml"
    assert grid.drop_oversize(files, 5)[1].count() == 1


def test_wide_csv(spark, tmp_path):
    cells = [f"h{k}" for k in range(150)]
    (tmp_path / "a.csv").write_text("x;y\n" + ";".join(cells) + '\n"a;b\n;c";2\n\n', "utf-8")
    (tmp_path / "b.csv").write_text("p;q\n", "utf-8")
    got = grid.csv_grid(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], sep=";")
    assert sorted(r["cells"] for r in got.collect()) == sorted([["x", "y"], cells, ["a;b\n;c", "2"], ["p", "q"]])
    assert grid.locate_header(got, ["h149", "h3"]).first()["at"] == [149, 3]


def test_xml_attributes_and_repeats(spark, tmp_path):
    xml = "<offers><offer><vendorCode>A-1</vendorCode><name>one</name><pic>p1</pic></offer><offer><vendorCode type='x'>B-2</vendorCode><name>two</name><pic>p2</pic><pic n='1'>p3</pic></offer><offer><name>three</name><box><w>1</w></box></offer></offers>"
    (tmp_path / "f.xml").write_text(xml, "utf-8")
    got = [r["item"] for r in feeds.read_offer_xml(spark, str(tmp_path / "f.xml"), "offer").collect()]
    assert got == [{"vendorcode": "A-1", "name": "one", "pic": "p1"}, {"vendorcode": "B-2", "name": "two", "pic": "p3"}, {"name": "three"}]


GRID = [
    ("f", 1, "One", 1, ["Прайс"]), ("f", 1, "One", 2, ["Модель", "Цена"]), ("f", 1, "One", 3, ["A-1", "49 490Р"]), ("f", 1, "One", 4, ["", "5"]), ("f", 1, "One", 5, ["C-1", ""]),
    ("f", 2, "Two", 1, ["Название", " ЦЕНА", "модель"]), ("f", 2, "Two", 2, ["x", "59590.0", "B-2"]), ("f", 3, "Three", 1, ["Описание", "Картинка"]),
]


@pytest.fixture()
def sheets(spark):
    return spark.createDataFrame(GRID, "file string, sheet_index int, sheet_name string, row_number int, cells array<string>")


def test_conversion(spark, sheets):
    got = grid.convert_prices(sheets, "Модель", "Цена").orderBy("sheet_index").select("model", "price").collect()
    assert [tuple(r) for r in got] == [("A-1", "49490"), ("B-2", "595900")]
    with pytest.raises(ValueError):
        grid.convert_prices(sheets, "Модель", "Цена", sheet=3)
    with pytest.raises(ValueError):
        grid.convert_prices(sheets, "Модель", "Цена", "Промо")


def test_promo(spark):
    g = spark.createDataFrame([("f", 1, "", 1, ["Модель", "Цена", "03.08"]), ("f", 1, "", 2, ["A-1", "9990", "7999"]), ("f", 1, "", 3, ["C-3", "12990", ""])], "file string, sheet_index int, sheet_name string, row_number int, cells array<string>")
    got = grid.convert_prices(g, "Модель", "Цена", "03.08.2026", "2026-08-05", "2026-09-01").orderBy("row_number")
    assert [r["special"] for r in got.collect()] == ["1,1,7999,2026-08-05,2026-09-01", ""]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", "m", "1")], "url string, model string, price string")
    whole = lambda name: b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
    many = spark.createDataFrame([(f"u{k}", 'm;"x', " 1 ") for k in range(9)], df.schema).repartition(3)
    for name, rows in (("p", df), ("none", df.limit(0)), ("many", many)):
        for one in (False, True):
            sinks.write_products(rows, str(tmp_path / name), one)
            lines = whole(name).decode("utf-8").split("\r\n")
            assert lines[0] == "\ufeffURL товара;_MODEL_;_PRICE_" and lines[-1] == ""
            assert sorted(lines[1:-1]) == ([f'u{k};"m;""x"; 1 ' for k in range(9)] if rows is many else ["u;m;1"] if rows is df else [])
    sinks.write_prices(df.withColumn("special", F.lit(None).cast("string")), str(tmp_path / "q"))
    assert whole("q").decode("utf-8") == "\ufeff_MODEL_;_PRICE_;_SPECIAL_\nm;1;\n"
    sinks.write_attributes(df.select(F.lit("М-1").alias("model"), F.lit("а|б|冰\nв|г|д").alias("stack")), str(tmp_path / "a"))
    assert whole("a") == '_MODEL_;_ATTRIBUTES_\r\nМ-1;"а|б|?\nв|г|д"\r\n'.encode("cp1251")
    news = df.select("url", "model", "price", *[F.lit(c).alias(c) for c in ("date_found", "group", "brand", "name", "availability")], F.array(F.lit("A"), F.lit("B")).alias("missing_on"))
    sinks.write_news(news, str(tmp_path / "n"))
    assert whole("n").decode("utf-8").split("\r\n")[1] == "date_found;group;brand;name;m;1;availability;A, B;u"
    sinks.write_sheets(df.withColumn("sheet", F.lit("A")), str(tmp_path / "s"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "info", "2026-01-01 00:00:00"), (2, "error", "2026-01-02 00:00:00"), (3, "info", "2026-01-02 00:00:00")], "id int, level string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, level string, at string, created_at timestamp_ntz").parquet(str(tmp_path / "in"))
    q = streams.stream_log_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("counts").collect()} == {("info", 2), ("error", 1)}
    q = streams.first_seen(stream, ["level"], "created_at").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2


def test_a_staged_table_is_discarded(spark):
    kept, gone = storage.staged(spark.range(5), "kept"), storage.staged(spark.range(7), "gone")
    file = gone.inputFiles()[0].removeprefix("file://")
    storage.discard(gone)
    storage.discard(storage.staged(spark.range(0), "empty"))
    assert not os.path.exists(file) and kept.count() == 5
