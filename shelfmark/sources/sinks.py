"""Exports. Spark's committer makes each of them appear as a whole or not at all.

An export is a folder: its first part holds the header (and the byte order mark), the others rows in order; put together by
name they are one file as the fixed formats ask for. one_file writes a single part, for reports that one task can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import text_of
from shelfmark.storage import setting

# Columns of the exports
PRODUCTS = ["URL товара", "_MODEL_", "_PRICE_"]
NEWS = {
    "date_found": "Дата появления",
    "group": "Группа",
    "brand": "Сайт/бренд",
    "name": "Наименование",
    "model": "Модель",
    "price": "Цена",
    "availability": "Наличие",
    "missing_on": "Нет на сайтах",
    "url": "URL товара",
}
BOM, CRLF = "\ufeff", "\r\n"


def _csv(df: DataFrame, headers: list[str], path: str, line: str = CRLF, encoding: str = "UTF-8", one_file: bool = False) -> None:
    spark = df.sparkSession
    quoted = lambda c: F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    record = F.concat_ws(";", *[quoted(text_of(F.col(c))) for c in df.columns])
    # the header is the first partition of the union, and so the first part
    head = spark.createDataFrame([((BOM if encoding == "UTF-8" else "") + ";".join(headers),)], "value string").coalesce(1)
    rows = head.unionAll(df.select(record.alias("value")))
    if one_file:  # in the order of the parts; coalesce may change it
        rows = rows.withColumn("_n", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("_n").drop("_n")
    if encoding == "UTF-8":
        return rows.write.mode("overwrite").text(path, lineSep=line)
    # the text writer copies a value's bytes as they are
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"), setting(spark, "spark.sql.legacy.codingErrorAction", "true"):
        rows.select(F.encode("value", encoding).cast("string").alias("value")).write.mode("overwrite").text(path, lineSep=line)


def write_products(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Address, model and price of products (url, model, price); UTF-8 with a byte order mark."""
    _csv(df.select("url", "model", "price"), PRODUCTS, path, one_file=one_file)


def write_news(df: DataFrame, path: str, one_file: bool = False) -> None:
    """The nine fixed columns; the missing feeds as one text."""
    out = df.withColumn("missing_on", F.array_join("missing_on", ", ")) if dict(df.dtypes)["missing_on"].startswith("array") else df
    _csv(out.select(*NEWS), list(NEWS.values()), path, one_file=one_file)


def write_prices(df: DataFrame, path: str, one_file: bool = False) -> None:
    """_MODEL_;_PRICE_ and, where there is one, _SPECIAL_; lines end with LF."""
    columns = ["model", "price"] + (["special"] if "special" in df.columns else [])
    _csv(df.select(*columns), ["_MODEL_", "_PRICE_", "_SPECIAL_"][: len(columns)], path, "\n", one_file=one_file)


def write_sheets(df: DataFrame, path: str) -> None:
    """A folder for each sheet (column sheet), every part with a header; without rows, one part with the header only."""
    df.write.mode("overwrite").partitionBy("sheet").option("sep", ";").option("header", True).csv(path)
    if df.isEmpty():
        df.drop("sheet").limit(0).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_attributes(df: DataFrame, path: str, one_file: bool = False) -> None:
    """_MODEL_;_ATTRIBUTES_ of products (model, stack) in windows-1251, what it lacks as question marks."""
    _csv(df.select("model", "stack"), ["_MODEL_", "_ATTRIBUTES_"], path, encoding="windows-1251", one_file=one_file)
