"""Sheet grids: file, sheet_index, sheet_name, row_number, cells. From CSV files, and the location of header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.candidates import converter_model
from shelfmark.functions.text import clean_text, norm_header, price_digits, text_of
from shelfmark.storage import spread

# Fixed values
DELIMITERS = (";", ",", "|", "\t")
BRAND_HEADERS = ("brand", "бренд", "manufacturer", "производитель", "vendor", "марка")
NAME_HEADERS = ("наименование товара", "название товара", "наименование", "название", "product name", "product_name", "item name", "item_name", "name")
MAX_BYTES = 200 * 1024 * 1024
#: Cells of a record beyond which a file is an error.
MAX_COLUMNS = 20_480
SHEET = ["file", "sheet_index"]


def detect_format(files: DataFrame) -> DataFrame:
    """path, format (xlsx, xls, xml, csv) of binaryFile rows: a zip file that names a workbook is xlsx, else what follows the byte order
    mark (UTF-8, UTF-16) and blanks in the first 4096 bytes decides."""
    head = F.hex(F.substring("content", 1, 4096))
    wide, narrow = "^(FFFE)((20|09|0A|0B|0C|0D)00)*3C00", "^FEFF(00(20|09|0A|0B|0C|0D))*003C"
    plain = "^(EFBBBF)?(20|09|0A|0B|0C|0D)*3C"
    workbook = head.startswith("504B0304") & F.contains("content", F.lit("xl/workbook.xml").cast("binary"))
    kind = F.when(workbook, "xlsx").when(head.startswith("D0CF11E0"), "xls").when(head.rlike(f"{wide}|{narrow}|{plain}"), "xml").otherwise("csv")
    return files.select("path", kind.alias("format"))


def drop_oversize(files: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files within the limit, and those beyond it (path, length)."""
    return files.where(F.col("length") <= limit), files.where(F.col("length") > limit).select("path", "length")


def detect_encoding(files: DataFrame) -> DataFrame:
    """path, encoding: utf-8 where the whole content is, else windows-1251."""
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), "UTF-8").otherwise("windows-1251").alias("encoding"))


def detect_delimiter(lines: DataFrame) -> str:
    """The delimiter that the first lines (column value, 4096 characters of each) hold most of, ';' among equals."""
    counts = lines.select(F.left("value", F.lit(4096)).alias("v")).limit(20).agg(*[F.sum(F.length("v") - F.length(F.replace("v", F.lit(d)))).alias(f"d{k}") for k, d in enumerate(DELIMITERS)]).first()
    return max(enumerate(DELIMITERS), key=lambda x: ((counts[x[0]] or 0), -x[0]))[1]


def csv_grid(spark: SparkSession, paths: str | list[str], sep: str | None = None, encoding: str = "UTF-8", width: int = 64) -> DataFrame:
    """CSV files as grids. Quoted cells may hold line breaks; row numbers count the records of a file, blank ones included.

    width: the columns read at least; wider records are read whole, their width being taken in a pass before.
    windows-1251 needs spark.sql.legacy.javaCharsets.
    """
    sep = sep or detect_delimiter(spark.read.text(paths).limit(20))
    read = lambda names, most: spark.read.schema(", ".join(f"{c} string" for c in names)).csv(paths, sep=sep, header=False, multiLine=True, encoding=encoding, ignoreLeadingWhiteSpace=False, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_record", maxColumns=most)
    # a record of more than one cell is whole in _record; quoted delimiters only make the bound wider
    records = read(["c0", "_record"], MAX_COLUMNS).select(F.when(F.col("c0").isNull() & F.col("_record").isNull(), 0).otherwise(F.length("_record") - F.length(F.replace("_record", F.lit(sep)))).alias("n"))
    width = max(width, (records.agg(F.max("n")).first()[0] or 0) + 1)
    cells = [f"c{k}" for k in range(width)]
    raw = read(cells, max(MAX_COLUMNS, width))
    # a file is one task with multiLine: its records come in order
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("cells"), F.monotonically_increasing_id().alias("_n"))
    first = rows.groupBy("file").agg(F.min("_n").alias("_first"))
    own = rows.join(first, "file")
    trimmed = F.slice("cells", F.lit(1), F.greatest(F.lit(1), F.aggregate(F.transform("cells", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))))
    bom = F.transform(trimmed, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "^﻿", ""))
    return own.select("file", F.lit(1).alias("sheet_index"), F.lit("").alias("sheet_name"), (F.col("_n") - F.col("_first") + 1).cast("int").alias("row_number"), bom.alias("cells"))


def first_header(grid: DataFrame) -> DataFrame:
    """file, sheet_index, header_row, header: the first row of each sheet with a cell that is not blank."""
    filled = grid.where(F.exists("cells", lambda c: clean_text(c) != ""))
    first = filled.groupBy(*SHEET).agg(F.min_by(F.struct("row_number", "cells"), "row_number").alias("h"))
    return first.select(*SHEET, F.col("h.row_number").alias("header_row"), F.transform("h.cells", norm_header).alias("header"))


def header_forms(field: str) -> list[str]:
    """Spellings that a header may have; a date d.m.Y is found in ISO form and without its year too."""
    parts = field.split(".")
    out = [field]
    if len(parts) == 3 and all(p.isdigit() for p in parts):
        out += [f"{parts[2]}-{parts[1]}-{parts[0]}", f"{parts[0]}.{parts[1]}"]
    return out


def locate_header(grid: DataFrame, fields: list[str], sheet: int | None = None) -> DataFrame:
    """file, sheet_index, header_row, at (place of each field in the cells, from 0): the first row of a sheet in which all fields stand, in any order.

    Sheets without one are left out; if a sheet was chosen and lacks it, ValueError.
    """
    rows = grid if sheet is None else grid.where(F.col("sheet_index") == sheet)
    heads = F.transform("cells", norm_header)
    place = lambda f: F.greatest(*[F.array_position(heads, norm_header(F.lit(x))) for x in header_forms(f)], F.lit(0))
    found = rows.withColumn("at", F.array(*[place(f).cast("int") - 1 for f in fields])).where(F.forall("at", lambda x: x >= 0))
    out = found.groupBy(*SHEET).agg(F.min_by(F.struct("row_number", "at"), "row_number").alias("h")).select(*SHEET, F.col("h.row_number").alias("header_row"), F.col("h.at").alias("at"))
    if sheet is not None and out.isEmpty():
        raise ValueError(f"sheet {sheet} lacks {fields}")
    return out


def body(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header of their sheet, with its columns."""
    return grid.join(headers, SHEET).where(F.col("row_number") > F.col("header_row"))


def cell(at: Column | int) -> Column:
    """The cleaned cell at a place, '' beyond the row's end or where the place is null or negative."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at >= 0, clean_text(F.get("cells", at))).otherwise(F.lit(""))


def read_supplier_grid(grid: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Offers (file, row_number, source_model, name, price, brand, url) of sheets whose first filled row is the header.

    fields: model (needed), name, price, brand, url to header text. Without a name column the model is the name; blank models are dropped.
    """
    heads = first_header(grid)
    at = lambda k: F.array_position("header", norm_header(F.lit(fields[k]))).cast("int") - 1 if fields.get(k) else F.lit(-1)
    rows = body(grid, heads.where(at("model") >= 0))
    value = {k: cell(at(k)) for k in ("model", "name", "price", "brand", "url")}
    name = F.when(at("name") >= 0, value["name"]).otherwise(value["model"])
    return rows.select("file", "row_number", value["model"].alias("source_model"), name.alias("name"), value["price"].alias("price"), value["brand"].alias("brand"), value["url"].alias("url")).where("source_model <> ''")


def read_price_file(grid: DataFrame, model_field: str, price_field: str) -> DataFrame:
    """row_number, name, price, brand, source_model of a price file; brand and name columns are found by their usual headers; no dedupe."""
    heads = first_header(grid)
    at = lambda names: F.coalesce(*[F.nullif(F.array_position("header", norm_header(F.lit(n))), F.lit(0)) for n in names], F.lit(0)).cast("int") - 1
    rows = body(grid, heads.where((at([model_field]) >= 0) & (at([price_field]) >= 0)))
    model = cell(at([model_field]))
    name = F.when(at(NAME_HEADERS) >= 0, cell(at(NAME_HEADERS))).otherwise(model)
    return rows.select("file", "row_number", model.alias("source_model"), name.alias("name"), cell(at([price_field])).alias("price"), cell(at(BRAND_HEADERS)).alias("brand")).where("source_model <> ''")


def available_fields(grid: DataFrame, limit: int = 20) -> DataFrame:
    """header, pos: the first distinct headers of the first sheet."""
    cells = first_header(grid).select(F.posexplode("header").alias("pos", "header")).where("header <> ''")
    return cells.groupBy("header").agg(F.min("pos").alias("pos")).orderBy("pos", "header").limit(limit)


def attr_csv(grid: DataFrame) -> DataFrame:
    """The grid with blanks in every cell cleaned line by line, breaks kept."""
    line = lambda c: F.array_join(F.transform(F.split(text_of(c), r"\r\n|\r|\n"), clean_text), "\n")
    return grid.withColumn("cells", F.transform("cells", lambda c: F.regexp_replace(line(c), r"^\n+|\n+$", "")))


def promo_special(price: Column, start: str, end: str) -> Column:
    """'1,1,price,start,end' where there is a promo price, else ''."""
    return F.when(price != "", F.concat_ws(",", F.lit("1"), F.lit("1"), price, F.lit(start), F.lit(end))).otherwise("")


def convert_prices(grid: DataFrame, model_field: str, price_field: str, promo_field: str = "", promo_start: str = "", promo_end: str = "", sheet: int | None = None) -> DataFrame:
    """file, sheet_index, row_number, model, price and, with a promo column, special of all rows with a model and a price.

    A promo column needs both dates (ISO), else ValueError.
    """
    if promo_field and not (promo_start and promo_end):
        raise ValueError("a promo column needs its dates")
    fields = [model_field, price_field] + ([promo_field] if promo_field else [])
    grid = spread(grid, *SHEET, "row_number")
    rows = body(grid, locate_header(grid, fields, sheet))
    special = [promo_special(price_digits(F.get("cells", F.col("at")[2])), promo_start, promo_end).alias("special")] if promo_field else []
    # one struct, exploded, so that the filter below does not compute the models again
    made = F.struct(converter_model(F.get("cells", F.col("at")[0])).alias("model"), price_digits(F.get("cells", F.col("at")[1])).alias("price"), *special)
    out = rows.select(*SHEET, "row_number", F.explode_outer(F.array(made)).alias("c")).select(*SHEET, "row_number", "c.*")
    return out.where("model <> '' and price <> ''")
