"""Training text from documents: five stages, each a table that the next one reads.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import re
from itertools import accumulate

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import mixing, ngram_join, pii, piece_codec, toxicity
from shelfmark.llm.common import WORD, gathered, listed, small_batches, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5 stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return gathered(docs.where(toxicity.toxicity(F.col("text"), model) < 0.5).select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies stays (five words, 0.8); rows without a doc_id all stay."""
    small_batches(spark)
    classes = ngram_join.classes(docs, n=5, percent=80)
    gone = staged(gathered(classes.where("doc_id <> component_id").select("doc_id").distinct()), "near-copies")
    few = gone.count() <= ngram_join.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), "doc_id", "left_anti")
    return gathered(kept.select(COLUMNS)) if few else kept.select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets."""
    small_batches(spark)
    text = pii.redact(F.col("text"), pii.learn(docs))
    return gathered(docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in training order; what the mix does not take goes, what it takes twice comes twice."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return mixing.uses(mixing.assign(docs, size=words)).select(COLUMNS)


def placed(docs: DataFrame) -> DataFrame:
    """docs with position: a row's place, from 0, in the order in which the table was written. Anything but a table is written first."""
    own = "_metadata.file_name", "_metadata.row_index"
    try:
        rows = docs.select("*", *[F.col(c).alias(n) for c, n in zip(own, ("_file", "_row"))])
    except AnalysisException:
        return placed(staged(docs, "placed"))
    # reads no column; as many rows reach the driver as there are files
    sizes = rows.groupBy("_file").count().collect()
    part = lambda name: int(m[1]) if (m := re.match(r"part-(\d+)", name)) else 0
    files = sorted(sizes, key=lambda r: (part(r["_file"]), r["_file"]))
    starts = accumulate((r["count"] for r in files), initial=0)
    first = listed(docs.sparkSession, [(r["_file"], n) for r, n in zip(files, starts)], "_file string, _first long")
    return rows.join(F.broadcast(first), "_file").withColumn("position", F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position (place in training order, from 0), doc_id, ids (little-endian 32-bit integers), n_tokens and whether decoding them gives the text back."""
    small_batches(spark)
    r = piece_codec.encode_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    coded = placed(docs).select("position", "doc_id", "text", r.alias("r"))
    # the codec knows blanks only as U+2581, which it decodes to a blank
    same = F.col("r.decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return coded.select("position", "doc_id", "r.n_tokens", "r.ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The grammar, the weak supervision and the codec are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
