"""What keeps executors small: few files, and one set of Python workers."""

from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")

from corpus_pipeline import placed  # noqa: E402
from shelfmark import storage  # noqa: E402
from shelfmark.llm import mixing, ngram_join  # noqa: E402


def test_many_small_partitions_become_few_files(spark):
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k % 7}" if k % 3 else f"s{k // 6} t u v w x y z") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(storage._written)
    with storage.setting(spark, "spark.sql.shuffle.partitions", "96"), storage.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        found = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()}
    assert found == {k: k if k % 3 else k // 6 * 6 for k, _ in rows}
    most = max(4 * spark.sparkContext.defaultParallelism, 96 // 8)
    files = {w: len([*Path(w.removeprefix("file:")).glob("part-*")]) for w in storage._written if w not in before and "ngram-active" not in w}
    assert files and max(files.values()) <= most, files


def test_small_tables_need_no_python_workers(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"s{k % 3}" if k % 4 else None, 5) for k in range(40)], "doc_id long, source string, size long")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for made in (mixing.assign(docs), placed(docs)):
        assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    assert sorted(r["position"] for r in placed(docs).collect()) == [*range(40)]
