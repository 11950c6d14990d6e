"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from shelfmark.llm import alignment, binary_search, fingerprint, html_extract, mixing, ngram_join, pii, piece_codec, sharding, spelling, toxicity, url_filter, vector_dedup
from shelfmark.llm.common import WORD, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, held_out, score, predicted. Null and empty texts score the bias alone; repeated rows score the same; a row whose
    doc_id is null is not held out; without toxic labels the prior weights score; no documents, no rows. Other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, url, text, n_chars. Null or empty html, and pages without main text: '' and 0. Repeated rows come again; an empty table
    gives none; pages may be very long, as the time grows in proportion; other columns are not looked at."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_extract.extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_shingles, component_id. Texts without words: 0 shingles, alone; null doc_ids: alone, component null; rows of one doc_id
    are one document. Links have no order, so there are no ties. An empty table gives none; other columns are not looked at."""
    return ngram_join.classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint, its edited text's and the likenesses. Null texts are empty; rows of one doc_id follow each other by text,
    null doc_ids come first; a single row is its own successor; an empty table gives none; other columns are not looked at."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: counts of the base kinds, the digest of the base spans, and all spans. Null and empty texts have none ('' digested). Spans go by start,
    kind, end. Repeated rows get the same; without candidates there is no model and base spans stand alone; other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.learn(docs)).alias("s"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = joined(F.filter("s", lambda x: x["base"]))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_tokens and digests of ids and decoded text. Null and empty texts: begin and end alone. Texts of any length and any
    characters; repeated rows get the same; an empty table gives none; other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", piece_codec.encode_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("r"))
    return coded.select("doc_id", "r.n_tokens", F.sha2("r.ids", 256).alias("ids_sha256"), F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: its size, crc32, shard and slot by the law of bytes. Null texts count 1 byte; equal texts share a shard unless they are too many for
    one; repeated rows have slots of their own; an empty table gives none; other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.lit("bytes").alias("law"),
    )
    out = sharding.shard_by_bytes(rows, F.col("text_hash"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: size, source_size, target, taken and positions. Null texts have no words; null sources are a source, the last; the order within
    a source is by md5 of the doc_id, then doc_id. Repeated rows are taken each; an empty table gives none; other columns are not looked at."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    assigned = mixing.assign(docs.select("doc_id", "source", words.alias("size")))
    return mixing.training_order(assigned).select("doc_id", "size", "source_size", "target", "taken", "position", "again")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source
), ranked AS (
  SELECT source, n, CAST(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS BIGINT) AS k FROM by_source
), weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked
), filled AS (
  SELECT *,
    sum(w) OVER (ORDER BY CAST(n AS DOUBLE) / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    coalesce(sum(n) OVER (ORDER BY CAST(n AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
    sum(n) OVER () AS n_all
  FROM weighed
), marked AS (
  SELECT *, (3 * n_all - 4 * n_before) * w < 4 * n * w_left AS free FROM filled
), level AS (
  SELECT max(CASE WHEN NOT free THEN CAST(n AS DOUBLE) / w END) AS capped_to,
         sum(CASE WHEN NOT free THEN n ELSE 0 END) AS n_capped,
         sum(CASE WHEN free THEN w ELSE 0 END) AS w_free
  FROM marked
), goal AS (
  SELECT m.source, m.n, m.k,
    CASE WHEN m.free THEN CAST((3 * m.n_all - 4 * l.n_capped) * m.w AS DOUBLE) / CAST(2 * l.w_free AS DOUBLE) ELSE CAST(2 * m.n AS DOUBLE) END AS target
  FROM marked m, level l
), laid AS (
  SELECT s.doc_id, s.size, g.n AS source_size, g.target, g.k,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), used AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS first_use,
            greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS second_use
  FROM laid
), timed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
            CASE k % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope,
            CAST(start AS DOUBLE) / target AS u, CAST(source_size + start AS DOUBLE) / target AS v
  FROM used
)
SELECT doc_id, size, source_size, target, CAST(first_use + second_use AS BIGINT) AS taken,
  CASE WHEN first_use > 0 THEN round(least(2 * u / (a + sqrt(greatest(a * a + 2 * slope * u, 0))), 1), 9) END AS position,
  CASE WHEN second_use > 0 THEN round(least(2 * v / (a + sqrt(greatest(a * a + 2 * slope * v, 0))), 1), 9) END AS again
FROM timed
"""


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is divisible by 50 the ten nearest codes: query_id, rank, neighbor_id, distance. Ties go to the smaller id; null ids or vectors have no
    code; repeated rows count once; fewer vectors give fewer rows, an empty table none; other columns are not looked at."""
    vectors = table(spark, sf_dir, "embeddings")
    return binary_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=10)


OP9_SQL = r"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         CAST(len(list_filter(list_zip(q.code, v.code), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
  FROM codes q JOIN codes v ON q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance FROM near
)
SELECT * FROM ranked WHERE rank <= 10
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, host, path, rule, verdict. Null urls and urls without '://': both '', no rule, allow. Of rules that fit the longest decides;
    repeated rows come again; an empty table gives none; other columns are not looked at."""
    listed = spark.createDataFrame([(d,) for d in url_filter.LISTED], "key string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '^(.*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings: vec_id, n_links, component_id, kept. Null, zero and non-finite vectors and null labels link with nothing; rows without a vec_id are linked but
    are no component's id; repeated rows are rows of their own, linked with each other; an empty table gives none; other columns are not looked at."""
    return vector_dedup.near_copies(table(spark, sf_dir, "embeddings"), 0.93)


OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), usable AS (
  SELECT k, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM given
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.k AS a, b.k AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.k <> b.k
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT k, k AS o FROM given UNION SELECT r.k, l.b FROM reach r JOIN links l ON r.o = l.a
), least AS (
  SELECT r.k, min(g.vec_id) AS component_id FROM reach r JOIN given g ON r.o = g.k GROUP BY r.k
), counts AS (
  SELECT a AS k, count(*) AS n FROM links GROUP BY a
)
SELECT g.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, CAST(m.component_id AS BIGINT) AS component_id, coalesce(g.vec_id = m.component_id, FALSE) AS kept
FROM given g JOIN least m ON g.k = m.k LEFT JOIN counts c ON g.k = c.k
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents of seven code points or more that occurs twice: word, form, root, n, n_near, form_n. Null and empty texts have no words; a null doc_id is
    hashed as an empty one; of equally frequent near words the smallest is the form; repeated rows count again; an empty table gives none; other columns are not looked at."""
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents
), lowered AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(s) + 1), lambda i: CAST(('0x' || substr(hex(encode(s)), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS h
  FROM (SELECT r, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS s FROM lowered), crc
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), skipped AS (
  SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM skipped a JOIN skipped b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM skipped a JOIN words w ON a.p || a.s = w.word
  UNION SELECT w.word, a.word, a.n FROM skipped a JOIN words w ON a.p || a.s = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(a := -n, b := encode(other))) AS top FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top.n >= 10 * w.n THEN b.top.other END AS form, CASE WHEN b.top.n >= 10 * w.n THEN b.top.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), ways AS (
  SELECT word, word AS here, 0 AS d FROM formed UNION ALL SELECT y.word, f.form, y.d + 1 FROM ways y JOIN formed f ON y.here = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(here, d) AS root FROM ways GROUP BY word
)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: tokens of two tokenizers, their groups and links, and how common the links are. Null and empty texts, and texts that the tokens do not give
    back: zeros and ''. Ties are all best; repeated rows are a document each; an empty table gives none; other columns are not looked at."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_join": op3_ngram_join,
    "op4_fingerprints": op4_fingerprints,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_mixing": op8_mixing,
    "op9_exact_search": op9_exact_search,
    "op10_url_filter": op10_url_filter,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op8_mixing": OP8_SQL,
    "op9_exact_search": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_vector_dedup": OP11_SQL,
    "op12_spelling": OP12_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
