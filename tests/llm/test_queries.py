"""The registered queries on small tables that hold nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import re
import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfmark.llm import fingerprint  # noqa: E402
from shelfmark.llm.queries import QUERIES  # noqa: E402
from tests.llm.test_llm import brute_classes  # noqa: E402

LONG = " ".join(f"w{k % 977}" for k in range(20_000))
TEXTS = [None, "", " \t\n", "you idiot", LONG, LONG + " x", "mail a.b@example.org, ip 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111 tel +49 (30) 1234-5678", "é🙂 \x00\n", "same words here for all", "same words here for all", "Same WORDS here for all"]
#: Names that the operators use within themselves.
EXTRA = "size digest d key id n comp score spans ids position target r s p e _key _order shard".split()


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = ", ".join(f"{c} int" for c in EXTRA)
    more = (7,) * len(EXTRA)
    docs = [(k, t, "en", "ab"[k % 2] if k else None, len(t or ""), *more) for k, t in enumerate(TEXTS)]
    docs.append(docs[3])
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    write(spark, path, "documents", docs, schema)
    write(spark, path, "labels", [(3, 0, 1), (3, 0, 0), (8, 1, 0), (9, 1, 0), (10, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    page = "<html><head><title>t</title></head><body><article><p>First line. Second line, with a longer text that goes on for a while.</p></article></body></html>"
    pages = [(1, "HTTPS://WWW.Example.org/en/1", page, *more), (2, None, None, *more), (3, "no host", "", *more), (1, "HTTPS://WWW.Example.org/en/1", page, *more), (4, "https://a.com/de/?q", page * 200, *more)]
    write(spark, path, "pages", pages, f"page_id long, url string, html string, {extra}")
    v = [float((k * 37) % 11 - 5) for k in range(40)]
    vectors = [(0, v, 1), (0, v, 1), (50, v, 1), (7, [-x for x in v], 1), (None, v, 1), (9, None, 1)]
    write(spark, path, "embeddings", vectors, "vec_id long, embedding array<float>, label int")
    empty = str(tmp_path_factory.mktemp("empty"))
    for name, s in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("pages", f"page_id long, url string, html string, {extra}"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        write(spark, empty, name, [], s)
    return path, empty


ROWS = [*enumerate(TEXTS), (3, TEXTS[3])]
sha = lambda t: hashlib.sha256(t.encode("utf-8") if isinstance(t, str) else t).hexdigest()


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r or "slot" in r
        out[r["doc_id"]] = r
    return out


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).count() == 0


def test_op1(spark, tables):
    df = QUERIES["op1_toxicity"](spark, tables[0])
    assert dict(df.dtypes)["predicted"] == "int" and df.count() == len(ROWS)
    got = by_id(df)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] < 0.5 <= got[3]["score"]


def test_op2(spark, tables):
    df = QUERIES["op2_html_extraction"](spark, tables[0])
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in df.collect()]
    want = "First line. Second line, with a longer text that goes on for a while."
    assert dict(df.dtypes)["n_chars"] == "bigint" and got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got
    assert all(n == len(t) for _, t, n in got)


def test_op3(spark, tables):
    got = by_id(QUERIES["op3_ngram_join"](spark, tables[0]))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute_classes(TEXTS, 4, 85)


def test_op4(spark, tables):
    got = QUERIES["op4_fingerprints"](spark, tables[0]).collect()
    rows = sorted(((k, t or "") for k, t in ROWS))
    edits = {}
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        edits.setdefault(k, set()).add((len(t), sha(e), fingerprint.to_text(fingerprint.sketch(t)), fingerprint.to_text(fingerprint.sketch(e))))
    assert len(got) == len(ROWS) and all((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) in edits[r["doc_id"]] for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def base_spans(t):
    """The contract's patterns, each leftmost and without retries."""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_op5(spark, tables):
    got = by_id(QUERIES["op5_pii"](spark, tables[0]))
    for k, t in ROWS:
        base = base_spans(t or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base)
        assert got[k]["base_sha256"] == sha(joined)
        assert [got[k][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(x[2] == kind for x in base) for kind in ("email", "ip", "card", "phone")]
        assert set(filter(None, joined.split(","))) <= set(got[k]["spans"].split(","))
    assert got[6]["n_email"] == got[6]["n_ip"] == got[6]["n_card"] == got[6]["n_phone"] == 1


def test_op6(spark, tables):
    df = QUERIES["op6_sharding"](spark, tables[0])
    got = df.collect()
    want = sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and all(0 <= r["shard"] < 8 for r in got)
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["doc_id"]: r["shard"] for r in got}[8] == {r["doc_id"]: r["shard"] for r in got}[9]


def test_op7(spark, tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(QUERIES["op7_sentencepiece"](spark, tables[0]))
    for k, t in ROWS:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        assert got[k].asDict() == {"doc_id": k, "n_tokens": len(ids), "ids_sha256": sha(struct.pack(f"<{len(ids)}I", *ids)), "decoded_sha256": sha(sp.decode(ids))}


def test_op8(spark, tables):
    got = QUERIES["op8_mixing"](spark, tables[0]).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in ROWS}
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((k, size[k]) for k, _ in ROWS)
    source = lambda k: "ab"[k % 2] if k else None
    for s in ("a", "b", None):
        own = [r for r in got if source(r["doc_id"]) == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)} and sum(r["taken"] for r in own) == int(own[0]["target"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_op9(spark, tables):
    got = sorted(map(tuple, QUERIES["op9_exact_search"](spark, tables[0]).select("query_id", "rank", "neighbor_id", "distance").collect()))
    assert [x[:3] for x in got if x[0] == 50] == [(50, 1, 0), (50, 2, 50), (50, 3, 7)]
    assert {x[0] for x in got} == {0, 50}


def test_op10(spark, tables):
    got = {tuple(r) for r in QUERIES["op10_url_filter"](spark, tables[0]).collect()}
    assert got == {(1, "www.example.org", "/en/1", "example.org/en/1", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "/de/", "com/de/", "block")}


def test_pipeline_on_repeated_labels(spark, tables):
    got = QUERIES["pipeline"](spark, tables[0])
    rows = got.collect()
    assert 3 not in {r["doc_id"] for r in rows} and len({r["position"] for r in rows}) == len(rows) and all(r["round_trip"] for r in rows)
