"""Spelling variants, aligned tokens and near copies of vectors against brute force."""

import hashlib
import random
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfmark.llm import alignment, spelling, vector_dedup  # noqa: E402
from shelfmark.llm.queries import QUERIES  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, word int, n int, id int, p int, s int, row int, key int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 7) for r in rows], DOCS)


# --- spelling variants


def brute_variants(rows):
    counts = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(near))
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w], words[forms[w]] if forms[w] else None)
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def found_variants(df):
    return {r[0]: tuple(r[1:]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for base in ["aaaaaaa", "aaaaaaab", "bananaén", "Àbcdefgh", "×÷×÷×÷×", "zzzzzzzz"] + ["".join(rng.choices("abc", k=rng.randint(7, 10))) for _ in range(40)]:
        for times in (300, 25, 2):
            w = list(base)
            if times < 300:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice("abczÿ")], [w[k], rng.choice("abcz")]])
            rows += [(rng.randrange(90), " ".join(["".join(w)] * (times // 2)).title() if times == 2 else " ".join(["".join(w)] * (times // 2))) for _ in range(2)]
    rows += [(k, " ".join([w] * n)) for w, n in (("chainsaws", 400), ("chainsawsa", 30), ("chainsawsab", 2)) for k in (1, 2)]  # forms of forms
    rows += [(None, "Abcdefgh abcdefgh"), (3, None), (4, ""), (5, "short words, none"), rows[0], (6, "q" * 3000), (7, "q" * 3000), (8, "q" * 3001 + " " + "q" * 3001)]
    got, want = found_variants(spelling.variants(docs(spark, rows))), brute_variants(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and any(v[0] and v[0] != v[1] for v in want.values())


def test_trie_numbers_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n int").repartition(3)
    got = {r["word"]: r["path"] for r in spelling.numbered(df, "word", "path").collect()}
    nodes = defaultdict(set)
    for w, path in got.items():
        assert len(path) > max([spelling.common_start(w, v) for v in words if v != w])
        for k, number in enumerate(path):
            nodes[w[:k]].add(number)
    assert all(len(x) == 1 for x in nodes.values()) and len({min(x) for x in nodes.values()}) == len(nodes)


# --- aligned tokens


def brute_alignment(texts):
    one = alignment.aligner(A, B)
    found = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = (one.a.encode(" " + t, add_special_tokens=False).ids, one.b.encode(t)) if t else ([], [])
        said_a, said_b = [one.a_bytes[i] for i in a], [one.b_bytes[i] for i in b]
        if not t or b"".join(said_a) != raw or b"".join(said_b) != raw:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = bisect_right(ends_a, cut), bisect_right(ends_b, cut)
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        ranges_a, ranges_b = list(zip([0, *ends_a], ends_a, a)), list(zip([0, *ends_b], ends_b, b))
        links = [(x, y) for s, e, x in ranges_a for u, v, y in ranges_b if s < v and u < e]
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for f in found if f for x in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return [(f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), sha(f[2])) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "\U0001f642", "中", " ", " ", "'s", "<|endoftext|>", "<s>", "</s>", "▁", "0", "12", ".", ",", "?!", "\x00", "\x1c", "́", "ह", "ﷺ", "\r\n", "​", "\x85", "A", "ß", "한", "×", "÷", "กำ"]


def test_alignment_against_whole_texts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(400)]
    texts = [t if k % 9 else t.replace("▁", "x") for k, t in enumerate(texts)] + [t.replace("▁", " ") for t in texts]
    texts += [None, "", " ", "  ", "\n", "a ", "same text twice, it says.", "same text twice, it says.", "w" * 3000, "word, " * 400]
    want = sorted((k, *x) for k, x in enumerate(brute_alignment(texts)))
    assert any(x[1] == 0 and texts[x[0]] for x in want)
    df = docs(spark, list(enumerate(texts)))
    for most in (1 << 22, 50, 0):  # all counts sent, the commonest, none
        got = alignment.alignment(df, A, B, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(map(tuple, got.collect())) == want


def test_spans_say_where_tokens_end():
    one = alignment.aligner(A, B)
    for chunk in [" héllo", "\U0001f642中", " ﷺ́x", ",", " हก"]:
        a, b = one.a.encode(chunk, add_special_tokens=False), one.b.encode("\n" + chunk, return_type="proto").pieces[len(one.ahead) :]
        to_byte = [len(chunk[:k].encode()) for k in range(len(chunk) + 1)]
        for spans, said in (([(to_byte[s], to_byte[e]) for s, e in a.offsets], [one.a_bytes[i] for i in a.ids]), ([(p.begin - 1, p.end - 1) for p in b], [one.b_bytes[p.id] for p in b])):
            assert one.ends(spans, list(map(len, said))) == np.cumsum(list(map(len, said))).tolist() and b"".join(said) == chunk.encode()


def test_alignment_forgets_what_is_not_asked_for(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    one = alignment.Aligner(A, B)
    texts = [f"word{k} again and again" for k in range(30)]
    want = list(alignment.aligner(A, B).documents(texts))
    assert [x for t in texts for x in one.documents([t])] == want and len(one.known) < 15


def test_alignment_pairs(spark):
    df = docs(spark, [(1, "the cat"), (2, "the cat"), (3, "the"), (4, None)])
    rows = alignment.links(df, A, B).collect()
    assert all(r["best"] == (r["n"] == max(x["n"] for x in rows if x["a"] == r["a"])) for r in rows) and max(r["n"] for r in rows) == 3


# --- near copies of vectors


def brute_copies(rows, least=0.93):
    links, root = [0] * len(rows), list(range(len(rows)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if label is None or label != other or not v or not w or len(v) != len(w) or not all(x is not None and np.isfinite(x) for x in [*v, *w]) or not any(v) or not any(w):
                continue
            if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                root[of(i)] = of(j)
    least_id = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least_id[of(i)] = min(k, least_id.get(of(i), k))
    return sorted((str(k), links[i], str(least_id.get(of(i))), k is not None and least_id[of(i)] == k) for i, (k, _, _) in enumerate(rows))


def found_copies(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int, node int, w int, grp int, shard int, h int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 5) for r in rows], VECTORS)


def test_vector_edge_cases(spark):
    v = [float((k * 37) % 11 - 5) for k in range(12)]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (None, [x + 0.1 for x in v], 1), (9, [2 * x for x in v], 1), (8, v, 2), (7, v, None), (1, None, 1), (2, [0.0] * 12, 1), (4, [float("nan")] + v[1:], 1)]
    rows += [(6, [float("inf")] + v[1:], 1), (10, [None] + v[1:], 1), (11, [-x for x in v], 1), (12, v[:6], 1), (13, v[:6], 1), (None, [-1.0, 0.0], 3), (14, [-0.0, 1.0], 4), (15, [0.0, 1.0], 4), (16, [], 1)]
    rows += [(17, [1e30, 1e30], 5), (18, [1e-30, 1e-30], 5), (None, [3.0, 3.0], 5), (5, [1.0] * 12, 1)]
    assert found_copies(vector_dedup.near_copies(vectors(spark, rows))) == brute_copies(rows)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, chain = [], rng.standard_normal(24)
    for k in range(500):
        v = rng.standard_normal(24)
        rows.append((k, v.round(3).tolist(), k % 2))
        if k % 9 == 0:
            rows.append((1000 + k, (v + 0.2 * rng.standard_normal(24)).round(3).tolist(), k % 2))
    center = rng.standard_normal(24)
    rows += [(2000 + k, (center + 0.1 * rng.standard_normal(24)).round(3).tolist(), 0) for k in range(150)]
    for k in range(40):  # each near the next only
        chain = chain + 0.25 * rng.standard_normal(24)
        rows.append((3000 + k, chain.round(3).tolist(), 1))
    rows += [(4000 + k, rows[0][1], 0) for k in range(60)]
    want = brute_copies(rows)
    for shard in (vector_dedup.SHARD, 90):  # one graph, and many that are searched in pairs
        assert found_copies(vector_dedup.near_copies(vectors(spark, rows), 0.93, shard)) == want


def test_audits_widen_beams(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 48))
    v[750:] = v[:750] + 0.3 * rng.standard_normal((750, 48))
    order, highest = vector_dedup.Graph.order(np.arange(1500))
    exact = vector_dedup.unit(v[order])
    g = vector_dedup.Graph.build(exact, highest)
    assert [len(x) for x in g.layers] == [int((highest >= k).sum()) for k in range(highest[0] + 1)]
    true = exact @ exact.T >= 0.93
    np.fill_diagonal(true, False)
    asked = []
    near = vector_dedup.Graph.near
    monkeypatch.setattr(vector_dedup.Graph, "near", lambda self, q, own, width, least: asked.append(width) or near(self, q, own, width, least))
    hit, _, _ = vector_dedup.links_between(g, exact, g, exact, 0.93, 1)
    assert (hit & true).sum() >= 0.98 * true.sum() and not (hit & ~true).any() and max(asked) > 1


def test_registered(spark, tmp_path):
    v = [float((k * 37) % 11 - 5) for k in range(40)]
    rows = [(0, v, 1), (0, v, 1), (7, [-x for x in v], 1), (None, v, 1), (9, None, 1)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [(1, "Wonderful words, wonderful words"), (1, "Wonderful words, wonderful words"), (None, "wonderfull wonderfull"), (2, None), (3, "")]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    assert found_copies(QUERIES["op11_vector_dedup"](spark, str(tmp_path))) == brute_copies(rows)
    assert found_variants(QUERIES["op12_spelling"](spark, str(tmp_path))) == brute_variants(texts)
    got = QUERIES["op13_alignment"](spark, str(tmp_path)).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_alignment([t for _, t in texts]))
