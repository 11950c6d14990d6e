"""Jaccard join of word n-gram sets by signature trees, and the classes of linked documents.

1. Equal sets are one class; only its smallest doc_id goes on.
2. Two sets that link share one of the first few of their shingles in any common
   order, here frequent shingles last: each set is sent to the groups of these shingles. A group is a shingle and a band
   of sizes; a set also goes to the next band if it may link with a set there.
   Sizes and places in the order rule out many groups of chance before anything but numbers moves.
3. In a group, a signature tree over the sets: leaves hold up to 64 sets with token bitmaps that are as wide as the band asks for
   (groups that are one leaf are done many at once), nodes the OR of the bitmaps below, the range of sizes and of surplus (tokens beyond the bits they set)
   and how many shingles follow the group's. Two nodes are traversed together, and dropped where no pair below can overlap enough, or
   where all of both is one component already. So a pair leaves the group only if bitmaps, sizes and places in the order leave it possible.
4. Of a maximum spanning forest of what is left, each set's three likest pairs are verified on the exact sets first; then,
   with the components known from that, every remaining pair between components, in the groups that had a pair and hold
   several components. So no link between components is lost, and a group of near copies does not emit all of its pairs.

Sets are held as 64-bit hashes of their shingles; two different shingles of one hash would count as one.
Groups beyond a block of sets are cut into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, gathered, partitions, staged

LEAF, FAN = 64, 8
#: Sets of a group that one task takes; larger groups are cut into blocks.
BLOCK = 4096
#: Pairs of numbers that a task looks at together.
MATRIX = 1 << 21
#: Most frequent shingles, put last in the common order. Any order gives right results.
FREQUENT = 20_000
#: Most doc ids, or keys, that are broadcast to pick rows; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


class Hasher:
    """Hashes of words, with a memory of those seen."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-word sequences of a text; fewer words are one sequence, none give none."""
        words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, blanks as the contract has them
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        codes = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            codes[k] = h
        n = min(self.n, len(words))
        count = len(words) - n + 1
        mixed = np.full(count, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ (codes[k : k + count] * _MULTIPLIERS[k])) * _MULTIPLIERS[8]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def least_overlap(size: np.ndarray | int, percent: int):
    """The overlap that a set needs with any set it links with."""
    return -(-percent * size // 100)


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def needed(n, m, percent: int):
    """The overlap at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


@lru_cache(maxsize=8)
def bands(percent: int) -> list[int]:
    """The least size of each band: half as large again, about, and so far apart that sets link within a band or with the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 1414 // 1000), -(-out[-1] * 100 // percent)))
    return out


def width(band: int, percent: int) -> int:
    """Bits of the bitmaps of a band: two to four for each shingle, about."""
    return max(64, 1 << (3 * bands(percent)[band + 1] // 2 - 1).bit_length())


def bitmap(shingles: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[(shingles >> np.uint64(40)) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes()


def fits(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Whether two sets of n and m shingles with these bitmaps may link; the longer bitmap is folded to the shorter."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) != len(q):
        if len(p) > len(q):
            p = p[: len(p) // 2] | p[len(p) // 2 :]
        else:
            q = q[: len(q) // 2] | q[len(q) // 2 :]
    ones = [int(np.bitwise_count(v).sum()) for v in (p, q, p & q)]
    most = min(n, m, ones[2] + min(n - ones[0], m - ones[1]))
    return (100 + percent) * most >= percent * (n + m)


def frequent(docs: DataFrame, n: int, top: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles by number of documents, and these numbers (of those that repeat within a partition)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, size = Hasher(n), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(hasher.shingles(text))
                size += len(held[-1])
                if size > 1_000_000:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        shingles, times = np.unique(np.concatenate(held), return_counts=True)
        often = times > 2
        return pd.DataFrame({"h": shingles[often].view(np.int64), "n": times[often]})

    counted = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(top).collect()  # top rows at most
    found = sorted((r["h"] % (1 << 64), r["n"]) for r in rows)
    return np.array([h for h, _ in found], np.uint64), np.array([c for _, c in found], np.int64)


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest, band, prefix (the shingles whose groups the set is sent to, in the common order), up (how many of these it is sent to in
    the next band, too) and the bitmaps for its band and, if it is sent there, for the next."""
    often, times = frequent(docs, n)

    @F.pandas_udf("struct<n_shingles: bigint, digest: binary, band: int, prefix: array<bigint>, up: int, bitmap: binary, wide: binary>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        hasher, out = Hasher(n), []
        for text in texts:
            s = hasher.shingles(text)
            size = len(s)
            if not size:
                out.append((0, b"", 0, s.view(np.int64), 0, None, None))
                continue
            at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
            rank = np.where(often[at] == s, times[at], 0) if len(often) else np.zeros(size, np.int64)
            prefix = s[np.lexsort((s, rank))][: size - least_overlap(size, percent) + 1]
            band = bisect_right(bands(percent), size) - 1
            above = bands(percent)[band + 1]
            up = size - needed(size, above, percent) + 1 if 100 * size >= percent * above else 0
            wide = bitmap(s, width(band + 1, percent)) if up > 0 else None
            out.append((size, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band, prefix.view(np.int64), max(up, 0), bitmap(s, width(band, percent)), wide))
        return pd.DataFrame(out, columns=["n_shingles", "digest", "band", "prefix", "up", "bitmap", "wide"])

    return docs.select("doc_id", describe("text").alias("d")).select("doc_id", "d.*")


class Tree:
    """Over sets with bitmaps (rows of 64-bit words), sizes, components and the overlap that their places in the order leave (rest); like sets stand side by side."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, comps: np.ndarray, rest: np.ndarray):
        self.order = np.lexsort((*words.T[:2], sizes))
        self.words, self.sizes, self.comps, self.rest = words[self.order], sizes[self.order], comps[self.order], rest[self.order]
        self.surplus = self.sizes - np.bitwise_count(self.words).sum(1).astype(np.int64)
        spans = [(a, min(a + LEAF, len(sizes))) for a in range(0, len(sizes), LEAF)]
        level = [self._node(a, b, []) for a, b in spans]
        while len(level) > 1:
            level = [self._node(g[0][0], g[-1][1], g) for g in (level[k : k + FAN] for k in range(0, len(level), FAN))]
        self.root = level[0]

    def _node(self, a: int, b: int, below: list) -> tuple:
        """(from, to, OR of bitmaps, least size, largest size, largest surplus, only component or None, nodes below, largest rest)"""
        ors = np.bitwise_or.reduce([n[2] for n in below]) if below else np.bitwise_or.reduce(self.words[a:b])
        only = self.comps[a] if (self.comps[a:b] == self.comps[a]).all() else None
        return a, b, ors, self.sizes[a:b].min(), self.sizes[a:b].max(), self.surplus[a:b].max(), only, below, self.rest[a:b].max()


def _hopeless(x: tuple, y: tuple, percent: int) -> bool:
    if x[6] is not None and x[6] == y[6]:
        return True
    if 100 * x[4] < percent * y[3] or 100 * y[4] < percent * x[3]:
        return True
    most = min(x[4], y[4], x[8], y[8], int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5]))
    return (100 + percent) * most < percent * (x[3] + y[3])


def dual(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, possible similarity) of pairs in different components that may link; within one tree each pair once."""
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if _hopeless(x, y, percent):
            continue
        if x[7] or y[7]:
            if a is b and x is y:
                stack += [(p, q) for k, p in enumerate(x[7]) for q in x[7][k:]]
            elif x[7] and (not y[7] or x[1] - x[0] >= y[1] - y[0]):
                stack += [(p, y) for p in x[7]]
            else:
                stack += [(x, q) for q in y[7]]
            continue
        (i0, i1), (j0, j1) = x[:2], y[:2]
        common = np.bitwise_count(a.words[i0:i1, None] & b.words[None, j0:j1]).sum(2).astype(np.int64)
        most = common + np.minimum(a.surplus[i0:i1, None], b.surplus[None, j0:j1])
        most = np.minimum(most, np.minimum(a.rest[i0:i1, None], b.rest[None, j0:j1]))
        total = a.sizes[i0:i1, None] + b.sizes[None, j0:j1]
        ok = ((100 + percent) * most >= percent * total) & (a.comps[i0:i1, None] != b.comps[None, j0:j1])
        if a is b and x is y:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        i, j = np.nonzero(ok)
        if len(i):
            yield a.order[i + i0], b.order[j + j0], common[i, j] / (total[i, j] - common[i, j])


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of complete groups from batches that are sorted by group, and where each group starts and the last one ends."""
    held: pd.DataFrame | None = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(frame):
            continue
        cells = frame[by].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1])
        held = frame.iloc[starts[-1] :]  # may go on in the next batch
        if starts[-1]:
            yield frame.iloc[: starts[-1]], starts
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def viable(groups: DataFrame, percent: int) -> DataFrame:
    """Rows of groups (key, band, id, n, rest, g and perhaps comp) without those that sizes and places alone keep from linking with any other of their
    group (of another component). A large group is looked at where most of it is one component. Nothing but numbers moves."""
    known = "comp" in groups.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["key", "band"]):
            lengths = np.diff(starts)
            cell = np.repeat(np.arange(len(lengths)), lengths)
            n, rest, comp = (frame[c].to_numpy() for c in ("n", "rest", "comp" if known else "id"))
            keep = lengths[cell] > LEAF
            small = ~keep
            for k in range(1, LEAF):
                i = np.flatnonzero(small[:-k] & (cell[:-k] == cell[k:]))
                if not len(i):
                    break
                i = i[((100 + percent) * np.minimum(rest[i], rest[i + k]) >= percent * (n[i] + n[i + k])) & (comp[i] != comp[i + k])]
                keep[i] = keep[i + k] = True
            for k in np.flatnonzero(lengths > LEAF):
                own = slice(starts[k], starts[k + 1])
                names, times = np.unique(comp[own], return_counts=True)
                others = np.flatnonzero(comp[own] != names[times.argmax()]) + starts[k]
                if len(others) * lengths[k] <= MATRIX:
                    ok = ((100 + percent) * np.minimum(rest[others, None], rest[None, own]) >= percent * (n[others, None] + n[None, own])) & (comp[others, None] != comp[None, own])
                    keep[own] = ok.any(0)
                    keep[others] |= ok.any(1)
            if keep.any():
                yield frame[keep]

    dealt = groups.repartition(partitions(groups.sparkSession), "key", "band").sortWithinPartitions("key", "band")
    return dealt.mapInPandas(run, groups.schema)


def candidates(groups: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b, like), a < b, that may link, from groups (key, band, left, right, block, id, n, rest, comp, bitmap): a spanning forest of each
    group, or all. With a forest also a row (key, band) for each group that has a pair. A pair may come from several tasks."""

    cell = ["key", "band", "left", "right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # of this task, so that a pair in many groups goes on once
        for frame, starts in whole_groups(batches, cell):
            yield from fresh(frame, starts, seen)

    def fresh(frame: pd.DataFrame, starts: np.ndarray, seen: set) -> Iterator[pd.DataFrame]:
        maps = frame["bitmap"].to_numpy()
        ids, sizes, comps, rest, bands = (frame[c].to_numpy() for c in ("id", "n", "comp", "rest", "band"))
        block, left, right = (frame[c].to_numpy() for c in ("block", "left", "right"))
        lengths = np.diff(starts)
        cell = np.repeat(np.arange(len(lengths)), lengths)
        small = lengths[cell] <= LEAF
        words = lambda at: np.frombuffer(b"".join(maps[at]), np.uint64).reshape(len(at), -1)
        found = []
        for band in np.unique(bands[small]):
            at = np.flatnonzero(small & (bands == band))
            found += [(at[i], at[j], like) for i, j, like in _in_leaves(words(at), sizes[at], comps[at], rest[at], block[at], left[at] != right[at], cell[at], percent)]
        for k in np.flatnonzero(lengths > LEAF):
            at = np.arange(starts[k], starts[k + 1])
            p, q = at[block[at] == left[at[0]]], at[block[at] == right[at[0]]]
            if len(p) and len(q):
                t = Tree(words(p), sizes[p], comps[p], rest[p])
                u = t if left[at[0]] == right[at[0]] else Tree(words(q), sizes[q], comps[q], rest[q])
                found += [(p[i], q[j], like) for i, j, like in dual(t, u, percent)]
        if not found:
            return
        i, j, like = (np.concatenate(x) for x in zip(*found))
        if forest:
            first = starts[np.unique(cell[i])]
            yield pd.DataFrame({"key": frame["key"].to_numpy()[first], "band": bands[first], "a": None, "b": None, "like": None})
            keep = _forest(cell[i], ids[i], ids[j], like)
            i, j, like = i[keep], j[keep], like[keep]
        pairs = dict(zip(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist()), like.tolist()))
        new = [(None, None, *t, v) for t, v in pairs.items() if t not in seen]
        if len(seen) < 1_000_000:
            seen.update(pairs)
        if new:
            yield pd.DataFrame(new, columns=["key", "band", "a", "b", "like"])

    dealt = groups.repartition(partitions(groups.sparkSession), *cell).sortWithinPartitions(*cell, "id")
    return dealt.mapInPandas(run, "key long, band int, a long, b long, like double")


def _in_leaves(words, sizes, comps, rest, block, crossed, cell, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for all groups that are one leaf, at once: rows are met with the next, the one after it, and so on."""
    surplus = sizes - np.bitwise_count(words).sum(1).astype(np.int64)
    for k in range(1, LEAF):
        i = np.flatnonzero(cell[:-k] == cell[k:])
        if not len(i):
            break
        j = i + k
        most = np.minimum(rest[i], rest[j])
        ok = (comps[i] != comps[j]) & ((100 + percent) * most >= percent * (sizes[i] + sizes[j])) & (~crossed[i] | (block[i] != block[j]))
        i, j, most = i[ok], j[ok], most[ok]
        common = np.bitwise_count(words[i] & words[j]).sum(1).astype(np.int64)
        most = np.minimum(most, common + np.minimum(surplus[i], surplus[j]))
        ok = (100 + percent) * most >= percent * (sizes[i] + sizes[j])
        if ok.any():
            i, j, common = i[ok], j[ok], common[ok]
            yield i, j, common / (sizes[i] + sizes[j] - common)


def _forest(cell: np.ndarray, a: np.ndarray, b: np.ndarray, like: np.ndarray) -> list[int]:
    """A maximum spanning forest of each group: places of the pairs that are kept."""
    keep, root = [], {}
    for k in np.argsort(-like, kind="stable").tolist():
        x, y = (int(cell[k]), int(a[k])), (int(cell[k]), int(b[k]))
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        while root.get(y, y) != y:
            root[y] = y = root.get(root[y], root[y])
        if x != y:
            root[x] = y
            keep.append(k)
    return keep


def nearest(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) of the pairs (a, b, like) that are among the likest few of a or of b."""
    ends = pairs.select("a", "b", "like", F.explode(F.array("a", "b")).alias("of"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("like"), "a", "b"))
    return ends.withColumn("_n", rank).where(F.col("_n") <= most).select("a", "b").distinct()


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that may link by size and bitmap."""

    @F.pandas_udf("boolean")
    def may(x: pd.Series, n: pd.Series, y: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([fits(*v, percent) for v in zip(x, n, y, m)], dtype="bool")

    of = lambda end: sets.select(F.col("id").alias(end), F.col("bitmap").alias(f"x_{end}"), F.col("n").alias(f"n_{end}")).hint("shuffle_hash")
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(may("x_a", "n_a", "x_b", "n_b")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs whose exact sets link."""
    pairs = staged(gathered(pairs), "ngram-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = staged(gathered(ids), "ngram-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")

    @F.pandas_udf("binary")
    def exact(texts: pd.Series) -> pd.Series:
        hasher = Hasher(n)
        return pd.Series([hasher.shingles(t).tobytes() for t in texts])

    @F.pandas_udf("boolean")
    def link(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            out.append(bool(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)))
        return pd.Series(out)

    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", exact("text").alias("s"))
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    return staged(gathered(both.where(link("x", "y")).select("a", "b").distinct()), "ngram-links")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): the smallest id that it is connected with. Alternates joining larger and smaller neighbours to the least one until all are stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(gathered(large.where("u > v").distinct()), "stars")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = staged(gathered(small.where("u > v").distinct()), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(roots)


def classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of n-word
    sequences. Documents without words have an empty set and are alone, as are rows without a doc_id
    (component_id null). Rows of one doc_id count as one document. Ties do not matter: a component has no order. Texts may be of
    any length; an empty table gives an empty one; other columns of docs, whatever their names, are not looked at.
    """
    table = staged(gathered(described(docs.select("doc_id", "text"), n, percent)), "ngram-sets")
    usable = table.where("doc_id is not null and n_shingles > 0")
    twins = staged(gathered(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))), "ngram-twins")
    # a row goes on if it is the first of its class; the others are few, as a rule, and then the wide rows stay where they are
    others = usable.select("digest", "doc_id").join(twins.hint("merge"), "digest").where("doc_id <> rep").select("digest", "doc_id").distinct()
    others = staged(gathered(others), "ngram-others")
    reps = usable.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others.hint("merge"), ["digest", "doc_id"], "left_anti")
    if not usable.groupBy("digest", "doc_id").count().where("count > 1").isEmpty():
        reps = reps.dropDuplicates(["doc_id", "digest"])
    reps = reps.withColumnsRenamed({"doc_id": "id", "n_shingles": "n"})
    reps = staged(gathered(reps.select("id", "n", "band", "prefix", "up", "bitmap", "wide")), "ngram-reps")
    # from here on the wide rows are those of reps; of the others three columns are left
    wide, table = table, staged(gathered(table.select("doc_id", "n_shingles", "digest")), "ngram-digests")
    discard(wide)
    # each shingle of a prefix, with the overlap that is left from its place on
    placed = reps.select("id", "n", "band", "up", F.posexplode("prefix").alias("at", "key"))
    above = (F.col("at") < F.col("up")).cast("int")
    bands = F.explode(F.sequence("band", F.col("band") + above)).alias("band")
    records = placed.select("key", "id", "n", (F.col("n") - F.col("at")).alias("rest"), bands)
    # a group of two is a pair already, and its sizes and places say at once whether it can link: by chance most cannot
    both = F.shiftleft("n", 32).bitwiseOR(F.col("rest"))  # one number to move instead of two
    counted = records.groupBy("key", "band").agg(F.count(F.lit(1)).alias("g"), F.min("id").alias("a"), F.max("id").alias("b"), F.min(both).alias("_low"), F.max(both).alias("_high"))
    size, left = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND((1 << 32) - 1))
    counted = counted.select("key", "band", "g", "a", "b", size("_low").alias("low"), size("_high").alias("high"), F.least(left("_low"), left("_high")).alias("rest"))
    two = (F.col("g") == 2) & ((100 + percent) * F.col("rest") >= percent * (F.col("low") + F.col("high"))) & (100 * F.col("low") >= percent * F.col("high"))
    shared = staged(gathered(counted.where((F.col("g") > 2) | two).select("key", "band", "g", "a", "b")), "ngram-shared")
    sets = reps.select("id", "n", "bitmap")
    twos = possible(shared.where("g = 2").select("a", "b").distinct(), sets, percent)
    keys = shared.where("g > 2").select("key", "band", "g")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys.hint("shuffle_hash")
    groups = records.join(keys, ["key", "band"]).select("key", "band", "id", "n", "rest", "g")
    groups = staged(gathered(viable(groups, percent)), "ngram-groups")
    maps = reps.select("id", "band", "bitmap").unionAll(reps.where("up > 0").select("id", F.col("band") + 1, "wide"))

    def with_sets(groups: DataFrame, comp: str) -> DataFrame:
        blocks = F.ceil(F.col("g") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("id"), blocks).cast("int")
        cells = groups.select("*", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        cells = cells.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other"), "comp": F.col(comp)})
        return cells.join(maps.hint("shuffle_hash"), ["id", "band"]).select("key", "band", "left", "right", "block", "id", "n", "rest", "comp", "bitmap")

    texts = docs.select("doc_id", "text")
    found = staged(gathered(candidates(with_sets(groups, "id"), percent, True)), "ngram-forests")
    likest = found.where("a is not null").groupBy("a", "b").agg(F.max("like").alias("like"))
    sure = verified(nearest(likest).unionAll(twos).distinct(), texts, n, percent)
    known = staged(gathered(components(sure)), "ngram-known")
    # groups that had a pair, and still hold several components
    active = found.where("key is not null").select("key", "band").distinct()
    named_groups = staged(
        groups.join(active.hint("shuffle_hash"), ["key", "band"], "left_semi").join(known.hint("shuffle_hash"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "ngram-active"
    )
    rest = candidates(with_sets(staged(gathered(viable(named_groups, percent)), "ngram-mixed"), "comp"), percent, False)
    more = verified(rest.select("a", "b").distinct(), texts, n, percent)
    final = staged(gathered(components(sure.unionAll(more))), "ngram-components").withColumnRenamed("id", "rep")
    named = twins.join(final.hint("shuffle_hash"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    out = table.select("doc_id", "n_shingles", "digest").withColumn("digest", F.when(F.col("n_shingles") > 0, F.col("digest")))
    out = out.join(named.hint("merge"), "digest", "left")
    alone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))
