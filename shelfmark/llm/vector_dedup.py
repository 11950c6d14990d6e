"""Near copies among vectors by navigable small-world graphs, and the classes of linked vectors.

1. Equal vectors of a label are one entry with its number of rows; entries of a label are dealt to shards of bounded size.
2. Each shard gets a hierarchical small-world graph: layers over fewer and fewer entries, each entry with links to
   near and diverse others. Entries are laid in order of their highest layer, so a layer is a start of the shard; they are
   inserted in batches, each searched for by all its members at once.
3. Every shard is searched by the entries of every shard of the label, its own included, with a beam through the layers. A task takes two
   shards, so what either direction finds counts for both.
4. Cosines are verified in double precision, also of all pairs within a component that was found, so that a beam does not cap
   the links of an entry; the components of all tasks are joined.
5. Before the searches, copies planted at just the threshold are searched for; after them, the near entries of a sample of
   entries are counted by brute force. Where fewer are found than RECALL asks for, beams are doubled, at the end to the whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions, staged
from shelfmark.llm.ngram_join import BROADCAST_IDS, components, whole_groups

#: Entries of a shard, at most about; a task holds two shards and a bit for each pair of theirs.
SHARD = 8192
#: Links of an entry in a layer, and in the lowest.
LINKS, LOWEST = 16, 32
#: Beams when entries are inserted and, at first, when they are searched for.
BUILD_BEAM, BEAM = 64, 32
#: Entries that are inserted or searched for together.
BATCH = 256
#: The share of links that the audits ask for; planted copies and entries that an audit looks at.
RECALL, PLANTED, AUDITED = 0.98, 128, 256
#: What single precision may lose.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the ids alone."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def diverse(v: np.ndarray, ids: np.ndarray, likes: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) most: first those that are nearer to the row's vector than to any chosen before, then the nearest of the rest."""
    near = v[ids]
    among = near @ near.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        blocked = ((among[:, k] > likes[:, k, None]) & chosen).any(1)
        chosen[:, k] = ~blocked & (ids[:, k] >= 0) & (chosen.sum(1) < most)
    first = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, first, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Over unit vectors in order of their layers: layers[k] holds the links of the first entries, as places, -1 for none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.v, self.layers = vectors.astype(np.float32), layers

    @staticmethod
    def order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order in which entries are laid, and the highest layer of each in it."""
        u = mixed(ids)
        highest = np.minimum(np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)), 30).astype(np.int64)
        order = np.lexsort((u, -highest))
        return order, highest[order]

    @classmethod
    def build(cls, vectors: np.ndarray, highest: np.ndarray) -> Graph:
        g = cls(vectors, [])
        # from the top: a layer's entries are met by way of the layers above, which are ready
        for layer in range(int(highest[0]), -1, -1):
            g._add_layer(int((highest >= layer).sum()), LINKS if layer else LOWEST)
        return g

    def _add_layer(self, size: int, links: int) -> None:
        above, own = self.layers, np.full((size, links), -1, np.int32)
        self.layers = [own, *above]
        done = 0
        while done < size:
            at = np.arange(done, min(size, done + max(1, min(BATCH, done))))
            q = self.v[at]
            ids, likes = np.full((len(at), 0), -1, np.int32), np.zeros((len(at), 0), np.float32)
            if done:
                start = self._descend(q, len(above))
                start[start >= done] = 0  # the first entries of a layer are those above
                ids, likes = self.beam(q, start, min(BUILD_BEAM, done), own)
            # the batch's own members are not in the graph yet
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            near = np.argsort(-among, axis=1, kind="stable")[:, : min(links, len(at) - 1)]
            ids = np.concatenate([ids, at[near].astype(np.int32)], 1)
            likes = np.concatenate([likes, np.take_along_axis(among, near, 1)], 1)
            best = np.argsort(-likes, axis=1, kind="stable")
            ids, likes = np.take_along_axis(ids, best, 1), np.take_along_axis(likes, best, 1)
            if ids.shape[1]:
                own[at, : links // 2] = diverse(self.v, ids, likes, links // 2)  # the rest is for links back
                self._link_back(own, at, links)
            done += len(at)

    def _link_back(self, own: np.ndarray, at: np.ndarray, links: int) -> None:
        """The new entries become links of those that they link to; entries with too many keep diverse ones."""
        new, old = np.repeat(at, links), own[at].ravel()
        new, old = new[old >= 0], old[old >= 0]
        likes = np.einsum("ij,ij->i", self.v[new], self.v[old])
        order = np.lexsort((-likes, old))
        new, old, likes = new[order], old[order], likes[order]
        targets, first, counts = np.unique(old, return_index=True, return_counts=True)
        rank = np.arange(len(old)) - np.repeat(first, counts)
        keep = rank < links
        added = np.full((len(targets), links), -1, np.int32)
        added[np.repeat(np.arange(len(targets)), counts)[keep], rank[keep]] = new[keep]
        for a in range(0, len(targets), BATCH):
            t = targets[a : a + BATCH]
            ids = np.concatenate([own[t], added[a : a + BATCH]], 1)
            ids[:, links:][(ids[:, links:, None] == ids[:, None, :links]).any(2)] = -1
            like = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.v[ids], self.v[t]), -np.inf)
            best = np.argsort(-like, axis=1, kind="stable")[:, : max(links, int((ids >= 0).sum(1).max()))]
            own[t] = diverse(self.v, np.take_along_axis(ids, best, 1), np.take_along_axis(like, best, 1), links)

    def _descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Where the upper layers lead: one entry for each query."""
        start = np.zeros((len(q), 1), np.int32)
        for links in self.layers[: len(self.layers) - layers - 1 : -1] if layers else []:
            ids, _ = self.beam(q, start, 2, links)
            start = ids[:, :1]
        return start

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, links: np.ndarray, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entries that beams from start meet (width of them, nearest first, -1: none), and their likenesses. All queries go on together."""
        n = len(q)
        seen = np.zeros((n, len(links)), bool)
        ids, likes, done = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        r, c = np.repeat(np.arange(n), start.shape[1]), start.ravel()
        while True:
            r, c = _fresh(r, c, seen)
            if len(r):
                like = np.einsum("ij,ij->i", q[r], self.v[c])
                better = like > likes[r, -1]
                r, c, like = r[better], c[better], like[better]
            if len(r):
                rows, counts = np.unique(r, return_counts=True)
                place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
                more, more_like = np.full((len(rows), counts.max()), -1, np.int32), np.full((len(rows), counts.max()), -np.inf, np.float32)
                row = np.repeat(np.arange(len(rows)), counts)
                more[row, place], more_like[row, place] = c, like
                all_like = np.concatenate([likes[rows], more_like], 1)
                best = np.argsort(-all_like, axis=1, kind="stable")[:, :width]
                likes[rows] = np.take_along_axis(all_like, best, 1)
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more], 1), best, 1)
                done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(more.shape, bool)], 1), best, 1)
            open_ = ~done & (ids >= 0)
            open_ &= np.cumsum(open_, 1) <= at_once
            rows, cols = np.nonzero(open_)
            if not len(rows):
                return ids, likes
            done[rows, cols] = True
            r, c = np.repeat(rows, links.shape[1]), links[ids[rows, cols]].ravel()

    def near(self, q: np.ndarray, own: np.ndarray | None, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of entries at least so like the queries. own: the queries' places if they are entries themselves."""
        start = self._descend(q, len(self.layers) - 1)
        if own is not None:
            start = np.concatenate([start, own[:, None].astype(np.int32)], 1)
        links = self.layers[0]
        ids, likes = self.beam(q, start, min(width, len(links)), links)
        row, col = np.nonzero(likes >= least)
        return row, ids[row, col].astype(np.int64)


def _fresh(r: np.ndarray, c: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs not seen before, once each and by row; now they are."""
    ok = c >= 0
    r, c = r[ok], c[ok]
    ok = ~seen[r, c]
    code = np.unique(r[ok].astype(np.int64) * seen.shape[1] + c[ok])
    r, c = np.divmod(code, seen.shape[1])
    seen[r, c] = True
    return r, c


def planted_width(g: Graph, percent: float, width: int) -> int:
    """The beam at which copies planted at just the threshold are found."""
    rng = np.random.default_rng(len(g.v))
    at = np.unique(np.linspace(0, len(g.v) - 1, min(PLANTED, len(g.v))).astype(np.int64))
    v = g.v[at].astype(np.float64)
    noise = rng.standard_normal(v.shape)
    noise -= (noise * v).sum(1, keepdims=True) * v
    q = percent * v + np.sqrt(1 - percent**2) * noise / np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    while width < len(g.v):
        r, c = g.near(q.astype(np.float32), None, width, percent - SLACK)
        if len(np.unique(r[c == at[r]])) >= RECALL * len(at):
            break
        width *= 2
    return width


def links_between(a: Graph, exact_a: np.ndarray, b: Graph, exact_b: np.ndarray, least: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries of a and b are linked, as a bit for each pair, and the components of a's and of b's entries; a may be b."""
    same = a is b
    width = max(planted_width(g, least, width) for g in ([a] if same else [a, b]))
    while True:
        hit = np.zeros((len(a.v), len(b.v)), bool)
        for g, q, x, y, flip in [(b, a, exact_a, exact_b, False)] + ([] if same else [(a, b, exact_b, exact_a, True)]):
            for at in range(0, len(q.v), BATCH):
                own = np.arange(at, min(at + BATCH, len(q.v)))
                r, c = g.near(q.v[own], own if same else None, width, least - SLACK)
                r = own[r]
                ok = np.einsum("ij,ij->i", x[r], y[c]) >= least
                hit[(c[ok], r[ok]) if flip else (r[ok], c[ok])] = True
        if same:
            hit |= hit.T
            np.fill_diagonal(hit, True)  # an entry's row and column are one
        rows, cols = joined(hit)
        for k in np.unique(rows[hit.sum(1) > same]):
            i, j = np.flatnonzero(rows == k), np.flatnonzero(cols == k)
            for at in range(0, len(i), BATCH):
                hit[np.ix_(i[at : at + BATCH], j)] = exact_a[i[at : at + BATCH]] @ exact_b[j].T >= least
        if same:
            np.fill_diagonal(hit, False)
        at = np.unique(np.linspace(0, len(a.v) - 1, min(AUDITED, len(a.v))).astype(np.int64))
        true = exact_a[at] @ exact_b.T >= least
        if same:
            true[np.arange(len(at)), at] = False
        if (true & hit[at]).sum() >= RECALL * true.sum() or width >= max(len(a.v), len(b.v)):
            return hit, rows, cols
        width *= 2


def joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each row and each column of a bit matrix of links, as the smallest row in it; -1: a column without links."""
    rows, cols = np.arange(hit.shape[0]), np.full(hit.shape[1], -1)
    left, free = np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)
    linked = hit.any(1)
    for k in np.flatnonzero(linked):
        if not left[k]:
            continue
        front = np.array([k])
        left[k] = False
        while len(front):
            rows[front] = k
            met = np.flatnonzero(hit[front].any(0) & free)
            free[met] = False
            cols[met] = k
            front = np.flatnonzero(hit[:, met].any(1) & left) if len(met) else met
            left[front] = False
    return rows, cols


def built(shards: DataFrame) -> DataFrame:
    """shards (grp, shard, node, w, vector) with place, highest layer and links (all layers of an entry, one after the other, from the lowest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["grp", "shard"]):
            for a, b in pairwise(starts):
                own = frame.iloc[a:b]
                order, highest = Graph.order(own["node"].to_numpy())
                own = own.iloc[order]
                g = Graph.build(unit(np.stack(own["vector"].to_numpy())), highest)
                links = [np.concatenate([layer[k] for layer in g.layers[: h + 1]]) for k, h in enumerate(highest.tolist())]
                yield own.assign(place=np.arange(len(own)), highest=highest, links=links)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shards.schema)
    dealt = shards.repartition(partitions(shards.sparkSession), "grp", "shard").sortWithinPartitions("grp", "shard", "node")
    return dealt.mapInPandas(run, f"{schema}, place int, highest int, links array<int>")


def _graph(frame: pd.DataFrame) -> tuple[Graph, np.ndarray]:
    exact = unit(np.stack(frame["vector"].to_numpy()))
    highest, links = frame["highest"].to_numpy(), frame["links"].to_numpy()
    layers = []
    for layer in range(int(highest[0]) + 1):
        a, b = (LOWEST + (layer - 1) * LINKS, LOWEST + layer * LINKS) if layer else (0, LOWEST)
        layers.append(np.stack([x[a:b] for x in links[highest >= layer]]))
    return Graph(exact, layers), exact


def searched(graphs: DataFrame, least: float) -> DataFrame:
    """For each pair of shards of a group, and each entry with links there: node, n_links (rows of the entries that it is linked with) and root, a node of its component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["grp", "lower", "upper"]):
            for s, e in pairwise(starts):
                yield one(frame.iloc[s:e])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        shard = own["shard"].to_numpy()
        cut = int((shard == shard[0]).sum())
        p, q = own.iloc[:cut], own.iloc[cut:]
        a, exact_a = _graph(p)
        b, exact_b = _graph(q) if len(q) else (a, exact_a)
        q = q if len(q) else p
        hit, rows, cols = links_between(a, exact_a, b, exact_b, least)
        nodes_a, nodes_b = p["node"].to_numpy(), q["node"].to_numpy()
        i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        out = [pd.DataFrame({"node": nodes_a[i], "n_links": hit[i] @ q["w"].to_numpy(), "root": nodes_a[rows[i]]})]
        if b is not a:
            out.append(pd.DataFrame({"node": nodes_b[j], "n_links": hit[:, j].T @ p["w"].to_numpy(), "root": nodes_a[cols[j]]}))
        return pd.concat(out)

    pair = graphs.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    pair = pair.withColumns({"lower": F.least("shard", "other"), "upper": F.greatest("shard", "other")}).drop("other", "shards")
    dealt = pair.repartition(partitions(graphs.sparkSession), "grp", "lower", "upper").sortWithinPartitions("grp", "lower", "upper", "shard", "place")
    return dealt.mapInPandas(run, "node long, n_links long, root long")


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link with others."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_copies(rows: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """One row for each row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors of one length and their cosine is least or more. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing. Rows of one vec_id are rows of their own. A null vec_id is no component's id: component_id is null only where no row
    of the component has an id, and such rows are not kept. Cosines have no ties. An empty table gives an empty one; other columns are not looked at.
    """
    spark = rows.sparkSession
    ok = usable(F.col("embedding"), F.col("label"))
    clean = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # no negative zeros
    given = rows.select("vec_id", F.when(ok, F.col("label")).alias("label"), F.when(ok, clean).alias("vector"))
    entries = given.where("vector is not null").groupBy("label", "vector").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least_id"))
    entries = staged(entries.select("*", F.monotonically_increasing_id().alias("node"), F.size("vector").alias("dims")), "hnsw-entries")
    groups = entries.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("_n")).select("label", "dims", "_n", F.monotonically_increasing_id().alias("grp"))
    groups = staged(groups.withColumn("shards", F.ceil(F.col("_n") / shard).cast("int")), "hnsw-groups")
    few = groups.count() <= BROADCAST_IDS
    named = entries.join(F.broadcast(groups) if few else groups.hint("shuffle_hash"), ["label", "dims"])
    dealt = named.withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")).where("_n > 1").select("grp", "shard", "shards", "node", "w", "vector")
    found = staged(searched(staged(built(dealt), "hnsw-graphs"), least), "hnsw-found")
    sums = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comps = staged(components(edges), "hnsw-components").withColumnRenamed("id", "node")
    about = entries.select("node", "label", "vector", "w", "least_id").join(sums.hint("shuffle_hash"), "node", "left").join(comps.hint("shuffle_hash"), "node", "left")
    about = staged(about.withColumn("comp", F.coalesce("comp", "node")), "hnsw-about")
    ids = about.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    about = about.join(ids.hint("shuffle_hash"), "comp").select(
        F.xxhash64("label", "vector").alias("h"), "label", "vector", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked")
    )
    out = given.withColumn("h", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))).join(about.hint("shuffle_hash"), ["h", "label", "vector"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
