"""Which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level BPE of the tokenizers library, B a SentencePiece model with byte fallback. Both encode blank + text, and each
token is a range of its bytes: the libraries' spans (characters of A, UTF-8 bytes of B's proto) cut the text coarsely; where a token
ends within a character, or stands for one byte of it and so has a span that is empty or goes on into its neighbour's, the bytes that
the tokens decode to say where. Byte offsets at which tokens of both end cut a text into groups; two tokens whose ranges overlap are a link.

No token of either goes across a blank that follows other characters, or from a word into the comma behind it, so a text is a series of chunks that are aligned on
their own, each once as long as the worker remembers it. A document goes on as its distinct links and how often it has each. Links
are counted over documents; the commonest of these counts, a bounded number, go to all tasks, the others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import staged

#: Pairs of ids whose counts are sent to all tasks; each takes 13 bytes.
MAX_PAIRS = 1 << 22
#: Chunks that a worker remembers, about, before it forgets those that were not asked for again, and chunks that are encoded at once.
REMEMBERED, AT_ONCE = 200_000, 10_000
#: Characters of text that are gathered at once.
GATHERED = 1 << 20
#: Distinct links that a task counts before it passes them on.
COUNTED = 1 << 21
RESULT = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, keys: binary, times: binary"


def bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the other bytes in order from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    #: Letters of both tokenizers' words; marks that may follow them in a token of neither.
    LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?\n"

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = bytes_of_letters()
        special = {i: t.content.encode("utf-8") for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special.get(i) or bytes(map(letters.__getitem__, self.a.id_to_token(i))) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a line feed, or with a blank behind other characters, are not supported")
        self.width = len(pieces)
        self.kind = np.dtype("<u4") if len(self.a_bytes) * self.width <= 1 << 32 else np.dtype("<u8")
        self.code = "I" if self.kind.itemsize == 4 else "Q"
        # what B makes of a line feed alone: it goes before each chunk, as B puts a blank before what it is given
        self.ahead = self.b.encode("\n")
        letter, within = f"[{self.LETTERS}]", "\n".join(pieces)
        marks = "".join(m for m in self.MARKS if not re.search(letter + re.escape(m), within) or m == "\n")
        marks = f"[{re.escape(marks)}]"
        cut = rf"(?<=\S)(?= )|(?<={letter})(?={marks})|(?<=\S\n)(?={letter})|\Z"
        self.chunk = re.compile(rf" ?{letter}+(?={marks}| |\Z)|(?s:.)+?(?:{cut})")
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        """What blank + text is made of, in order: cut before blanks that follow anything but white space, between words and marks, and behind single line feeds before words."""
        return self.chunk.findall(" " + text)

    @staticmethod
    def ends(spans: list[tuple[int, int]], sizes: list[int]) -> list[int]:
        """Where tokens end: at the end of their span, or, if that is empty or reaches into the next one, as many bytes behind the token before as they decode to."""
        out, at = [], 0
        for (start, end), (next_start, _), size in zip(spans, [*spans[1:], (1 << 62, 0)], sizes):
            at = end if start < end <= next_start else at + size
            out.append(at)
        return out

    def align(self, chunk: str, ids_a: list[int], chars: list[tuple[int, int]], ids_b: list[int], spans_b: list[tuple[int, int]]) -> tuple | None:
        """(groups, links as ids of A times width plus ids of B, numbers of tokens), or None if tokens do not say the chunk."""
        raw = chunk.encode("utf-8")
        bytes_a, bytes_b = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        if len(raw) == len(chunk):  # a byte a character: spans are exact
            ends_a, ends_b = [e for _, e in chars], [e for _, e in spans_b]
        else:
            to_byte = [0, *accumulate(len(c.encode("utf-8")) for c in chunk)]
            ends_a = self.ends([(to_byte[s], to_byte[e]) for s, e in chars], list(map(len, bytes_a)))
            ends_b = self.ends(spans_b, list(map(len, bytes_b)))
        links, groups, i, j, from_i, from_j, width = [], [], 0, 0, 0, 0, self.width
        for _ in range(len(ids_a) + len(ids_b)):
            links.append(ids_a[i] * width + ids_b[j])
            p, q = ends_a[i], ends_b[j]
            if p < q:
                i += 1
            elif q < p:
                j += 1
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, ids_a[from_i:i]))}|{','.join(map(str, ids_b[from_j:j]))}")
                if i == len(ids_a):
                    break
                from_i, from_j = i, j
        return ";".join(groups), array(self.code, links).tobytes(), len(ids_a), len(ids_b)

    def learn(self, chunks: list[str]) -> None:
        skip = len(self.ahead)
        for at in range(0, len(chunks), AT_ONCE):
            some = chunks[at : at + AT_ONCE]
            coded = zip(some, self.a.encode_batch(some, add_special_tokens=False), self.b.encode(["\n" + c for c in some], return_type="proto", num_threads=1))
            for c, a, b in coded:
                pieces = b.pieces[skip:]
                self.known[c] = self.align(c, a.ids, a.offsets, [p.id for p in pieces], [(p.begin - 1, p.end - 1) for p in pieces])

    def documents(self, texts: Iterable[str | None]) -> Iterator[tuple]:
        """The values of RESULT for each text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= GATHERED:
                yield from self._gathered(held)
                held, size = [], 0
        yield from self._gathered(held)

    def _gathered(self, texts: list[str | None]) -> Iterator[tuple]:
        cut = [self.chunks(t) if t else [] for t in texts]
        known, older = self.known, self.older
        new = {c for chunks in cut for c in chunks if c not in known}
        if new and len(known) > REMEMBERED:  # what is asked for again comes back from the older ones
            self.known, self.older = known, older = {}, known
            new = {c for chunks in cut for c in chunks}
        known.update((c, older[c]) for c in new if c in older)
        self.learn([c for c in new if c not in known])
        for chunks in cut:
            found = [known[c] for c in chunks]
            if not found or None in found:
                yield 0, 0, 0, 0, "", b"", b""
                continue
            groups, links, n_a, n_b = zip(*found)
            groups, links = ";".join(groups), np.frombuffer(b"".join(links), self.kind)
            keys, times = np.unique(links, return_counts=True)
            yield sum(n_a), sum(n_b), groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest(), keys.tobytes(), times.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of models and worker process."""
    return Aligner(path_a, path_b)


def aligned(text: Column, path_a: str, path_b: str) -> Column:
    """A struct: numbers of tokens, groups and links, the digest of the groups, keys (distinct links, as id of A times the size of B's vocabulary plus id of B) and times (how often).

    Null and empty texts, and texts that the tokens do not give back byte by byte, have none: zeros and ''. The paths name model files, found at the same places on every executor.
    """

    @F.pandas_udf(f"struct<{RESULT}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        one = aligner(path_a, path_b)
        return pd.DataFrame(list(one.documents(texts)), columns=[f.split(":")[0] for f in RESULT.split(", ")])

    return run(text)


def pair_counts(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """key, n (rows whose keys hold it) and best (whether no other pair of its A id is in more rows)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for k in batch["keys"]:
                held.append(np.frombuffer(k, kind))
                size += len(held[-1])
                if size >= COUNTED:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"key": keys.astype(np.int64), "n": n})

    pairs = rows.select("keys").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # an id of A meets as many ids as B has, at most
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("key") / width)))
    return staged(pairs.withColumn("best", F.col("n") == most), "align-pairs")


def least_common(pairs: DataFrame, most: int) -> int:
    """The least n so that no more than most pairs have it or more."""
    by_n = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    so_far = F.sum("c").over(Window.orderBy(F.desc("n")))  # a row for each value of n
    return by_n.withColumn("c", so_far).where(F.col("c") <= most).agg(F.min("n")).first()[0] or 1 << 62


def scored(rows: DataFrame, pairs: DataFrame, kind: str, most: int = MAX_PAIRS) -> DataFrame:
    """rows with n_best and count_sum: how many links are a best pair, and the sum of their counts."""
    least = 0 if pairs.count() <= most else least_common(pairs, most)
    common = pairs.where(F.col("n") >= least).select("key", "n", "best").toPandas().sort_values("key")  # most rows at most
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((common["key"].to_numpy().astype(kind), common["n"].to_numpy(), common["best"].to_numpy(bool)))

    @F.pandas_udf("struct<n_best: bigint, count_sum: bigint, rest: array<bigint>, rest_times: array<bigint>>")
    def look(keys: pd.Series, times: pd.Series) -> pd.DataFrame:
        known, n, best = sent.value
        out = []
        for k, t in zip(keys, times):
            k, t = np.frombuffer(k, kind), np.frombuffer(t, "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
            hit = known[at] == k if len(known) else np.zeros(len(k), bool)
            out.append((int(t[hit] @ best[at[hit]]), int(t[hit] @ n[at[hit]]), k[~hit].astype(np.int64), t[~hit]))
        return pd.DataFrame(out, columns=["n_best", "count_sum", "rest", "rest_times"])

    found = rows.withColumn("_x", look("keys", "times")).select(*[c for c in rows.columns if c not in ("keys", "times")], "_x.*")
    if not least:
        return found.drop("row", "rest", "rest_times")
    found = staged(found, "align-found")
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("key"), F.col("x.rest_times").alias("t"))
    # none of these pairs is among the commonest
    rare = pairs.where(F.col("n") < least).hint("shuffle_hash")
    sums = rest.join(rare, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"), F.sum(F.col("t") * F.col("n")).alias("c"))
    out = found.join(sums.hint("shuffle_hash"), "row", "left")
    for c, more in (("n_best", "b"), ("count_sum", "c")):
        out = out.withColumn(c, F.col(c) + F.coalesce(more, F.lit(0)))
    return out.drop("row", "rest", "rest_times", "b", "c")


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n, best: the pairs of ids that are linked anywhere, in how many rows of docs, and whether b is linked with a in most."""
    one = aligner(path_a, path_b)
    pairs = pair_counts(docs.select(aligned(F.col("text"), path_a, path_b).alias("x")).select("x.keys"), one.kind.str, one.width)
    return pairs.select(F.floor(F.col("key") / one.width).cast("int").alias("a"), F.pmod("key", F.lit(one.width)).cast("int").alias("b"), "n", "best")


def alignment(docs: DataFrame, path_a: str, path_b: str, most: int = MAX_PAIRS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or that the tokens do not give back (as those with U+2581), have zeros and ''. Texts and words may be of any length. Repeated rows
    count as a document each; pairs that are equally common for their A id are all best; an empty table gives an empty one; other columns are not looked at.
    """
    one = aligner(path_a, path_b)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).select("doc_id", "row", aligned(F.col("text"), path_a, path_b).alias("x"))
    rows = staged(rows.select("doc_id", "row", "x.*"), "align-rows")
    out = scored(rows, pair_counts(rows, one.kind.str, one.width), one.kind.str, most)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
