"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a text the encoding has exactly one last token. The table holds it:
an automaton gives the tokens that end at a position, and the one that is compatible
with the last token of the prefix before it is taken. Two tokens are compatible if
merging the characters of both gives just these two. Ids are read from the table backwards.

No token spans the start of a run of blanks, or a character that is in no piece, so a text is a
series of chunks (blanks, then what follows up to the next blank or such a character) that are encoded on their own. The distinct chunks
of a batch of texts are encoded once, all of them together: one run of the automaton, then the
table from left to right, a column of all chunks at a time. The batch's ids are gathered from them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: Slots of the table of pairs seen; a pair that meets another in its slot takes its place.
PAIR_BITS = 21
#: Chunks longer than this are encoded one by one.
MAX_COLUMNS = 512
#: Characters of text that are gathered at once, and of distinct chunks that are encoded at once.
GATHERED, ENCODED = 2 << 20, 1 << 17
RESULT = "struct<ids: binary, n_tokens: bigint, decoded: string>"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict:
    """Pieces and their ids, scores and kinds from a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    if any(sp.is_unused(i) for i in ids):
        raise ValueError("unused pieces are not supported")
    special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
    return {
        "pieces": [sp.id_to_piece(i) for i in ids],
        "scores": [sp.get_score(i) for i in ids],
        "plain": [i for i in ids if i not in special],
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)},
        "unknown": sp.unk_id(),
        "begin": sp.bos_id(),
        "end": sp.eos_id(),
    }


def merged(text: str, id_of: dict[str, int], scores: list[float]) -> list[str]:
    """The pieces of a short text by merging the best pair until none is left."""
    parts = list(text)
    while True:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = id_of.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of runs of these sizes, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Codec:
    def __init__(self, path: str):
        v = vocabulary(path)
        self.pieces, self.scores, self.bytes = v["pieces"], v["scores"], v["bytes"]
        self.unknown, self.begin, self.end = v["unknown"], v["begin"], v["end"]
        self.id_of = {self.pieces[i]: i for i in v["plain"]}
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        used = set("".join(self.id_of)) - {SPACE}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        known = "".join(map(re.escape, sorted(used)))
        self.chunk = re.compile(f"[{SPACE}{known}]+|(?s:.)" if inner else f"{SPACE}+[{known}]*|[{known}]+|(?s:.)")
        self.between = next(c for c in map(chr, range(1 << 16)) if c not in used)  # in no piece
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = np.full(0x110000, -1, np.int32)  # the pieces of one character, by code point
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
            elif merged(piece, self.id_of, self.scores) == [piece]:  # else no merge ever makes it
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {self.begin, self.end}
        # what an id says; odd are those that say something only together with others
        self.said = [chr(self.byte_of[i]) if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.said[self.unknown] = " ⁇ "
        self.odd = np.zeros(len(self.pieces), bool)
        self.odd[[i for i, b in self.byte_of.items() if b > 127]] = True
        self.keys = np.full(1 << PAIR_BITS, -1, np.int64)  # pairs seen, as left * pieces + right
        self.fits = np.zeros(1 << PAIR_BITS, bool)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces gives just these two."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        fit, new = self.fits[slot], self.keys[slot] != key
        if new.any():
            asked, where = np.unique(key[new], return_inverse=True)
            pairs = [(self.pieces[k // len(self.pieces)], self.pieces[k % len(self.pieces)]) for k in asked.tolist()]
            answers = np.array([merged(a + b, self.id_of, self.scores) == [a, b] for a, b in pairs], bool)[where]
            fit[new] = answers
            # of pairs that share a slot the same one is taken in both tables
            place, first = np.unique(slot[new], return_index=True)
            self.keys[place], self.fits[place] = key[new][first], answers[first]
        return fit

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths + 1) - lengths - 1
        joined = self.between.join([*chunks, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        unknown = self.single[points] < 0
        unknown[starts + lengths] = False
        odd = (lengths > MAX_COLUMNS) | np.logical_or.reduceat(unknown, starts) if len(chunks) else np.zeros(0, bool)
        if odd.any():
            return self._mixed(chunks, odd)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int32).reshape(-1, 2)
        alone = np.flatnonzero(self.single[points] >= 0)
        ends = np.concatenate([alone, found[:, 0]]) + 1
        tokens = np.concatenate([self.single[points[alone]], found[:, 1]])
        column = (ends - np.repeat(starts, lengths + 1)[ends - 1]).astype(np.uint16)
        order = np.argsort(column, kind="stable")
        ends, tokens, column = ends[order], tokens[order], column[order]
        before = ends - self.lengths[tokens]
        cuts = np.searchsorted(column, np.arange(1, lengths.max(initial=0) + 2))
        last = np.full(len(joined) + 1, -1, np.int32)  # the last token of each prefix; -1: none before
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            left, right = last[before[a:b]], tokens[a:b]
            ok = np.flatnonzero((left < 0) | self.compatible(left, right))
            last[ends[a:b][ok]] = right[ok]
        steps = []
        at, own = starts + lengths, np.arange(len(chunks))
        while len(own):
            token = last[at]
            steps.append((own, token))
            at = at - self.lengths[token]
            more = at > starts[own]
            own, at = own[more], at[more]
        sizes = np.bincount(np.concatenate([o for o, _ in steps]), minlength=len(chunks)) if steps else np.zeros(0, np.int64)
        flat, to = np.empty(int(sizes.sum()), np.uint32), np.cumsum(sizes) - 1
        for own, token in steps:  # from the last id to the first
            flat[to[own]] = token
            to[own] -= 1
        return flat, sizes

    def _mixed(self, chunks: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_chunks, with the chunks that are marked one at a time."""
        rest, sizes = np.flatnonzero(~alone), np.zeros(len(chunks), np.int64)
        flat, sizes[rest] = self.encode_chunks([chunks[k] for k in rest.tolist()])
        single = {k: self.encode_chunk(chunks[k]) for k in np.flatnonzero(alone).tolist()}
        for k, ids in single.items():
            sizes[k] = len(ids)
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[spread(starts[rest], sizes[rest])] = flat
        for k, ids in single.items():
            out[starts[k] : starts[k] + len(ids)] = ids
        return out, sizes

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of one chunk, however long and of whatever characters; those of no piece become their bytes."""
        last = [-1] * (len(chunk) + 1)
        matches = self.automaton.iter(chunk)
        at, token = next(matches, (len(chunk), -1))
        for k, c in enumerate(chunk):
            fitting = [int(self.single[ord(c)])]
            while at == k:
                fitting.append(token)
                at, token = next(matches, (len(chunk), -1))
            for t in fitting:
                before = last[k + 1 - self.lengths[t]]
                if t >= 0 and (before < 0 or self.compatible(np.array([before]), np.array([t]))[0]):
                    last[k + 1] = t
                    break
        ids, end = [], len(chunk)
        while end:
            token = last[end]
            if token >= 0:
                ids.append(token)
                end -= int(self.lengths[token])
            else:
                end -= 1
                ids += [self.bytes.get(b, self.unknown) for b in reversed(chunk[end].encode("utf-8"))]
        return ids[::-1]

    def text(self, ids: list[int]) -> str:
        """What the pieces say, blanks as blanks, without taking off a leading one."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_from_bytes(raw))
                raw = bytearray()
            if i not in self.silent:
                out.append(self.said[i])
        if raw:
            out.append(_from_bytes(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.text(ids)
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return text[1:] if self.pieces[first].startswith(SPACE) else text

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.run([text]))[0], "<u4").tolist()

    def run(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids with begin and end, and the text that they decode to."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GATHERED:
                yield from self._gathered(held)
                held, size = [], 0
        if held:
            yield from self._gathered(held)

    def _gathered(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        place = defaultdict(count().__next__)  # of each distinct chunk
        chunks = [np.fromiter(map(place.__getitem__, self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else ()), np.int64) for t in texts]
        distinct = list(place)
        cuts = np.flatnonzero(np.diff(np.cumsum(list(map(len, distinct))) // ENCODED)) + 1
        coded = [self.encode_chunks(distinct[a:b]) for a, b in zip([0, *cuts], [*cuts, len(distinct)])]
        flat, sizes = (np.concatenate(x) for x in zip(*coded))
        starts = np.cumsum(sizes) - sizes
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        for own in chunks:
            ids = flat[spread(starts[own], sizes[own])]
            listed = ids.tolist()
            text = self.text(listed) if self.odd[ids].any() else "".join(map(self.said.__getitem__, listed))
            # the first piece's own blank is not part of the text
            yield begin + ids.astype("<u4").tobytes() + end, text[1:] if text.startswith(" ") else text

def _from_bytes(raw: bytes) -> str:
    """UTF-8, each byte that is not part of a character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each model and worker process."""
    return Codec(path)


def encode_decode(text: Column, path: str) -> Column:
    """A struct: ids (little-endian unsigned 32-bit integers, begin and end included), n_tokens,
    decoded (what these ids decode to).

    Null counts as an empty text: begin and end alone, ''. Texts may be of any length, with or without
    blanks. A row depends on its own text alone: repeated rows get equal results, an empty table gives none, there are no
    ties, and other columns are not looked at. path names the model file, found at the same place on every executor.
    """

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = list(codec(path).run([t or "" for t in texts]))
        return pd.DataFrame({"ids": [r for r, _ in rows], "n_tokens": [len(r) // 4 for r, _ in rows], "decoded": [t for _, t in rows]})

    return run(text)
