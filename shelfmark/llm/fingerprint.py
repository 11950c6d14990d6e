"""Threshold-scaled sketches of documents, and how alike neighbouring documents are.

A sketch keeps every hash of a shingle (20 consecutive code points) below a fixed
fraction of the hash range, whatever the document's length; the union of two sketches is
the sketch of both documents together, and the share of one sketch that is in another
estimates containment even between very unequal documents. The smallest hash is kept in any
case, so that short texts have a fingerprint too.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions

SHINGLE = 20
FRACTION = 16
#: Hashes are kept with 48 bits.
BELOW = np.uint64((1 << 48) // FRACTION)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
LEAST = -(1 << 63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(text: str) -> np.ndarray:
    """Sorted distinct 48-bit hashes kept of a text; a text shorter than a shingle is one shingle, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(codes):
        return codes
    k = min(SHINGLE, len(codes))
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[0] = 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(codes + np.uint64(k << 32)) * np.cumprod(powers))))
    back = np.full(len(codes) - k + 1, _INVERSE, np.uint64)
    back[0] = 1
    hashes = _mix((sums[k:] - sums[:-k]) * np.cumprod(back)) >> np.uint64(16)
    kept = np.unique(hashes[hashes < BELOW])
    return kept if len(kept) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents together."""
    both = np.union1d(a, b)
    return both[both < BELOW] if (both < BELOW).any() else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two documents' shingles; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low_a, low_b = a[a < BELOW], b[b < BELOW]
    if not len(low_a) and not len(low_b):
        return float(a[0] == b[0])
    common = len(np.intersect1d(low_a, low_b, assume_unique=True))
    return common / (len(low_a) + len(low_b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    low = a[a < BELOW]
    return len(np.intersect1d(low, b, assume_unique=True)) / len(low) if len(low) else float(a[0] in b)


def to_text(s: np.ndarray) -> str:
    """Big-endian six-byte hashes in base64."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode("ascii") if len(s) else ""


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (null: empty) and of its edited text, which takes its end from the next document by doc_id.

    Texts move once, to ranges of doc_id; the first rows of a range are also sent to the range
    before it (to the last, for the first), so every row meets its successor in a sorted stream. Null ids
    come first; rows with the same id are ordered by text. A single row is its own successor.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST)).alias("_key"))
    ids = rows.select("_key")
    cuts = sorted(set(ids.agg(F.percentile_approx("_key", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []))
    at = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy(), "right").astype(np.int32))

    first = {r["p"]: r["k"] for r in ids.groupBy(range_of("_key").alias("p")).agg(F.min("_key").alias("k")).collect()}  # a row for each range
    used = sorted(first)
    guests = {first[p]: used[k - 1] for k, p in enumerate(used)}

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        return pd.Series([[bisect_right(cuts, k), guests[k]] if k in guests else [bisect_right(cuts, k)] for k in keys.tolist()])

    sent = rows.select("*", F.posexplode(targets("_key")).alias("_guest", "_to"))
    sent = sent.repartitionById(len(cuts) + 1, "_to").sortWithinPartitions("_guest", "_key", "text")
    return sent.select("_key", F.col("doc_id").isNull().alias("_null"), "text", "_guest").mapInPandas(_pairs, RESULT)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, over = None, False
    for batch in batches:
        out = []
        for key, null, text, guest in zip(batch["_key"].tolist(), batch["_null"], batch["text"], batch["_guest"]):
            if over:  # one guest is enough
                break
            own = sketch(text)
            if held:
                out.append(_result(*held, text, own))
            held, over = (None if null else key, text, own), bool(guest)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def _result(doc_id: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = sketch(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), to_text(own), to_text(changed), likeness(own, changed), likeness(own, theirs)
