"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so that repeats count. For each of
``SIZE`` orders (keyed hashes of k-mer and number) the ``TUPLE`` smallest are selected, put back
into text order and hashed as a tuple. The share of equal tuples of two fingerprints falls with
the edit distance of their texts, also where their sets of k-mers are equal.

:func:`with_ranges` puts each document beside the one that follows in descending ``doc_id`` order
with one shuffle of the texts: documents are dealt to ranges of ids, each a partition of its own of
about ``RANGE_BYTES``, and each range also gets the one document that follows it. A task streams
through its range and holds two documents. The driver holds one key per range, ``RANGES`` at most.

Null text is empty. An empty text has its own constant fingerprint. Documents with equal ids
follow each other in descending order of text; null ids come last, in descending order of a hash of
their texts, so that they fill ranges like others; the only document of a table follows itself; a text of any
length is fingerprinted whole; an empty table gives an empty result; clashing column names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

K = 8
TUPLE = 2
SIZE = 64
BLOCK = 2048
SEED = 20240607
RANGE_BYTES = 16 << 20
RANGES = 8192
_LOW = (1 << 32) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(SEED)
_MUL = (_rng.integers(0, 1 << 32, SIZE, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint64).astype(np.uint32)[:, None]
_END = np.uint32(0xFFFFFFFF)


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` code points; of the whole text if it is shorter."""
    if len(points) == 0:
        return np.empty(0, np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    h = np.zeros(n, np.uint64)
    base = np.uint64(0x2545F4914F6CDD1D)
    for i in range(k):
        h = h * base + points[i : i + n]
    return _mix(h + np.uint64(k))


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, number of its occurrence so far)."""
    n = len(h)
    bits = np.uint64(n.bit_length())
    s = np.sort((h >> bits) << bits | np.arange(n, dtype=np.uint64))  # equal k-mers side by side, in text order
    same = (s[1:] ^ s[:-1]) >> bits == 0
    x = h
    if same.any():
        run = np.flatnonzero(np.concatenate(([True], ~same)))
        number = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        again = number > 0
        x = h.copy()
        x[(s[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] += number[again].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (_mix(x) >> np.uint64(32)).astype(np.uint32)


def smallest(x: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Under each order the ``TUPLE`` smallest values of ``x`` and their positions."""
    vals, places = [], []
    rows = np.arange(SIZE)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        v = part[None, :] * _MUL + _ADD
        v ^= v >> np.uint32(15)
        for _ in range(min(TUPLE, len(part))):
            i = np.argmin(v, axis=1)
            vals.append(v[rows, i])
            places.append(i + (lo + start))
            v[rows, i] = _END
    if not vals:
        return np.empty((SIZE, 0), np.uint32), np.empty((SIZE, 0), np.int64)
    return least(np.stack(vals, axis=1), np.stack(places, axis=1))


def least(vals: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``TUPLE`` smallest of each row, ties by position."""
    if vals.shape[1] <= TUPLE:
        return vals, places
    both = np.sort(vals.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64), axis=1)[:, :TUPLE]
    return (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(_LOW)).astype(np.int64)


def tuples(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the selected k-mers of each order, in text order."""
    out = np.zeros(SIZE, np.uint64)
    places = np.sort(places, axis=1)
    for i in range(places.shape[1]):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + h[places[:, i]])
    return (out >> np.uint64(32)).astype(">u4")


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(text: str) -> np.ndarray:
    h = kmer_hashes(points_of(text))
    return tuples(h, smallest(numbered(h), 0)[1])


def fingerprint_pair(a: np.ndarray, b: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that agree in their first ``shared`` code points; k-mers within
    these are hashed once under all orders."""
    ha, hb = kmer_hashes(a), kmer_hashes(b)
    m = max(0, min(shared - K + 1, len(ha), len(hb))) if min(len(a), len(b)) >= K else 0
    xa, xb = numbered(ha), numbered(hb)
    head = smallest(xa[:m], 0)
    both = []
    for h, x in ((ha, xa), (hb, xb)):
        tail = smallest(x[m:], m)
        both.append(tuples(h, least(*(np.concatenate(p, axis=1) for p in zip(head, tail, strict=True)))[1]))
    return both[0], both[1]


def likeness(f: np.ndarray, g: np.ndarray) -> float:
    return float(np.mean(f == g))


# ---------------------------------------------------------------- documents and their successors


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b) for b in bounds])

    def step(pos, s):
        return F.when((pos + s <= len(bounds)) & (F.try_element_at(table, pos + s) <= key), pos + s).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(bucket, named, key, last, doc_id, text)`` rows, the rows that follow each bucket, and the
    number of buckets.

    ``named`` and ``key`` order descending; ``last`` marks the copies that only serve as a successor."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(whole_text())).alias("key"), "doc_id", whole_text().alias("text"))
    parts = rows.groupBy("named").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    total = sum(r["bytes"] for r in parts)
    ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)), RANGES)
    share = {r["named"]: max(1, round(ranges * r["bytes"] / max(total, 1))) for r in parts}
    cuts = [F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias(f"cuts_{name}") for name, n in share.items()]
    found = rows.groupBy("named").agg(*cuts).collect() if cuts else []
    bounds = {name: sorted(set(next(r[f"cuts_{name}"] for r in found if r["named"] == name))) if n > 1 else [] for name, n in share.items()}
    first = len(bounds.get(False, [])) + 1 if False in share else 0
    bucket = F.when(F.col("named"), F.lit(first) + _range_of(F.col("key"), bounds.get(True, []))).otherwise(_range_of(F.col("key"), bounds.get(False, [])))
    rows = rows.withColumn("bucket", bucket)
    tops = sorted(tuple(r) for r in rows.groupBy("bucket", "named").agg(F.max("key").alias("top")).collect())
    follow = [(*tops[i - 1][1:], b) for i, (b, *_) in enumerate(tops)]  # the lowest range is followed by the highest
    edges = spark.createDataFrame(follow, "named boolean, key long, bucket int")
    heads = rows.drop("bucket").join(F.broadcast(edges), ["named", "key"]).withColumn("last", F.lit(True))
    return rows.withColumn("last", F.lit(False)), heads, first + len(bounds.get(True, [])) + 1


def report(docs: DataFrame) -> DataFrame:
    rows, heads, buckets = with_ranges(docs)
    columns = ["bucket", "key", "last", "doc_id", "text"]
    dealt = rows.select(columns).unionByName(heads.select(columns)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "last", F.desc("key"), F.desc("text"))
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.select("doc_id", *[F.lit(None).cast(s.split()[1]).alias(s.split()[0]) for s in schema.split(", ")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose successor comes next: bucket, id, text
        made = None  # a row that lacks the likeness to its successor: id, fields, fingerprint
        for b in batches:
            ids, rows_out = [], []

            def finish(after: np.ndarray) -> None:
                if made:
                    ids.append(made[0])
                    rows_out.append((*made[1], likeness(made[2], after)))

            for bucket, last, doc_id, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                if before and before[0] == bucket:
                    fields, f = describe(before[2], text)
                    finish(f)
                    made = (before[1].as_py(), fields, f)
                if last and made:
                    finish(fingerprint(text))
                    made = None
                before = None if last else (bucket, doc_id, text)
            columns = list(zip(*rows_out, strict=True)) if rows_out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(3).type), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[f.name for f in out])

    return dealt.mapInArrow(run, out)


def describe(text: str, following: str) -> tuple[tuple, np.ndarray]:
    """The report's fields but the last, and the fingerprint of ``text``."""
    n = len(text)
    kept = n - n // 3
    edited = text[:kept] + following[: n // 3]
    f, g = fingerprint_pair(points_of(text), points_of(edited), kept)
    sha = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (n, sha, f.tobytes().hex(), g.tobytes().hex(), likeness(f, g)), f
