"""Exact substring dedup by distributed prefix doubling over positions sampled by content.

A byte goes when a string of ``LENGTH`` bytes (a *window*) covers it that also starts in a document
with a smaller id. Plain doubling sorts every byte position in every round; here Spark sorts only
positions that can still matter, and each of them stands for a run of windows:

* Every window takes its smallest 24-byte gram as *anchor*, which depends on the window's content
  alone. Neighbouring windows share anchors, about one per 14 bytes. An anchor's *core* is its 24
  bytes, which all of its windows hold; its *whole* is all that its windows cover, 76 bytes at most.
* Round 0 sorts (rank of the core, rank of the whole, document). A core that is alone drops out. Of
  equal wholes all but those of the smallest document are settled, with every window. What is left
  are first occurrences of wholes that share their core with other wholes: the borders of repeated
  passages.
* Each further round parts a run of windows in three. All windows of a part share a longer core: 42
  bytes, then 48 and 50. Spark sorts (longer core, whole of the part, document) again; unique cores
  drop out, equal wholes are settled, the rest goes on, until the core is the window itself.

In round 0 a rank is a name of 128 bits made where the text is, so that equal strings have equal
ranks in every task; it is sent as two numbers, and two different wholes are taken for equal only if
both agree. The later rounds sort the bytes themselves.

Scale: documents are dealt once, by a hash of the id, into batches of about ``BATCH_BYTES`` and stay
there. A batch sends one row per core and whole, with its smallest document, and gets back only
rows that settle something, so rows grow with the text. A string that a third of all documents share
is thus one row per batch. A core with more than ``PER_CORE`` wholes in one batch is *wide*: its rows
are dealt by the whole, one mark tells those who hold the core elsewhere that it is not alone, and
the next round brings them together. The last round has no wide cores. No step sees all copies of
a string, and none is left out.

Null text is empty; texts under ``LENGTH`` bytes lose nothing; a null id counts as larger than
all others; rows with equal ids never remove bytes from each other; matches do not cross documents; a
text of any length is one member of its batch; an empty table gives an empty result; extra columns,
whatever their names, are kept by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_dealt, release, trim, whole_text, written

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
BATCH_BYTES = 8 << 20
#: Partitions at most; each then works through several batches, one after the other.
PARTITIONS = 100_000
PER_CORE = 4
PIECE = 1 << 15
CHUNK = 1 << 16
LAST = np.int64((1 << 63) - 1)

_M1, _M2, _M3, _M4 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_LOW = np.uint64(PIECE * 2 - 1)


def pair(a: np.ndarray, b: np.ndarray, m: np.uint64 = _M1, n: np.uint64 = _M2) -> np.ndarray:
    """The rank of a pair of ranks."""
    x = a * m
    x += b * n
    x ^= x >> np.uint64(32)
    return x


def mix(x: np.ndarray, m: np.uint64 = _M3) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * m
    return x ^ (x >> np.uint64(32))


def words_at(data: bytes) -> np.ndarray:
    """The 8 bytes at every position, as numbers, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def gram_hashes(u: np.ndarray, lo: int, n: int) -> np.ndarray:
    """What anchors are chosen by: a hash of the ``GRAM`` bytes at ``n`` positions from ``lo``."""
    rest = GRAM - 8
    u = u[lo : lo + n + rest].copy()
    return pair(u[:n], u[rest:])


def anchor_offsets(u: np.ndarray, windows: int) -> np.ndarray:
    """How far each window's anchor is from its start."""
    out = np.empty(windows, np.uint8)
    for lo in range(0, windows, PIECE):
        n = min(PIECE, windows - lo)
        m = gram_hashes(u, lo, n + SPAN - 1)
        m = m & ~_LOW | np.arange(n + SPAN - 1, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < SPAN:
            m = np.minimum(m[: width - SPAN], m[SPAN - width :])
        out[lo : lo + n] = (m & _LOW).astype(np.int64) - np.arange(n)
    return out


def runs(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, whose text each run of windows with one anchor is in, the places of
    their anchors, first and last windows."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    data = b"".join(texts) + bytes(64)
    windows = len(data) - 64
    # no window crosses the end of a text
    inside = np.zeros(windows + 1, np.int8)
    long = size >= LENGTH
    inside[(end - size)[long]] += 1
    inside[(end - LENGTH + 1)[long]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    off = anchor_offsets(words_at(data), windows)
    begins, ends = inside.copy(), inside.copy()
    if windows:
        same = inside[1:] & inside[:-1] & (off[1:] + np.uint8(1) == off[:-1])
        begins[1:] &= ~same
        ends[:-1] &= ~same
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
    return data, np.searchsorted(end, lo, side="right"), lo + off[lo], lo, hi


def names(data: bytes, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of the cores and of the wholes."""
    u = words_at(data)

    def rank(p: np.ndarray, offsets: list[int], m: np.uint64, n: np.uint64) -> np.ndarray:
        x = u[p + offsets[0]]
        for o in offsets[1:]:
            x = pair(x, u[p + o], m, n)
        return mix(x, n)

    core = rank(pos, [0, GRAM - 8], _M2, _M4)
    # the first window, and of the last one what may lie behind the first
    whole = pair(rank(lo, [0, 8, 16, 24, 32, 40, LENGTH - 8], _M3, _M1), rank(hi, [*range(GRAM, LENGTH - 8, 8), LENGTH - 8], _M4, _M3))
    shape = ((pos - lo) * 64 + hi - lo).astype(np.uint64)
    return core.view(np.int64), mix(pair(whole, shape, _M1, _M4), _M3).view(np.int64)


# ---------------------------------------------------------------- one batch


class Batch:
    """The documents of a batch, their runs of windows, and the runs' names: numbers of the
    distinct pairs of core and whole."""

    def __init__(self, table: pa.Table):
        unpack = zstandard.ZstdDecompressor()
        ids = np.array([LAST if i is None else i for i in table.column("__id").to_pylist()], np.int64)
        #: Rows of the table in ascending order of id, as everything here keeps them.
        self.rows = np.argsort(ids, kind="stable")
        self.ids = ids[self.rows]
        self.texts = [unpack.decompress(x) for x in table.column("__data").take(pa.array(self.rows)).to_pylist()]
        self.data, self.owner, self.pos, self.lo, self.hi = runs(self.texts)
        core, whole = names(self.data, self.pos, self.lo, self.hi)
        self.doc = self.ids[self.owner]
        self.order = np.argsort(whole, kind="stable")
        w, c = whole[self.order], core[self.order]
        if ((w[1:] == w[:-1]) & (c[1:] != c[:-1])).any():
            self.order = np.lexsort((core, whole))
            w, c = whole[self.order], core[self.order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        self.begin = np.flatnonzero(new)
        self.first = self.order[self.begin]
        self.core, self.whole = c[new], w[new]
        self.name = np.empty(len(w), np.int64)
        self.name[self.order] = np.cumsum(new) - 1

    def find(self, core: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The names of pairs, -1 for what is not here."""
        found = np.full(len(core), -1)
        at = np.searchsorted(self.whole, whole)
        todo = np.arange(len(core))
        while len(todo):
            todo = todo[at[todo] < len(self.whole)]
            todo = todo[self.whole[at[todo]] == whole[todo]]
            hit = self.core[at[todo]] == core[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return found

    def entries(self, batch: int) -> pa.Table:
        """Round 0: a row per name, and a mark per wide core."""
        cores, inverse, count = np.unique(self.core, return_inverse=True, return_counts=True)
        wide, marked = (count > PER_CORE)[inverse], cores[count > PER_CORE]
        n, m = len(self.core), len(marked)
        return pa.table({
            "batch": np.repeat(np.array([batch, -1], np.int32), (n, m)),
            "wide": np.concatenate((wide, np.zeros(m, bool))),
            "one": np.concatenate((np.where(wide, self.whole, self.core), marked)),
            "two": np.concatenate((np.where(wide, self.core, self.whole), np.zeros(m, np.int64))),
            "doc": np.concatenate((self.doc[self.first], np.full(m, LAST))),
        })

    def contexts(self, batch: int, core: np.ndarray, whole: np.ndarray) -> pa.Table:
        """The bytes of open wholes; ``low`` and ``high`` say how far before its anchor the
        nearest and the farthest window start."""
        name = self.find(core, whole)
        row = self.first[name[name >= 0]]
        lo, hi, pos = self.lo[row], self.hi[row], self.pos[row]
        return pa.table({
            "batch": np.full(len(row), batch, np.int32),
            "core": self.core[self.name[row]],
            "whole": self.whole[self.name[row]],
            "doc": self.doc[row],
            "first": np.zeros(len(row), np.int32),
            "last": np.full(len(row), SPAN - 1, np.int32),
            "low": (pos - hi).astype(np.int32),
            "high": (pos - lo).astype(np.int32),
            "bytes": pa.array([self.data[a : b + LENGTH] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
        })

    def removed(self, core: np.ndarray, whole: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
        """For each document the bytes to remove, as pairs of span ends, given the settled windows
        of first occurrences here. Those with a smaller document in the batch are settled anyway."""
        least = self.doc[self.first][self.name]
        later = np.flatnonzero(self.doc > least)
        leads = np.bincount(self.name[self.doc == least], minlength=len(self.core))
        name = self.find(core, whole)
        low, high, name = low[name >= 0], high[name >= 0], name[name >= 0]
        n = leads[name]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row = self.order[np.repeat(self.begin[name], n) + step]
        start = np.concatenate((self.lo[later], np.maximum(self.pos[row] - np.repeat(high, n), self.lo[row])))
        stop = np.concatenate((self.hi[later], np.minimum(self.pos[row] - np.repeat(low, n), self.hi[row])))
        order = np.argsort(start, kind="stable")
        start, stop = start[order], stop[order] + LENGTH
        base = 0
        bounds = np.searchsorted(start, np.cumsum([0, *map(len, self.texts)]))
        for k, text in enumerate(self.texts):
            s, e = start[bounds[k] : bounds[k + 1]], stop[bounds[k] : bounds[k + 1]]
            if len(s):
                e = np.maximum.accumulate(e)
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                yield np.stack((s[new], e[np.append(new[1:], len(s)) - 1]), axis=1) - base
            else:
                yield np.empty((0, 2), np.int64)
            base += len(text)


# ---------------------------------------------------------------- rounds


def _judged(rows: DataFrame, parts: int, group: list[str], same: list[str]) -> DataFrame:
    """``rows`` (but marks) that are ``settled`` or go on. Rows of one ``group``, dealt by its first
    column, have equal cores; of those that agree in ``same`` too, the smallest document is first.
    One sort serves both windows."""
    inner, outer = Window.partitionBy(*group, *same), Window.partitionBy(*group)
    one = F.col(same[0]) if len(same) == 1 else F.struct(*same)
    dealt = rows.repartition(parts, group[0]).withColumn("settled", F.col("doc") > F.min("doc").over(inner))
    others = (F.min(one).over(outer) != F.max(one).over(outer)) | (F.min("batch").over(outer) < 0)
    return dealt.withColumn("others", F.col("wide") | others).where("batch >= 0 and (settled or others)").drop("others")


def _core_bytes(first, last, high, bytes_):
    """The bytes that all windows from ``first`` to ``last`` before an anchor hold."""
    return F.substring(bytes_, high - first + 1, LENGTH - (last - first))


_OPEN = "batch int, core long, whole long, doc long, first int, last int, low int, high int, bytes binary"
_PART = _OPEN + ", wide boolean, cut boolean"
_CUTS = ["batch", "core", "whole", "low", "high"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for b in batches:
        held += zip(*[c.to_pylist() for c in b.columns], strict=True)
        if len(held) >= CHUNK:
            yield held
            held = []
    yield held


def _parts(opened: DataFrame) -> DataFrame:
    """The three parts of each run of windows. Of equal parts in a chunk of rows, only those of the
    smallest document go on, the others are ``cut``."""

    def split(rows: list[tuple]) -> Iterator[tuple]:
        best: dict[tuple, list[tuple]] = {}
        for batch, core, whole, doc, first, last, low, high, text in rows:
            step = -(-(last - first + 1) // 3)
            for a in range(first, last + 1, step):
                b = min(a + step - 1, last)
                near, far = max(low, a), min(high, b)
                if near > far:
                    continue
                key = (a, b, near, far, text[high - far : high - near + LENGTH])
                held = best.setdefault(key, [])
                row = (batch, core, whole, doc)
                if held and doc < held[0][3]:
                    yield from ((*h, a, b, near, far, None, False, True) for h in held)
                    held.clear()
                if held and doc > held[0][3]:
                    yield (*row, a, b, near, far, None, False, True)
                else:
                    held.append(row)
        count: dict[tuple, int] = {}
        place = lambda a, b, far, text: (a, b, text[far - a : far - a + LENGTH - (b - a)])
        for a, b, _, far, text in best:
            k = place(a, b, far, text)
            count[k] = count.get(k, 0) + 1
        for (a, b, near, far, text), held in best.items():
            wide = count[place(a, b, far, text)] > PER_CORE
            yield from ((*h, a, b, near, far, text, wide, False) for h in held)
        for (a, b, text), n in count.items():
            if n > PER_CORE:  # a mark
                yield -1, 0, 0, int(LAST), a, b, a, a, text, False, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            columns = list(zip(*split(rows), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        trim()

    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = {name: of[kind] for name, kind in (f.split() for f in _PART.split(", "))}
    return opened.mapInArrow(run, _PART)


def _round(opened: DataFrame, parts: int) -> DataFrame:
    """One round of parts: the rows that are ``settled`` or go on."""
    core = _core_bytes(F.col("first"), F.col("last"), F.col("high"), F.col("bytes"))
    key = F.when(F.col("cut"), F.xxhash64("core", "whole", "low")).when(F.col("wide"), F.xxhash64("first", "low", "high", "bytes")).otherwise(F.xxhash64("first", core))
    rows = _parts(opened).select(key.alias("key"), "*")
    # the core is bytes of the row itself and is not sent beside it
    held = rows.repartition(parts, "key").withColumn("core_bytes", core)
    inner = Window.partitionBy("key", "first", "core_bytes", "low", "high", "bytes")
    outer = Window.partitionBy("key", "first", "core_bytes")
    one = F.struct("low", "high", "bytes")
    held = held.withColumn("settled", F.col("cut") | (F.col("doc") > F.min("doc").over(inner)))
    held = held.withColumn("others", F.col("wide") | (F.min(one).over(outer) != F.max(one).over(outer)) | (F.min("batch").over(outer) < 0))
    kept = held.where("batch >= 0 and (settled or (others and first < last))").drop("key", "core_bytes", "wide", "cut", "others")
    return kept.withColumn("bytes", F.when(~F.col("settled"), F.col("bytes")))


# ---------------------------------------------------------------- the operator


def _batch_of(batches: int) -> Column:
    """Rows without an id are dealt by their text."""
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("__data")).otherwise(F.xxhash64("doc_id")), F.lit(batches))


def _dealt(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Documents in batches, texts compressed, in the shared checkpoint folder; and how many
    partitions they fill."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(whole_text(text)).cast("long")).alias("n")).first()["n"] or 0
    batches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BATCH_BYTES))
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(whole_text(text).alias("__data"), *[F.col(f"`{c}`") for c in rest])
    rows = rows.select("__data", _batch_of(batches).cast("int").alias("__batch"), F.col("doc_id").cast("long").alias("__id"), *[F.col(f"`{c}`") for c in rest])
    schema = rows.withColumn("__data", F.lit(None).cast("binary")).schema

    def compress(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches_:
            data = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *b.columns[1:]], names=b.schema.names)

    parts = min(batches, PARTITIONS)
    return cut_dealt(rows.mapInArrow(compress, schema), parts, "__batch"), parts


def _number(table: pa.Table) -> int:
    return table.column("__batch")[0].as_py()


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in columns]


def _settled(dealt: DataFrame, parts: int) -> DataFrame:
    """``batch, core, whole, low, high``: windows of first occurrences in their batches that a
    smaller document has."""

    def send(table: pa.Table) -> pa.Table:
        out = Batch(table).entries(_number(table))
        trim()
        return out

    def send_bytes(table: pa.Table, opened: pa.Table) -> pa.Table:
        if not table.num_rows or not opened.num_rows:
            return pa.table({n: pa.array([], k) for n, k in empty.items()})
        out = Batch(table).contexts(_number(table), *_numbers(opened, "core", "whole"))
        trim()
        return out

    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    empty = {n: of[k] for n, k in (f.split() for f in _OPEN.split(", "))}
    docs = dealt.select("__batch", "__id", "__data")
    release(dealt)
    rows = docs.groupBy("__batch").applyInArrow(send, "batch int, wide boolean, one long, two long, doc long")
    seen = _judged(rows, parts, ["one", "wide"], ["two"])
    seen = written(seen.select("batch", F.when(F.col("wide"), F.col("two")).otherwise(F.col("one")).alias("core"), F.when(F.col("wide"), F.col("one")).otherwise(F.col("two")).alias("whole"), "settled"))
    cuts = seen.where("settled").select("batch", "core", "whole", F.lit(0).alias("low"), F.lit(SPAN - 1).alias("high"))
    going = seen.where("not settled").select("batch", "core", "whole")
    opened = docs.groupBy("__batch").cogroup(going.groupBy("batch")).applyInArrow(send_bytes, _OPEN)
    width = SPAN
    while width > 1:
        width = -(-width // 3)
        judged = written(_round(opened, parts))
        cuts = cuts.union(judged.where("settled").select(_CUTS))
        opened = judged.where("not settled").drop("settled")
        if opened.isEmpty():
            break
    return cuts


def _finished(docs: DataFrame, text: str, describe, added: list) -> DataFrame:
    """The columns of ``docs`` without the text, and what ``describe(data, spans)`` gives."""
    dealt, parts = _dealt(docs, text)
    cuts = _settled(dealt, parts)
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast(kind).alias(name) for name, kind, _ in added]).schema

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        out = table.select(rest)
        made: list[tuple] = []
        if table.num_rows:
            batch = Batch(table)
            out = out.take(pa.array(batch.rows))
            made = [describe(d, s) for d, s in zip(batch.texts, batch.removed(*_numbers(back, "core", "whole", "low", "high")), strict=True)]
            del batch
        columns = list(zip(*made, strict=True)) if made else [()] * len(added)
        for (name, _, kind), c in zip(added, columns, strict=True):
            out = out.append_column(name, pa.array(c, kind))
        del made, columns
        trim()
        return out

    return dealt.groupBy("__batch").cogroup(cuts.groupBy("batch")).applyInArrow(finish, schema)


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return data
    edges = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame) -> DataFrame:
    def describe(data: bytes, spans: np.ndarray) -> tuple:
        return len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha256(kept_bytes(data, spans)).hexdigest()

    added = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return _finished(docs.select("doc_id", "text"), "text", describe, added)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pipeline stage: ``docs`` with repeated passages removed from the text. A cut through a
    code point drops its rest; ``n_chars`` follows a changed text; a null text becomes empty; the columns are those of ``docs``."""

    def describe(data: bytes, spans: np.ndarray) -> tuple:
        return kept_bytes(data, spans).decode("utf-8", "ignore"), len(spans) > 0

    out = _finished(docs, text, describe, [(text, "string", pa.string()), ("__cut", "boolean", pa.bool_())])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
