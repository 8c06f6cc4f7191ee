"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window of ``WINDOW`` tokens visits all queues in turn: each
queue's deficit grows by its share of the window, whole tokens are taken, and what is left of the
window goes to the queues with the largest deficits. Deficits carry over to the next window.

That schedule depends on the queues' lengths alone, so it is laid out once, as a few phases of a
repeated cycle of ``CYCLE`` windows, and any task can then place any document: the document's
offset in its queue gives its windows. The deficits thus carry across partitions too, without any
task that sees all windows. A queue that runs dry ends a phase; its share passes to the others.
All windows but the last are full.

Steps: tokenise (one pass; the ids stay with their partition, in the shared checkpoint folder),
sum tokens per (partition, source), turn the sums into queue offsets, place. The driver holds one
row per source: sources are the parts of a mixture, their number does not grow with the rows.

Null text is an empty document, which still has its closing id; a null source is a queue of its
own; null ids and repeated rows are packed each; a text of any length is cut into as many pieces as it
takes; queues with equal deficits take turns in order of their names; an empty table gives no rows;
clashing names do not matter.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_rounds import rounds
from .common import cut, trim, whole_text

WINDOW = 4096
CYCLE = 64
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE = 400_000
#: Of the query: a source's target share is its share of the tokens to this power, so that small
#: sources are seen early and often, and large ones fill what is left.
TEMPERATURE = 0.7
SLICE = 12 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens


class WordMerges:
    """Merge table of a byte-level BPE with word ends; symbols are ids plus one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.count = len(vocab) + 1
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault((vocab[left] + 1) * self.count + vocab[right] + 1, (rank, vocab[left + right] + 1))
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # byte-level models write a byte as itself where it is printable, else from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        letters = [chr(b if b in set(shown) else next(rest)) for b in range(256)]
        self.inner = np.array([vocab[c] + 1 for c in letters], np.int64)
        self.last = np.array([vocab[c + end] + 1 for c in letters], np.int64)

    @staticmethod
    def pack(rows: np.ndarray) -> np.ndarray:
        return (rows - 1).astype("<u2")

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, each of a bounded length."""
        pairs = sorted(((w.encode(), w) for w in words), key=lambda p: len(p[0]))
        lengths = np.fromiter((len(b) for b, _ in pairs), np.int64, len(pairs))
        out: list[bytes] = [b""] * len(pairs)
        for n in np.unique(lengths).tolist():
            lo, hi = np.searchsorted(lengths, [n, n + 1]).tolist()
            raw = np.frombuffer(b"".join(b for b, _ in pairs[lo:hi]), np.uint8).reshape(hi - lo, n)
            s = self.inner[raw]
            s[:, -1] = self.last[raw[:, -1]]
            rounds(self, s, np.zeros(hi - lo, np.uint64), np.arange(lo, hi), 0.0, out)
        return {w: ids for (_, w), ids in zip(pairs, out, strict=True)}


class WordCache:
    """Token ids of texts, as bytes of little-endian 16-bit ids, by way of their words.

    The tokenizer never joins text across a blank or a line feed and drops both, so a text's ids
    are those of its pieces between them. A piece that is one run of letters with an optional comma
    or full stop is the ids of the word in lower case and those of the mark; such words are merged
    many at a time by :class:`WordMerges`, and up to ``CACHE`` and those of a slice are kept. All
    other pieces go to the tokenizers library as they are.
    """

    _letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.merges = WordMerges(path)
        self.marks = dict(zip(".,", self._encode([".", ","]), strict=True))
        self.plain: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.model.encode_batch(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.plain) > CACHE:
            self.plain = {}
        words: list[str | None] = []
        for p in pieces:
            w = p[:-1] if p.endswith((".", ",")) else p
            # letters of ASCII or Latin-1 alone: no case rule that looks at a letter's neighbours
            if w.isalpha() and len(w) <= 24 and (w.isascii() or self._letters.fullmatch(w)):
                words.append(w.lower())
            else:
                words.append(None)
        need = {w for w in words if w is not None and w not in self.plain}
        if need:
            self.plain.update(self.merges.encode(list(need)))
        whole = iter(self._encode([p for p, w in zip(pieces, words, strict=True) if w is None and p]))
        out = []
        for p, w in zip(pieces, words, strict=True):
            if w is None:
                out.append(next(whole) if p else b"")
            else:
                ids = self.plain[w]
                out.append(ids if len(p) == len(w) else ids + self.marks[p[-1]])
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, a slice of ``SLICE`` bytes of texts at a time."""
        if not len(texts):
            return
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.searchsorted(size, np.arange(SLICE, size[-1], SLICE)) + 1
        bounds = np.unique(np.concatenate(([0], cuts[cuts < len(texts)], [len(texts)])))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids, at = self._encode_slice(texts.slice(lo, hi - lo))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[a:b].tobytes()

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last
        end). Arrow splits the texts and numbers the distinct pieces; only these become Python
        objects."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = pieces.values.dictionary_encode()
        names = flat.dictionary.to_pylist()
        found = self._ids(names)
        size = np.fromiter(map(len, found), np.int32, len(found)) // 2
        start = np.cumsum(size, dtype=np.int32) - size
        which = flat.indices.to_numpy()
        count = size[which]
        end = np.cumsum(count, dtype=np.int64)
        pool = np.frombuffer(b"".join(found), "<u2")
        at = np.repeat(start[which] - (end - count).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        bounds = pieces.offsets.to_numpy()
        return pool[at], np.concatenate(([0], end))[bounds - bounds[0]]


@lru_cache(maxsize=1)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def tokenise(docs: DataFrame, path: str, text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """``doc_id, source, chunk, at, n, ids``: the chunk is the task's partition, ``at`` the
    document's place in its source's queue within the chunk, ``ids`` its packed token ids."""
    rows = docs.select("doc_id", F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("source"), whole_text(text).alias("text"))
    schema = rows.select("doc_id", "source", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids")).schema
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pack = _cache(path), zstandard.ZstdCompressor(level=1)
        chunk, filled = TaskContext.get().partitionId(), {}
        for b in batches:
            at, n, ids = [], [], []
            for name, got in zip(b.column(1).to_pylist(), cache.encode_all(b.column(2)), strict=True):
                got += end
                at.append(filled.get(name, 0))
                n.append(len(got) // 2)
                filled[name] = at[-1] + n[-1]
                ids.append(pack.compress(got))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([chunk] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "chunk", "at", "n", "ids"],
            )
        trim()

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- the schedule


class Phase:
    """``cycles`` repeats of the same windows. ``taken[r, s]``: tokens of queue ``s`` before
    window ``r`` of a cycle; ``begin[r, s]``: where they start within that window."""

    def __init__(self, first_window: int, cycles: int, takes: np.ndarray, queue_at: np.ndarray):
        zero = np.zeros((1, takes.shape[1]), np.int64)
        self.first_window, self.cycles, self.queue_at = first_window, cycles, queue_at.copy()
        self.taken = np.concatenate((zero, np.cumsum(takes, axis=0)))
        self.begin = np.cumsum(takes, axis=1) - takes
        self.per_cycle = self.taken[-1]


def round_of(deficit: np.ndarray, share: np.ndarray, room: int, left: np.ndarray) -> np.ndarray:
    """One window: what each queue gives. Updates the deficits in place."""
    deficit += room * share
    take = np.minimum(np.clip(np.floor(deficit), 0, room), left).astype(np.int64)
    over = int(take.sum()) - room
    while over > 0:  # whole parts may exceed the window after a carry
        i = int(np.argmax(take))
        step = min(over, int(take[i]))
        take[i] -= step
        over -= step
    for i in np.argsort(-(deficit - take), kind="stable").tolist() * 2:
        if over == 0:
            break
        step = min(-over, int(left[i] - take[i]), 1 if share[i] > 0 else 0)
        take[i] += step
        over += step
    for i in np.argsort(-(left - take), kind="stable").tolist():
        step = min(-over, int(left[i] - take[i]))
        take[i] += step
        over += step
    deficit -= take
    return take


def schedule(totals: list[int], weights: list[float] | None = None, window: int = WINDOW, cycle: int = CYCLE) -> list[Phase]:
    """Phases that use up all queues. ``weights`` are target proportions of tokens; without
    them the target is what remains in the queues, and all of them run dry together."""
    left = np.array(totals, dtype=np.int64)
    deficit = np.zeros(len(left))
    phases: list[Phase] = []
    at, length = 0, cycle
    queue_at = np.zeros(len(left), np.int64)
    while left.sum() > 0:
        want = left.astype(float) if weights is None else np.where(left > 0, weights, 0.0)
        if want.sum() <= 0:
            want = left.astype(float)
        share = want / want.sum()
        room = int(min(window, left.sum()))
        trial = deficit.copy()
        endless = np.where(left > 0, np.int64(1) << 40, 0)
        takes = np.stack([round_of(trial, share, window, endless) for _ in range(length)])
        used = takes.sum(axis=0)
        cycles = int((left[used > 0] // used[used > 0]).min())
        if cycles == 0 and length > 1:
            length //= 2
            continue
        if cycles == 0:
            takes, cycles = round_of(deficit, share, room, left)[None, :], 1
            used = takes[0]
        else:
            deficit += cycles * (trial - deficit)
        phases.append(Phase(at, cycles, takes, queue_at))
        at += cycles * len(takes)
        queue_at += cycles * used
        left -= cycles * used
        np.clip(deficit, -window, window, out=deficit)
        deficit[left == 0] = 0
        length = cycle if length == 1 else max(1, length // 2)
    return phases


class Queue:
    """One queue's part of the phases, in plain lists for quick look-up."""

    def __init__(self, phases: list[Phase], queue: int):
        mine = [p for p in phases if p.per_cycle[queue]]
        self.starts = [int(p.queue_at[queue]) for p in mine]
        self.phases = [(p.first_window, int(p.per_cycle[queue]), len(p.taken) - 1, p.taken[:, queue].tolist(), p.begin[:, queue].tolist()) for p in mine]

    def pieces(self, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, length, sequence_id, offset)`` of a document of ``n`` tokens at ``at``."""
        k = bisect_right(self.starts, at) - 1
        done = 0
        while done < n:
            first, per, windows, taken, begin = self.phases[k]
            stop = self.starts[k + 1] - at if k + 1 < len(self.starts) else n
            stop = min(n, stop)
            turn, rest = divmod(at + done - self.starts[k], per)
            r = bisect_right(taken, rest) - 1
            while done < stop:
                length = min(stop - done, taken[r + 1] - rest)
                if length:
                    yield done, length, first + turn * windows + r, begin[r] + rest - taken[r]
                done += length
                rest += length
                r += 1
                if r == windows:
                    r, rest, turn = 0, 0, turn + 1
            k += 1


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, path: str | None = None, source: str = "source", weights: dict[str, float] | None = None, window: int = WINDOW, temperature: float | None = None) -> DataFrame:
    """One row per piece of a document in a sequence. ``weights`` are the target proportions; without
    them ``temperature`` says to which power the corpus's own are taken, and without either they are the
    corpus's own."""
    tokens = cut(tokenise(docs, path or tokenizer_path(), source=source))
    sums = tokens.groupBy("source", "chunk").agg(F.sum("n").alias("n"))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    if weights is None and temperature is not None:
        weights = {s: totals[s] ** temperature for s in names}
    phases = schedule([totals[s] for s in names], None if weights is None else [float(weights.get(s, 0.0)) for s in names], window)
    queues = {s: Queue(phases, i) for i, s in enumerate(names)}
    total = sum(totals.values())
    last, rest = divmod(total, window)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = tokens.join(base, ["source", "chunk"]).select("doc_id", "source", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            where, found = [], []
            columns = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True)
            for i, (name, at, n, ids) in enumerate(columns):
                wide = np.frombuffer(unpack.decompress(ids.as_py()), dtype="<u2").astype("<u4").tobytes()
                for start, length, seq, offset in queues[name].pieces(at, n):
                    where.append(i)
                    found.append((start, length, crc32(memoryview(wide)[4 * start : 4 * (start + length)]), n, seq, offset, window if seq < last else 1 << (rest - 1).bit_length()))
            made = list(zip(*found, strict=True)) if found else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), *[pa.array(c, pa.int64()) for c in made]], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    return pack(docs, temperature=TEMPERATURE)
