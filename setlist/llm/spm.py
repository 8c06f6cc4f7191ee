"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Merges of a word stand on an agenda, best score first, leftmost first among equals. When a
candidate merge comes up, a keyed hash of (seed, document, place, span) may skip it for good; with
probability ``dropout`` it does. Every occurrence of a word draws for itself: the document is its text's hash, the place
is the word's number in it. A rerun, another partitioning or a lost executor gives the same ids, and equal texts get equal ones.

:func:`agenda` is that algorithm for one word. Without a skip, all occurrences of a word take the same merges in the
same order, so these are worked out once a word; for an occurrence only the hashes of these merges are drawn. If none of
them skips, the agenda would have taken just these, and the known ids are its result. If one skips, the
occurrence is segmented by itself: :func:`bpe_rounds.rounds` gives what the agenda gives for many occurrences of a few lengths
at once: each round takes the best candidate that is not skipped in every word. Longer words go to the agenda.

The model's normalizer is the identity, a blank becomes U+2581 and one is put before the text.
Code points that the vocabulary lacks, and U+2581 itself where the text has it, become byte
pieces, so that every text decodes to itself. Nothing is trained. One pass, no shuffle.

Null text is empty and gives no pieces; repeated rows give equal rows; merges of equal score are taken from the left; a text of
any length is encoded whole, in groups of texts of about :data:`GROUP` characters; extra columns do not matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_rounds import _M1, _M2, LONGEST, Places, mix, rounds
from .common import whole_text

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
#: Words whose merges are remembered, and characters that are encoded at once.
CACHE = 500_000
GROUP = 1_000_000
SPACE = "▁"
GONE = 1 << 62
_ALL = (1 << 64) - 1
_PIECE = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mix_int(x: int) -> int:
    x = (x ^ (x >> 31)) * _M1 & _ALL
    x = (x ^ (x >> 29)) * _M2 & _ALL
    return x ^ (x >> 32)


class Bpe:
    """Merge tables of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.count = len(self.pieces)
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(self.count)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.table = -np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.table[ord(p)] = i
        # best score first; pieces of equal score are equally good
        levels = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in self.ids.values()}))}
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    pairs[self.ids[p[:k]] * self.count + self.ids[p[k:]]] = (levels[-sp.get_score(i)], i)
        keys = np.array(sorted(pairs), np.int64)
        self.pairs, self.keys, self.find = pairs, keys, Places(keys).find
        self.rank = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()], np.int64)

    def symbols(self, word: str) -> list[int]:
        """A known code point's id, or minus the code point."""
        return [self.ids.get(c, -ord(c)) for c in word]

    @staticmethod
    def pack(rows: np.ndarray) -> np.ndarray:
        return rows.astype("<u2")

    def final(self, symbols: list[int]) -> bytes:
        """Symbols as 16-bit ids, unknown code points as bytes."""
        out = []
        for s in symbols:
            if s > 0:
                out.append(s)
            else:
                out.extend(self.bytes[b] for b in chr(-s).encode("utf-8", "surrogatepass"))
        return np.array(out, "<u2").tobytes()


def occurrence_key(seed: int, document: int, place: int) -> int:
    return _mix_int((_mix_int((seed * _M1 + document) & _ALL) + (place + 1) * _M2) & _ALL)


def occurrence_keys(seed: int, documents: list[int], counts: list[int]) -> np.ndarray:
    """:func:`occurrence_key` of all words of documents that have ``counts`` words."""
    own = np.array([_mix_int((seed * _M1 + d) & _ALL) for d in documents], np.uint64)
    n = np.array(counts, np.int64)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(own, n) + (place + 1).astype(np.uint64) * np.uint64(_M2))


def skipped(key: int, start: int, mid: int, end: int, dropout: float) -> bool:
    x = _mix_int((key + start * 0x2545F4914F6CDD1D + mid * 0x9E6C63D0876A9A47 + end * 0xD1342543DE82EF95) & _ALL)
    return x >> 11 < int(dropout * (1 << 53))


def agenda(bpe: Bpe, word: str, key: int, dropout: float) -> list[int]:
    """Segment one word by priority queue. A symbol that has gone into its left neighbour is marked :data:`GONE`; zero is the
    unknown code point 0."""
    sym = bpe.symbols(word)
    n = len(sym)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap: list[tuple] = []

    def propose(i: int) -> None:
        j = right[i]
        if j < n and sym[i] > 0 and sym[j] > 0 and (hit := bpe.pairs.get(sym[i] * bpe.count + sym[j])):
            heapq.heappush(heap, (hit[0], i, j, end[j], hit[1]))

    for i in range(n - 1):
        propose(i)
    while heap:
        _, i, j, e, new = heapq.heappop(heap)
        if sym[i] == GONE or sym[j] == GONE or right[i] != j or end[j] != e or end[i] != j:
            continue
        if dropout and skipped(key, i, j, e, dropout):
            continue
        sym[i], sym[j], end[i], right[i] = new, GONE, e, right[j]
        if right[i] < n:
            left[right[i]] = i
            propose(i)
        if left[i] >= 0:
            propose(left[i])
    return [s for s in sym if s != GONE]


def merge_words(bpe: Bpe, words: list[str], keys: np.ndarray, dropout: float, trace: list | None = None) -> list[bytes]:
    """Ids of words of up to ``LONGEST`` code points, each with its own key; all words of a length at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out: list[bytes] = [b""] * len(words)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        points = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        rounds(bpe, bpe.table[points], keys[at], at, dropout, out, trace)
    return out


LITERAL = "\0literal"


class Encoder:
    """Encodes texts by way of what it remembers of words: their ids if no merge is skipped, and these merges."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        self.bpe, self.seed, self.dropout = Bpe(path), seed, dropout
        self.limit = np.uint64(int(dropout * (1 << 53)))
        self._forget()

    def _forget(self) -> None:
        """Start with the mark of a literal U+2581 and the empty word, which have no merges."""
        self.index: dict[str, int] = {LITERAL: 0, "": 1}
        self.plain: list[bytes] = [self.bpe.final([-ord(SPACE)]), b""]
        self.long = np.zeros(2, bool)
        self.starts, self.terms = np.zeros(3, np.int64), np.empty(0, np.uint64)

    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LONGEST]
        trace: list[tuple] = []
        plain = merge_words(self.bpe, short, np.zeros(len(short), np.uint64), 0.0, trace)
        at = np.concatenate([a for a, _ in trace]) if trace else np.empty(0, np.int64)
        terms = np.concatenate([t for _, t in trace]) if trace else np.empty(0, np.uint64)
        long = [w for w in words if len(w) > LONGEST]  # their every occurrence goes to the agenda
        known = len(self.plain)
        self.index.update(zip(short + long, range(known, known + len(words)), strict=True))
        self.plain += plain + [b""] * len(long)
        self.long = np.concatenate([self.long, np.zeros(len(short), bool), np.ones(len(long), bool)])
        n = np.concatenate([np.bincount(at, minlength=len(short)), np.zeros(len(long), np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.terms = np.concatenate([self.terms, terms[np.argsort(at, kind="stable")]])

    def _split(self, text: str) -> list[str]:
        if SPACE in text or "  " in text or text.endswith(" ") or text.startswith(" ") or " \n" in text or "\n " in text:
            parts = []
            for i, x in enumerate(text.split(SPACE)):
                x = (SPACE if i == 0 else "") + x.replace(" ", SPACE)
                parts += [LITERAL] * (i > 0) + _PIECE.findall(x)
            return parts
        return (SPACE + text.replace(" ", f" {SPACE}")).replace("\n", " \n ").split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """16-bit little-endian ids of each text."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP:
                out += self._encode_group(group)
                group, size = [], 0
        return out + (self._encode_group(group) if group else [])

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) if t else [] for t in texts]
        counts = [len(parts) for parts in split]
        words = [w for parts in split for w in parts]
        found = list(map(self.index.get, words))
        tally = Counter([w for w, i in zip(words, found, strict=True) if i is None])
        again = [w for w, n in tally.items() if n > 1]
        if again:
            if len(self.index) + len(again) > CACHE:
                self._forget()
                tally = Counter(words)
                again = [w for w, n in tally.items() if n > 1 and w not in self.index]
            self._learn(again)
            found = list(map(self.index.get, words))
        # a word that is new and comes once is segmented without being remembered
        places = np.array(found, np.float64)  # None is not a number
        once = np.isnan(places)
        which = np.where(once, 1, places).astype(np.int64)
        made = list(map(self.plain.__getitem__, which.tolist()))
        keys = occurrence_keys(self.seed, [crc32(t.encode("utf-8", "surrogatepass")) for t in texts], counts)
        alone = self.long[which]
        alone[once] = [len(words[i]) > LONGEST for i in np.flatnonzero(once).tolist()]
        other = once & ~alone
        if self.dropout:
            n = self.starts[which + 1] - self.starts[which]
            of = np.repeat(np.arange(len(which)), n)
            term = np.arange(len(of)) + np.repeat(self.starts[which] - (np.cumsum(n) - n), n)
            other[of[mix(keys[of] + self.terms[term]) >> np.uint64(11) < self.limit]] = True
        at = np.flatnonzero(other)
        for i, ids in zip(at.tolist(), merge_words(self.bpe, [words[i] for i in at.tolist()], keys[at], self.dropout), strict=True):
            made[i] = ids
        for i in np.flatnonzero(alone).tolist():
            made[i] = self.bpe.final(agenda(self.bpe, words[i], int(keys[i]), self.dropout))
        ends = np.cumsum(counts).tolist()
        return [b"".join(made[end - k : end]) for end, k in zip(ends, counts, strict=True)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bpe.raw.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _encoder(path: str, seed: int, dropout: float) -> Encoder:
    return Encoder(path, seed, dropout)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """``docs`` without the text, plus ``ids`` (16-bit little-endian) and ``decoded``."""
    path = path or model_path()
    keys = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    rows = docs.select(whole_text(text).alias("__text"), *[F.col(f"`{c}`") for c in keys])
    schema = rows.select(*[F.col(f"`{c}`") for c in keys], F.lit(None).cast("binary").alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, seed, dropout)
        for b in batches:
            ids = enc.encode_all(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())], names=[*keys, "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """One row per document: the pieces under dropout and what they decode to."""
    path = model_path()
    rows = docs.select("doc_id", whole_text().alias("text"))
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_pieces", "ids_crc32")], F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), F.lit(True).alias("lossless")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, seed, dropout)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = []
            for t, ids in zip(texts, enc.encode_all(texts), strict=True):
                back = enc.decode(ids)
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                found.append((len(t.encode()), len(ids) // 2, crc32(wide), sha256(wide).hexdigest(), sha256(back.encode()).hexdigest(), back == t))
            made = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
