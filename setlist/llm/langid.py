"""Language identification by rank-order n-gram profiles.

A profile is the ranked list of the :data:`PROFILE` most frequent 1- to 3-grams of a text's
words (letters only, lower case, a blank at either end). A document gets the language whose
profile is nearest by the out-of-place distance: the sum over the document's n-grams of the
rank difference, or :data:`PROFILE` for an n-gram that the language's profile lacks.

Training counts n-grams with Spark over a sample of the labelled rows, chosen by a hash of the
id: about :data:`SAMPLE` rows per label are expected, all of them where there are fewer. The
driver receives at most ``TOP_SALTS * PROFILE`` n-grams per label. Prediction is one pass over
the documents without a shuffle.

Null text, or text without a letter, gets ``und`` and score 0, as does every text where nothing
was learned. A text of any length is profiled whole. Ties go to the label that sorts first, and n-grams
of equal count to the smaller code. A null id counts as an empty one for the
held-out rule; labels that are null are not learned from; repeated rows are predicted alike;
extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
SAMPLE = 2000
TOP_SALTS = 16
PIECE = 1 << 20
UNKNOWN = "und"
#: Of :func:`reject`. Texts in the languages learned score 0.45 and more even if they are a line long;
#: other languages of the same script and random letters stay below 0.35.
MIN_SCORE, MIN_LEAD = 0.35, 0.1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text, ascending, and their counts.

    A code packs up to three code points, 21 bits each; 1 stands for the blank around a word.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.ones(len(points) + 2, dtype=np.int64)
    a[1:-1] = np.where(_letters()[points], points, 1)
    a = a[np.concatenate(([True], (a[1:] != 1) | (a[:-1] != 1)))]
    if len(a) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(a), PIECE):  # a window starts in exactly one piece
        p = a[lo : lo + PIECE + 2]
        own = min(PIECE, len(a) - lo)
        one = p[:own]
        two = (p[:-1] << 21 | p[1:])[:own]
        three = (p[:-2] << 42 | p[1:-1] << 21 | p[2:])[:own]
        three = three[p[1:-1][:own] != 1]
        s = np.sort(np.concatenate((one[one != 1], two, three)))
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else s
        c, n = s[at], np.diff(np.append(at, len(s)))
        if len(codes):
            both, inv = np.unique(np.concatenate((codes, c)), return_inverse=True)
            c, n = both, np.bincount(inv, weights=np.concatenate((counts, n))).astype(np.int64)
        codes, counts = c, n
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profile_of(text: str, size: int = PROFILE) -> np.ndarray:
    return ranked(*ngram_counts(text), size)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """One ranked profile per label. ``sample`` bounds the expected rows per label."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where("label is not null and text is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, min(1_000_000, sample * 1_000_000 // n + 1)).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, counts = ngram_counts(value)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["label", "code", "n"])

    grams = rows.mapInArrow(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("label", F.pmod(F.xxhash64("code"), F.lit(TOP_SALTS))).orderBy(F.desc("n"), "code")
    best = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("label", "code", "n").collect()
    found: dict[str, list] = {name: [] for name in sizes}
    for r in best:
        found[r["label"]].append((-r["n"], r["code"]))
    return {name: np.array([c for _, c in sorted(v)[:size]], dtype=np.int64) for name, v in sorted(found.items()) if v}


class Model:
    """Profiles of all languages side by side, for the distance of one text to each."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.codes)), -1, dtype=np.int64)
        for i, p in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, profile), len(self.codes) - 1)
        known = self.codes[at] == profile
        r = self.ranks[:, at[known]]
        near = np.where(r >= 0, np.abs(r - np.flatnonzero(known)), self.size)
        return near.sum(axis=1) + self.size * int((~known).sum())

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Label, score, and by how much the score leads the next label's."""
        profile = profile_of(text, self.size) if text and self.names else ()
        if not len(profile):
            return UNKNOWN, 0.0, 0.0
        d = self.distances(profile) / (self.size * len(profile))
        best = int(np.argmin(d))
        rest = np.delete(d, best)
        return self.names[best], float(1.0 - d[best]), float(rest.min() - d[best]) if len(rest) else 1.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE, names: tuple[str, str, str] = ("lang_pred", "score", "lead")) -> DataFrame:
    """``docs`` plus the predicted label, its score and its lead, which replace columns of those
    names; one pass, no shuffle."""
    docs = docs.drop(*names)
    columns = docs.columns
    out = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    at = columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(profiles, size)
        for b in batches:
            got = [model.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), *[pa.array([g[i] for g in got], pa.float64()) for i in (1, 2)]], names=[*columns, *names])

    return docs.mapInArrow(label, out)


def report(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = train(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), profiles).drop("text")


def reject(docs: DataFrame, min_score: float = MIN_SCORE, min_lead: float = MIN_LEAD) -> DataFrame:
    """Pipeline stage: keep the documents whose language is one of those learned, with their columns.

    A document goes if its distance is no better than that of a text in another language or of
    letters at random: a score under ``min_score``. A null ``lang`` becomes the predicted label, and so
    does one that differs from it by ``min_lead`` in score or more."""
    cols = docs.columns
    profiles = train(docs.where(~held_out()))
    got = identify(docs, profiles, names=("__pred", "__score", "__lead"))
    kept = got.where((F.col("__pred") != UNKNOWN) & (F.col("__score") >= min_score))
    lang = F.when(F.col("lang").isNull() | (F.col("__lead") >= min_lead), F.col("__pred")).otherwise(F.col("lang"))
    return kept.withColumn("lang", lang.cast(docs.schema["lang"].dataType)).select(*[F.col(f"`{c}`") for c in cols])
