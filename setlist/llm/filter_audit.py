"""Filter interaction audit with a counting-Bloom prepass for duplicates.

Five filters are judged on every text, whatever the others say: A few words, B few distinct words, C many
capitals, D special characters, E the text of a document with a smaller id. A document's failures are a set;
counts of documents by set are additive, so every order of the filters is worked out from at most 32 counts a
part, never from the documents again.

E needs equal whole texts to meet. A counting Bloom filter is merged first: each text's hash names
:data:`PROBES` cells, one in each of as many regions, and Spark counts how many documents name a cell (partial counts are
added, so a hot text costs one row a task). A text with a cell that no other document names is certainly unique and
goes no further. The rest, the possible repeats, are shuffled by their whole text, which settles the smallest id of
each; only a pair of id and hash comes back. The merged sketch keeps one bit a cell (two or more documents).
It has 8 to 16 cells a document and at most :data:`MAX_CELLS`, which bounds what is broadcast at 32 MB: up to 33
million documents under one unique text in forty is shuffled needlessly. Larger tables keep that size unless
the caller raises it; more unique texts are then shuffled, and results stay the same.

Null texts are empty, and empty texts repeat each other; a null lang is the part ``''``; a null id has no smaller id
and is none, so it never fails E; rows that repeat an id and a text are counted each and do not fail E for each other; labels of one
document in several rows count once; texts of any length are judged whole; extra columns are not read; an empty table
has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

FILTERS = "ABCDE"
PROBES = 4
CELLS_PER_DOCUMENT = 8
MIN_CELLS, MAX_CELLS = 2**15, 2**28
#: Bits of one row of Spark's bitmap functions.
BUCKET = 32_768
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails; A is bit 0."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    failed = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PCT * n, 100 * capitals > MAX_CAPITALS_PCT * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]"))]
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return sum(bits[1:], bits[0])


def cell_count(rows: int, most: int = MAX_CELLS) -> int:
    """A power of two, so that the regions are equal."""
    return max(MIN_CELLS, min(most, 1 << (CELLS_PER_DOCUMENT * max(rows, 1) - 1).bit_length()))


def cells(key: Column, n_cells: int) -> Column:
    """The cells that a text's hash names: one in each region of the filter."""
    region = n_cells // PROBES
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(region)) + i * region for i in range(PROBES)])


def merged_sketch(keys: DataFrame, n_cells: int) -> np.ndarray:
    """The cells that two documents or more name, as bits: partial counts of all tasks are added."""
    counted = keys.select(F.explode(cells(F.col("key"), n_cells)).alias("cell")).groupBy("cell").count()
    shared = counted.where("count > 1")
    at = F.col("cell") + 1  # the functions count from 1
    rows = shared.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(n_cells // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():  # at most MAX_CELLS / BUCKET rows of 4 kB
        at = (r["bucket"] - 1) * BUCKET // 8
        out[at : at + BUCKET // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def possible_repeat(sketch, n_cells: int):
    """Whether all of a text's cells are shared; ``sketch`` is a broadcast variable."""

    @F.pandas_udf("boolean")
    def shared(named: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = sketch.value
        for s in named:
            at = np.stack(s.to_numpy()) if len(s) else np.zeros((0, PROBES), dtype=np.int64)
            yield pd.Series(((bits[at >> 3] >> (at & 7)) & 1).all(axis=1))

    return lambda key: shared(cells(key, n_cells))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", most_cells: int = MAX_CELLS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail."""
    texts = docs.select("doc_id", whole_text().alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    flags = written(texts.select("doc_id", "part", F.xxhash64("text").alias("key"), failures(F.col("text")).alias("mask")))
    n_cells = cell_count(flags.count(), most_cells)
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(flags, n_cells))
    repeat = possible_repeat(sketch, n_cells)
    # whole texts are shuffled from here on, those of possible repeats only
    repeats = texts.select("doc_id", "text").where(repeat(F.xxhash64("text")))
    first = repeats.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    first = first.select("doc_id", F.xxhash64("text").alias("key"), F.lit(True).alias("first")).distinct()
    label = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    judged = flags.withColumn("again", repeat(F.col("key"))).join(first, ["doc_id", "key"], "left").join(label, "doc_id", "left")
    fails_e = F.col("again") & F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(fails_e, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return judged.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """All orders of the filters, worked out from :func:`mask_counts`."""
    steps = []
    for order in permutations(FILTERS):
        earlier = 0
        for i, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            steps.append(("".join(order), i + 1, own, earlier))
            earlier |= own
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("earlier")) for o, s, own, before in steps])).alias("s")
    rows = counts.select("*", each).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    stepped = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    shapley = stepped.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return stepped.join(shapley, ["part", "own"]).drop("own")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    return audit(mask_counts(docs, labels))
