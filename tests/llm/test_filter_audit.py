"""The audit against a plain loop over documents and orders."""

import re
from collections import Counter
from itertools import permutations

import pytest

from setlist.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, mask string, n long"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bits = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]
    return {c for c, b in zip("ABCD", bits) if b}


def brute(docs, labels):
    docs = [(i, t or "", lang or "") for i, t, lang, *_ in docs]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    judged = [(i, p, fails(t) | ({"E"} if i is not None and first[t] < i else set())) for i, t, p in docs]
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                all_fail = sum(c in f for _, f in mine)
                out[part, "".join(order), step] = (len(left), len(gone), all_fail - len(gone), sum(f == {c} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, c] += len(gone)
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def run(spark, docs, labels, **more):
    df, lab = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    rows = fa.audit(fa.mask_counts(df, lab, **more)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def fixture():
    plain = " ".join(f"word{i}" for i in range(120))
    texts = [None, "", "  ", plain, plain + " Word1", "A b " * 80, plain.replace("word1", "WORD1"), plain + " #", "x" * 50_000, "hé " * 300, "\t\n\x0b\x0c\r a", plain + "\u00a0z", "É" * 20]
    docs = [(i, t, [None, "en", "de"][i % 3], "x", 1) for i, t in enumerate(texts)]
    docs += [(100 + i, plain, "en", "x", 1) for i in range(40)] + [(None, plain, "en", "x", 1), (None, "alone", None, "x", 1), (3, plain, "fr", "x", 1), (3, plain, "fr", "x", 1), (200, "only  here", "es", "x", 1)]
    labels = [(i, i % 2, (i + 1) % 3 // 2, "x") for i in range(0, 140, 2)] + [(3, 1, 1, "x"), (3, 0, 0, "x"), (100, None, None, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x")]
    return docs, labels


@pytest.mark.parametrize("most_cells", [fa.MAX_CELLS, 2**15])
def test_brute_force(spark, most_cells):
    docs, labels = fixture()
    assert run(spark, docs, labels, most_cells=most_cells) == brute(docs, labels)


def test_sketch_clears_unique_texts_only(spark):
    docs = [(i, f"text {i if i % 3 else 0}", "en", "x", 1) for i in range(3000)]
    df = spark.createDataFrame(docs, DOCS)
    keys = df.selectExpr("xxhash64(text) as key", "doc_id")
    n = fa.cell_count(3000)
    sketch = spark.sparkContext.broadcast(fa.merged_sketch(keys, n))
    kept = {r.doc_id for r in keys.where(fa.possible_repeat(sketch, n)(keys["key"])).collect()}
    assert {i for i in range(3000) if i % 3 == 0} <= kept  # no repeat is lost
    assert len(kept) < 1000 + 2000 * 0.06  # and few others stay
    assert fa.cell_count(10) == fa.MIN_CELLS and fa.cell_count(10**12) == fa.MAX_CELLS and fa.cell_count(100_000) == 2**20


def test_full_sketch_still_gives_whole_results(spark):
    docs = [(i, f"text {i if i % 3 else 0}", "en", "x", 1) for i in range(20_000)]
    got = run(spark, docs, [], most_cells=fa.MIN_CELLS)
    assert got["en", "EABCD", 1][:2] == (20_000 - 6666, 6666)


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1, "x")]) == {}
