import random
import re

import pytest

from setlist.llm import neardup as N


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (n, component) by comparing all pairs."""
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * 100 >= 75 * max(len(s[i]), len(s[j])):
                k = len(s[i] & s[j])
                if 100 * k >= 75 * (len(s[i]) + len(s[j]) - k):
                    up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return [(d, len(s[i]), low.get(top(i))) for i, (d, _) in enumerate(rows)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in N.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_shingles():
    for t in ["", " \t\n", "a B", "A b\x0bc\x0cd\re", "x y z u v w x y z u v", "é É\xa0ß a b c d", "Σ a b c d e"]:
        assert len(N.shingles(t)) == len(sets(t))
    assert (N.shingles("A b c") == N.shingles("a  B\nc")).all() and len(set(N.shingles("a b c d e")) & set(N.shingles("a b c d"))) == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    check(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


@pytest.mark.parametrize("outside,alike,levels", [(64, 4096, 16), (2, 64, 2), (1, 64, 4)])
def test_hard_groups(spark, monkeypatch, outside, alike, levels):
    monkeypatch.setattr(N, "OUTSIDE", outside)
    monkeypatch.setattr(N, "OUTSIDE_ALIKE", alike)
    monkeypatch.setattr(N, "LEVELS", levels)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(5)
    base, passage = words(rng, 80), words(rng, 60)
    rows = []
    for i in range(60):  # near copies whose distances reach around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # a shared passage in otherwise different texts
        rows.append((100 + i, " ".join(passage + words(rng, rng.choice([5, 15, 30, 90])))))
    chain = words(rng, 100)
    for i in range(12):  # a chain: neighbours are similar, the ends are not
        rows.append((200 + i, " ".join(chain[i * 8 : i * 8 + 100] + words(rng, 0) + chain[: 0])))
        chain += words(rng, 8)
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE\ttwo"), (304, "one"), (None, "one"), (305, rows[0][1]), (305, rows[0][1]), (306, " ".join(words(rng, 20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as class", "1 as n")
    check(docs)


def test_no_coordinate_twice():
    assert len(set(N._ROOTS.tolist())) == N.TREES * N.BRANCH
    assert all(len({c, *p.tolist()}) == N.COORDINATES for c, p in zip(N._ROOTS.tolist(), N._PATHS, strict=True))


def test_recall_where_everything_branches(spark, monkeypatch):
    """Pages of one template that are all somewhat alike, some pairs at the threshold and above."""
    monkeypatch.setattr(N, "OUTSIDE", 4)
    monkeypatch.setattr(N, "OUTSIDE_ALIKE", 4)
    monkeypatch.setattr(N, "LEVELS", 4)
    rng = random.Random(3)
    template = words(rng, 90)
    rows = []
    for i in range(120):
        own = words(rng, 60)
        rows.append((2 * i, " ".join(template + own)))
        rows.append((2 * i + 1, " ".join(template + own[: rng.randint(33, 60)] + words(rng, 4))))
    want = {(d, c) for d, _, c in brute(rows) if d != c}
    got = {(r.doc_id, r.component_id) for r in N.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != r.component_id}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_null_ids(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "solo text of some words here"
    rows = [(None, a), (None, a.upper()), (None, a + "!"), (None, b), (7, b), (None, ""), (None, None), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in N.report(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, False)] * 2 + [(None, None, True)] + [(None, 7, False), (7, 7, True), (3, 3, True)] + [(None, None, True)] * 2, key=str)
    assert sorted(((r.doc_id, (r.text or "")[:1].lower()) for r in N.keep_one(docs).collect()), key=str) == [(3, "x"), (7, "s"), (None, ""), (None, "o")]


def test_empty_and_stage(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (3, None, "z")], "doc_id long, text string, row string")
    assert N.report(docs.limit(0)).count() == 0
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
