"""Vector codes against plain k-means over integers, and what the trees promise."""

import hashlib
import math

import numpy as np
import pytest

from setlist.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, vec_ids string"


def brute(rows):
    """The contract in plain Python: (vec_id, label, code, error) of the kept rows and the codebooks' digest."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for i, e, lab, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return [], None
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(part(v, p)) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            owned = {}
            for _, v, _ in kept:
                owned.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, qs in owned.items():
                books[p][e] = [sum(c) // len(qs) for c in zip(*qs)]
    out = []
    for i, v, lab in kept:
        best = [near(part(v, p), books[p]) for p in range(8)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    want, sha = brute(rows)
    sums = {}
    for _, lab, _, error in want:
        sums[lab] = sums.get(lab, 0) + error
    key = lambda r: tuple(str(x) for x in r)
    got = vc.report(df).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got], key=key) == sorted([(i, c, e, sums[lab], sha) for i, lab, c, e in want], key=key)
    return got


@pytest.mark.parametrize("seed,width,n", [(1, 16, 300), (2, 8, 90), (3, 32, 150)])
def test_brute_force(spark, seed, width, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, width))
    vectors = (centres[rng.integers(0, 5, n)] + rng.normal(0, 0.05, (n, width))).astype(np.float32)
    rows = [(int(i), [float(x) for x in v], None if i % 7 == 0 else int(i) % 3, "x") for i, v in enumerate(vectors)]
    hot = rows[20]
    rows += [(1000 + i, hot[1], 1, "x") for i in range(120)] + [rows[3], rows[3]]  # one vector for a third of all rows, repeated rows
    check(spark, rows)


def test_dropped_and_odd_rows(spark):
    good = [float(i % 5) / 7 for i in range(16)]
    rows = [(1, None, 1, "x"), (2, [None] + good[1:], 1, "x"), (3, [float("nan")] + good[1:], 1, "x"), (4, good[:-1] + [float("-inf")], None, "x"), (5, good, None, "x"), (None, good[::-1], None, "x"), (7, [-0.0001] * 16, 2, "x")]
    got = check(spark, rows)
    assert len(got) == 3 and {r.vec_id for r in got} == {5, None, 7}
    assert vc.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.report(spark.createDataFrame(rows[:4], SCHEMA)).collect() == []
    odd = {r.vec_id: r for r in vc.report(spark.createDataFrame(rows[4:5] + [(9, good + [1.0], 4, "x")], SCHEMA)).collect()}
    assert odd[9].code is None and odd[9].error is None and odd[9].label_error is None and odd[5].code == "00" * 8
    narrow = vc.report(spark.createDataFrame([(1, [1.0] * 12, 1, "x"), (2, [], 1, "x")], SCHEMA)).collect()
    assert [r.code for r in narrow] == [None, None]
    far = [(i, [3e38 if i == 3 else float(i)] * 8, 1, "x") for i in range(20)]
    assert len(vc.report(spark.createDataFrame(far, SCHEMA)).collect()) == 20


def test_trees():
    rng = np.random.default_rng(5)
    spots = rng.integers(-40, 40, (40, 8)) * 100
    points = np.concatenate([spots[rng.integers(0, 40, 1500)] + rng.integers(-30, 30, (1500, 8)), np.tile(spots[0], (400, 1))]).astype(np.int64)
    tree = vc.Tree.unpack((t := vc.grow(points)).pack(), len(points), len(t.lo), 8)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for b in range(len(tree.lo)):
        held = points[tree.order[tree.lo[b] : tree.hi[b]]]
        assert (held.sum(axis=0) == tree.sums[b]).all()
        assert np.sqrt(((held - tree.centre[b]) ** 2).sum(axis=1)).max() <= tree.radius[b] * (1 + 1e-9) + 1e-6
        if tree.left[b] >= 0:
            assert {tree.lo[tree.left[b]], tree.lo[tree.right[b]]} >= {tree.lo[b]} and tree.hi[b] - tree.lo[b] == sum(tree.hi[c] - tree.lo[c] for c in (tree.left[b], tree.right[b]))
    entries = spots[:16]
    sums, counts, of = vc.owners(tree, points, entries, each=True)
    plain = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (of == plain).all() and (counts == np.bincount(plain, minlength=16)).all()
    assert (sums == np.array([points[plain == e].sum(axis=0) for e in range(16)])).all()
    # most balls are wholly owned: few points are compared with entries at all
    assert (vc.owners(tree, points, entries, each=False)[2] >= 0).mean() < 0.6


def test_ties_go_to_the_lower_entry():
    points = np.array([[0, 0], [2, 0], [1, 0], [1, 5]] * 30, dtype=np.int64)
    tree = vc.grow(points)
    entries = np.array([[2, 0], [0, 0], [2, 0], [0, 0]])
    of = vc.owners(tree, points, entries, each=True)[2]
    assert of.tolist() == [1, 0, 0, 0] * 30
