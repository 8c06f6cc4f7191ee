"""Vector code compression: product codes whose codebooks are fitted on anchors-hierarchy metric trees.

A vector's components become integers and are cut into :data:`PARTS` consecutive parts; a part's code is the index
of the nearest of :data:`ENTRIES` codebook entries. Each round of fitting assigns every part of every vector and moves
the entries to the means of what they own, all in integers, so results do not depend on how rows are dealt.

Chunks of vectors hold one tree for each part, built once, written to the shared folder and used by all rounds:

* Anchors (:func:`anchors`): the point farthest from its anchor becomes the next anchor and takes the points that
  are nearer to it. An anchor whose farthest point is nearer than half the way to the new one keeps all its points unseen.
* Middle out (:func:`grow`): some square root of the points become anchors, which are merged upwards pair by pair, always the pair with the
  smallest ball around both, and are split downwards the same way. A ball caches the sum and the number of its points.
* Rounds (:func:`owners`): a ball gets its parent's list of candidate entries. An entry leaves the list if the whole
  ball lies on the nearer side of the plane between it and the ball's best entry. A ball with one candidate left is wholly
  owned: its cached sum counts and no point is looked at. Points of the leaves that stay are compared with the
  candidates of their leaf only.

A round sends (part, entry) sums of each task, added up by Spark; the driver holds the codebooks only, ``PARTS * ENTRIES``
entries. Copies of one vector are a ball of radius zero, whatever their number, and no row is shuffled before the labels' sums.

Rows whose vector is null, or holds a null or non-finite component, are dropped. An integer component beyond
:data:`LARGEST` (16,384 before scaling) counts as that, so that squared distances fit a long. All kept vectors should have one
width: that of the smallest kept id; a row of another width, or all rows if the width is no multiple of ``PARTS``, keep
their place in the result with null code and error. Null ids come last in the order of ids, ties go by the components; repeated rows
count each; with fewer than ``ENTRIES`` kept vectors the codebooks have as many entries as there are; a label's sum that fits
no long is null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import salted_lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one chunk, and so of one tree of each part.
CHUNK = 2048
#: Points that a leaf may have.
LEAF = 48
LARGEST = 2**26
#: Share of the squared distances that rounding may have added to a comparison of balls: candidates that
#: are nearer than this to leaving a list stay on it.
SLACK = 1e-9


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of the components; null for a vector that is dropped."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = float(LARGEST)
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * SCALE))).cast("int")))


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


# ---------------------------------------------------------------- trees


class Tree:
    """Balls of one part of a chunk. ``order`` lists the points so that each ball's are ``lo`` to ``hi``; ``left`` and
    ``right`` are the two halves, or -1 in a leaf; ``depth`` is below the root, which comes last."""

    FIELDS = ("lo", "hi", "left", "right", "depth")

    def __init__(self, order, lo, hi, left, right, depth, sums, centre, radius):
        self.order, self.lo, self.hi, self.left, self.right, self.depth, self.sums, self.centre, self.radius = order, lo, hi, left, right, depth, sums, centre, radius

    def pack(self) -> bytes:
        ints = np.concatenate([self.order, *[getattr(self, f) for f in self.FIELDS]]).astype(np.int32)
        return ints.tobytes() + self.sums.astype(np.int64).tobytes() + self.centre.astype(np.float64).tobytes() + self.radius.astype(np.float64).tobytes()

    @classmethod
    def unpack(cls, data: bytes, n: int, balls: int, width: int) -> Tree:
        ints = np.frombuffer(data, np.int32, n + 5 * balls).astype(np.int64)
        at = 4 * (n + 5 * balls)
        sums = np.frombuffer(data, np.int64, balls * width, at).reshape(balls, width)
        centre = np.frombuffer(data, np.float64, balls * width, at + 8 * balls * width).reshape(balls, width)
        radius = np.frombuffer(data, np.float64, balls, at + 16 * balls * width)
        return cls(ints[:n], *ints[n:].reshape(5, balls), sums, centre, radius)


def anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The points of each of at most ``most`` anchors, as row numbers."""
    lists = [np.arange(len(points))]
    spots = [points[0]]
    far = [squared(points, points[0])]  # squared distances of the points of each list to its anchor
    reach = [far[0].max()]
    while len(lists) < most:
        widest = int(np.argmax(reach))
        if reach[widest] == 0:
            break  # every point is where its anchor is
        spot = points[lists[widest][far[widest].argmax()]]
        between = squared(np.array(spots), spot)
        taken, taken_far = [], []
        for a in np.flatnonzero(4 * np.array(reach) > between):
            new = squared(points[lists[a]], spot)
            nearer = new < far[a]
            if nearer.any():
                taken.append(lists[a][nearer])
                taken_far.append(new[nearer])
                lists[a], far[a] = lists[a][~nearer], far[a][~nearer]
                reach[a] = far[a].max() if len(far[a]) else 0
        lists.append(np.concatenate(taken))
        far.append(np.concatenate(taken_far))
        spots.append(spot)
        reach.append(far[-1].max())
    return lists


def grow(points: np.ndarray) -> Tree:
    """The tree over ``points``, middle out."""
    sums, counts, left, right, own, centre, radius = [], [], [], [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        held = points[rows]
        total = held.sum(axis=0)
        middle = total / len(rows)
        add(total, len(rows), -1, -1, rows, middle, np.sqrt(((held - middle) ** 2).sum(axis=1).max()))
        return len(sums) - 1

    def add(total, n, one, other, rows, middle, reach) -> None:
        for to, x in zip((sums, counts, left, right, own, centre, radius), (total, n, one, other, rows, middle, reach), strict=True):
            to.append(x)

    def merged(balls: list[int]) -> int:
        """One ball over all of ``balls``: again and again the two whose common ball is smallest."""
        live = list(balls)
        spots = np.array([centre[b] for b in live])
        reach = np.array([radius[b] for b in live])

        def around(i: int) -> np.ndarray:
            apart = np.sqrt(((spots - spots[i]) ** 2).sum(axis=1))
            size = np.maximum((apart + reach + reach[i]) / 2, np.maximum(reach, reach[i]))
            size[i] = np.inf
            return size

        cost = np.array([around(i) for i in range(len(live))])
        for _ in range(len(balls) - 1):
            i, j = divmod(int(cost.argmin()), len(live))
            i, j = min(i, j), max(i, j)
            a, b = live[i], live[j]
            total, n = sums[a] + sums[b], counts[a] + counts[b]
            middle = total / n
            size = max(np.sqrt(((centre[x] - middle) ** 2).sum()) + radius[x] for x in (a, b))
            add(total, n, a, b, None, middle, size)
            live[i], spots[i], reach[i] = len(sums) - 1, middle, size
            reach[j] = spots[j] = np.nan
            cost[j, :] = cost[:, j] = np.inf
            fresh = around(i)
            fresh[np.isnan(fresh)] = np.inf
            cost[i, :] = cost[:, i] = fresh
        return live[i] if len(balls) > 1 else live[0]

    def build(rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return leaf(rows)
        lists = anchors(points[rows], max(2, int(np.sqrt(len(rows)))))
        if len(lists) == 1:
            return leaf(rows)  # copies of one point
        return merged([build(rows[held]) for held in lists if len(held)])

    root = build(np.arange(len(points)))
    n = len(sums)
    order, lo, hi, depth = [], np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    at, stack = 0, [root]
    while stack:  # the points of a ball lie together
        b = stack.pop()
        lo[b], hi[b] = at, at + counts[b]
        if left[b] < 0:
            order.append(own[b])
            at += counts[b]
        else:
            depth[left[b]] = depth[right[b]] = depth[b] + 1
            stack += [right[b], left[b]]
    return Tree(np.concatenate(order), lo, hi, np.array(left), np.array(right), depth, np.array(sums), np.array(centre), np.array(radius))


def owners(tree: Tree, points: np.ndarray, entries: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of what each entry owns and, if ``each`` is set, the owner of every point (else -1 for points
    of balls that are wholly owned)."""
    k, width = entries.shape
    sums, counts, of = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.full(len(points), -1)
    spots = entries.astype(float)
    apart = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(axis=2))
    balls = np.flatnonzero(tree.depth == 0)
    lists = np.ones((len(balls), k), bool)
    while len(balls):
        far = ((tree.centre[balls][:, None] - spots[None]) ** 2).sum(axis=2)
        far[~lists] = np.inf
        best = far.argmin(axis=1)
        near = far[np.arange(len(balls)), best][:, None]
        with np.errstate(invalid="ignore"):
            beyond = far - near > 2 * tree.radius[balls][:, None] * apart[best] * (1 + SLACK) + SLACK * (far + near + 1)
        lists &= ~beyond
        lists[np.arange(len(balls)), best] = True
        whole = lists.sum(axis=1) == 1
        np.add.at(sums, best[whole], tree.sums[balls[whole]])
        np.add.at(counts, best[whole], tree.hi[balls[whole]] - tree.lo[balls[whole]])
        if each:
            for b, e in zip(balls[whole], best[whole], strict=True):
                of[tree.order[tree.lo[b] : tree.hi[b]]] = e
        ends = ~whole & (tree.left[balls] < 0)
        if ends.any():
            sizes = tree.hi[balls[ends]] - tree.lo[balls[ends]]
            rows = np.concatenate([tree.order[tree.lo[b] : tree.hi[b]] for b in balls[ends]])
            open_to = np.repeat(lists[ends], sizes, axis=0)
            held = points[rows]
            least, mine = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), int)
            for e in range(k):  # ties stay with the lower index
                at = np.flatnonzero(open_to[:, e])
                d = squared(held[at], entries[e])
                won = d < least[at]
                least[at[won]], mine[at[won]] = d[won], e
            of[rows] = mine
            np.add.at(sums, mine, held)
            counts += np.bincount(mine, minlength=k)
        down = ~whole & (tree.left[balls] >= 0)
        lists = np.repeat(lists[down], 2, axis=0)
        balls = np.column_stack([tree.left[balls[down]], tree.right[balls[down]]]).ravel()
    return sums, counts, of


# ---------------------------------------------------------------- Spark


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width)


def chunks(vectors: DataFrame, width: int) -> DataFrame:
    """Rows ``vec_id, label, ints`` to rows of up to :data:`CHUNK` vectors: their ids and labels, the integers, and
    each part's tree, written to the shared folder."""
    part = width // PARTS
    schema = vectors.schema
    kinds = {c: schema[c].dataType for c in ("vec_id", "label")}
    fields = ", ".join(f"{c}s array<{kinds[c].simpleString()}>" for c in kinds)

    def packed(table: pa.Table):
        table = table.combine_chunks()
        points = _matrix(table["ints"].chunk(0), width)
        trees = [grow(points[:, p * part : (p + 1) * part].astype(np.int64)) for p in range(PARTS)]
        row = {f"{c}s": [table[c].to_pylist()] for c in kinds}
        row |= {"points": [points.tobytes()], "trees": [[t.pack() for t in trees]], "balls": [[len(t.lo) for t in trees]]}
        return pa.RecordBatch.from_pydict(row, schema=to_arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, CHUNK - n)
                batch = batch.slice(len(piece))
                held.append(piece)
                n += len(piece)
                if n == CHUNK:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    to_arrow = pa.schema([(f"{c}s", pa.list_(to_arrow_type(kinds[c]))) for c in kinds] + [("points", pa.binary()), ("trees", pa.list_(pa.binary())), ("balls", pa.list_(pa.int32()))])
    return written(vectors.select("vec_id", "label", "ints").mapInArrow(run, f"{fields}, points binary, trees array<binary>, balls array<int>"))


def _unpacked(row: dict, width: int):
    """Points of a chunk, and (part, its points, its tree) of each part."""
    part = width // PARTS
    points = np.frombuffer(row["points"], np.int32).reshape(-1, width).astype(np.int64)
    return points, [(p, points[:, p * part : (p + 1) * part], Tree.unpack(row["trees"][p], len(points), row["balls"][p], part)) for p in range(PARTS)]


def moved(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part is assigned, every entry goes to the mean of its parts."""
    n_entries, part = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, n_entries, part), np.int64), np.zeros((PARTS, n_entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, points, tree in _unpacked(row, PARTS * part)[1]:
                    s, c, _ = owners(tree, points, books[p], each=False)
                    sums[p] += s
                    counts[p] += c
        if counts.any():
            place = np.indices(counts.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"part": place[0], "entry": place[1], "n": counts.ravel(), "total": list(sums.reshape(-1, part))})

    each = held.select("points", "trees", "balls").mapInArrow(run, "part long, entry long, n long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(part)]
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # PARTS * ENTRIES rows
        if r["n"]:
            out[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(part)]
    return out


def encoded(held: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector, from the last assignment."""
    part = books.shape[2]
    id_type, label_type = (held.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["points", "trees", "balls"]).to_pylist()):
                whole, parts = _unpacked(row, PARTS * part)
                codes, error = np.zeros((len(whole), PARTS), np.uint8), np.zeros(len(whole), np.int64)
                for p, points, tree in parts:
                    of = owners(tree, points, books[p], each=True)[2]
                    codes[:, p] = of
                    d = points - books[p][of]
                    error += np.einsum("ij,ij->i", d, d)
                text = codes.tobytes().hex()
                hexes = [text[2 * PARTS * j : 2 * PARTS * (j + 1)] for j in range(len(whole))]
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own["vec_ids"].flatten(), own["labels"].flatten(), pa.array(hexes), pa.array(error)], ["vec_id", "label", "code", "error"])

    return held.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def first_books(vectors: DataFrame) -> np.ndarray:
    """Each part of the vectors with the smallest ids, as ``(part, entry, place)``."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    return np.array([r["ints"] for r in rows], dtype=np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Rows ``vec_id, label, code, error`` of the kept vectors, and the codebooks (None without any)."""
    kept = table.select("vec_id", "label", integers(F.col(vector)).alias("ints")).where("ints is not null")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).collect()
    width = len(first[0]["ints"]) if first else 0
    uncoded = lambda rows: rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if width == 0 or width % PARTS:
        return uncoded(kept), None
    fits = F.size("ints") == width
    books = first_books(kept.where(fits))
    held = chunks(kept.where(fits), width)
    for _ in range(rounds):
        books = moved(held, books)
    return encoded(held, books).unionByName(uncoded(kept.where(~fits))), books


def report(table: DataFrame) -> DataFrame:
    """One row per kept vector: its code and error, the error of its label, and the digest of the codebooks."""
    rows, books = compress(table)
    rows = written(rows)  # read three times below
    # a null label is one of its own; rows of a label may be a third of all, so they are summed first and meet the sum by salted keys
    keyed = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("__key").agg(F.expr("try_sum(error)").alias("label_error"))
    joined = salted_lookup(keyed, sums, "__key", ["vec_id"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
