"""Near-duplicate documents by chosen-path similarity join.

A document is its set of word shingles. Equal sets form one class, and classes are compared:

* Each class gets a signature of ``COORDINATES`` minwise tokens.
* In each of ``TREES`` independent trees the root selects ``BRANCH`` coordinates, no coordinate in two
  trees, and a class goes to one child per selected coordinate, named by its token there. Two classes
  with similarity ``s`` share at least one first-level node with probability
  ``1 - (1 - s) ** (TREES * BRANCH)``.
* In each node all classes are first held against one pivot, the class with the smallest id.
  Components of the links found so far settle most nodes: a node whose classes are all in one
  component needs no further pair.
* In a node with several components, the classes outside its largest one have to be compared with all
  others. A small node does that on full sets, in blocks: a task counts common shingles of a block by
  one matrix product and keeps one link for each class and component, so what it emits does not
  grow with the pairs it looks at.
* A larger node branches on further coordinates, none twice on a path. Where classes have little in
  common (a passage that many documents share), ``BRANCH`` of them thin the node out. Where they have
  much in common (pages of one template), that many would repeat the same classes over and over; there a
  node takes four thirds on average, the rate at which a pair at the threshold keeps one shared child
  a level while pairs below it lose theirs. Such a node is taken for small while no more than
  ``OUTSIDE_ALIKE`` classes are outside, which keeps its comparisons in proportion to its size.
* What is left after ``LEVELS`` levels is compared in blocks, however much it is.

Signatures only propose pivot pairs (``ESTIMATE`` is 7 standard deviations below the threshold);
every link is confirmed on the full sets. Rows are never dropped, capped or sampled. Tables of edges,
labels and members are cut into the shared checkpoint folder, so that a join on a hot key has plain
exchanges on either side and skewed partitions are split.

Empty or null texts and texts without a word have no shingles and are linked to nothing; a text
of any length is one set. A row's id may be null or occur more than once; the component's id is its
smallest id that is not null, or null if there is none; then the row with the smallest hash is kept
for it. Rows that repeat an id and a text are one document: all of them are ``kept`` in the report, and
:func:`keep_one` leaves one. Extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_lookup, trim, whole_text

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
COORDINATES = 64
TREES = 4
BRANCH = 3
LEVELS = 16
OUTSIDE = 64
OUTSIDE_ALIKE = 4096
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
COLUMNS = 1024
ESTIMATE = 0.375
CACHE = 400_000

_M1, _M2, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x5851F42D4C957F2D)
_rng = np.random.default_rng(75)
_MUL = (_rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)[:, None]
#: The coordinate of each child of a root, and those that its descendants select, in order.
_ROOTS = _rng.permutation(COORDINATES)[: TREES * BRANCH]
_PATHS = np.stack([_rng.permutation(np.delete(np.arange(COORDINATES), c)) for c in _ROOTS])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    # on bytes, lower() changes A-Z alone and split() parts at blanks and bytes 9 to 13
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * _B + w[i : i + n]
    h = np.sort(_mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def packed(h: np.ndarray) -> bytes:
    """A set's hashes, 48 bits of each: what is sent to compare two sets."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view("<u8").reshape(-1)


def signature(h: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set of hashes."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        v = x[None, lo : lo + 2048] * _MUL + _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The threshold on full sets, in whole numbers."""
    if len(a) * DENOMINATOR < NUMERATOR * len(b) or len(b) * DENOMINATOR < NUMERATOR * len(a):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), whole_text(text)))


def _describe(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n, class, sig`` of every document."""
    rows = docs.select("doc_id", row_key().alias("row"), whole_text().alias("text"))
    schema = rows.select("doc_id", "row", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("class"), F.lit(None).cast("binary").alias("sig")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                n.append(len(h))
                key.append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=[f.name for f in schema])
        _words().clear()
        trim()

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- trees


def children(node: np.ndarray, sig: np.ndarray, start: np.ndarray, level: int, branches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the names of their children at ``level``: ``branches`` children for each class in a
    node; ``start`` says below which child of which root the node is."""
    for b in range(BRANCH):
        rows = np.flatnonzero(branches > b)
        at = _PATHS[start[rows], ((level - 2) * BRANCH + b) % (COORDINATES - 1)]
        salt = np.uint64((b + 1) * int(_B) % (1 << 64))
        yield rows, _mix(_mix(node[rows] + salt) ^ sig[rows, at].astype(np.uint64) * _M1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _first_level(classes: DataFrame) -> DataFrame:
    """``node, class, low, size, start``: every class in the first-level nodes of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _signatures(b.column(3))
            for k, c in enumerate(_ROOTS):
                node = _mix(_mix(np.full(len(sig), k + 1, np.uint64)) ^ sig[:, c].astype(np.uint64) * _M1)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *b.columns[:3], pa.array(np.full(len(sig), k, np.int32))], names=["node", "class", "low", "size", "start"])

    return classes.select("class", "low", "size", "sig").mapInArrow(run, "node long, class binary, low long, size long, start int")


def _next_level(members: DataFrame, level: int) -> DataFrame:
    """``node, class, root, size, start, above`` of members of nodes that branch; ``above`` is how
    many classes the parent has."""
    names = ["node", "class", "root", "size", "start", "above"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            start, branches = b.column(4).to_numpy(), b.column(6).to_numpy()
            for rows, node in children(b.column(0).to_numpy().view(np.uint64), _signatures(b.column(7)), start, level, branches):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[c.take(pa.array(rows)) for c in b.columns[1:6]]], names=names)

    rows = members.select("node", "class", "root", "size", "start", F.col("n").alias("above"), "branches", "sig")
    return rows.mapInArrow(run, "node long, class binary, root binary, size long, start int, above long")


# ---------------------------------------------------------------- pairs


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` and the share of coordinates in which their signatures agree."""
    left = classes.select(F.col("class").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("class").alias("b"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_signatures(b.column(2)) == _signatures(b.column(3))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same)], names=["a", "b", "likeness"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, likeness double")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, set``: the shingles of one document of each of ``classes``. Rows that repeat in
    the table may give a class more than once; that repeats pairs, and links are made distinct."""
    texts = docs.select(row_key().alias("row"), whole_text().alias("text")).join(classes.select("class", "row"), "row").select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            found = {c: i for i, c in enumerate(b.column(0).to_pylist()) if c not in seen}
            seen |= found.keys()
            sets = [packed(shingles(b.column(1)[i].as_py())) for i in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(sets, pa.binary())], names=["class", "set"])
        _words().clear()
        trim()

    return cut(texts.mapInArrow(run, "class binary, set binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(unpacked(x.as_buffer()), unpacked(y.as_buffer())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary")


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components within nodes. ``members``: ``node, class, root, n, main, outside,
    weight`` with the size of the node, its largest component, how many classes are not in that
    one and how many shingles the node has. Each class outside is held against each class of the
    node, block by block."""
    parts = lambda c: F.ceil(F.greatest(F.col(c) / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = members.withColumns({"blocks": parts("n"), "chunks": F.least(parts("outside"), F.col("outside").cast("int"))})
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), "chunk": F.pmod(F.xxhash64("class", F.lit(1)), F.col("chunks")).cast("int")})
    every = rows.select("node", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("out"), "class", "root")
    outside = rows.where("root != main").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", F.lit(True).alias("out"), "class", "root")
    dealt = every.union(outside).join(sets, "class").select("node", "block", "chunk", "out", "class", "root", "set")
    dealt = dealt.repartition("node", "block", "chunk").sortWithinPartitions("node", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            found: list[tuple] = []
            for node, block, chunk, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (node, block, chunk) != key:
                    found += _compare(group)
                    key, group = (node, block, chunk), []
                group.append(row)
            yield _links(found)
        yield _links(list(_compare(group)))
        group.clear()
        trim()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _compare(group: list[list]) -> Iterator[tuple[bytes, bytes]]:
    """Of the rows ``out, class, root, set`` of a block: one link per class outside and root."""
    out = [(c, r, unpacked(s)) for o, c, r, s in group if o]
    every = [(c, r, unpacked(s)) for o, c, r, s in group if not o]
    if not out or not every:
        return
    if len(out) * len(every) <= 64:
        ok = np.array([[r != q and linked(s, t) for _, q, t in every] for _, r, s in out])
    else:
        ok = _similar([s for *_, s in out], [s for *_, s in every])
        names = {r: i for i, r in enumerate({r for _, r, _ in every} | {r for _, r, _ in out})}
        ok &= np.array([names[r] for _, r, _ in out])[:, None] != np.array([names[r] for _, r, _ in every])[None, :]
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        seen = set()
        for j in np.flatnonzero(ok[i]).tolist():
            if every[j][1] not in seen:
                seen.add(every[j][1])
                yield min(out[i][0], every[j][0]), max(out[i][0], every[j][0])


def _similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The threshold for all pairs of two lists of sets. Common shingles are counted exactly by
    products of 0/1 matrices, ``COLUMNS`` shingles at a time; counts stay below 2 ** 24."""
    size = np.array([len(s) for s in [*left, *right]])
    owner = np.repeat(np.arange(len(size)), size)
    values, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(size), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1.0
        common += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    union = size[: len(left), None] + size[None, len(left) :] - common
    return DENOMINATOR * common >= NUMERATOR * union


# ---------------------------------------------------------------- components


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around their smallest class."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = up[min(x, y)] = min(x, y)
    names = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([top(x) for x in names], pa.binary())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``class, root``: the smallest class that links lead to, for every class of ``links``.

    Links are first reduced to stars within each partition. Stars spread their smallest labels along
    their links, and labels of labels replace labels, until none changes."""
    stars = cut(links.select("a", "b").mapInArrow(_forest, "a binary, b binary").where("a != b").distinct())
    edges = cut(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("class"), F.least("a", "root").alias("root")))
    while True:
        spread = edges.join(labels.select(F.col("class").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        lower = cut(labels.join(spread.withColumnRenamed("a", "class"), "class").select("class", F.col("root").alias("old"), F.least("root", "low").alias("root")))
        jump = lower.select(F.col("class").alias("root"), F.col("root").alias("top"))
        jumped = cut(lower.join(jump, "root").select("class", "old", F.col("top").alias("root")))
        labels = jumped.select("class", "root")
        if jumped.where("old != root").isEmpty():
            return labels


def _open_nodes(members: DataFrame) -> DataFrame:
    """Nodes with several components: ``node, n, main, outside, weight, above`` (the size of the
    node, its largest component, the classes that are not in it, and all their shingles). ``members``
    must be cut."""
    sizes = members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("w"), F.max("above").alias("above"))
    nodes = sizes.groupBy("node").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top"), F.sum("w").alias("weight"), F.max("above").alias("above"))
    return nodes.where("roots > 1").select("node", "n", F.col("top.root").alias("main"), (F.col("n") - F.col("top.k")).alias("outside"), "weight", "above")


def similar_classes(docs: DataFrame, described: DataFrame) -> DataFrame:
    """``class, root`` for classes that are similar to another one."""
    low = F.coalesce(F.min("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("low")
    classes = cut(described.where("n > 0").groupBy("class").agg(F.min("row").alias("row"), low, F.first("n").alias("size"), F.first("sig").alias("sig")))
    keys = _first_level(classes)
    nodes = cut(keys.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("low", "class")).alias("pivot")).where("n > 1").select("node", "n", F.col("pivot.class").alias("pivot")))
    members = cut(keys.join(nodes, "node").select("node", "class", "size", "start", "pivot", "n"))
    stars = cut(_estimated(members.where("class != pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct(), classes))
    near = stars.where(F.col("likeness") >= ESTIMATE)
    # the pivot's pair is all there is to decide in a node of two
    members = members.where("n > 2")
    wanted = near.select(F.col("a").alias("class")).union(near.select(F.col("b").alias("class"))).union(members.select("class")).distinct()
    sets = _sets(docs, classes.join(wanted, "class", "left_semi"))
    labels = components(_confirmed(near, sets))

    # BRANCH children keep a class in BRANCH * likeness nodes on average: that thins out below one
    alike = members.join(stars.toDF("class", "pivot", "likeness"), ["class", "pivot"]).groupBy("node").agg((F.avg("likeness") * BRANCH >= 1).alias("alike"))
    rooted = cut(members.join(labels, "class", "left").select("node", "class", F.coalesce("root", "class").alias("root"), "size", "start", F.lit(None).cast("long").alias("above")))
    links = []
    for level in range(1, LEVELS + 1):
        nodes = _open_nodes(rooted)
        if level == 1:
            nodes = nodes.join(alike, "node")
        else:
            nodes = nodes.withColumn("alike", F.col("n") * BRANCH >= F.col("above"))
        few = F.when(F.pmod(F.xxhash64("node"), F.lit(3)) == 0, 2).otherwise(1)
        small = F.col("outside") <= F.when(F.col("alike"), OUTSIDE_ALIKE).otherwise(OUTSIDE)
        nodes = cut(nodes.withColumn("branches", F.when(small | F.lit(level == LEVELS), 0).when(F.col("alike"), few).otherwise(BRANCH)).drop("above"))
        if nodes.isEmpty():
            break
        links.append(cut(_block_links(rooted.select("node", "class", "root").join(nodes.where("branches = 0"), "node"), sets)))
        deeper = nodes.where("branches > 0")
        if deeper.isEmpty():
            break
        below = rooted.join(deeper.select("node", "n", "branches"), "node").select("node", "class", "root", "size", "start", "n", "branches")
        rooted = cut(_next_level(below.join(classes.select("class", "sig"), "class"), level + 1))
    if not links:
        return labels
    new = links[0]
    for more in links[1:]:
        new = new.union(more)
    across = new.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(across)
    # a component's old root may itself have a new root
    both = labels.join(merged.toDF("root", "top"), "root", "left").select("class", F.coalesce("top", "root").alias("root"))
    return cut(both.unionByName(merged.join(labels.select("class"), "class", "left_anti")))


def find(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept`` of every document; ``row`` is
    :func:`row_key`."""
    described = cut(_describe(docs))
    labels = similar_classes(docs, described)
    # the smallest id of each class, then of each component, then back to classes and documents
    ids = cut(described.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("low"), F.min("row").alias("head")))
    rooted = cut(ids.join(labels, "class"))
    lows = rooted.groupBy("root").agg(F.struct(F.min("low").alias("id"), F.min("head").alias("head")).alias("component"))
    moved = salted_lookup(rooted, lows, "root", ["class"]).select("class", "component")
    final = cut(ids.join(moved, "class", "left").select("class", F.coalesce("component", F.struct(F.col("low").alias("id"), "head")).alias("component")))
    out = salted_lookup(described.select("doc_id", "row", "n", "class"), final, "class", ["doc_id", "row"])
    component = F.when(F.col("n") > 0, F.col("component.id")).otherwise(F.col("doc_id"))
    nameless = (F.col("n") > 0) & component.isNull()
    kept = F.when(nameless, F.col("row") == F.col("component.head")).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text")).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` with one document of each component, columns unchanged."""
    cols = docs.columns
    gone = find(docs.select("doc_id", "text")).where("not kept").select("row").distinct()
    rest = docs.withColumn("__row", row_key()).join(gone.withColumnRenamed("row", "__row"), "__row", "left_anti")
    return rest.dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in cols])
