import time
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from setlist.llm import fingerprint as fp
from setlist.llm import media


def test_sequence():
    html = '<h1>A &amp; b</h1><p>one <b>two</b><img src="x.png" alt="an x">three</p><figure><img data-digest="AB" src=y><img src="sha256:cd"><figcaption>Cap</figcaption></figure><figure><figcaption>First</figcaption><video src=v></video></figure><script>no</script><!-- c --><img>end'
    assert media.parse_sequence(html) == [
        (0, "text", "A & b", None, None, None), (1, "text", "one two", None, None, None), (2, "media", None, "x.png", None, "an x"), (3, "text", "three", None, None, None),
        (4, "media", None, "y", "ab", "Cap"), (5, "media", None, "sha256:cd", "cd", "Cap"), (6, "media", None, "v", None, "First"), (7, "text", "end", None, None, None),
    ]
    assert media.parse_sequence(None) == media.parse_sequence("") == []


def test_resolve_keeps_order_and_missing(spark):
    payload = b"z" * 192
    sha = sha256(payload).hexdigest()
    pages = spark.createDataFrame([(1, f'a<img src="sha256:{sha}">b<img src=none>', "k"), (1, f'a<img src="sha256:{sha}">b<img src=none>', "k"), (2, None, None)], "page_id long, html string, text string")
    store = media.media_store(spark.createDataFrame([(bytearray(payload),), (bytearray(payload),), (None,)], "payload binary"), keep_media=True)
    rows = media.resolve(media.interleave(pages), store, ["page_id", "position"]).collect()
    assert len(rows) == 8
    for r in rows:
        if r.digest:
            assert media.read_back(bytes(r.media)).tobytes() == payload and r.position == 1
        else:
            assert r.media is None


def plain_feature(payload):
    n, mean = len(payload), sum(payload) / len(payload)
    std = max(sum(b * b for b in payload) / n - mean * mean, 0.0) ** 0.5
    bins = ",".join(f"{sum(b // 32 == k for b in payload) / n:.4f}" for k in range(8))
    return f"rows={n // 192};mean={mean:.4f};std={std:.4f};min={min(payload)};max={max(payload)};bins={bins}"


def test_media_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 192), (-4, "é" * 96 + " "), (-5, "é"), (-6, "é "), (-5, "é"), (None, "q")], docs.schema)).withColumn("digest", docs.text)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = media.report(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r.doc_id].encode()
        pay = raw + b" " * (192 if not raw else -len(raw) % 192)
        form = media.store_form(pay)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), sha256(pay).hexdigest(), crc32(pay[-16:]))
        assert r.feature == plain_feature(pay) and r.position == 1
        assert (r.media_bytes, r.media_sha256) == (len(form), sha256(form).hexdigest()) and r.caption == f"text of document {'null' if r.doc_id is None else r.doc_id}"
    assert media.report(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    """Order MinHash written down directly."""
    p = fp.points_of(text)
    h = fp.kmer_hashes(p)
    seen, x = {}, []
    for v in h.tolist():
        n = seen[v] = seen.get(v, -1) + 1
        x.append((v + n * 0xD6E8FEB86659FD93) % (1 << 64))
    x = (fp._mix(np.array(x, np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(fp._MUL[:, 0], fp._ADD[:, 0], strict=True):
        v = x * a + b
        v ^= v >> np.uint32(15)
        out.append(sorted(sorted(range(len(x)), key=lambda i: (v[i], i))[: fp.TUPLE]))
    return fp.tuples(h, np.array(out, np.int64).reshape(fp.SIZE, -1))


def test_fingerprint_matches_plain():
    texts = ["", "a", "abcdefg", "abcdefgh", "ab" * 40, "the cat sat on the mat " * 20, "x" * 5000, "é𝄞 " * 30, "".join(chr(97 + i * i % 23) for i in range(6000))]
    for t in texts:
        f = fp.fingerprint(t)
        assert (f == plain_fingerprint(t)).all()
        for u in texts:
            n = len(t)
            e = t[: n - n // 3] + u[: n // 3]
            a, b = fp.fingerprint_pair(fp.points_of(t), fp.points_of(e), n - n // 3)
            assert (a == f).all() and (b == fp.fingerprint(e)).all()


def test_order_counts():
    words = [f"word{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[30:] + words[:30]), " ".join(words[:59] + ["other"])
    f = fp.fingerprint(a)
    assert fp.likeness(f, fp.fingerprint(c)) > fp.likeness(f, fp.fingerprint(b)) > 0


def test_fingerprint_report(spark, sf, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**12, None), (7, "same id"), (-9, "z"), (None, "null id"), (None, None), *[(None, f"null id {i}") for i in range(300)]], docs.schema)).withColumn("bucket", docs.text)
    hashed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.h if r.doc_id is None else r.doc_id, r.text or ""), reverse=True)
    want = []
    for r, s in zip(order, order[1:] + order[:1], strict=True):
        t, u = r.text or "", s.text or ""
        n = len(t)
        e = t[: n - n // 3] + u[: n // 3]
        f, g, h = map(fp.fingerprint, (t, e, u))
        want.append((r.doc_id, n, sha256(e.encode()).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), fp.likeness(f, g), fp.likeness(f, h)))
    got = [tuple(r) for r in fp.report(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fp.report(docs.limit(0)).count() == 0
    one = fp.report(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_malformed_pages_take_linear_time():
    for unit in ("<a", "<img src=", "<!--", "<script", "<", "<a <b ", "< a=", "a=", "<figure"):
        for tail in ("", ">"):
            began = time.perf_counter()
            media.parse_sequence(unit * (1_000_000 // len(unit)) + tail)
            assert time.perf_counter() - began < 10, (unit, tail)
    kinds = lambda h: [(e[1], e[2] or e[3]) for e in media.parse_sequence(h)]
    assert kinds("a > b <!-- c") == [("text", "a > b")] and kinds("x<p>a<!-- <b> c") == [("text", "x"), ("text", "a")]
    assert kinds("<p>a<script>var x = '<p>'") == [("text", "a")] and kinds("a < b <img src=q") == [("text", "a < b <img src=q")]
    assert kinds("<p>a</p><style>p > a</style>b") == [("text", "a"), ("text", "b")]
