import random
from hashlib import sha256

import numpy as np
import pytest

from setlist.llm import substring as S


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all windows."""
    far = 1 << 63
    key = lambda d: far if d is None else d
    low = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            low[w] = min(low.get(w, far), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def kept_bytes(rows):
    """What is left of each text."""
    far = 1 << 63
    low = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            low[b[i : i + 50]] = min(low.get(b[i : i + 50], far), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def test_runs_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [b"a" * 400, bytes(rng.choices(b"ab", k=900)), bytes(rng.choices(range(256), k=777)), b"x" * 49, b"x" * 50, b""]
    for piece in (1 << 15, 64):
        monkeypatch.setattr(S, "PIECE", piece)
        data, owner, pos, lo, hi = S.runs(texts)
        assert data[:-64] == b"".join(texts)
        hashes = S.gram_hashes(S.words_at(data), 0, len(data) - 40) >> np.uint64(16)
        run, base = 0, 0
        for k, t in enumerate(texts):
            for s in range(base, base + len(t) - 49):
                run += s > hi[run]
                assert owner[run] == k and lo[run] <= s <= hi[run] and pos[run] == s + int(np.argmin(hashes[s : s + 27]))
            base += len(t)
        assert run == len(lo) - 1


def test_table(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize(("per_core", "chunk"), [(4, 1 << 16), (1, 1 << 16), (1, 1), (4, 1)])
def test_hard_texts(spark, monkeypatch, per_core, chunk):
    monkeypatch.setattr(S, "PER_CORE", per_core)
    monkeypatch.setattr(S, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if chunk == 1 else "10000")
    rng = random.Random(7)
    syllables = ["the ", "of ", "an", "er", "tion ", "é", "ß"]
    say = lambda n: "".join(rng.choices(syllables, k=n))
    passage, long = say(60), say(400)
    rows = [(i, say(rng.randint(0, 30)) + passage[rng.randint(0, 40) :] + say(rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, long[: rng.randint(40, 400)] + say(3) + long[rng.randint(0, 300) :]) for i in range(25)]
    rows += [(200, "a" * 300), (201, "a" * 60), (202, "b" + "a" * 49), (203, "ab" * 100), (204, "ab" * 30), (205, None), (206, ""), (None, long), (None, long), (7, long), (7, long), (207, say(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as batch", "1 as __x")
    check(docs)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_stage(spark):
    p = "une phrase répétée qui dépasse largement cinquante octets, é."
    docs = spark.createDataFrame([(1, p, "en", "s", 1), (2, "début " + p + " fin", "fr", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert S.report(docs.limit(0)).count() == 0
    out = S.dedup(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, p, 1), (2, "début  fin", 10)]
