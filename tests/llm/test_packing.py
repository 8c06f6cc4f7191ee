import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from setlist.llm import packing as P


@pytest.mark.parametrize("seed", range(12))
def test_schedule_places_every_token_once(seed):
    rng = random.Random(seed)
    totals = [rng.choice([1, 3, 50, 700, 9000, 60000]) for _ in range(rng.randint(1, 9))]
    weights = None if seed % 2 else [rng.random() * (i != 1) for i in range(len(totals))]
    phases = P.schedule(totals, weights, window=64, cycle=8)
    seen, share = set(), defaultdict(lambda: [0] * len(totals))
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            size = min(n - at, rng.randint(1, 300))
            want = 0
            for start, length, seq, offset in P.Queue(phases, q).pieces(at, size):
                assert start == want and length > 0 and offset + length <= 64
                want += length
                for i in range(length):
                    assert (seq, offset + i) not in seen
                    seen.add((seq, offset + i))
                share[seq][q] += length
            assert want == size
            at += size
    total = sum(totals)
    assert len(seen) == total and seen == {divmod(i, 64) for i in range(total)}
    if weights is None and min(totals) >= 700:
        whole = [s for w, s in share.items() if w < total // 64 * 0.8]
        for s in whole:
            assert all(abs(x / 64 - t / total) < 0.05 for x, t in zip(s, totals, strict=True))


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [0.1, 0.1, 0.8], [1 / 3, 1 / 3, 1 / 3], [0.05, 0.9, 0.05]])
def test_windows_keep_target_proportions(weights):
    totals, window = [90_000, 20_000, 41_000], 512
    phases = P.schedule(totals, weights, window=window, cycle=8)
    share = defaultdict(lambda: [0] * 3)
    for q, n in enumerate(totals):
        for _, length, seq, _ in P.Queue(phases, q).pieces(0, n):
            share[seq][q] += length
    dry = int(min(n / (w * window) for n, w in zip(totals, weights, strict=True)))
    done = [0.0] * 3
    for s in range(dry - 8):
        done = [d + x for d, x in zip(done, share[s], strict=True)]
        # deficits are carried: no window is off by two tokens, and a run of windows from the first on
        # by no more than that and one for each cycle, which is evened out where the phase ends
        assert all(abs(x - w * window) < 2 for x, w in zip(share[s], weights, strict=True))
        assert all(abs(d - w * window * (s + 1)) < 2 + (s + 1) / 8 for d, w in zip(done, weights, strict=True))


def test_word_cache_is_exact(spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n", "İstanbul ΟΔΟΣ ςΣ, é ́x don't I'LL <|endoftext|> a<|startoftext|>b a\tb c d\x1ce 12.5, ½ ǅ ﬁ", "日本語 テスト, 👍🏽", "A.B, ,. word., W0rd_x", "aªb ºC µM ÿŸ ß ÀÉ, " + "z" * 24 + " " + "é" * 24 + " " + "q" * 25, "".join(chr(i) + " x" + chr(i) + ". " for i in range(32, 0x2FF))]
    cache = P.WordCache(P.tokenizer_path())
    monkeypatch.setattr(P, "CACHE", 300)
    monkeypatch.setattr(P, "SLICE", 5000)
    tight = P.WordCache(P.tokenizer_path())
    for array in (pa.array(texts), pa.array(["x y", *texts, "z"]).slice(1, len(texts))):
        for c in (cache, tight):
            for x, ids in zip(texts, c.encode_all(array), strict=True):
                assert np.frombuffer(ids, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert list(cache.encode_all(pa.array([], pa.string()))) == []


def test_pack_report(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(9001, None, None), (9002, "", "src1"), (9002, "", "src1"), (None, "x y", None)], docs.schema)).withColumn("ids", docs.text)
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in P.report(docs).collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    total = 0
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        rows = sorted(pieces[d.doc_id], key=lambda r: r.start)
        if d.doc_id == 9002:
            assert len(rows) == 2 and all(r.doc_tokens == r.length == 1 for r in rows)
            continue
        at = 0
        for r in rows:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(seqs) == list(range(-(-total // 4096)))
    for s, rows in seqs.items():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at == 4096 if s < total // 4096 else at <= rows[0].sequence_length < 2 * at
    assert P.report(docs.limit(0)).count() == 0
