import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import sentencepiece

from setlist.llm import bpe_rounds
from setlist.llm import spm as S

ODD = ["", " ", "  a  b ", "a\n\nb\n", " \n x \n", "▁", "a▁b ▁▁ c", "日本 𝄞 é ́ \x00\t", "x" * 300, "a" * 47 + " " + "a" * 48 + " " + "ab" * 40, "<s> </s> <0x41> <unk>", "\x00" * 60 + "z"]


def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ODD


def test_without_dropout_as_the_library(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    enc = S.Encoder(S.model_path(), dropout=0.0)
    many = texts(spark, sf)
    for t, ids in zip(many, enc.encode_all(many), strict=True):
        assert enc.decode(ids) == t
        if "▁" not in t:
            assert np.frombuffer(ids, "<u2").tolist() == sp.encode(t), t


def test_rounds_equal_agenda():
    bpe = S.Bpe(S.model_path())
    rng = random.Random(3)
    words = ["".join(rng.choice("▁etaonhi,é日") for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["▁international", "▁▁▁▁x"]
    for p in (0.0, 0.1, 0.5, 1.0):
        keys = [S.occurrence_key(9, 77, i) for i in range(len(words))]
        for w, k, ids in zip(words, keys, S.merge_words(bpe, words, np.array(keys, np.uint64), p), strict=True):
            assert ids == bpe.final(S.agenda(bpe, w, k, p)), w
    assert S.occurrence_keys(9, [77, 5], [3, 2]).tolist() == [S.occurrence_key(9, d, i) for d, n in ((77, 3), (5, 2)) for i in range(n)]


def test_places():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 30, 50_000))
    places = bpe_rounds.Places(keys)
    assert (places.find(keys) == np.arange(len(keys))).all()
    code = rng.integers(-1, 1 << 30, (3000, 40))
    code[:, ::3] = rng.choice(keys, (3000, 14))
    found = keys[places.find(code)] == code
    assert (found == np.isin(code, keys)).all() and found[:, ::3].all()


def brute(bpe, text, seed, dropout):
    """Every word of the text by the agenda alone."""
    if not text:
        return b""
    enc = S.Encoder.__new__(S.Encoder)
    out = []
    for i, w in enumerate(enc._split(text)):
        key = S.occurrence_key(seed, crc32(text.encode("utf-8", "surrogatepass")), i)
        out.append(bpe.final([-ord(S.SPACE)] if w == S.LITERAL else S.agenda(bpe, w, key, dropout)))
    return b"".join(out)


def test_whole_query_as_the_agenda(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    bpe = S.Bpe(S.model_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.report(docs).collect():
        ids = np.frombuffer(brute(bpe, texts[r.doc_id], S.SEED, S.DROPOUT), "<u2").astype("<u4").tobytes()
        assert (r.n_pieces, r.ids_crc32, r.ids_sha256) == (len(ids) // 4, crc32(ids), sha256(ids).hexdigest()) and r.lossless
    # every occurrence draws for itself
    text = "international " * 3000
    seen, at = set(), 0
    ids = S.Encoder(S.model_path()).encode_all([text])[0]
    for i, w in enumerate(S.Encoder.__new__(S.Encoder)._split(text)):
        n = len(bpe.final(S.agenda(bpe, w, S.occurrence_key(S.SEED, crc32(text.encode()), i), S.DROPOUT)))
        seen.add(ids[at : at + n])
        at += n
    assert at == len(ids) and len(seen) > 15


def test_dropout_varies_and_is_lossless(spark, sf, monkeypatch):
    many = texts(spark, sf)
    runs = [S.Encoder(S.model_path(), seed=s).encode_all(many) for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    monkeypatch.setattr(S, "CACHE", 50)
    enc = S.Encoder(S.model_path(), seed=1)
    assert [enc.encode_all([t])[0] for t in many] == runs[0]
    assert [enc.decode(i) for i in runs[2]] == many
    plain = S.Encoder(S.model_path(), dropout=0.0).encode_all(many)
    assert sum(map(len, runs[0])) > 1.05 * sum(map(len, plain))


def test_spm_report(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, ids string")
    rows = S.report(docs).collect()
    assert len(rows) == 4 and all(r.lossless for r in rows) and len({r.ids_sha256 for r in rows}) == 2
    assert {r.decoded_sha256 for r in rows} == {sha256(b"").hexdigest(), sha256(b"a b").hexdigest()}
    assert S.report(docs.limit(0)).count() == 0 and S.encode(docs).count() == 4
