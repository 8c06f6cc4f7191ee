from collections import defaultdict
from pathlib import Path

import brute
import test_neardup
import test_substring
from pyspark.sql import Row

import corpus_pipeline as C
from setlist.llm import langid, packing, secret_scan


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "en", "src1", 0), (5001, "12 34 %", "en", "src1", 7), (5002, "a small text with password = Zq81kdLw02Xb inside it, so there", "en", "src9", 63)], docs.schema)
    docs = docs.union(extra)
    (tmp_path / "documents.parquet").mkdir()
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    stages, now = [docs], docs
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        stages.append(now)
        if k < 4:
            assert now.columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in stages[:5]]
    # 1: what has no letters goes, the rest is unchanged
    assert set(rows[0]) - set(rows[1]) == {5000, 5001} and all(rows[0][i] == r for i, r in rows[1].items())
    # 2: one of each component
    want = {d for d, _, c in test_neardup.brute([(i, r.text) for i, r in rows[1].items()]) if d == c}
    assert set(rows[2]) == want and all(rows[1][i] == r for i, r in rows[2].items())
    # 3: repeated passages go
    kept = test_substring.kept_bytes([(i, r.text) for i, r in rows[2].items()])
    changed = 0
    for d, r in rows[3].items():
        text = kept[d].decode("utf-8", "ignore")
        changed += text != rows[2][d].text
        assert r == Row(**rows[2][d].asDict() | {"text": text, "n_chars": rows[2][d].n_chars if text == rows[2][d].text else len(text)})
    assert changed and set(rows[3]) == set(rows[2])
    # 4: live secrets are masked, and nothing else changes
    masked = brute.redacted([(r.doc_id, r.text, r.source, r.lang) for r in rows[3].values()])
    assert {i: r.text for i, r in rows[4].items()} == masked
    assert all(r == Row(**rows[3][i].asDict() | {"text": masked[i], "n_chars": rows[3][i].n_chars if masked[i] == rows[3][i].text else len(masked[i])}) for i, r in rows[4].items())
    assert "Zq81kdLw02Xb" not in rows[4][5002].text and sum(masked[i] != r.text for i, r in rows[3].items()) >= 1
    # 5: every id once
    cache = packing.WordCache(packing.tokenizer_path())
    import pyarrow as pa

    ids = cache.encode_all(pa.array([r.text for r in rows[4].values()]))
    lengths = {i: len(x) // 2 + 1 for i, x in zip(rows[4], ids, strict=True)}
    got = defaultdict(int)
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == lengths[r.doc_id]
    assert got == lengths
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.iterdir())
    result = C.run(spark, str(tmp_path))
    assert result.count() == stages[5].count()
    left = [p.name for p in set(folder.iterdir()) - before]
    # the last stage's input, and what the last stage reads
    assert sum(n.startswith("pipeline-") for n in left) == 1 and len(left) <= 6, left


def test_stages_on_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in C.STAGES:
        out = f(spark, docs, "")
        assert out.count() == 0
