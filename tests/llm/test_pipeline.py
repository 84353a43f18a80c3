import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as C
from hashwood.llm import op2_byte_bpe, op3_toxicity, op5_pii, queries
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as near

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, tmp_path):
    """Each stage's decisions are made anew, on what the stage before kept, by the plain versions of the other tests."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    scorer = op3_toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = scorer.score([t or "" for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.3]
    rows = [r for r, (_, _, _, kept) in zip(rows, near(rows, 5, 80, 100), strict=True) if kept]
    wanted = [(r.item_id, r.text) for r in items.collect()]
    rows = [r for r in rows if not contaminated(r[1], wanted)[4]]
    before = spark.createDataFrame(rows, "doc_id long, text string")
    replaced = {r.doc_id: r.text for r in op5_pii.pii(before, queries.pii_key(spark)).collect()}
    assert any(replaced[k] != t for k, t in rows) and not any(re.search(r"@mail\d+\.example\.com\b", replaced[k]) and re.search(r"[\w.]+@mail\d+\.example\.com", t)[0] in replaced[k] for k, t in rows if "@" in t)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op2_byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = sorted((k, library.encode_ordinary(replaced[k]), hashlib.sha256(replaced[k].encode()).hexdigest()) for k, _ in rows)
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in C.run(spark, SF).collect())
    assert 50 < len(got) < docs.count() and got == expected


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    rows = [(1, "one two three four five six seven", "en", "a", 3, "x"), (1, "one two three four five six seven", "en", "a", 3, "x"), (1, "quite another text with some words in it", "en", None, 0, "x"), (None, None, None, None, None, None), (2, "", "de", "b", 0, ""), (None, "mail me@some.example.net now", "en", "a", 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for kind in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{kind}.parquet").limit(0 if kind == "labels" else 9).write.parquet(f"{tmp_path}/{kind}.parquet")
    odd = [docs.withColumnRenamed("row", name) for name in ("_hash", "_id", "text_hash", "found", "n_email", "hmac_key")]
    for frame in (docs, docs.limit(0), *odd):
        docs = frame
        now = frame
        for _, stage in C.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.dtypes == docs.dtypes
        assert now.count() == (0 if not docs.head(1) else 5)
        assert C.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
