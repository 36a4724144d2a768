"""The pipeline on the smallest tables against brute force, stage by stage on one another's results."""

import re
from hashlib import sha256

import numpy as np
from public_tokenizers import path as tokenizer
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from tests.llm.test_duplicates import groups_of, plain_fingerprint, plain_lines
from tests.llm.test_learned import plain_alignment

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if re.search(r"[^\W\d_]{2}", t)}
    gone, _ = plain_lines(sorted(rows.items()))
    rows = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items()}
    fps = {i: plain_fingerprint(t, 5) for i, t in rows.items()}
    groups = groups_of(rows, [(a, b) for a in rows for b in rows if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[n : n + 3]) for n in range(len(w) - 2)}

    def dirty(text):
        words = re.findall(r"\w+", text.lower())
        own = grams(words)
        return any(len(own & grams(item)) >= 3 and plain_alignment(item, words) >= len(item) for item in items)

    rows = {i: t for i, t in rows.items() if not dirty(t)}
    library = SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = {}
    for i, t in rows.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[i] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids))
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded) for r in found} == want and len(found) == len(want)
    assert 0 < len(found) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumnRenamed("lang", "lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS


def test_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (5, None, "en", None, 0)], schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= 3
