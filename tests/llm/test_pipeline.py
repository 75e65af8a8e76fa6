"""The pipeline on planted cases, against brute force for each stage's rule."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from gainset.llm.bpe_fst import parse_ranks


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    words = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "ing", "er", "ly"]) for _ in range(600)]

    def prose(n):
        out = [rng.choice(words) for _ in range(n)]
        return " ".join(w.capitalize() + "" if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(out))

    clean = [(i, prose(60)) for i in range(100)]
    item = prose(25)
    junk = [(200 + i, " ".join(rng.choice(words) + "###" for _ in range(50))) for i in range(12)]
    near = []
    for i in range(5):
        own = clean[i][1].split()
        own[30] = "changed"
        near.append((300 + i, " ".join(own)))
    exact = [(400 + i, clean[10 + i][1]) for i in range(5)]
    leaked = [(500 + i, f"{prose(30)} {item} {prose(20)}") for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in [*clean, *junk, *near, *exact, *leaked, (600, None), (601, "")] if t is not None] + [(600, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    others = set(range(100)) - set(range(5)) - set(range(10, 15))
    assert kept["quality"] == {i for i, *_ in rows} - {i for i, _ in junk} - {600, 601}
    assert kept["exact"] == kept["quality"] - set(range(10, 15))
    assert len(kept["near"]) == len(kept["exact"]) - 5 and others <= kept["near"] and all((i in kept["near"]) != (300 + i in kept["near"]) for i in range(5))
    assert kept["decontaminate"] == kept["near"] - {500, 501, 502}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    for row in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert row.doc_id in kept["decontaminate"] and np.frombuffer(row.token_ids, "<u4").tolist() == other.encode_ordinary(row.text)


def test_the_last_stage_decodes(spark):
    texts = {1: "hi there, 日本 🎉\n", 2: "", 3: None}
    rows = corpus_pipeline.encode(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows]
    assert len(rows) == 3 and all(r.round_trip for r in rows) and all(bytes(r.token_ids) for r in rows if r.text)
