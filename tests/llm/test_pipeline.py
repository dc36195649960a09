"""The pipeline's stages, each judged on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from brute import near_classes
from test_operators import item_matches, token_rows


def test_stages_take_effect(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"  # sf0.001 has too few labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, at = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = at[name] = spark.read.parquet(path)
        if name != "token_ids":
            assert docs.columns == columns
    pairs = {k: sorted(tuple(r) for r in v.select("doc_id", "text").collect()) for k, v in at.items() if k != "token_ids"}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = {i for i, _ in pairs["quality"]}
    assert sum((i in good) == bool(q) for i, q in known.items()) >= 0.9 * len(known)
    classes = near_classes(pairs["quality"])
    assert [i for i, _ in pairs["near_dedup"]] == sorted(i for i, (n, c) in classes.items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {r[0] for r in item_matches(pairs["near_dedup"], items)}
    assert pairs["decontaminate"] == [p for p in pairs["near_dedup"] if p[0] not in leaks]
    assert set(pairs["mix"]) == set(pairs["decontaminate"])
    got = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[1])
    assert got == token_rows(pairs["mix"])
