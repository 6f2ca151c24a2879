"""The pipeline's stages, each on what the one before kept, against the brute-force versions of the operators' tests."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm.ngram_join import Threshold
from graphloom.llm.packing import binary_pieces
from graphloom.llm.pii import base_spans
from graphloom.llm.quality import score_quality

from .test_ngram_join import brute as brute_classes
from .test_quality import text as written
from .test_repeats import brute as brute_repeats


def corpus():
    rng = random.Random(11)
    passage = written(rng, True) + " " + written(rng, True) + " " + written(rng, True)
    rows = []
    for i in range(260):
        body = written(rng, i % 5 != 0)
        if i % 17 == 0:
            body += " " + passage
        if i % 11 == 0:
            body += f" Write to me{i}@mail.example or +49 30 {1000000 + i}"
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
    for i in range(60):
        words = rows[i][1].split(" ")
        if i % 2 and len(words) > 60:
            words[3] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "s0", len(" ".join(words))))
    return [*rows, (2000, None, None, None, None), (2001, "", "en", "s", 0), (None, rows[1][1], "en", "s", 9), (5, rows[6][1], "en", "s", 9), (6, rows[6][1], "en", "s0", 9)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(260) if i % 4], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "pii", "packing"]
    kept = {}
    key = lambda r: str(tuple(r))
    good = sorted(((r.doc_id, r.text) for r in score_quality(docs, labels, ["text"]).collect() if r.predicted), key=key)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
    assert kept["quality"] == good and 0 < len(good) < len(rows)

    # one row of each class of near duplicates stays, with the least doc_id
    left = kept["near_duplicates"]
    classes = brute_classes(kept["quality"], 5, Threshold())
    groups = {c for k, n, c in classes if n}
    assert len([t for _, t in left if t and t.split()]) == len({(c) for _, n, c in classes if n}) and groups == {k for k, t in left if t and t.split()}
    assert len([1 for _, t in left if not (t and t.split())]) == len([1 for _, n, _ in classes if not n])

    assert kept["repeats"] == sorted(((k, t) for k, _, _, _, t in brute_repeats(left, 50)), key=key) and kept["repeats"] != left
    assert len(kept["pii"]) == len(kept["repeats"]) and all(not base_spans(t or "") for _, t in kept["pii"])
    assert any("[EMAIL]" in (t or "") for _, t in kept["pii"])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, t in kept["pii"]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want += [(k, a, ids[4 * a : 4 * (a + n)]) for a, n in binary_pieces(len(ids) // 4, 2048)]
    packed = docs.collect()
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in packed), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in packed}) == len(packed) and all(r.offset == 0 and r.length == 1 << r.bucket for r in packed)


def test_near_duplicates_when_the_splits_change_between_passes(spark, tmp_path, monkeypatch):
    """The files are split otherwise after the classes are known; the same documents go."""
    rows = [(i, f"{chr(97 + i)} " + " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", "s", 1) for i in range(12)]
    rows += [(100 + i, t, "en", "s", 1) for i, t, *_ in rows[:6]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6).write.parquet(f"{tmp_path}/documents")
    docs, real = spark.read.parquet(f"{tmp_path}/documents"), corpus_pipeline.ngram_join.ngram_classes
    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    was = {k: spark.conf.get(k) for k in (cost, most)}

    def then_otherwise(*args, **kwargs):
        out = real(*args, **kwargs).localCheckpoint()
        spark.conf.set(cost, "1")
        spark.conf.set(most, "700")
        return out

    monkeypatch.setattr(corpus_pipeline.ngram_join, "ngram_classes", then_otherwise)
    try:
        left = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert left == list(range(12))


def test_run_is_the_stages_in_turn(spark, tmp_path):
    rows = corpus()[:40]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    # without labels the classifier rejects nothing, so that one document of each near-duplicate class is left
    left = {c for _, _, c in brute_classes([r[:2] for r in rows], 5, Threshold())}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == left
