"""The whole pipeline against the same steps in plain Python."""

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import ITEMS, prose


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 130)
    texts = [prose(rng, rng.randrange(60, 260)) for _ in range(30)]
    texts += [prose(rng, 70) + " " + passage + " " + prose(rng, 60) for _ in range(3)]
    texts += [texts[0], texts[1].replace("w1 ", "w2 ", 1), texts[2] + " and one more"]
    texts += [None, "", "too short", prose(rng, 60) + " ### $$$ %%% &&&" * 40, "LOUD " + " ".join(f"X{i}A" for i in range(90))]
    texts += [prose(rng, 80) + " " + ITEMS[1][1].upper() + " " + prose(rng, 80)]
    texts += [prose(rng, 80) + " " + ITEMS[1][1] + " " + prose(rng, 80)]  # the one above is too loud
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [r for r, q in zip(rows, brute.quality([(r[2], r[3], r[1]) for r in rows], 200)) if q[2]]
    ids = brute.component_ids([r[:2] for r in good], 5, 80)
    single = [r for r, c in zip(good, ids) if r[0] == c]
    cut = brute.repeated_bytes([r[1] for r in single], 400)
    left = [(r[0], r[2], r[3], kept.decode("utf-8", "ignore")) for r, (kept, *_) in zip(single, cut)]
    clean = [r for r in left if not brute.contaminated(r[3], ITEMS)[1]]
    assert len(rows) > len(good) > len(single) > len(clean) > 25
    assert any(gone for _, gone, _ in cut)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted((i, lang, source, library.encode(t)) for i, lang, source, t in clean)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["lang"], r["source"], r["ids"]) for r in found) == expected
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a few words", "en", "s", 11)], schema)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
