"""The pipeline decides each row, also where doc_ids repeat or are null."""

import corpus_pipeline
from pyspark.sql import functions as F

from webloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "mark").collect()), key=repr)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, mark string")


def test_near_copies_by_row(spark):
    words = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(words), " ".join([*words[:99], "changed"]), " ".join(f"v{i}" for i in range(100))
    rows = [
        (None, text, "exact copy without id"), (None, near, "near copy without id"), (5, near, "near copy"), (3, text, "first"), (3, text, "same row again"),
        (None, other + " x", "near copy of unnamed"), (None, other, "unnamed"),
        (8, "alone in the world of many words", "alone"), (8, "quite another text under the same doc id", "same id, other text"), (None, None, "null"), (None, "", "empty"), (9, " ", "blank"),
    ]
    out = corpus_pipeline.deduplicate(spark, frame_of(spark, rows).coalesce(1), SF)
    assert out.columns == ["doc_id", "text", "mark"]
    want = [(3, "first"), (None, "near copy of unnamed"), (8, "alone"), (8, "same id, other text"), (None, "null"), (None, "empty"), (9, "blank")]
    assert rows_of(out) == sorted(want, key=repr)


def test_contaminated_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.size(F.split("text", " ")) > 12).first()["text"]
    rows = [(None, f"before {item} after", "unnamed, contaminated"), (1, item, "contaminated"), (1, "clean text", "clean, same id"), (None, "clean too", "unnamed, clean"), (2, None, "null")]
    out = corpus_pipeline.decontaminate_benchmark(spark, frame_of(spark, rows), SF)
    assert rows_of(out) == sorted([(1, "clean, same id"), (None, "unnamed, clean"), (2, "null")], key=repr)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert rows_of(decontaminate.keep(frame_of(spark, rows), bench, max_bytes=2_000)) == rows_of(out)


def test_odd_rows_in_every_stage(spark):
    """Null, empty, blank, repeated, clashing and very long rows; and no rows at all."""
    long = "word and another one. " * 40_000
    rows = [(1, None, "null"), (1, None, "null"), (None, "", "empty"), (2, " \n", "blank"), (3, "token = abcdefgh12345678", "secret"), (3, "token = abcdefgh12345678", "secret"), (4, long, "long")]
    odd = frame_of(spark, rows).withColumns({c: F.lit("clash") for c in ("component_id", "root", "score", "__row_number2", "a.b")}).withColumn("n_chars", F.lit(0).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns and stage(spark, odd.limit(0), SF).count() == 0, name
    scored = corpus_pipeline.quality(spark, odd, SF)
    assert {r["mark"] for r in scored.select("mark").collect()} <= {"null", "empty", "blank", "secret", "long"}
    assert rows_of(corpus_pipeline.deduplicate(spark, odd, SF)) == sorted([(1, "null"), (1, "null"), (None, "empty"), (2, "blank"), (3, "secret"), (4, "long")], key=repr)
    assert corpus_pipeline.decontaminate_benchmark(spark, odd, SF).count() == len(rows)
    masked = corpus_pipeline.mask_secrets(spark, odd, SF).collect()
    assert sorted((str(r["text"])[:9], r["n_chars"]) for r in masked if r["mark"] in ("secret", "null", "blank")) == [(" \n", 2), ("None", None), ("None", None), ("[assign]", 8), ("[assign]", 8)]
    ids = corpus_pipeline.tokenize(spark, odd, SF).collect()
    assert len(ids) == len(rows) and sum(r["n_tokens"] == 0 for r in ids) == 3
    assert corpus_pipeline.tokenize(spark, odd.limit(0), SF).count() == 0
