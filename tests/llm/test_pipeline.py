import corpus_pipeline
from colloquy.llm.pieces import decode_texts
from compare import SF
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF), "stage")
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.collect()})
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    encoded = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert encoded.where(~F.col("lossless")).count() == 0
    back = decode_texts(encoded).withColumnRenamed("text", "again")
    assert kept.join(back, "doc_id").where("text <> again").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids[-1]


def test_repeated_and_empty_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "a line of words here", "en", "s", 20)] * 2 + [(2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_odd_documents_and_clashing_columns(spark, prose):
    """Null ids, equal ids with other texts, a very long text and extra columns: each stage takes out what it should, and nothing else."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first().text
    texts = [prose(90, 500_000 + n) for n in range(8)]
    near = texts[2].split()
    near[30] = "other"
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, " ".join(near) + " end"), (9, texts[4]), (9, texts[4]), (10, texts[5] + " " + item), (None, texts[6] + " " + item), (11, "\n".join(prose(60, 510_000 + n) for n in range(1200))), (12, None), (13, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    extra = ["__row", "__key", "__id", "__hash", "__first", "__least", "key", "n", "x", "row", "first"]
    docs = docs.selectExpr("*", *(f"concat('{c}', coalesce(cast(doc_id as string), '')) as `{c}`" for c in extra))
    kept = docs
    ends = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF), "stage")
        assert kept.columns == docs.columns
        found = kept.collect()
        assert all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for r in found for c in extra)
        ends.append(sorted(str(r.doc_id) for r in found))
    assert ends[0] == sorted(str(i) for i, _ in rows)  # no document is toxic
    assert ends[1] == ends[0]  # lines go, documents stay
    final = sorted(str(i) for i, _ in rows if i not in (10,))
    final.remove("None")  # of those without an id the one that holds the item
    final.remove("9")  # of repeated rows one stays
    assert [e for e in ends[3] if e not in ("8", "13", "12")] == [e for e in final if e not in ("8", "13", "12")]
    assert spark.createDataFrame(kept.collect(), kept.schema).where("doc_id = 11").first().text.count("\n") >= 1100
