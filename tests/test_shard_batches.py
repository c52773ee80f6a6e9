from lodeworks import pipelines
from lodeworks.functions.tokenizers import ByteTokenizer


def test_shards_are_made_in_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    docs = spark.createDataFrame([(i, "a", "some text") for i in range(50)], "doc_id long, source string, text string")
    assert pipelines.tokenize(docs, ByteTokenizer(), str(tmp_path / "out"), 100)["documents"] == 50
    assert int(spark.conf.get(key)) <= 1000
