import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import mixture, shards
from lodeworks.streaming import ingest


def run(df, at):
    job = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    job.awaitTermination()


def test_streamed_packing_equals_batch_packing_over_restarts(spark, tmp_path):
    rows = [(i, f"s{i % 3}", i * 7 % 23 + 1) for i in range(120)]
    schema = "doc_id long, source string, n_tokens long"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(ingest.packed(ingest.file_stream(spark, str(tmp_path / "in"), schema), 50), tmp_path)
    want = shards.assign_shards(spark.createDataFrame(rows, schema), 50, shards.AFTER, ["source"], "doc_id").collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["doc_id"], r["shard_index"]) for r in got} == {(r["doc_id"], r["shard_index"]) for r in want}
    assert sorted(r["doc_index"] for r in got if r["source"] == "s1") == list(range(40))


def test_streamed_budget(spark, tmp_path):
    schema = "doc_id long, source string, n_tokens long"
    spark.createDataFrame([(i, "s", 10) for i in range(9)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(ingest.packed(ingest.file_stream(spark, str(tmp_path / "in"), schema), 50, budget=31), tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_a_stream_ends_once_all_sources_have_their_budget(spark, tmp_path):
    schema = "doc_id long, source string, n_tokens long"
    rows = [(i, "ab"[i % 2], 10) for i in range(160)]
    for k in range(16):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), schema)
    read = ingest.pack_until_budget(stream, 50, 95, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20))
    assert 20 <= read < 160
    # started again, it ends again: a source says with its next row that it has its budget
    again = ingest.pack_until_budget(stream, 50, 95, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert read + again < 160 and spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_a_stream_without_enough_is_read_to_its_end(spark, tmp_path):
    schema = "doc_id long, source string, n_tokens long"
    for k in range(3):
        spark.createDataFrame([(k, "a", 10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = ingest.pack_until_budget(ingest.file_stream(spark, str(tmp_path / "in"), schema), 50, 95, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert read == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streamed_shards_and_those_that_come_later(spark, tmp_path):
    def put(name, ids):
        (tmp_path / "in" / name[0]).mkdir(parents=True, exist_ok=True)
        np.asarray(ids, np.uint16).tofile(tmp_path / "in" / name[0] / f"{name}.bin")

    def go():
        rows = ingest.shard_stream(spark, str(tmp_path / "in"), range_bytes=8, batch_tokens=2)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["position"], r["tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a_0000", range(9))
    put("b_0000", [65535])
    put("b_0001", [])
    first = [("a_0000.bin", a, list(range(a, min(a + 2, 9)))) for a in (0, 2, 4, 6, 8)] + [("b_0000.bin", 0, [65535])]
    assert go() == first
    put("c_0000", [7, 8])
    assert go() == [*first, ("c_0000.bin", 0, [7, 8])]


def test_a_batch_of_many_shards_is_dealt_to_tasks_and_looked_up_in_few(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(60):
        np.arange(i + 1, dtype=np.uint16).tofile(tmp_path / "in" / f"a_{i:04d}.bin")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000")
    rows = ingest.shard_stream(spark, str(tmp_path / "in")).select("path", "tokens", F.spark_partition_id().alias("task"))
    job = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["tokens"] for r in got) == [list(range(i + 1)) for i in range(60)]
    cores = spark.sparkContext.defaultParallelism
    assert len({r["task"] for r in got}) >= cores
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup(str(job.runId)) for s in told.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * cores < 60


def test_the_mixture_goes_on_where_a_run_ended(spark, tmp_path):
    weights = {"books": 0.15, "news": 0.75, "scripts": 0.10}
    per_pass = spark.createDataFrame([("books", 5), ("news", 17), ("scripts", 1)], "source string, windows long")
    wins = per_pass.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("window_index")).withColumn("tokens", F.array(F.col("window_index").cast("int")))
    for _ in range(3):
        ingest.serve(ingest.mixture_stream(spark, wins, weights, 8, 11, per_pass, 7, first=100), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, mixture.batches(spark, wins, weights, 8, 11, 100, 121, per_pass, "keyed").collect()))
    assert got == want and len(got) == 21 * 8
