import os

from lodeworks.plans import jobs


def test_a_stream_takes_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(i, "some text", "ab"[i % 2]) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, own = [], jobs.ingest.file_stream

    def counted(session, folder, schema):
        seen.append(sum(x.endswith(".parquet") for x in os.listdir(folder.removeprefix("file:"))))
        return own(session, folder, schema)

    monkeypatch.setattr(jobs.ingest, "file_stream", counted)
    monkeypatch.setattr(jobs, "STREAM_ROWS", 15, raising=False)
    assert jobs.stream_stop(spark, str(tmp_path)).count() == 100 and seen == [7]
