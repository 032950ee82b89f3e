"""Row-local preprocessing gives the same rows on a stream as in batch."""

from conftest import SF_SMALL

from clickwright.plans.catalog import log
from clickwright.session import scratch_path
from clickwright.streaming import read_log_stream, row_local_preprocess


def test_stream_matches_batch(spark):
    batch = log(spark, SF_SMALL)
    folder = scratch_path(spark, "stream-in")
    batch.write.parquet(folder)
    stream = row_local_preprocess(read_log_stream(spark, folder, batch.schema))
    q = stream.writeStream.format("memory").queryName("cw_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("cw_stream_test")
    expected = row_local_preprocess(batch)
    assert got.count() == expected.count()
    assert got.exceptAll(expected.select(*got.columns)).count() == 0
