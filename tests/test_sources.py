"""Text-log ingestion: header names decide the columns, dirty values become null."""

import os

from clickwright.schema import LOG_SCHEMA
from clickwright.session import scratch_path
from clickwright.sources import files as fs


def test_read_log_matches_columns_by_header_name(spark):
    folder = scratch_path(spark, "raw-log")
    if folder.startswith("file:"):
        folder = folder[len("file:"):]
    if "://" in folder:
        import pytest

        pytest.skip("needs a local checkpoint folder to write the raw file")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "log.txt"), "w") as f:
        f.write("is_trade context_timestamp instance_id item_category_list shop_score_service\n")
        f.write("1 1537236544 7 1;2;3 0.97\n")
        f.write("0 notanumber 8 4;5 -1\n")
    df = fs.read_log(spark, folder)
    rows = {r["instance_id"]: r for r in df.collect()}
    assert dict(df.dtypes)["context_timestamp"] == "bigint"
    assert rows[7]["is_trade"] == 1 and rows[7]["context_timestamp"] == 1537236544
    assert rows[7]["item_category_list"] == "1;2;3" and rows[7]["shop_score_service"] == 0.97
    assert rows[8]["context_timestamp"] is None and rows[8]["shop_score_service"] == -1.0
    assert {f.name for f in LOG_SCHEMA.fields} >= set(df.columns)


def test_headerless_labels_and_positional_concat(spark):
    data = spark.createDataFrame([(i, i * 10) for i in range(5)], "id bigint, v bigint").orderBy("id")
    path = fs.write_labels_headerless(spark.createDataFrame([(i % 2,) for i in range(5)], "is_trade int"), scratch_path(spark, "lab"))
    labels = fs.read_labels_headerless(spark, path)
    assert sorted(r[0] for r in labels.collect()) == [0, 0, 0, 1, 1]
    glued = fs.concat_columns_by_position(data, spark.createDataFrame([(i % 2,) for i in range(5)], "is_trade int"))
    assert [tuple(r) for r in glued.collect()] == [(i, i * 10, i % 2) for i in range(5)]
