import datetime

from cloakwork.functions.patterns import Registry
from cloakwork.streaming import inbox as S

SCHEMA = "doc_id long, text string, received_at timestamp"


def test_inbox_to_redacted_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    rows = [(1, "mail a@b.co", at), (1, "mail a@b.co", at), (2, "nothing", at)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.redacted(S.once(S.inbox(spark, str(tmp_path / "in"), SCHEMA)), Registry().only("EMAIL_ADDRESS"))
    S.start(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["mail [EMAIL_ADDRESS]", "nothing"]
    # the same files are not read again
    S.start(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(k, "mail a@b.co", datetime.datetime(2024, 1, 1, h)) for k, h in enumerate((10, 10, 11, 23))]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = S.detections(S.inbox(spark, str(tmp_path / "in"), SCHEMA, 1), Registry().only("EMAIL_ADDRESS"))
    S.start(S.hourly(found), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(180)
    got = sorted((r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(10, 2), (11, 1)]


def test_batches_with_a_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a", None), (1, "b", None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.start(S.inbox(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "c"), lambda df, n: df.groupBy("doc_id").count())
    q.awaitTermination(120)
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
