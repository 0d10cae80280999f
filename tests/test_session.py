from cloakwork.session import one_of_each, stored


def test_stored_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    back = stored(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_one_of_each_drops_repeats_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, t string")
    assert [r.id for r in one_of_each(df, "id").collect()] == [1]
