from tagloom.llm import queries


def test_each_query_covers_the_table(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.p6_ids(spark, sf).count() == n
    assert queries.p7_found(spark, sf).columns == ["doc_id", "item_id"] and queries.p7_found(spark, sf).count() > 0
    assert queries.p8_found(spark, sf).columns == ["doc_id"] and 0 < queries.p8_found(spark, sf).count() < n / 4
