"""The classifier's training rows: no text is shuffled that the table of bits keeps back."""

from lodestone.llm import quality_model


def test_bits_come_before_the_exact_join(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    ids = spark.range(0, 3000, 30).selectExpr("id AS doc_id").union(spark.range(0, 90, 30).selectExpr("id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quality_model.of_ids(docs, ids)
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the root comes first: what is joined by shuffled ids has been through the broadcast table
    assert 0 <= plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 1000, 30))
