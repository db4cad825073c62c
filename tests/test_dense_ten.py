"""Dense search returns as many hits as the reference's retriever."""

from idloom.plans import tables


def test_ten_of_every_vector(spark):
    hits = tables.QUERIES["ret_dense_ten"](spark, "/root/testdata/sf0.001").groupBy("query_id").count().collect()
    assert hits and {r["count"] for r in hits} == {10}
