"""The split that the queries on flows share reads hashes that are kept."""

from flowgauge.catalog.views import split_flows
from flowgauge.operators.sampling import stratified_split


def test_split_reads_kept_hashes(spark, sf):
    rows = split_flows(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # the hashes come out of the kept rows, they are not made once more
    scan = plan[plan.index("InMemoryTableScan"):].split("]")[0]
    assert "_hash" in scan


def test_kept_hashes_give_the_same_split(spark):
    rows = spark.createDataFrame([(str(i % 90), i % 4 if i % 7 else None) for i in range(400)], "row_id string, y int")
    ratios = {"train": 0.6, "val": 0.2, "test": 0.2}
    plain, kept = (stratified_split(rows, ratios, [1, 2], keep_hashes=k) for k in (False, True))
    assert kept.columns == plain.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
