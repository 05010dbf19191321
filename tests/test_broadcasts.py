"""What is sent to all tasks goes by counts of rows: files of repeating texts are small and large in memory."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelark.plans.domain import PRODUCT_ROWS, Domain
from pricelark.session import checked_broadcast


@pytest.fixture(scope="module")
def many(spark, sf, tmp_path_factory):
    """The tables with more products, of 7 names, than may be broadcast."""
    to = tmp_path_factory.mktemp("many")
    for f in Path(sf).glob("*.parquet"):
        if f.stem != "part":
            (to / f.name).symlink_to(f)
    part = spark.read.parquet(f"{sf}/part.parquet")
    top = part.agg(F.max("p_partkey")).first()[0]
    more = spark.range(top + 1, top + PRODUCT_ROWS + 2).select(F.col("id").alias("p_partkey"), F.concat(F.lit("a name that repeats "), F.col("id") % 7).alias("p_name"))
    part.unionByName(more, allowMissingColumns=True).coalesce(1).write.parquet(str(to / "part.parquet"))
    return str(to)


def test_many_products_are_not_broadcast(spark, sf, many):
    """They were: their file is below the threshold of a broadcast, once for each time that a plan makes the variants."""
    assert sum(f.stat().st_size for f in Path(many, "part.parquet").glob("*.parquet")) < 10 << 20
    joins = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [product_id" in x]
    few, lot = Domain(spark, sf).variants, Domain(spark, many).variants
    assert len(joins(lot)) == 1 and "SortMergeJoin" in joins(lot)[0] and "BroadcastHashJoin" in joins(few)[0]
    assert sorted(map(str, lot.collect())) == sorted(map(str, few.collect()))


def test_a_large_dimension_is_kept_from_broadcasts(spark):
    rows = spark.range(20)
    met = lambda most: spark.range(9).join(checked_broadcast(rows, most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in met(20) and "Broadcast" not in met(19)
