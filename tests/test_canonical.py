"""How the canonical tables are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans import canonical as c
from cadenza.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_larger_tables_are_dealt_to_more_tasks(spark):
    """Interactions of more plays than tasks are meant for have partitions in proportion, by user, and the same rows."""
    plays = c.read(spark, SF, "lineitem").count()
    made = c.interactions(spark, SF, 200)
    assert made.rdd.getNumPartitions() == -(-plays // 200) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.select("user_id", F.spark_partition_id().alias("n")).distinct().groupBy("user_id").count().filter("count > 1").isEmpty()
    other = c.interactions(spark, SF)
    assert made.exceptAll(other).isEmpty() and other.exceptAll(made).isEmpty()


def test_moods_are_summed_up_in_one_pass(spark):
    plan = QUERIES["A08_mood_distribution"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2
