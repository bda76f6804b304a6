"""Rows of open buckets and rounds of components: findings on the hot table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.llm import common, linking


def test_stars_take_no_round(spark, monkeypatch):
    made, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: made.append(1) or cut(df))
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") % 3 - 3).alias("b"))
    got = dict(common.components(links).collect())
    assert got == {**{k: k % 3 - 3 for k in range(1, 60)}, -3: -3, -2: -2, -1: -1}
    assert len(made) == 1
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert dict(common.components(chain).collect()) == dict.fromkeys(range(41), 0)


def test_members_of_a_bucket_become_rows_once(spark, monkeypatch):
    """40 unlike items of one bucket: only their heads are dealt a second time."""
    plans, cut = [], linking.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(linking, "cut", noted)
    members = spark.range(40).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"))
    traits = spark.range(40).select(F.col("id").alias("node"), F.lit(10).alias("size"))
    same = lambda pairs: cut(pairs.where("a % 10 = b % 10"))
    got = dict(linking.link_classes(members, traits, lambda x, y: F.lit(True), same, 0.8).collect())
    assert got == {k: k % 10 for k in range(40)}
    made = [line for plan in plans for line in plan.splitlines() if "Generate inline(" in line]
    assert made and sum("inline(filter(" in line for line in made) * 2 == len(made)
