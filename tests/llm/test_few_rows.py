"""Small tables are written by few tasks, and few links are followed without shuffles, however many shuffle partitions there are."""

import os

import pytest
from pyspark.sql import functions as F

from emberline import session
from emberline.llm import graph
from emberline.llm.common import in_one_task


@pytest.fixture
def uncoalesced(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_links_are_written_as_one_file_a_turn(spark, uncoalesced, monkeypatch):
    written = []

    def settled(df, tasks=None):
        out = session.settled(df, tasks)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "settled", settled)
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 50 == 0, 0).otherwise(1)).alias("b"))
    got = {r.v: r.component for r in graph.components(links, 4).collect()}
    assert got == {k: k // 50 * 50 for k in range(400)}
    assert written[0] <= 4 and len(written) > 2 and set(written[1:]) == {1}
    monkeypatch.setattr(graph, "ALONE", 0)
    assert got == {r.v: r.component for r in graph.components(links, 4).collect()}


def test_settled_writes_by_so_many_tasks(spark, uncoalesced):
    rows = spark.range(1000).groupBy("id").count()
    assert len(session.settled(rows, 3).inputFiles()) == 3 and session.settled(rows, 3).count() == 1000


def test_a_model_is_fitted_in_a_task_and_not_in_the_driver(spark):
    def fit(rows):
        return os.getpid(), sorted(r["id"] for r in rows)

    where, ids = in_one_task(spark.range(0, 100, 1, 7), fit)
    assert where != os.getpid() and ids == list(range(100))
    assert in_one_task(spark.range(0), fit)[1] == []
