"""Connected components: few links take few tasks, many links are spread; the result is the same."""

from __future__ import annotations

import pytest

from lectern.llm import components as C


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 61 partitions that are not put together."""
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("links_a_task", "most"), [(C.LINKS_A_TASK, 2), (10, 44)])
def test_tasks_go_by_the_number_of_links(spark, many_partitions, monkeypatch, links_a_task, most):
    monkeypatch.setattr(C, "LINKS_A_TASK", links_a_task)
    # a chain, a ring, a star, and loops
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 50) for i in range(50)] + [(200 + i, 200) for i in range(1, 100)] + [(400, 400)]
    found = C.components(spark.createDataFrame(links + links[:7], "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: i // 100 * 100 for i in [*range(61), *range(100, 150), *range(200, 300)]}
    assert found.rdd.getNumPartitions() <= most


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
