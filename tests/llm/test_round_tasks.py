"""Rounds of components: few links take few tasks, however many partitions shuffles have; many links are shuffled. Both give the same groups."""

import random

import pytest

from sparloom.llm import simhash

PARTITIONS = 32


def ran(spark, group):
    """Tasks that ran in the job group."""
    seen = spark.sparkContext.statusTracker()
    stages = {s for job in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(job).stageIds}
    return sum(x.numCompletedTasks for s in stages if (x := seen.getStageInfo(s)))


@pytest.fixture
def partitions(spark):
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_links_take_few_tasks(spark, partitions):
    rng = random.Random(3)
    links = sorted({(max(p), min(p)) for _ in range(400) if len(p := {rng.randrange(600), rng.randrange(600)}) == 2})
    links += [(10_000 + i, 9_999 + i) for i in range(8)] + [(20_000 + i, 20_000) for i in range(1, 300)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "a long, b long").repartition(PARTITIONS)
    took = {}
    for few in (len(links), len(links) - 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "FEW", few, raising=False)
            spark.sparkContext.setJobGroup(f"few-{few}", "")
            try:
                found = simhash.components(frame)
                took[few] = ran(spark, f"few-{few}")
                assert sorted(tuple(r) for r in found.collect()) == sorted((x, find(x)) for x in root)
            finally:
                spark.sparkContext._jsc.clearJobGroup()
    # Beyond the bound each round has some 14 stages of all partitions.
    assert 4 * took[len(links)] < took[len(links) - 1]
