"""Retry chains of many hops."""

from tessera.operators.sessions import retry_chains


def test_long_chains_reach_their_first_attempt(spark):
    data = [(i, i - 1 if i else None) for i in range(30)] + [(100, 99), (101, 100), (200, None)]
    got = {r.task_id: (r.root, r.attempt) for r in retry_chains(spark.createDataFrame(data, "task_id long, parent_task_id long")).collect()}
    assert got == {i: (0, i + 1) for i in range(30)} | {100: (100, 1), 101: (100, 2), 200: (200, 1)}
