"""Windows over buckets of time, and sketches, against counting by hand."""

import random

import numpy as np

from vicinal.operators import evaluate, windows


def rows_of(seed, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([0, 50, 99, 100, 101, 1000]) + 100 * rng.randint(-5, 30)) for i in range(n)]


def test_counts_over_a_length_of_time(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "id bigint, user bigint, sec bigint")
    got = {r["id"]: r["n"] for r in windows.count_within(df, ["user"], "sec", 100, "n").collect()}
    assert got == {i: sum(u == user and sec - 100 <= s <= sec for _, u, s in rows) for i, user, sec in rows}


def test_the_row_before_may_lie_many_buckets_back(spark):
    rows = rows_of(2, 200) + [(1000, 7, 5), (1001, 7, 500_000), (1002, 7, 500_000), (1003, 8, -1)]
    df = spark.createDataFrame(rows, "id bigint, user bigint, sec bigint")
    got = {r["id"]: r["last_sec"] for r in windows.since_last(df, ["user"], "sec", "id", bucket=130).collect()}
    want = {}
    for user in {u for _, u, _ in rows}:
        own = sorted((s, i) for i, u, s in rows if u == user)
        want |= {i: own[k - 1][0] if k else None for k, (s, i) in enumerate(own)}
    assert got == want


def test_no_window_holds_all_rows_of_a_user(spark):
    """A user with all rows, over many days: the largest bucket of the plan's shuffles has a few of them."""
    df = spark.range(5000).selectExpr("id", "cast(id < 0 as int) as user", "id * 1000 as sec")
    got = windows.since_last(df, ["user"], "sec", "id").filter("last_sec = sec - 1000").count()
    assert got == 4999
    plan = windows.since_last(df, ["user"], "sec", "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user" in plan and "_bucket" in plan


def test_merged_sketches_are_within_their_bound(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(0, 1 << 30, 30_000), np.zeros(3000, int), rng.integers(0, 50, 7000)])
    df = spark.createDataFrame([(i % 20, int(v)) for i, v in enumerate(values)] + [(3, None)], "window int, v bigint").repartition(6)
    parts = evaluate.sketches(df, ["window"], "v")
    one = evaluate.sketch_quantiles(evaluate.merged_sketches(parts.selectExpr("1 as g", "n", "sketch"), ["g"]), ["g"], {f"p{p}": p / 100 for p in (1, 25, 50, 90, 99)}).first()
    assert one["n"] == len(values)
    for p in (1, 25, 50, 90, 99):
        x, n = one[f"p{p}"], len(values)
        less, upto = (values < x).sum(), (values <= x).sum()
        assert less <= (p / 100 + evaluate.SKETCH_ERROR) * n and upto >= (p / 100 - evaluate.SKETCH_ERROR) * n
