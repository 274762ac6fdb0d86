"""Selection rules against a plain Python statement of them, on small skewed inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import select, skew
from newsloom.operators.counts import items_by_source

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
SCHEMA = "seq long, source string, title string, url string, summary string, published_at timestamp"
POLICY = [("hot", 1, 6), ("small", 1, 50), ("none", 1, 0)]


def rows(seed, n=300):
    """Two thirds of the rows share a source, a third of them a url."""
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        source = "hot" if rnd.random() < 0.66 else rnd.choice(["small", "none", "unlisted"])
        url = "u" if rnd.random() < 0.33 else f"u{rnd.randrange(150)}"
        hours = rnd.choice([0, 1, 1, 2, 5, 170, 170, 500])
        published = None if rnd.random() < 0.03 else NOW - dt.timedelta(hours=hours)
        out.append((seq, source, f" t{seq}  x", url, "", published))
    return out


def expected(data, limit):
    """The rule in order: first of each url; recent or undated; topped up; newest first; capped."""
    seen, items = set(), []
    for r in data:
        if r[3] not in seen:
            seen.add(r[3])
            items.append(r)
    policy = {s: (h, k) for s, h, k in POLICY}
    oldest = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    kept = [r for r in items if r[5] is None or r[5] >= NOW - dt.timedelta(hours=policy.get(r[1], (168, 0))[0])]
    for source in dict.fromkeys(r[1] for r in items):
        need = policy.get(source, (168, 0))[1] - sum(r[1] == source for r in kept)
        spare = sorted((r for r in items if r[1] == source and r not in kept), key=lambda r: r[5] or oldest, reverse=True)
        kept += spare[: max(need, 0)]
    return [r[0] for r in sorted(kept, key=lambda r: r[5] or oldest, reverse=True)][:limit]


def chosen(spark, data, parts, limit=1000):
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    policy = spark.createDataFrame(POLICY, "source string, recent_hours int, min_keep int")
    out = select.select_items(df, policy, NOW, limit)
    return [r.seq for r in out.orderBy("rank").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_selection_is_the_stated_rule(spark, seed):
    data = rows(seed)
    assert chosen(spark, data, 5) == expected(data, 1000)
    assert chosen(spark, data, 5, 20) == expected(data, 20)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_selection_does_not_depend_on_partitions(spark, parts):
    data = rows(9)
    assert chosen(spark, data, parts) == expected(data, 1000)


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    once = select.deduplicate(df)
    assert sorted(select.deduplicate(once).collect()) == sorted(once.collect())


def test_undated_can_be_dropped(spark):
    df = spark.createDataFrame(rows(2), SCHEMA)
    policy = spark.createDataFrame(POLICY, "source string, recent_hours int, min_keep int")
    assert select.recent_items(df, policy, NOW, undated="drop").where("published_at IS NULL").count() == 0


def test_lookup_join_is_the_same_without_broadcast(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    policy = spark.createDataFrame(POLICY, "source string, recent_hours int, min_keep int")
    want = sorted(select.with_policy(df, policy).collect(), key=lambda r: r.seq)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = select.with_policy(df, policy)
        got = sorted(salted.collect(), key=lambda r: r.seq)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_distributed_rank_is_the_global_rank(spark):
    df = spark.range(0, 5000, 1, 13).selectExpr("id", "id * 7919 % 5003 AS x", "id % 3 AS hot")
    got = skew.distributed_rank(df, [F.col("hot").desc(), F.col("x")]).select("id", "rank").collect()
    order = sorted(range(5000), key=lambda i: (-(i % 3), i * 7919 % 5003))
    assert {r.id: r.rank for r in got} == {i: n + 1 for n, i in enumerate(order)}


def test_items_by_source_positions(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    got = {r.seq: (r.source, r.pos) for r in items_by_source(df).collect()}
    count, want = {}, {}
    for r in rows(5):
        count[r[1]] = count.get(r[1], 0) + 1
        want[r[0]] = (r[1], count[r[1]])
    assert got == want


def test_arrival_seq_orders_like_its_parts(spark):
    parts = [(a, b, c, d) for a in (0, 1, 99_999_999) for b in (0, 1, 2) for c in (0, 1) for d in (0, 1, 500_000)]
    df = spark.createDataFrame(parts, "a long, b int, c int, d long")
    got = df.withColumn("seq", select.arrival_seq(*(F.col(x) for x in "abcd"))).orderBy("seq").collect()
    assert [tuple(r)[:4] for r in got] == sorted(parts)
