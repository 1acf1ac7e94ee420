"""Results by signature: only what changed is computed again, and all equal a full run."""

import random

from pyspark.sql import functions as F

from tidemark.sources.cache import Store, signatures

SCHEMA = "game string, part int, t int, v double"


def totals(rows):
    return rows.groupBy("game", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


def got(df):
    return {(r.game, r.part): (r.n, r.total, r.recomputed) for r in df.collect()}


def plain(rows):
    out = {}
    for g, p, _, v in rows:
        n, s = out.get((g, p), (0, None))
        out[g, p] = n + 1, s if v is None else (s or 0.0) + v
    return {k: (n, s if s is None else round(s, 6)) for k, (n, s) in out.items()}


def test_only_changes_are_computed(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, None]), t, rng.choice([1.0, 2.5, None])) for t in range(200)]
    df = lambda rows, n=3: spark.createDataFrame(rows, SCHEMA).repartition(n)
    store = Store(spark, str(tmp_path / "store"), ["game", "part"], buckets=4)
    first = got(store.run(df(rows), totals))
    assert {k: v[:2] for k, v in first.items()} == plain(rows) and all(v[2] for v in first.values())
    # the same rows in another order and layout: all from the store
    again = got(store.run(df(rows[::-1], 7), totals))
    assert {k: v[:2] for k, v in again.items()} == plain(rows) and not any(v[2] for v in again.values())
    # one entity gains a row, one changes a value, one is gone, one is new, one has a row twice now
    changed = [r for r in rows if (r[0], r[1]) != ("d", 2)] + [("a", 1, 999, 4.0), ("new", 1, 0, 1.0), next(r for r in rows if r[:2] == ("b", 2))]
    k = next(i for i, r in enumerate(changed) if r[:2] == (None, None))
    changed[k] = (None, None, changed[k][2], 77.0)
    calls = []
    third = got(store.run(df(changed), lambda x: calls.append(x.select("game", "part").distinct().collect()) or totals(x)))
    assert {k: v[:2] for k, v in third.items()} == plain(changed)
    assert {k for k, v in third.items() if v[2]} == {("a", 1), ("new", 1), ("b", 2), (None, None)} == {tuple(r) for r in calls[0]}
    assert not any(v[2] for v in got(store.run(df(changed), totals)).values())
    # what was gone comes back
    assert {k: v[:2] for k, v in got(store.run(df(rows), totals)).items()} == plain(rows)
    # a new version makes all anew
    newer = Store(spark, str(tmp_path / "store"), ["game", "part"], "2", 4)
    assert all(v[2] for v in got(newer.run(df(rows), totals)).values())


def test_only_final_results_are_stored(spark, tmp_path):
    rows = [("live", 1, 0, 1.0), ("over", 1, 0, 9.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = Store(spark, str(tmp_path / "store"), ["game", "part"], buckets=2)
    for _ in range(2):
        out = got(store.run(df, totals, final=F.col("total") >= 5))
        assert out["live", 1] == (1, 1.0, True)
    assert out["over", 1] == (1, 9.0, False)


def test_entities_without_a_result_are_remembered(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 0, 1.0), ("y", 1, 0, -1.0)], SCHEMA)
    store, asked = Store(spark, str(tmp_path / "store"), ["game", "part"]), []
    compute = lambda rows: asked.append(rows.count()) or totals(rows.filter("v > 0"))
    assert [len(got(store.run(df, compute))) for _ in range(2)] == [1, 1] and asked == [2, 0]
    assert store.run(df.limit(0), compute).count() == 0
    # one that had a result and has none now doesn't get its old one back
    for rows, want in (([("x", 1, 0, 1.0)], 1), ([("x", 1, 0, -2.0)], 0), ([("x", 1, 0, -2.0)], 0), ([("x", 1, 0, 1.0)], 1)):
        assert store.run(spark.createDataFrame(rows, SCHEMA), compute).count() == want


def test_signatures_tell_rows_apart(spark):
    of = lambda rows: {r.signature for r in signatures(spark.createDataFrame([("g", 1, *r) for r in rows], SCHEMA), ["game"]).collect()}
    a = of([(1, 2.0), (3, None)])
    assert a == of([(3, None), (1, 2.0)]) and len(a) == 1
    for other in ([(1, 2.0)], [(1, 2.0), (3, None), (3, None)], [(1, None), (3, 2.0)], [(3, 2.0), (1, None)], [(1, 2.0), (3, 0.0)]):
        assert a.isdisjoint(of(other))
