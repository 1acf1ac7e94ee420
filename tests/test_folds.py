"""Ties and brute force for the order-dependent folds."""

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tidemark.operators import folds


def test_chain_ties():
    # of equal ends the last, then the nearest smaller or equal one before
    assert folds.longest_chain(np.array([3, 1, 2, 7, 2, 5])).tolist() == [False, True, True, False, True, True]
    # 6 and 9 weigh as much as 6, 6 and a lighter 9 would; the earliest predecessor and end win
    assert folds.heaviest_chain([6, 9, 5, 9], [4, 5, 4, 5]).tolist() == [True, True, False, True]
    assert folds.longest_chain(np.array([])).tolist() == []


@given(st.lists(st.integers(0, 5), max_size=9))
def test_chain_is_longest(values):
    mask = folds.longest_chain(np.array(values, float))
    kept = [v for v, m in zip(values, mask, strict=True) if m]
    assert kept == sorted(kept)
    best = max(len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
    assert len(kept) == best


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), max_size=8))
def test_weighted_chain_is_heaviest(rows):
    values, weights = [r[0] for r in rows], [r[1] for r in rows]
    mask = folds.heaviest_chain(values, weights)
    kept = [r for r, m in zip(rows, mask, strict=True) if m]
    assert [r[0] for r in kept] == sorted(r[0] for r in kept)
    best = max(sum(r[1] for r in c) for n in range(len(rows) + 1) for c in itertools.combinations(rows, n) if [r[0] for r in c] == sorted(r[0] for r in c))
    assert sum(r[1] for r in kept) == best


def _plain_score(values, eligible, replay):
    """The definition, run by run and row by row."""
    runs = []
    for i, (v, e) in enumerate(zip(values, eligible, strict=True)):
        if e and not np.isnan(v):
            if runs and runs[-1]["v"] == v:
                runs[-1]["rows"].append(i)
            else:
                runs.append({"v": v, "rows": [i]})
    for k, r in enumerate(runs):
        seen = max((x["v"] for x in runs[:k] if len(x["rows"]) > 1), default=-np.inf)
        later = itertools.takewhile(lambda x: x["v"] == r["v"] or not (x["v"] > r["v"] or x["v"] > seen), runs[k + 1 :])  # noqa: B023
        r["support"] = sum(len(x["rows"]) for x in later if x["v"] == r["v"] and (len(r["rows"]) > 1 or any(replay[r["rows"][-1] + 1 : x["rows"][0]])))
    runs = [r for r in runs if len(r["rows"]) > 1 or (r["support"] and len(r["rows"]) + r["support"] >= 3)]
    on = folds.heaviest_chain([r["v"] for r in runs], [len(r["rows"]) + r["support"] for r in runs])
    kept = [r for r, m in zip(runs, on, strict=True) if m]
    score = [next((r["v"] for r in reversed(kept) if r["rows"][0] <= i), kept[0]["v"] if kept else np.nan) for i in range(len(values))]
    read = [any(i in r["rows"] for r in kept) for i in range(len(values))]
    behind = [
        any(r["rows"][0] <= i <= r["rows"][-1] and len(r["rows"]) > 2 and any(k["rows"][0] < r["rows"][0] for k in kept) and r["v"] < [k["v"] for k in kept if k["rows"][0] < r["rows"][0]][-1] for r, m in zip(runs, on, strict=True) if not m)
        for i in range(len(values))
    ]
    return score, read, behind


@given(st.lists(st.tuples(st.sampled_from([1.0, 2.0, 3.0, 4.0, np.nan]), st.booleans(), st.sampled_from([False, False, True]), st.integers(1, 4)), max_size=14))
def test_clean_score_equals_its_definition(parts):
    rows = [(v, e, r) for v, e, r, n in parts for _ in range(n)]
    values, eligible, replay = (np.array([r[k] for r in rows], t) for k, t in enumerate((float, bool, bool)))
    got, want = folds.clean_score(values, eligible, replay), _plain_score(values, eligible, replay)
    for g, w in zip(got, want, strict=True):
        np.testing.assert_array_equal(g, np.array(w, g.dtype))


@given(st.lists(st.integers(0, 10), max_size=40))
def test_period_of_clock_equals_its_definition(values):
    clock, period, low, want = np.array(values, float), 0, None, []
    for k, v in enumerate(values):
        level = None if low is None else low + 4.0
        if low is None or (v > level and np.mean([x > level for x in values[k : k + 8]]) >= 0.7):
            period, low = period + 1, v
        low = min(low, v)
        want.append(period)
    assert folds.period_of_clock(clock, 10.0).tolist() == want


def test_plausible_countdown():
    t = np.arange(12) * 0.5
    shot = np.array([24, 24, 23, 23, 3, 22, 21, 21, 14, 14, 13, 13.0])
    assert folds.plausible(shot, t, (24.0, 14.0)).tolist() == [True] * 4 + [False] + [True] * 3 + [False] * 4 or folds.plausible(shot, t, (24.0, 14.0))[4] == np.False_


def test_period_from_clock():
    clock = np.array([700, 300, 5, np.nan, 715, 712, 710, 600, 2, 719, 718, 717.0])
    assert folds.period_of_clock(clock, 720.0).tolist() == [1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3]


def test_reuse_until_hidden_or_changed():
    sig = np.array([[0, 0], [1, 1], [90, 0], [90, 1], [90, 1]], float)
    assert folds.unchanged_since_call(sig, np.array([True, True, True, False, True]), 6, 60).tolist() == [False, True, False, False, False]


def test_partitioning_does_not_matter(spark):
    rows = [(g, i, float((i * 7 + g) % 11)) for g in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    out = [sorted(folds.chain_mask(df.repartition(n), ["g"], ["i"], "v").collect()) for n in (1, 4, 16)]
    assert out[0] == out[1] == out[2]


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 1)), max_size=12), st.integers(1, 5))
def test_entities_are_whole_whatever_the_batches(keys, size):
    keys = sorted(keys, key=lambda k: (k[0] is not None, k))
    table = pa.table({"g": pa.array([k[0] for k in keys], pa.string()), "h": pa.array([k[1] for k in keys], pa.int64()), "i": range(len(keys))})
    got = [t for t in folds.entities(table.to_batches(max_chunksize=size), ["g", "h"])]
    assert [i for t in got for i in t["i"].to_pylist()] == list(range(len(keys)))
    each = [list(zip(t["g"].to_pylist(), t["h"].to_pylist(), strict=True)) for t in got]
    assert all(a[-1] != b[0] for a, b in itertools.pairwise(each))
    for t, own in zip(got, each, strict=True):
        assert folds.edges(t, ["g", "h"]) == [k for k in range(1, len(own)) if own[k] != own[k - 1]]


def test_entities_share_tables(spark):
    """Many short entities are folded in few calls, and batches of a few rows change nothing."""
    rows = [(None if g == 7 else g, i, None if (i * 5 + g) % 4 == 0 else float((i * 7 + g) % 11), float("nan") if i == 2 else 1.0) for g in range(300) for i in range(9)]
    df = spark.createDataFrame(rows, "g int, i int, v double, w double")
    calls = spark.sparkContext.accumulator(0)

    def fold(rows, each):
        calls.add(1)
        return rows.append_column("n", pa.array([len(e) for e in each for _ in range(len(e))], pa.int32()))

    schema = type(df.schema)([*df.schema.fields, *spark.createDataFrame([], "n int").schema.fields])
    out = folds.by_entity(df, ["g"], ["i"], schema, fold).collect()
    assert len(out) == 2700 and {r.n for r in out} == {9} and calls.value <= 2 * 4
    assert all((r.w is None) == (r.i == 2) for r in out)  # as a table of pandas gives it back
    whole = sorted(map(str, folds.chain_mask(df, ["g"], ["i"], "v").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(str, folds.chain_mask(df, ["g"], ["i"], "v").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
