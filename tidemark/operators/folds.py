"""Order-dependent folds that no window expression states: maps over rows sorted by entity.

An entity (a game, a user) is a bounded group by design; thousands of them run in parallel. The
functions on arrays are small and are tested alone.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def longest_chain(values: np.ndarray) -> np.ndarray:
    """Mask of a longest non-decreasing subsequence: the last possible end, then the nearest predecessors."""
    tops: list[float] = []
    length = np.zeros(len(values), np.int64)
    for i, v in enumerate(values):
        k = bisect.bisect_right(tops, v)
        tops[k : k + 1] = [v]
        length[i] = k + 1
    mask, want = np.zeros(len(values), bool), len(tops)
    for i in range(len(values) - 1, -1, -1):  # the latest row of each length, from the end
        if want and length[i] == want:
            mask[i] = True
            want -= 1
    return mask


def heaviest_chain(values: list[float], weights: list[float]) -> np.ndarray:
    """Mask of a heaviest non-decreasing subsequence; of equal ones the earliest predecessor and end.

    A tree of prefix maxima over the ranks of values (Fenwick's) gives each element its best predecessor.
    """
    v, w = np.asarray(values, float), np.asarray(weights, float).tolist()
    mask = np.zeros(len(v), bool)
    if not len(v):
        return mask
    rank = (np.unique(v, return_inverse=True)[1] + 1).tolist()
    size = max(rank)
    nobody = (0.0, 1)  # weight of a chain and, of equal ones, the earlier end; nobody adds nothing
    tree, back = [nobody] * (size + 1), [-1] * len(v)
    top = (-math.inf, 0)
    for i, r in enumerate(rank):
        best, k = nobody, r
        while k:
            best = max(best, tree[k])
            k &= k - 1
        if best[0] > 0:
            back[i] = -best[1]
        here = (best[0] + w[i] if best[0] > 0 else w[i], -i)
        top, k = max(top, here), r
        while k <= size:
            tree[k] = max(tree[k], here)
            k += k & -k
    i = -top[1]
    while i >= 0:
        mask[i] = True
        i = back[i]
    return mask


class Runs(NamedTuple):
    """Equal neighbours among some rows: first and last row, value, number of rows."""

    first: np.ndarray
    last: np.ndarray
    value: np.ndarray
    n: np.ndarray

    def where(self, on: np.ndarray) -> Runs:
        return Runs(*(x[on] for x in self))


def runs_of(values: np.ndarray, eligible: np.ndarray) -> Runs:
    """Runs of equal neighbours among eligible known values."""
    at = np.flatnonzero(eligible & ~np.isnan(values))
    v = values[at]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else at
    ends = np.concatenate([edge[1:], [len(v)]]) if len(v) else at
    return Runs(at[edge], at[ends - 1], v[edge], ends - edge)


def first_after(v: np.ndarray, k: int, above: float, but: float, step: int = 16) -> int:
    """The first place behind k with a value over ``above`` that is not ``but``; looked for in stretches that double."""
    at = k + 1
    while at < len(v):
        part = v[at : at + step]
        hit = np.flatnonzero((part > above) & (part != but))
        if len(hit):
            return at + int(hit[0])
        at, step = at + step, 2 * step
    return len(v)


def backing(runs: Runs, replay: np.ndarray) -> np.ndarray:
    """Rows of later runs that confirm each run's value.

    They lie before the run that bounds it: the first of another value that is higher than it, or
    higher than any lasting value (two rows or more) seen before it. A run of one row may be a
    misread, so only runs behind a replay that follows it confirm it.
    """
    first, last, v, n = runs
    many = len(v)
    if not many:
        return np.zeros(0, int)
    seen = np.concatenate([[-np.inf], np.maximum.accumulate(np.where(n >= 2, v, -np.inf))[:-1]])
    bound = np.array([first_after(v, k, min(v[k], seen[k]), v[k]) for k in range(many)], int)
    # runs sorted by value, then place: one of equal value that lies beyond a mark is found by (value, mark)
    order = np.argsort(v, kind="stable")
    same = np.cumsum(np.concatenate([[0], np.diff(v[order]) != 0])).astype(np.int64)
    of_run = np.empty(many, np.int64)
    of_run[order] = same
    place, ends = np.empty(many, np.int64), np.searchsorted(same, of_run, side="right")
    place[order] = np.arange(many)
    replays = np.concatenate([[0], np.cumsum(replay)])
    wide = max(many, int(replays[-1])) + 2
    stop = np.searchsorted(same * wide + order, of_run * wide + bound)
    # a single row counts from the first run on that a replay separates from it
    apart = np.searchsorted(same * wide + replays[first[order]], of_run * wide + replays[last + 1], side="right")
    begin = np.where(n >= 2, place + 1, np.maximum(place + 1, apart))
    rows = np.concatenate([[0], np.cumsum(n[order])])
    return np.maximum(0, rows[stop] - rows[np.minimum(begin, ends)])


def clean_score(values: np.ndarray, eligible: np.ndarray, replay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-decreasing score, whether each row read it, and rows of lasting runs behind it (a replay).

    Runs of two rows, or with confirmed ones of three, are believed; the chain of them that never
    falls and has the most rows is the score. It holds from a run to the next, the first one from
    the start on.
    """
    runs = runs_of(values, eligible)
    support = backing(runs, replay)
    believed = (runs.n >= 2) | ((support > 0) & (runs.n + support >= 3))
    runs, support = runs.where(believed), support[believed]
    on = heaviest_chain(runs.value.tolist(), (runs.n + support).tolist())
    kept, others = runs.where(on), runs.where(~on)
    row, none = np.arange(len(values)), np.zeros(len(values), bool)
    if not len(kept.first):
        return np.full(len(values), np.nan), none, none
    now = np.searchsorted(kept.first, row, side="right") - 1
    score = kept.value[np.maximum(now, 0)]
    read = eligible & (now >= 0) & (row <= kept.last[np.maximum(now, 0)]) & (values == score)
    before = np.searchsorted(kept.first, others.first) - 1
    late = others.where((others.n >= 3) & (before >= 0) & (others.value < kept.value[np.maximum(before, 0)]))
    edges = np.bincount(late.first, minlength=len(values) + 1) - np.bincount(late.last + 1, minlength=len(values) + 1)
    return score, read, np.cumsum(edges)[:-1] > 0


def plausible(values: np.ndarray, at: np.ndarray, resets: tuple[float, ...], reach: float = 3.0, agree: int = 4, span: float = 1.5) -> np.ndarray:
    """Mask of readings of a countdown that belong to its course.

    Readings fall into stretches: within one, each falls from the one before no faster than time (and
    a second) and never rises. A stretch joins the course at its first reading that follows the end of the
    course so far: in the same way, as a reset, or more than ``reach`` seconds later; what it has before
    that reading is wrong. One that doesn't join by its ``agree``-th reading, if that lies ``span`` seconds
    in (or by the first that does), is the course from there on, and all of it counts. Others are wrong.
    """
    mask, known = np.zeros(len(values), bool), np.flatnonzero(~np.isnan(values))
    v, t = values[known], at[known]
    if not len(v):
        return mask
    falls = (v[1:] >= v[:-1] - np.diff(t) - 1.0) & (v[1:] <= v[:-1] + 0.01)
    first = np.flatnonzero(np.concatenate([[True], ~falls]))
    end = np.concatenate([first[1:], [len(v)]])
    on_target = (np.abs(v[:, None] - np.array(resets, float)) < 0.01).any(1)
    good, tail = np.zeros(len(v), bool), None
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        lasts = np.flatnonzero(t[a + agree - 1 : b] - t[a] >= span)
        alone = a + agree - 1 + int(lasts[0]) if len(lasts) else b  # where the stretch stands on its own
        part = slice(a, min(b, alone + 1))
        joins = np.ones(1, bool)
        if tail is not None:
            age = t[part] - t[tail]
            low = v[part] >= v[tail] - age - 1.0
            joins = (age > reach) | (low & ((v[part] <= v[tail] + 0.01) | on_target[part]))
        if joins.any():
            good[a + int(joins.argmax()) : b] = True
        elif alone < b:
            good[a:b] = True
        else:
            continue
        tail = b - 1
    mask[known] = good
    return mask


def neighbours_fill(values: np.ndarray) -> np.ndarray:
    """Unknown values as the last known one before them; at the head, as the first known one."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values
    return values[known[np.maximum(np.searchsorted(known, np.arange(len(values)), side="right") - 1, 0)]]


def next_top(clock: np.ndarray, rise: float, ahead: int, most: float, step: int = 64) -> int:
    """The first place where a countdown stands by ``rise`` above its least value before, and so do ``most`` of ``ahead`` values from there on."""
    while True:
        part = clock[:step]
        level = np.minimum.accumulate(part)[:-1] + rise
        for k in np.flatnonzero(part[1:] > level) + 1:
            if (clock[k : k + ahead] > level[k - 1]).mean() >= most:
                return int(k)
        if step >= len(clock):
            return len(clock)
        step *= 2


def period_of_clock(clock: np.ndarray, length: float, share: float = 0.4, ahead: int = 8, most: float = 0.7) -> np.ndarray:
    """Periods counted from lasting jumps of a countdown towards its top; unknown rows take their neighbour's."""
    known = np.flatnonzero(~np.isnan(clock))
    tops, left = [], clock[known]
    while len(left):
        tops.append(len(known) - len(left))
        left = left[next_top(left, share * length, ahead, most) :]
    out = np.full(len(clock), np.nan)
    out[known] = np.searchsorted(tops, np.arange(len(known)), side="right")
    return neighbours_fill(out)


def unchanged_since_call(signature: np.ndarray, visible: np.ndarray, mean: float, most: float) -> np.ndarray:
    """Rows that can reuse the last reading: close to the row last read; hidden rows clear it."""
    out, last = np.zeros(len(signature), bool), None
    for i, (s, seen) in enumerate(zip(signature, visible, strict=True)):
        if not seen:
            last = None
            continue
        if last is not None:
            d = np.abs(s - last)
            out[i] = d.mean() < mean and d.max() < most
        if not out[i]:
            last = s
    return out


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` dealt by entity to as many tasks as shuffles have: an entity's rows may be few, but the work on each row is not, and adaptive execution looks at bytes only."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def edges(rows: pa.Table, key: list[str]) -> list[int]:
    """Places of rows whose entity is not that of the row before."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for k in key:
        now, before = rows[k].slice(1), rows[k].slice(0, len(new))
        one = pc.or_(pc.is_null(now), pc.is_null(before))
        new |= pc.if_else(one, pc.xor(pc.is_null(now), pc.is_null(before)), pc.fill_null(pc.not_equal(now, before), False)).to_numpy()
    return (np.flatnonzero(new) + 1).tolist()


def entities(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by entity in batches, as tables of whole entities: one that may go on in the next batch waits for it."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        cuts = edges(rows, key)
        if waiting and edges(pa.concat_tables([waiting[-1].slice(len(waiting[-1]) - 1), rows.slice(0, 1)]), key):
            cuts = [0, *cuts]
        if cuts:
            whole = pa.concat_tables([*waiting, rows.slice(0, cuts[-1])])
            if len(whole):
                yield whole
            waiting, rows = [], rows.slice(cuts[-1])
        waiting.append(rows)
    if waiting:
        yield pa.concat_tables(waiting)


class Columns(dict):
    """Columns of a table as arrays, made when first asked for; unknown numbers are NaN."""

    def __init__(self, rows: pa.Table):
        super().__init__()
        self.rows = rows

    def __missing__(self, name: str) -> np.ndarray:
        out = self[name] = self.rows[name].to_pandas().to_numpy()
        return out


class Entity:
    """The arrays of one entity's rows among those of many."""

    def __init__(self, columns: Columns, first: int, end: int):
        self.columns, self.at, self.size = columns, slice(first, end), end - first

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][self.at]


def _known(rows: pa.Table) -> pa.Table:
    """NaN goes as NULL."""
    for k, field in enumerate(rows.schema):
        if pa.types.is_floating(field.type):
            x = rows.column(k)
            rows = rows.set_column(k, field, pc.if_else(pc.fill_null(pc.is_nan(x), False), pa.scalar(None, field.type), x))
    return rows


def by_entity(df: DataFrame, key: list[str], order: list[str] | list[Column], schema: T.StructType, fold: Callable[[pa.Table, list[Entity]], pa.Table]) -> DataFrame:
    """``fold`` over the ordered rows of entities: it takes a table of whole entities and their arrays.

    Spark deals and sorts the rows and tasks read them in batches, since a grouped map makes tables of its own for each
    entity, which takes ten times what the folds do where entities have some hundred rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in entities(batches, key):
            rows, starts = _known(rows), [0, *edges(rows, key), len(rows)]
            columns = Columns(rows)
            yield from fold(rows, [Entity(columns, a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]).to_batches()

    by = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    return spread(df, key).sortWithinPartitions(*key, *by).mapInArrow(run, schema)


def _grouped(df: DataFrame, key: list[str], order: list[str], added: list[tuple[str, T.DataType]], fold: Callable[[Entity], Iterable[np.ndarray]]) -> DataFrame:
    """``df`` with columns that ``fold`` (of an entity's ordered rows) gives."""
    new = T.StructType([T.StructField(n, t) for n, t in added])

    def run(rows: pa.Table, each: list[Entity]) -> pa.Table:
        for field, parts in zip(to_arrow_schema(new), zip(*map(fold, each), strict=True), strict=True):
            rows = rows.append_column(field, pa.array(np.concatenate(parts), field.type, from_pandas=True))
        return rows

    return by_entity(df, key, order, T.StructType([*df.schema.fields, *new.fields]), run)


def chain_mask(df: DataFrame, key: list[str], order: list[str], value: str, out: str = "on_chain") -> DataFrame:
    def fold(rows: Entity):
        known = ~pd.isna(rows[value])
        mask = np.zeros(len(rows), bool)
        mask[known] = longest_chain(rows[value][known])
        return [mask]

    return _grouped(df, key, order, [(out, T.BooleanType())], fold)


def weighted_chain_mask(df: DataFrame, key: list[str], order: list[str], value: str, weight: str, out: str = "on_chain") -> DataFrame:
    return _grouped(df, key, order, [(out, T.BooleanType())], lambda rows: [heaviest_chain(rows[value].tolist(), rows[weight].tolist())])


def clean_scores(df: DataFrame, key: list[str], order: list[str], value: str, eligible: str, replay: str) -> DataFrame:
    def fold(rows: Entity):
        return clean_score(rows[value].astype(float), rows[eligible].astype(bool), rows[replay].astype(bool))

    return _grouped(df, key, order, [("score", T.DoubleType()), ("score_read", T.BooleanType()), ("behind", T.BooleanType())], fold)


def plausible_mask(df: DataFrame, key: list[str], order: list[str], value: str, at: str, resets: tuple[float, ...], reach: float, span: float, out: str = "plausible") -> DataFrame:
    return _grouped(df, key, order, [(out, T.BooleanType())], lambda rows: [plausible(rows[value].astype(float), rows[at].astype(float), resets, reach, span=span)])


def infer_period(df: DataFrame, key: list[str], order: list[str], clock: str, length: float, out: str = "period") -> DataFrame:
    return _grouped(df, key, order, [(out, T.DoubleType())], lambda rows: [period_of_clock(rows[clock].astype(float), length)])


def reuse_mask(df: DataFrame, key: list[str], order: list[str], signature: str, visible: str, mean: float, most: float, out: str = "reused") -> DataFrame:
    return _grouped(df, key, order, [(out, T.BooleanType())], lambda rows: [unchanged_since_call(np.stack(rows[signature]), rows[visible].astype(bool), mean, most)])
