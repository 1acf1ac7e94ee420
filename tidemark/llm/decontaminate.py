"""Benchmark decontamination with an FM-index of each training shard.

A shard is the words of some consecutive documents of a task, written in the alphabet of the test
phrases: a word that no phrase has is a separator, and stretches between separators that are
shorter than the shortest phrase hold no match and are left out. The shard's suffixes are sorted
(separators are all different, so comparisons end there), its Burrows-Wheeler transform goes into
a wavelet tree, and all phrases are searched backwards at once by ranks. Occurrences are located
by walking to the nearest sampled suffix position. Overlapping occurrences merge to removal spans.

Phrases come from the benchmark as windows of ten consecutive words, or the whole item where it
has fewer. They are shipped to the tasks in blocks of bounded size; a long item is split between
blocks. A pass searches one block, and where there are more, its rows are written before the next
one begins: however large the benchmark, a task has one worker, and a worker one block. With one
block all is one scan without a shuffle. The driver reads the benchmark a partition at a time and
holds two blocks.

Defined results. Null text has no words. An item without words has no window; an item with a null
id marks words, but isn't listed. Repeated rows are judged alike, repeated items count once.
Empty documents or benchmark: no hits. A text longer than a shard is a shard of its own. Extra
columns are kept by ``find`` if named, by ``remove`` all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import Scratch, read, tidied

WINDOW = 10
#: Symbols of a shard from which the next document starts a new one.
SHARD = 1_000_000
#: Every so-manieth suffix position is kept.
SAMPLED = 8
#: Words of benchmark text that are broadcast at once (about 20 bytes each, and 150 for each distinct one), and windows searched at once.
BLOCK_WORDS, SEARCHED = 1_000_000, 200_000

#: 0-9, a-z and bytes of other scripts stay, A-Z are lowered, the rest is white space.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    # only spaces are left to split at: no word byte counts as white space
    return (text or b"").translate(FOLD).split()


class Phrases:
    """Windows of items as places in one array of symbols; a window of several items is there for each."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, item: str | None, words: list[bytes], window: int) -> None:
        """All windows of some consecutive words of an item, or the whole where it has fewer."""
        ids = self.ids
        w = np.fromiter((ids.setdefault(x, len(ids) + 1) for x in words), np.int32, len(words))
        n = max(1, len(w) - window + 1)
        self._parts.append((w, np.arange(self.size, self.size + n), np.full(n, min(window, len(w)), np.int32), np.full(n, len(self.items), np.int32)))
        self.items.append(item)
        self.size += len(w)

    def packed(self) -> Phrases:
        """All in whole arrays: some 20 bytes a word, and the distinct words themselves."""
        none = np.zeros(0, np.int32)
        self.symbols, self.starts, self.lengths, self.item = (np.concatenate(x) for x in zip(*self._parts, strict=True)) if self._parts else (none,) * 4
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self._parts = []
        return self

    def present(self, symbols: np.ndarray) -> np.ndarray:
        """The windows all of whose words are among ``symbols``."""
        there = np.zeros(len(self.ids) + 1, bool)
        there[symbols] = True
        absent = np.concatenate([[0], np.cumsum(~there[self.symbols])])
        return np.flatnonzero(absent[self.starts + self.lengths] == absent[self.starts])

    def backward(self, windows: np.ndarray) -> np.ndarray:
        """Symbols from the end of each window (columns), 0 where it has no more."""
        n, first = self.lengths[windows].astype(np.int64), self.starts[windows].astype(np.int64)
        k = np.arange(int(n.max()) if len(n) else 0)[:, None]
        return np.where(k < n, self.symbols[np.maximum(first + n - 1 - k, 0)], 0).astype(np.int64)


def blocks_of(items: Iterator[tuple[str | None, str | None]], most: int, window: int = WINDOW) -> Iterator[Phrases]:
    """Phrases of items, in blocks of about ``most`` words; a longer item goes on in the next block, and shares a window's words with it."""
    now = Phrases()
    for item, text in items:
        w = words_of((text or "").encode(errors="replace"))
        at = 0
        while at < len(w) and (at == 0 or at + window <= len(w)):
            part = w[at : at + max(window, most - now.size)]
            now.add(item, part, window)
            at += max(1, len(part) - window + 1)
            if now.size >= most:
                yield now.packed()
                now = Phrases()
    if now.size:
        yield now.packed()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols, 0 being separators that differ from each other by position."""
    n = len(s)
    stops = np.flatnonzero(s == 0)
    rank = s + len(stops)  # separators come first, in order
    rank[stops] = np.arange(len(stops))
    order = np.argsort(rank, kind="stable")
    h = 1
    while True:
        ordered = rank[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        beyond = np.zeros(n, np.int64)
        beyond[: n - h] = rank[h:] + 1
        rank = rank * (n + 1) + beyond
        order = np.argsort(rank, kind="stable")
        h *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one array of counts for each bit."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.shifts = range(max(1, (symbols - 1).bit_length()) - 1, -1, -1)
        self.ones: list[np.ndarray] = []
        for shift in self.shifts:
            bit = (s >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.zeros = [len(s) - int(x[-1]) for x in self.ones]
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            r = ones[i]
            i = np.where((c >> shift) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are c."""
        return self._down(c, i) - self.first[c]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i and how many of each stand before."""
        c = np.zeros(len(i), np.int64)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            r = ones[i]
            bit = ones[i + 1] - r
            c |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + r, i - r)
        return c, i - self.first[c]


class FMIndex:
    """Backward search and location in a sequence of symbols with separators 0."""

    def __init__(self, s: np.ndarray, symbols: int, sampled: int = SAMPLED):
        order = suffix_order(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.tree = WaveletTree(np.where(order > 0, s[order - 1], 0), symbols)
        # places after separators are kept, too: ranks of separators don't lead further left
        keep = (order % sampled == 0) | (s[order - 1] == 0)
        self.kept = np.where(keep, order, -1)
        self.n = len(s)

    def search(self, backward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that start with each phrase (columns, from the end)."""
        lo, hi = np.zeros(backward.shape[1], np.int64), np.full(backward.shape[1], self.n, np.int64)
        for c in backward:
            on = np.flatnonzero((c > 0) & (hi > lo))
            lo[on] = self.before[c[on]] + self.tree.rank(c[on], lo[on])
            hi[on] = self.before[c[on]] + self.tree.rank(c[on], hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes by their rows."""
        at, steps, todo = self.kept[rows], np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo := todo[at[todo] < 0]):
            c, r = self.tree.read(rows[todo])
            rows[todo] = self.before[c] + r
            steps[todo] += 1
            at[todo] = self.kept[rows[todo]]
        return at + steps


def occurrences(phrases: Phrases, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of all occurrences in a shard of documents as symbol arrays."""
    none = np.zeros(0, np.int64)
    total = sum(map(len, docs))
    if not total or not len(phrases.starts):
        return none, none, none
    s = np.concatenate([x for d in docs for x in (d, [0])])
    inside = s > 0
    # borders of the stretches between separators
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
    starts, ends = change[::2], change[1::2]
    long_ = ends - starts >= phrases.shortest
    starts, ends = starts[long_], ends[long_]
    if not len(starts):
        return none, none, none
    sizes = ends - starts + 1  # with the separator that follows
    places = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    index = FMIndex(s[places], len(phrases.ids) + 1)
    ats, windows = [], []
    # a window with a word that the shard lacks needs no search
    todo = phrases.present(s[places])
    for k in range(0, len(todo), SEARCHED):
        part = todo[k : k + SEARCHED]
        lo, hi = index.search(phrases.backward(part))
        counts = np.maximum(hi - lo, 0)
        windows.append(np.repeat(part, counts))
        ats.append(places[index.locate(np.arange(counts.sum()) + np.repeat(lo - (np.cumsum(counts) - counts), counts))])
    at, window = (np.concatenate(ats), np.concatenate(windows)) if ats else (none, none)
    first = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    doc = np.searchsorted(first, at, side="right") - 1
    return doc, at - first[doc], window


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as disjoint ones in order; touching spans join."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(a) else new
    return a[new], b[last]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ADDED = {
    "n_words": T.LongType(),
    "hit_words": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    "item_ids": T.ArrayType(T.StringType()),
}


def _mark(rows: DataFrame, block: Broadcast, text: str, keep: list[str], finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``keep`` and the added columns, which hold what earlier blocks found if they are there already.

    ``finish`` makes the rows that leave the task (of ``schema``) from these, in the same pass.
    """
    again = "hit_words" in rows.columns

    def judge(phrases: Phrases, held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        docs = [d for _, ds in held for d in ds]
        doc, at, window = occurrences(phrases, docs)
        order = np.argsort(doc, kind="stable")
        doc, at, window = doc[order], at[order], window[order]
        cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
        k = 0
        for batch, ds in held:
            spans, items = [], []
            for i in range(len(ds)):
                lo, hi = cuts[k], cuts[k + 1]
                k += 1
                a, b = at[lo:hi], at[lo:hi] + phrases.lengths[window[lo:hi]]
                known = {phrases.items[w] for w in set(phrases.item[window[lo:hi]].tolist())} - {None}
                if again:
                    old = batch.column("hit_words")[i].as_py()
                    a, b = np.array([*a, *(x["start"] for x in old)], np.int64), np.array([*b, *(x["end"] for x in old)], np.int64)
                    known.update(batch.column("item_ids")[i].as_py())
                a, b = merged(a, b)
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                items.append(sorted(known))
            added = [pa.array([len(d) for d in ds], pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, *ADDED])
            yield finish(out) if finish else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        known = phrases.ids.get
        held, size = [], 0
        for batch in batches:
            start, docs = 0, []
            for x in batch.column(text).cast(pa.binary()):
                w = words_of(x.as_py())
                d = np.fromiter((known(y, 0) for y in w), np.int64, len(w))
                docs.append(d)
                size += len(d)
                if size >= SHARD:
                    held.append((batch.slice(start, len(docs)), docs))
                    yield from judge(phrases, held)
                    start, docs, held, size = start + len(docs), [], [], 0
            if docs:
                held.append((batch.slice(start, len(docs)), docs))
        yield from judge(phrases, held)

    kept = [rows.schema[c] for c in keep]
    return rows.mapInArrow(tidied(run), schema or T.StructType([*kept, *(T.StructField(k, v) for k, v in ADDED.items())]))


def find(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """``keep`` of all rows with n_words, merged hit_words (word positions) and the item_ids found, which replace kept columns of these names."""
    keep = tuple(c for c in keep if c not in ADDED)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows, wide = docs.select(*dict.fromkeys((*keep, text))), list(dict.fromkeys((*keep, text)))
    # one block is held while the next is made, as the last pass has rows of its own form
    held, scratch = Phrases().packed(), Scratch(spark, "decontaminate")
    for k, block in enumerate(blocks_of(((r.item_id, r.text) for r in items.toLocalIterator()), BLOCK_WORDS)):
        if k:
            sent = spark.sparkContext.broadcast(held)
            rows = scratch.write(_mark(rows, sent, text, wide), f"pass-{k}")
            sent.destroy()  # the rows are written
            scratch.drop(f"pass-{k - 1}")
        held = block
    return _mark(rows, spark.sparkContext.broadcast(held), text, list(keep), finish, schema)


def cut(text: str, spans: list) -> str:
    """``text`` without the runs of words that ``spans`` name, and without the gap before each run."""
    found, out, at = list(WORD.finditer(text)), [], 0
    for s in spans:
        out.append(text[at : found[s["start"]].start()].rstrip(" "))
        at = found[s["end"] - 1].end()
    return "".join([*out, text[at:]])


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; other columns stay, ``n_chars`` is recounted."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]  # no clash with what is added
    at = names.index("text")

    def without(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column("hit_words").to_pylist()
        columns = [batch.column(c) for c in own]
        texts = columns[at].to_pylist()
        new = [cut(x, s) if s else x for x, s in zip(texts, spans, strict=True)]
        columns[at] = pa.array(new, columns[at].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([len(x) if s else n for x, s, n in zip(new, spans, columns[k].to_pylist(), strict=True)], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return find(spark, docs.toDF(*own), benchmark, keep=tuple(own), text=own[at], finish=without, schema=docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL = {
    "op2_decontaminate": f"""
WITH base AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
doc_words AS (SELECT rn, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM base),
docs AS (SELECT doc_id, rn, len(w)::BIGINT AS n_words FROM base),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[k:k + {WINDOW - 1}] AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS k FROM items WHERE len(w) > 0)),
keyed AS (SELECT *, array_to_string(phrase, ' ') AS p, len(phrase) AS n FROM windows),
grams AS (
  SELECT n, rn, pos, string_agg(word, ' ') OVER (PARTITION BY n, rn ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS p
  FROM doc_words, (SELECT DISTINCT n FROM keyed WHERE n = {WINDOW})),
shorter AS (
  SELECT n, rn, pos, list(word) OVER (PARTITION BY n, rn ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING)[1:n] AS ws
  FROM doc_words, (SELECT DISTINCT n FROM keyed WHERE n < {WINDOW})),
found AS (
  SELECT g.rn, g.pos, k.n, k.item_id FROM grams g JOIN keyed k ON g.p = k.p AND g.n = k.n
  UNION ALL
  SELECT s.rn, s.pos, k.n, k.item_id FROM shorter s JOIN keyed k ON s.ws = k.phrase AND s.n = k.n),
hits AS (SELECT rn, count(DISTINCT w) AS n_hit FROM (SELECT rn, unnest(range(pos, pos + n)) AS w FROM found) GROUP BY rn),
listed AS (SELECT rn, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS i FROM found) GROUP BY rn)
SELECT doc_id, n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rn) LEFT JOIN listed USING (rn)"""
}
