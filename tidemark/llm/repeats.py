"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier. All documents count as
one text in the order of their ids, but no string crosses a document.

1. Every window of ``LENGTH`` bytes has an anchor, its smallest-hashed ``GRAM``-byte part, so equal
   windows have equal anchors at equal offsets. One scan lists the anchors with the stretch of
   bytes whose windows they own, as hashes only.
   Among the rows that a task holds at once, all but the first of equal stretches are known
   repeats; they skip the next step, so a stretch sends it few rows however frequent it is.
2. Sorted by anchor, stretch and place, the list streams through tasks: anchors that occur once go,
   all but the first of equal stretches are repeats as a whole, and anchors with different
   stretches stay open. The state is one row, so an anchor of any frequency passes.
3. The bytes of open stretches meet by anchor. The suffixes at their window starts are sorted; in
   suffix order, the previous and next suffixes that start at a smaller place give each one's
   longest previous factor, and those of ``LENGTH`` or more are repeats. An anchor with more than
   ``OPEN`` open stretches is dealt out further, by its windows' contents.
4. The spans of a document are merged and cut out of its bytes.

Defined results. Null text is empty. Texts of under ``LENGTH`` bytes lose nothing. Null ids come
first. Rows of equal id and text are one document and judged alike; different texts of one id are
ordered by checksum. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read, tidied

LENGTH, GRAM = 100, 32
#: Starts per piece of a scan; a longer text is scanned in pieces that overlap.
PIECE = 1 << 19
#: Open stretches of one anchor that are sorted together.
OPEN = 1_000
#: Window starts that a task sorts at once, at least.
SORTED = 60_000

_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M64 = 0xFFFFFFFFFFFFFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of a piece, by prefix sums over powers of an odd number."""

    def __init__(self, most: int):
        self.tables = [(_powers(p, most + 1), _powers(pow(p, -1, 1 << 64), most + 1)) for p in (_P, _Q)]

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.tables[which][0][: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, which: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (sums[end] - sums[start]) * self.tables[which][1][: len(sums)][start]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running leasts of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first owned start, owned starts and stretch hash of all windows of ``data``."""
    first, second = hashes.sums(data, 0), hashes.sums(data, 1)
    grams = len(data) - GRAM + 1
    value = _mix(hashes.spans(first, 0, slice(0, grams), slice(GRAM, GRAM + grams)))
    bits = np.uint64(PIECE.bit_length() + 1)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # equal values: the leftmost, by the place in the low bits
    placed = (value & ~mask) | np.arange(grams, dtype=np.uint64)
    at = (_sliding_least(placed, LENGTH - GRAM + 1) & mask).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.concatenate([start, [len(at)]]))
    anchor = at[start]
    end = start + count - 1 + LENGTH
    whole = hashes.spans(second, 1, start, end)
    stretch = _mix(whole + _mix((anchor - start).astype(np.uint64) * np.uint64(_P) + count.astype(np.uint64)))
    return value[anchor].view(np.int64), start, count, (stretch << np.uint64(7) | count.astype(np.uint64)).view(np.int64)


LISTED = "known boolean, anchor long, stretch long, doc_id long, place long"


def list_anchors(docs: DataFrame) -> DataFrame:
    """One row per anchor: hashes, document and place (checksum and first owned start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(PIECE + LENGTH)
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[list[np.ndarray]] = [[], [], [], []]
            size = 0

            missing, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.lexsort((number, ~missing))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (number[order][1:] != number[order][:-1]) | (missing[order][1:] != missing[order][:-1])]))[: len(order)]

            def rows() -> pa.RecordBatch:
                a, s, k, p = (np.concatenate(x) for x in out)
                order = np.lexsort((p, rank[k], s, a))
                a, s, k, p = a[order], s[order], k[order], p[order]
                again = np.concatenate([[False], (a[1:] == a[:-1]) & (s[1:] == s[:-1])])
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(a))))
                twice = again & (rank[k] == rank[k[first]]) & (p == p[first])  # a repeated row of the table
                a = np.where(again, _mix((p + k).view(np.uint64)).view(np.int64), a)  # known repeats go anywhere
                keep = pa.array(~twice)
                return pa.RecordBatch.from_arrays([pa.array(again), pa.array(a), pa.array(s), ids.take(pa.array(k)), pa.array(p)], names=["known", "anchor", "stretch", "doc_id", "place"]).filter(keep)

            for k, x in enumerate(batch.column("text").cast(pa.binary())):
                raw = x.as_py() or b""
                if len(raw) < LENGTH:
                    continue
                crc, data = zlib.crc32(raw) - (1 << 31), np.frombuffer(raw, np.uint8)
                for begin in range(0, len(raw) - LENGTH + 1, PIECE):
                    a, s, n, h = anchors(data[begin : begin + PIECE + LENGTH - 1], hashes)
                    for o, v in zip(out, (a, h, np.full(len(a), k), (s + begin) + (crc << 32)), strict=True):
                        o.append(v)
                    size += len(a)
                    del n
                if size > 100_000:
                    yield rows()
                    out, size = [[], [], [], []], 0
            if size:
                yield rows()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), LISTED)


FOUND = "doc_id long, crc long, start long, n long, anchor long, open boolean"


def _same_document(rows: pa.RecordBatch, other: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Where rows and the rows of ``other`` (as many, or one) agree in doc_id (null or not) and the columns."""
    out = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False) == other.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    out &= rows.column("doc_id").fill_null(0).to_numpy() == other.column("doc_id").fill_null(0).to_numpy()
    for c in columns:
        out = out & (rows.column(c).to_numpy() == other.column(c).to_numpy())
    return out


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats and open stretches of rows sorted by known, anchor, stretch, doc_id and place."""
    top: pa.RecordBatch | None = None  # the first row of the current stretch
    alone = False  # whether that stretch is its anchor's only one so far, and so not yet given out

    def shaped(rows: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
        place, stretch = rows.column("place").to_numpy(), rows.column("stretch").to_numpy()
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array((place >> 32) + (1 << 31)), pa.array(place & 0xFFFFFFFF), pa.array(stretch & 127), rows.column("anchor"), pa.array(np.full(len(rows), open_))],
            names=["doc_id", "crc", "start", "n", "anchor", "open"],
        )

    for batch in batches:
        border = int(np.searchsorted(batch.column("known").to_numpy(zero_copy_only=False), True))
        if border < len(batch):
            yield shaped(batch.slice(border), False)
        batch = batch.slice(0, border)
        if not len(batch):
            continue
        anchor, stretch = batch.column("anchor").to_numpy(), batch.column("stretch").to_numpy()
        before = (top.column("anchor").to_numpy()[0], top.column("stretch").to_numpy()[0]) if top is not None else None
        new_anchor = np.concatenate([[before is None or anchor[0] != before[0]], anchor[1:] != anchor[:-1]])
        new_stretch = new_anchor | np.concatenate([[before is None or stretch[0] != before[1]], stretch[1:] != stretch[:-1]])
        firsts = np.flatnonzero(new_stretch)
        repeats = np.flatnonzero(~new_stretch)
        if len(repeats):
            # repeated rows of the table are one document: the first row again is no repeat of it
            at = np.searchsorted(firsts, repeats, side="right") - 1
            rows = batch.take(pa.array(repeats))
            tops = batch.take(pa.array(firsts[np.maximum(at, 0)])) if len(firsts) else batch.slice(0, 1)
            twice = _same_document(rows, tops, ("place",)) & (at >= 0)
            if top is not None:
                twice |= _same_document(rows, top, ("place",)) & (at < 0)
            if not twice.all():
                yield shaped(rows.filter(pa.array(~twice)), False)
        if len(firsts):
            begins = new_anchor[firsts]
            follows = np.concatenate([~begins[1:], [False]])
            if alone and not begins[0]:
                yield shaped(top, True)
            # open if the anchor has another stretch, before or after
            open_ = ~begins | follows
            if open_.any():
                yield shaped(batch.take(pa.array(firsts[open_])), True)
            top, alone = batch.slice(int(firsts[-1]), 1), bool(begins[-1])


PACKED = "doc_id long, crc long, packed binary"


def pack(docs: DataFrame) -> DataFrame:
    """Documents with checksum and compressed bytes, for joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([squeeze.compress(x) for x in raw], pa.binary())], names=["doc_id", "crc", "packed"]
            )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), PACKED)


def _unpacked(x: bytes, squeeze: zstandard.ZstdDecompressor) -> bytes:
    return squeeze.decompress(x) if x else b""


CUT = "hot boolean, key binary, doc_id long, crc long, start long, n long, bytes binary"


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of open stretches with their bytes; those of crowded anchors as single windows without."""
    squeeze = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        size = 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            hot, key, doc, crc, start, n, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(hot), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
                names=["hot", "key", "doc_id", "crc", "start", "n", "bytes"],
            )

        for doc, crc, packed, opened in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "crc", "packed", "opened")), strict=True):
            raw = _unpacked(packed, squeeze)
            for x in opened:
                if x["hot"]:
                    for s in range(x["start"], x["start"] + x["n"]):
                        rows.append((True, xxhash.xxh128_digest(raw[s : s + LENGTH]), doc, crc, s, 1, None))
                else:
                    rows.append((False, x["anchor"].to_bytes(8, "big", signed=True), doc, crc, x["start"], x["n"], raw[x["start"] : x["start"] + x["n"] - 1 + LENGTH]))
            size += len(opened)
            if size > 10_000:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)


def previous_factors(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factors, up to the rows' width, of suffixes given as fixed-width rows.

    ``place`` orders the suffixes in the text; equal places are one suffix listed twice. In suffix
    order, the nearest suffixes on both sides with a smaller place hold the longest match that
    starts earlier; both are found for all suffixes at once by jumping over larger places.
    """
    n, width = data.shape
    order = np.argsort(np.ascontiguousarray(data).view(f"S{width}").ravel(), kind="stable")
    rows, at = data[order], place[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width).astype(np.int64)
    best = np.zeros(n, np.int64)
    for flip in (False, True):
        a, common = (at[::-1], lcp[::-1]) if flip else (at, lcp)
        before = np.arange(n) - 1
        least = np.concatenate([[0], common])  # the common prefix with the suffix that ``before`` names
        todo = np.flatnonzero((before >= 0) & (least > 0))
        while len(todo := todo[(a[before[todo]] >= a[todo]) & (least[todo] > 0)]):
            b = before[todo]
            least[todo] = np.minimum(least[todo], least[b])
            before[todo] = before[b]
            gone = before[todo] < 0
            least[todo[gone]] = 0
            before[todo[gone]] = 0
        factor = np.where(before >= 0, least, 0)
        np.maximum(best, factor[::-1] if flip else factor, out=best)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


SPANS = "doc_id long, crc long, a long, b long"


def _factor_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats among rows sorted by hot, key, doc_id, crc and start."""
    held: list[pa.RecordBatch] = []
    starts, last = 0, None  # window starts held; the first row of the current window's contents

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column("key").to_pylist()
        group = np.cumsum([0, *(x != y for x, y in zip(keys[1:], keys, strict=False))])
        doc = table.column("doc_id")
        missing, ids = doc.is_null().to_numpy(), doc.fill_null(0).to_numpy()
        crc, start, n = (table.column(c).to_numpy() for c in ("crc", "start", "n"))
        changed = np.concatenate([[False], (ids[1:] != ids[:-1]) | (crc[1:] != crc[:-1]) | (missing[1:] != missing[:-1]) | (group[1:] != group[:-1])])
        rank = np.cumsum(changed)  # rows come in the order of documents within a group
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        size = n - 1 + LENGTH
        offset = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[offset[row] + k]
        # groups are told apart by four bytes in front
        named = np.concatenate([group[row].astype(">u4").view(np.uint8).reshape(-1, 4), windows], axis=1)
        repeat = previous_factors(named, (rank[row] << 32) + start[row] + k) >= LENGTH + 4
        # runs of repeated starts in a stretch are one span
        on = np.flatnonzero(repeat)
        if not len(on):
            return
        first = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])])
        final = np.concatenate([first[1:], [True]])
        a, b = on[first], on[final]
        yield pa.RecordBatch.from_arrays(
            [doc.combine_chunks().take(pa.array(row[a])), pa.array(crc[row[a]]), pa.array(start[row[a]] + k[a]), pa.array(start[row[b]] + k[b] + LENGTH)], names=["doc_id", "crc", "a", "b"]
        )

    def windows(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal last
        keys = table.column("key").to_pylist()
        again = np.array([x == y for x, y in zip(keys, [last and last.column("key")[0].as_py(), *keys[:-1]], strict=True)])
        firsts, repeats = np.flatnonzero(~again), np.flatnonzero(again)
        if len(repeats):
            at = np.searchsorted(firsts, repeats, side="right") - 1
            rows = table.take(pa.array(repeats))
            tops = table.take(pa.array(firsts[np.maximum(at, 0)])) if len(firsts) else table.slice(0, 1)
            twice = _same_document(rows, tops, ("crc", "start")) & (at >= 0)
            if last is not None:
                twice |= _same_document(rows, last, ("crc", "start")) & (at < 0)
            rows = rows.filter(pa.array(~twice))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("crc"), rows.column("start"), pa.array(rows.column("start").to_numpy() + LENGTH)], names=["doc_id", "crc", "a", "b"])
        if len(firsts):
            last = table.slice(int(firsts[-1]), 1)

    for batch in batches:
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        border = int(np.searchsorted(hot, True))
        if border:
            held.append(batch.slice(0, border))
            starts += int(batch.slice(0, border).column("n").to_numpy().sum())
            if starts >= SORTED:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_pylist()
                cut = next((i + 1 for i in range(len(keys) - 2, -1, -1) if keys[i] != keys[-1]), 0)
                if cut:  # the last anchor may go on
                    yield from judge(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    starts = int(table.slice(cut).column("n").to_numpy().sum())
        if border < len(batch):
            yield from windows(batch.slice(border))
    if held:
        yield from judge(pa.Table.from_batches(held))


def spans_of(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, crc and spans (array of start and end) of the documents that lose bytes."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("known", "anchor", "stretch", "doc_id", "place")
    found = scratch.write(list_anchors(docs).repartition(tasks, "anchor").sortWithinPartitions(*order).mapInArrow(tidied(_sift), FOUND), "found")
    opened = found.filter("open").select("doc_id", "crc", "start", "n", "anchor")
    crowded = scratch.write(opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > OPEN).select("anchor", F.lit(True).alias("hot")), "crowded")
    per_doc = (
        opened.join(crowded, "anchor", "left")
        .groupBy("doc_id", "crc")
        .agg(F.collect_list(F.struct("anchor", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("opened"))
        .select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "opened")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc"))
    # equal rows are one document: their stretches count once
    cut = pack(docs).join(per_doc, same).select("doc_id", "crc", "packed", "opened").mapInArrow(tidied(_cut_stretches), CUT)
    keys = ("hot", "key", "doc_id", "crc", "start")
    factors = cut.repartition(tasks, "hot", "key").sortWithinPartitions(*keys).mapInArrow(tidied(_factor_spans), SPANS)
    repeats = found.filter("NOT open").select("doc_id", "crc", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("b"))
    return repeats.unionByName(factors).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def kept_bytes(spark: SparkSession, docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """One row per document: sizes, number of maximal removed runs, digest of what is kept (and, if asked for, the bytes)."""
    from tidemark.llm.decontaminate import merged

    scratch = Scratch(spark, "repeats")
    spans = spans_of(spark, docs, scratch).select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "spans")
    joined = pack(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")), "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "spans")), strict=True):
                raw = _unpacked(packed, squeeze)
                a, b = merged(np.array([x["a"] for x in found or []], np.int64), np.array([x["b"] for x in found or []], np.int64))
                cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((doc, len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return joined.mapInArrow(tidied(run), RESULT)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_bytes(spark, read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op6_repeats": op6_repeats}
SQL = {
    "op6_repeats": f"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS s FROM h WHERE length(h) >= {2 * LENGTH})),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM starts) WHERE r > 1),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id),
kept AS (
  SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(len(a), 0) AS n_spans,
    CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * coalesce(b[i], 0) + 1, 2 * (coalesce(a[i + 1], length(h) // 2) - coalesce(b[i], 0)))), '') END AS left_
  FROM h LEFT JOIN cuts USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, (n_bytes - length(left_) // 2)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(left_)) AS kept_sha256 FROM kept"""
}
