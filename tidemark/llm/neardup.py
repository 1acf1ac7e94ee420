"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Every element (a hashed five-word shingle) deals one value to each register along its own
pseudo-random order of the registers, the j-th value lying in [j, j + 1). Registers therefore
fill evenly, which lowers the variance against independent minima, and a document stops at the
first level that can't lower any register. Five registers make a band, 32 bands a signature; two
documents that are alike enough to be linked share no band with a probability of 7e-9 where
links begin at 85 %, as they do by default, and of 3e-6 where they begin at 80 %.

Rows of one band value meet in blocks of bounded size (a hot value is dealt over pairs of
blocks), where full signatures are compared and joined to stars by union-find. The components of
these stars are the candidate groups; within them, again in bounded pairs of blocks, sets are
rebuilt from the whole texts and compared exactly. No pair is ever a row: tasks return stars.
Documents with equal sets are one representative (the smallest id) from the start.

Defined results. Null text, or a text without words, has an empty set and is linked with nothing.
A text of any length has its whole set; one with more shingles than a block holds is a block's worth alone.
A null id can't be named in a component: the row keeps a null component and is kept. Rows that
share an id are one document: the links of all its texts count. An empty table gives an empty
result. Extra columns are kept by ``keep_one`` and ignored by ``groups``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import components, stars
from tidemark.llm.tables import Scratch, read, tidied

WIDTH, PERCENT = 5, 85
REGISTERS, BAND = 160, 5
#: Members of a block of signatures (some 200 bytes each); a band value with more is compared by pairs of blocks.
SIGNED_BLOCK = 1024
#: Members and shingles of a block of texts.
BLOCK, BLOCK_SHINGLES = 128, 2_000_000
#: Ids up to which the rows that go are broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000


def alike(percent: int) -> int:
    """Equal registers from which a pair may reach the similarity: their mean at it less six deviations."""
    p = percent / 100
    return round(REGISTERS * p - 6 * (REGISTERS * p * (1 - p)) ** 0.5)


#: A-Z lowered, white space to spaces; all other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when large, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole UTF-8 text; fewer words are one shingle."""
    found = (text or b"").translate(FOLD).split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * _ODD[1] + h[j : len(h) - size + 1 + j] * _ODD[j % len(_ODD)])
    return np.unique(out)


def super_min_hash(elements: np.ndarray, sizes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (documents x m) of the sets that ``elements`` holds one after the other."""
    n = len(sizes)
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    order = None
    for j in range(m):
        if j:
            # early stopping: a document whose registers are all below this level is done
            live = out.reshape(n, m).max(axis=1) >= np.uint64(j << 32)
            keep = live[doc]
            if not keep.any():
                break
            if not keep.all():
                elements, doc = elements[keep], doc[keep]
                order = order[keep] if order is not None else None
        x = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            register = first = pick
        else:
            if order is None:
                # the order's only change so far: the first pick took place 0's register
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
                first = ((mix(elements + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                order[np.arange(len(elements)), first] = 0
            rows = np.arange(len(elements))
            register = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, j]
        np.minimum.at(out, doc * m + register, np.uint64(j << 32) | (x >> np.uint64(32)))
    return out.reshape(n, m)


def band_keys(signatures: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each band (documents x bands)."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // band, band)
    out = np.broadcast_to(np.arange(m // band, dtype=np.uint64), (n, m // band)) * _ODD[0]
    for j in range(band):
        out = mix(out * _ODD[1] + parts[:, :, j] * _ODD[2])
    return out.view(np.int64)


def short(signatures: np.ndarray) -> np.ndarray:
    """One byte of each register, enough to compare by."""
    return (mix(signatures) & np.uint64(0xFF)).astype(np.uint8)


SIGNED = "doc_id long, set_key binary, n_shingles long, signature binary, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """Set size, key of the set, short signature and band keys of each document; one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            start = 0
            while start < len(texts):
                sets, total = [], 0
                while start + len(sets) < len(texts) and (not sets or total < 100_000):
                    sets.append(shingle_set(texts[start + len(sets)].as_py(), words))
                    total += len(sets[-1])
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in full], np.int64)
                signatures = super_min_hash(np.concatenate(full), sizes) if full else np.zeros((0, REGISTERS), np.uint64)
                at = iter(zip(short(signatures), band_keys(signatures), strict=True))
                marks = [next(at) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(sets)),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x and x[0].tobytes() for x in marks], pa.binary()),
                        pa.array([x and x[1] for x in marks], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_key", "n_shingles", "signature", "bands"],
                )
                start += len(sets)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), SIGNED)


def dealt(rows: DataFrame, key: str, blocks: str, member: str) -> DataFrame:
    """Rows copied to the pairs of blocks of their group that they belong to, as (key, lo, hi, side)."""
    own = F.pmod(F.xxhash64(key, member), F.col(blocks)).cast("int")
    placed = rows.withColumn("_own", own)
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return other.select("*", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") < F.col("_other")).alias("side")).drop("_own", "_other", blocks)


def gathered(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows by pairs of blocks, each pair whole and in order; the pairs of one group go to one task after the other, so a large group fills all evenly."""
    pair = F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")
    task = F.pmod(F.pmod(F.xxhash64(key), F.lit(tasks)) + pair.cast("long"), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions(key, "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], whole: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches cut at group borders; groups are bounded, so a piece is, too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        marks = [table.column(k).to_numpy() for k in keys]
        cut = len(table) - 1
        last = [m[-1] for m in marks]
        inside = np.logical_and.reduce([m == x for m, x in zip(marks, last, strict=True)])
        cut = int(np.argmax(inside))  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _borders(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    changed = np.zeros(len(table), bool)
    for k in keys:
        x = table.column(k).to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.cumsum(changed)


def _star_rows(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    far = root != np.arange(len(root))
    a, b = ids[far], ids[root[far]]
    apart = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], names=["a", "b"])


def _signature_stars(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    keys = ("band_key", "lo", "hi")
    for table in _groups(batches, keys):
        group, ids, side = _borders(table, keys), table.column("uid").to_numpy(), table.column("side").to_numpy(zero_copy_only=False)
        split = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), REGISTERS)
        size = int(np.bincount(group).max())
        a, b = [], []
        for d in range(1, size):
            i = np.flatnonzero((group[d:] == group[:-d]) & ~(split[d:] & (side[d:] == side[:-d])))
            if not len(i):
                continue
            i = i[(marks[i] == marks[i + d]).sum(axis=1) >= least]
            a.append(i)
            b.append(i + d)
        if a:
            # one document meets the same others in many bands: its rows are one node here
            known, node = np.unique(ids, return_inverse=True)
            yield _star_rows(known, stars(node[np.concatenate(a)], node[np.concatenate(b)], len(known)))


def shared_counts(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of membership matrices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1  # others add to no intersection
    row = np.repeat(np.arange(n), sizes)[shared]
    rank = np.cumsum(counts > 1) - 1
    col = rank[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n))
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        lo, hi = np.searchsorted(col, [start, start + columns])
        held = np.zeros((n, columns), np.float32)
        held[row[lo:hi], col[lo:hi] - start] = 1
        out += held @ held.T  # at most 2 ** 15 a product: exact
    return out.astype(np.int64)


def _exact_stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    held: list[tuple[int, bool, np.ndarray]] = []
    now = None

    def links() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        ids, side = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
        sizes = np.array([len(h[2]) for h in held], np.int64)
        both = shared_counts([h[2] for h in held])
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        if now[1] != now[2]:
            linked &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(linked, 1))
        yield _star_rows(ids, stars(a, b, len(ids)))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "lo", "hi", "uid", "side")]
        texts = batch.column("text").cast(pa.binary())
        for k, (c, lo, hi, uid, side) in enumerate(zip(*columns, strict=True)):
            if (c, lo, hi) != now:
                yield from links()
                held.clear()
                now = (c, lo, hi)
            s = shingle_set(texts[k].as_py(), words)
            if len(s):
                held.append((uid, side, s))
    yield from links()


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def link_stars(spark: SparkSession, docs: DataFrame, signed: DataFrame, reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Verified links (a, b) between representatives, enough to connect each group."""
    tasks = _tasks(spark)
    unique = scratch.write(
        signed.join(reps.select(F.col("rep"), F.col("set_key").alias("_key")), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_key")), "left_semi").select(F.col("doc_id").alias("uid"), "n_shingles", "signature", "bands"),
        "unique",
    )
    banded = unique.select("uid", F.explode("bands").alias("band_key"))
    # written apart, so that the join's hot keys can be split
    several = scratch.write(banded.groupBy("band_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band_key", F.ceil(F.col("n") / SIGNED_BLOCK).cast("int").alias("blocks")), "several")
    met = banded.join(several, "band_key").join(unique.select("uid", "signature"), "uid")
    candidates = (
        gathered(dealt(met, "band_key", "blocks", "uid"), "band_key", tasks).mapInArrow(tidied(partial(_signature_stars, least=alike(percent))), "a long, b long")
    )
    found = scratch.write(components(candidates, scratch, "candidates").join(unique.select(F.col("uid").alias("node"), "n_shingles"), "node"), "candidate-groups")
    sizes = scratch.write(
        found.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "candidate-sizes"
    )
    members = scratch.write(found.join(sizes, "component").select(F.col("node").alias("uid"), "component", "blocks"), "members")
    texts = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("uid")).drop("doc_id")
    exact = gathered(dealt(texts, "component", "blocks", "uid"), "component", tasks).mapInArrow(tidied(partial(_exact_stars, percent=percent)), "a long, b long")
    return components(exact, scratch, "links")


def groups(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``; links begin at ``percent`` of Jaccard similarity."""
    scratch = Scratch(spark, "neardup")
    signed = scratch.write(sign(docs), "signed")
    reps = scratch.write(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    found = scratch.write(link_stars(spark, docs, signed, reps, scratch, percent), "components")
    # rows that share an id are one document, so links run between ids, also those of equal sets
    named = signed.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    out = groups(spark, docs.select("doc_id", "text"), percent)
    gone = Scratch(spark, "neardup-gone").write(out.filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone"], "left_anti")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, read(spark, sf_dir, "documents"))


QUERIES = {"op4_neardup": op4_neardup}
SQL = {
    "op4_neardup": f"""
WITH RECURSIVE base AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
long_ AS (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS k FROM base WHERE len(w) >= {WIDTH}),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + {WIDTH - 1}], ' ') AS s FROM long_
  UNION SELECT doc_id, array_to_string(w, ' ') FROM base WHERE len(w) BETWEEN 1 AND {WIDTH - 1}),
sizes AS MATERIALIZED (SELECT b.doc_id, count(s) AS n FROM (SELECT DISTINCT doc_id FROM base) b LEFT JOIN shingles USING (doc_id) GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT base.doc_id, n::BIGINT AS n_shingles, c.component_id, base.doc_id = c.component_id AS kept
FROM base JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = base.doc_id"""
}
