"""Language-model scores by masked pseudo-likelihood.

Every token is predicted from the two words on each side of it, the token itself being masked. A
small network (an embedding of the word at each side, a hidden layer) predicts it by way of a tree
of two softmax levels, classes and the leaves of each class. The tree grows with the vocabulary:
it has about ``PER_ROOT`` leaves for each square root of the number of distinct words. The most
frequent words are leaves of their own, so the network predicts the word itself; rarer words share
leaves by their last ``ENDING`` bytes, and the network predicts the ending's leaf. Which word of such
a leaf it is, is told by the exact counts of all words over all documents, less the token's own
occurrence, as that is masked; a word that occurs nowhere else gets a small share of its leaf. A
document's score is the sum of the conditional log-probabilities of its tokens.

The network is trained in numpy on all documents: rows are dealt to tasks by a hash of id and text,
about ``TASK_TOKENS`` tokens a task, and sorted there. A row that is repeated in full trains it once (counts
have it as often as it occurs), so no id and text is too much for a task. Each task runs Adagrad
from the same start; a parameter is then averaged over the tasks by how often each used it.

Results do not hang on files, partitions or batches: what is added up over tasks are whole numbers (parameters
and log-probabilities in fixed point), and scores multiply hidden values and parameters in fixed
point of so few bits that their sums are exact in double precision, in whatever order a library adds.
 Words are counted in a table; only the words with leaves of their own
and the parameters are collected and broadcast, whose number grows with the square root of the
vocabulary. Rare words of documents meet their counts in a shuffle join; no rare word is hot, since
a frequent word is none of them. (They meet by 64-bit hashes.)

Defined results. Null text, or a text without words, has no tokens, a log-probability of 0 and a
null mean. A text of any length is scored whole. Words of equal counts take leaves in the order of
their bytes. Repeated rows count as often as they occur and score alike. An empty table trains
nothing and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import FOLD, words_of
from tidemark.llm.tables import Scratch, read, tidied

#: Leaves for each square root of the number of distinct words, and the part of them that rare words share.
PER_ROOT, SHARED = 2, 0.25
ENDING = 3
SIDES = (-2, -1, 1, 2)
HIDDEN, BATCH, RATE, SEED = 16, 16_384, 0.2, 20
TASK_TOKENS = 4_000_000
#: Bytes of texts that are split into words at once, and bytes of words that are held until they are counted and passed on.
PIECE, COUNTED = 1_000_000, 64_000_000
#: Tokens whose classes are computed at once: what they need stays in the processor's caches.
STRETCH = 2048
#: Fixed point of sums of parameters, of the factors of scores, and of the log-probabilities of rare words, in bits; the largest parameter of a score.
PARAMETER_BITS, SCORE_BITS, WORD_BITS, LARGEST = 24, 20, 30, 63.0
#: Repeats of a row from which repeats are dropped before rows are dealt to tasks, and not only after.
REPEATED = 1000
#: Occurrences that are added to those of each rare word, and once for all unseen ones.
ADDED = 0.1
#: Bytes that stand between words.
BETWEEN = bytes(b for b in range(256) if FOLD[b] == 32)
#: Seed of the 64-bit hashes by which rare words meet their counts (Spark's own).
HASHED = 42


@dataclass
class Tree:
    """Classes of ``side`` leaves each; the first leaves are words of their own."""

    side: int
    words: list[bytes]

    @property
    def leaves(self) -> int:
        return self.side * self.side

    @property
    def alone(self) -> int:
        return self.leaves - self.shared

    @property
    def shared(self) -> int:
        return max(1, int(self.leaves * SHARED))

    @classmethod
    def side_for(cls, distinct: int) -> int:
        return max(2, math.ceil(math.sqrt(PER_ROOT * math.sqrt(distinct))))

    def rows(self) -> int:
        """Parameter vectors: an embedding for each side and leaf (the last one lies outside of the text), classes, leaves, hidden bias."""
        return len(SIDES) * (self.leaves + 1) + self.side + self.leaves + 1


def split(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as ``words_of`` has them, in one array, and how many each text has."""
    joined = b" ".join(t or b"" for t in texts)
    inside = np.frombuffer(joined.translate(FOLD), np.uint8) != 32
    borders = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = borders[::2], borders[1::2] - borders[::2]
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(FOLD, BETWEEN))])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def in_pieces(texts: Iterable[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts by about ``PIECE`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or b"") + 1
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


class LeafOf:
    """Leaves of words."""

    def __init__(self, tree: Tree):
        self.tree, self.own = tree, pa.array(tree.words, pa.large_binary())

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.fill_null(pc.index_in(words, value_set=self.own), -1).to_numpy().copy()
        rare = np.flatnonzero(out < 0)
        endings = pc.binary_slice(words.take(pa.array(rare)), -ENDING).dictionary_encode()  # few differ
        leaves = np.array([self.tree.alone + zlib.crc32(e) % self.tree.shared for e in endings.dictionary.to_pylist()], np.int32)
        out[rare] = leaves[endings.indices.to_numpy()]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def rows() -> pa.RecordBatch:
            words, n = pc.value_counts(pa.chunked_array(held, pa.large_binary())).flatten()
            held.clear()
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), n], names=["word", "n"])

        for batch in batches:
            for texts in in_pieces(x.as_py() for x in batch.column("text").cast(pa.binary())):
                held.append(split(texts)[0])
                if sum(w.nbytes for w in held) > COUNTED:
                    yield rows()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """The parameters as one table of vectors, its parts being views of it."""

    def __init__(self, tree: Tree, table: np.ndarray | None = None):
        self.tree = tree
        if table is None:
            table = np.zeros((tree.rows(), HIDDEN + 1), np.float32)
            n = tree.rows() - 1
            table[:n, :HIDDEN] = np.random.default_rng(SEED).normal(0, 0.1, (n, HIDDEN))
        # arrays made here: numpy's indexed sums are several times slower on types that came by pickle
        self.table = np.zeros(table.shape, np.float32) + table
        self.parts(self.table)

    def parts(self, table: np.ndarray) -> list[np.ndarray]:
        e = len(SIDES) * (self.tree.leaves + 1)
        self.sides = table[:e].reshape(len(SIDES), self.tree.leaves + 1, -1)
        self.classes, self.inner, self.bias = table[e : e + self.tree.side], table[e + self.tree.side : -1], table[-1]
        return [self.sides, self.classes, self.inner, self.bias]

    def contexts(self, leaves: np.ndarray) -> np.ndarray:
        """Leaves at the side positions of each token (sides x tokens)."""
        reach = max(map(abs, SIDES))
        padded = np.full(len(leaves) + 2 * reach, self.tree.leaves, np.int32)
        padded[reach : reach + len(leaves)] = leaves
        return np.stack([padded[reach + s : reach + s + len(leaves)] for s in SIDES])

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """Hidden layer of contexts (sides x tokens), with a one behind it for the biases."""
        h = self.sides[0].take(x[0], axis=0)
        for k in range(1, len(SIDES)):
            h += self.sides[k].take(x[k], axis=0)
        h += self.bias
        np.tanh(h, out=h)
        h[:, HIDDEN] = 1
        return h

    def sorted(self, y: np.ndarray) -> np.ndarray:
        """The order of leaves; short numbers are sorted by counting."""
        return np.argsort(y.astype(np.uint16) if self.tree.leaves < 65_535 else y, kind="stable")

    def by_class(self, y: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(class, first, last + 1) of leaves that are sorted by class, a large class in several stretches."""
        cuts = np.searchsorted(y, np.arange(self.tree.side + 1) * self.tree.side).tolist()
        return ((k, lo, min(lo + STRETCH, cuts[k + 1])) for k in range(self.tree.side) for lo in range(cuts[k], cuts[k + 1], STRETCH))

    def scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probabilities of leaves y in contexts x."""
        order = self.sorted(y)
        x, y = x[:, order], y[order]
        h, rows, side = fixed(self.hidden(x).T), np.arange(len(y)), self.tree.side
        classes, inner = (fixed(np.clip(w, -LARGEST, LARGEST)) for w in (self.classes, self.inner))
        got, far = np.empty(len(y), np.float32), _far(classes, inner)

        def settle(lo: int, hi: int, w: np.ndarray, at: np.ndarray) -> np.ndarray:
            z = (w @ h[:, lo:hi]).astype(np.float32)
            if far:
                _bounded(z)
            chosen = z.ravel().take(at * (hi - lo) + rows[: hi - lo])
            np.exp(z, out=z)
            if hi - lo == 1:  # a single column would be added in pairs, and not in its order as in any wider table
                z = np.repeat(z, 2, axis=1)
            return chosen - np.log(z.sum(axis=0)[: hi - lo])

        for lo in range(0, len(y), STRETCH):
            got[lo : lo + STRETCH] = settle(lo, min(lo + STRETCH, len(y)), classes, y[lo : lo + STRETCH] // side)
        for k, lo, hi in self.by_class(y):
            got[lo:hi] += settle(lo, hi, inner[k * side : (k + 1) * side], y[lo:hi] - k * side)
        out = np.empty(len(y))
        out[order] = got
        return out


def fixed(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole multiples of 2 ** -SCORE_BITS.

    A product of one below 1 and one below 64 has 46 bits, and the sum of all of a hidden layer less than 53.
    """
    out = x.astype(np.float64, order="C")
    out *= 2.0**SCORE_BITS
    np.rint(out, out=out)
    out *= 2.0**-SCORE_BITS
    return out


def _bounded(z: np.ndarray) -> np.ndarray:
    """Exponentials of what is bounded stay finite without a shift."""
    return np.clip(z, -60, 60, out=z)


def _far(*parts: np.ndarray) -> bool:
    """Whether products of these vectors and a hidden layer, which is nowhere over 1, may need bounds."""
    return max(float(np.abs(w).sum(axis=1).max()) for w in parts) >= 60


class Trainer(Network):
    """Adagrad on the parameters, of which a step touches only those that its tokens use."""

    def __init__(self, tree: Tree, table: np.ndarray | None = None):
        super().__init__(tree, table)
        squares = np.full_like(self.table, 1e-6)
        self.uses = np.zeros(len(self.table), np.int64)
        held = self.parts(squares)
        self.sq_sides, self.sq_classes, self.sq_inner, self.sq_bias = held
        self.parts(self.table)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | slice, np.ndarray]]:
        """(parameters, squares, rows, gradient) of the summed loss of leaves y, sorted by class, in contexts x; rows are not repeated."""
        side, n = self.tree.side, self.tree.leaves + 1
        h = self.hidden(x)
        dh, of_classes, of_inner = np.empty_like(h), np.zeros_like(self.classes), np.zeros_like(self.inner)
        starts, far = np.arange(len(y)) * side, _far(self.classes, self.inner)
        # with ones in place of the biases, whose part of dh is not needed, one product has the sums of exponentials, too
        classes, inner = self.classes.copy(), self.inner.copy()
        classes[:, HIDDEN] = inner[:, HIDDEN] = 1

        def differences(lo: int, hi: int, w: np.ndarray, ones: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Gradients of the hidden layer and of w."""
            z = h[lo:hi] @ w.T
            if far:
                _bounded(z)
            np.exp(z, out=z)
            d = z @ ones
            total = d[:, HIDDEN].copy()
            z.ravel()[starts[: hi - lo] + at] -= total
            total = np.reciprocal(total, out=total)[:, None]
            d *= total
            d -= w.take(at, axis=0)
            return d, z.T @ (h[lo:hi] * total)

        for lo in range(0, len(y), STRETCH):
            hi = min(lo + STRETCH, len(y))
            dh[lo:hi], g = differences(lo, hi, self.classes, classes, y[lo:hi] // side)
            of_classes += g
        for k, lo, hi in self.by_class(y):
            at = slice(k * side, (k + 1) * side)
            d, g = differences(lo, hi, self.inner[at], inner[at], y[lo:hi] - k * side)
            dh[lo:hi] += d
            of_inner[at] += g
        dh *= 1 - h * h  # zero for the one behind
        found = [(self.classes, self.sq_classes, slice(None), of_classes), (self.inner, self.sq_inner, slice(None), of_inner)]
        columns = dh.T[:HIDDEN].astype(np.float64, order="C")
        for k in range(len(SIDES)):
            ids = np.flatnonzero(np.bincount(x[k], minlength=n))
            g = np.zeros((len(ids), HIDDEN + 1), np.float32)
            for c, column in enumerate(columns):
                g[:, c] = np.bincount(x[k], column, n)[ids]
            found.append((self.sides[k], self.sq_sides[k], ids, g))
        found.append((self.bias, self.sq_bias, slice(None), dh.sum(axis=0)))
        return iter(found)

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        order = self.sorted(y)
        for p, squares, rows, g in self.gradients(x[:, order], y[order]):
            squares[rows] += g * g
            p[rows] -= np.float32(RATE) * g / np.sqrt(squares[rows])
        n, e, side = self.tree.leaves + 1, len(SIDES) * (self.tree.leaves + 1), self.tree.side
        for k in range(len(SIDES)):
            self.uses[k * n : (k + 1) * n] += np.bincount(x[k], minlength=n)
        in_class = np.bincount(y // side, minlength=side)
        self.uses[e : e + side] += len(y)
        self.uses[e + side : -1] += np.repeat(in_class, side)
        self.uses[-1] += len(y)

    def train(self, texts: Iterator[np.ndarray]) -> None:
        """One pass over texts as arrays of leaves."""
        xs, ys, held = [], [], 0
        for y in texts:
            if not len(y):
                continue
            xs.append(self.contexts(y))
            ys.append(y)
            held += len(y)
            if held >= BATCH:
                x, y = np.concatenate(xs, axis=1), np.concatenate(ys)
                for k in range(0, held - held % BATCH, BATCH):
                    self.learn(x[:, k : k + BATCH], y[k : k + BATCH])
                xs, ys = [x[:, held - held % BATCH :]], [y[held - held % BATCH :]]
                held %= BATCH
        if held:
            self.learn(np.concatenate(xs, axis=1), np.concatenate(ys))


def fit_network(spark: SparkSession, docs: DataFrame, tree: Tree, tokens: int) -> Network:
    """The tasks' networks, averaged by how often each task used a parameter."""
    sent = spark.sparkContext.broadcast(tree)  # grows with the square root of the vocabulary
    xs = [f"x{i}" for i in range(HIDDEN + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, leaf_of = Trainer(sent.value), LeafOf(sent.value)

        def texts() -> Iterator[bytes]:
            last = None
            for b in batches:
                for row in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                    now = row[0], row[1].as_py()
                    if now != last:  # repeats stand together
                        yield now[1]
                    last = now

        def leaves() -> Iterator[np.ndarray]:
            for piece in in_pieces(texts()):
                words, sizes = split(piece)
                yield from np.split(leaf_of.of(words), np.cumsum(sizes)[:-1])

        own.train(leaves())
        used = np.flatnonzero(own.uses)
        for k in range(0, len(used), 10_000):
            at = used[k : k + 10_000]
            whole = np.rint(own.table[at].astype(np.float64) * 2**PARAMETER_BITS).astype(np.int64) * own.uses[at][:, None]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.uses[at]), *(pa.array(x) for x in whole.T)], names=["at", "uses", *xs])

    rows = docs.select("doc_id", "text").filter("text IS NOT NULL")
    most = rows.groupBy("doc_id", F.xxhash64("text")).count().agg(F.max("count")).first()[0] or 0
    rows = rows.distinct() if most > REPEATED else rows
    dealt = rows.repartition(max(1, -(-tokens // TASK_TOKENS)), "doc_id", "text").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    trained = dealt.mapInArrow(tidied(run), ", ".join(["at long, uses long", *(f"{x} long" for x in xs)]))
    # one row for each vector that any task used
    sums = trained.groupBy("at").agg(F.sum("uses").alias("uses"), *(F.sum(F.col(x).cast("decimal(20,0)")).cast("double").alias(x) for x in xs)).toArrow()
    out = Network(tree)
    if len(sums):
        out.table[sums.column("at").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in xs], axis=1) / sums.column("uses").to_numpy()[:, None] / 2**PARAMETER_BITS
    return out


@dataclass
class Model:
    network: Network
    #: Words that share leaves: h (hash of the word), n, leaf.
    rare: DataFrame
    #: By leaf: tokens and distinct words.
    shared: DataFrame


def leaf_of(word: Column, tree: Tree) -> Column:
    return (F.crc32(F.substring(word, -ENDING, ENDING)) % tree.shared + tree.alone).cast("int")


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> Model:
    words = scratch.write(count_words(docs), "words")
    distinct, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tree = Tree(Tree.side_for(distinct), [])
    top = words.orderBy(F.desc("n"), "word").limit(tree.alone).collect()  # about 3 times the square root of the vocabulary
    tree.words = [bytes(r.word) for r in top]
    rest = words.filter((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("word") > F.lit(top[-1].word)))) if top else words
    rare = scratch.write(rest.select(F.xxhash64("word").alias("h"), "n", leaf_of(F.col("word"), tree).alias("leaf")), "rare")
    shared = scratch.write(rare.groupBy("leaf").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")), "shared")
    return Model(fit_network(spark, docs, tree, tokens), rare, shared)


def inside(n: Column, tokens: Column, words: Column, own: int) -> Column:
    """Log-probability of a word within a shared leaf, without ``own`` occurrences of it."""
    seen = F.coalesce(n, F.lit(0)) - F.when(n.isNotNull(), own).otherwise(0)
    every = F.coalesce(tokens, F.lit(0)) - F.when(n.isNotNull(), own).otherwise(0)
    return F.log((seen + ADDED) / (every + ADDED * (F.coalesce(words, F.lit(0)) + 1)))


SCORED = "row long, {id}, n_tokens long, of_leaves double, rare array<struct<h: long, leaf: int, times: int>>"


def score_leaves(spark: SparkSession, docs: DataFrame, network: Network) -> DataFrame:
    """A number and the id of each row, its tokens, the sum of their leaves' log-probabilities, and its rare words."""
    sent = spark.sparkContext.broadcast((network.tree, network.table))  # grows with the square root of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, leaf = Network(*sent.value), LeafOf(sent.value[0])
        alone = net.tree.alone

        def settle(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            """Score texts together, each with its own borders."""
            words, sizes = split(texts)
            y = leaf.of(words)
            ends = np.cumsum(sizes)
            x = np.concatenate([net.contexts(t) for t in np.split(y, ends[:-1])], axis=1)
            each = [net.scores(x[:, k : k + BATCH], y[k : k + BATCH]) for k in range(0, len(y), BATCH)]
            every = np.concatenate([*each, [0.0]])
            sums = np.where(sizes > 0, np.add.reduceat(every, ends - sizes), 0.0)  # each document's own, in its order
            at = np.flatnonzero(y >= alone)
            known = words.take(pa.array(at)).dictionary_encode()
            # a document's words lie together: number of the document, then of the word
            pairs, first, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[at] << 32 | known.indices.to_numpy(), return_index=True, return_counts=True)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, HASHED) for w in known.dictionary.to_pylist()), np.uint64, len(known.dictionary)).view(np.int64)
            parts = [pa.array(hashes[pairs & 0xFFFFFFFF]), pa.array(y[at[first]]), pa.array(times.astype(np.int32))]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).astype(np.int32)), pa.StructArray.from_arrays(parts, names=["h", "leaf", "times"]))
            return pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), pa.array(sizes), pa.array(sums), lists], names=["row", "doc_id", "n_tokens", "of_leaves", "rare"]
            )

        for batch in batches:
            start = 0
            for texts in in_pieces(x.as_py() for x in batch.column("text").cast(pa.binary())):
                yield settle(batch.slice(start, len(texts)), texts)
                start += len(texts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(tidied(run), SCORED.format(id=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"))


def score(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every row under ``model``, or under a model of ``docs`` from which each token's own occurrence is taken out."""
    scratch = Scratch(spark, "lm")
    own = 0 if model else 1
    model = model or fit(spark, docs, scratch)
    scored = scratch.write(score_leaves(spark, docs, model.network), "scored")
    shared = F.broadcast(model.shared)  # a quarter of the leaves at most
    known = model.rare.join(shared, "leaf").select("h", inside(F.col("n"), F.col("tokens"), F.col("words"), own).alias("inside"))
    met = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(known, "h", "left")
    if not own:
        met = met.join(shared, "leaf", "left").withColumn("inside", F.coalesce("inside", inside(F.lit(None), F.col("tokens"), F.col("words"), 0)))
    # whole numbers, whose sum hangs on no order
    fixed = F.col("times").cast("decimal(10,0)") * F.round(F.col("inside") * 2**WORD_BITS).cast("long").cast("decimal(19,0)")
    within = met.groupBy("row").agg((F.sum(fixed).cast("double") / 2**WORD_BITS).alias("of_words"))
    log_prob = F.round(F.col("of_leaves") + F.coalesce("of_words", F.lit(0.0)), 6)
    return scored.drop("rare").join(within, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_score": op3_lm_score}
