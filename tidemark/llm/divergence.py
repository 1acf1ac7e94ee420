"""Source divergence audit: how far the term shares of a language's sources lie apart.

One scan counts terms per document and source; only counts move. The kept counts of a language
are cut into tiles: a block of terms by two blocks of sources, as dense int64 matrices. A tile
compares all its pairs of sources at once by broadcasting and returns its part of the pair matrix
and, for each source, its best terms. Spark adds the partial matrices and merges the best terms.

A tile holds ``TERMS`` terms on average by at most about ``SOURCES`` sources on each side, whatever
the corpus: more terms or sources give more tiles. Terms and sources are dealt by hash, so one hot
language or source is spread over all blocks. A source's N and its language's totals come with the
tile as one row for each source. The driver gets two numbers, the numbers of blocks.

Defined results. Null text, lang and source are ''. A source without terms, or a language that
keeps none, has pairs of value 0 and no term rows. A language of one source has no pairs. Rows are
documents: repeated rows count as often as they occur, null ids too. Texts are read whole. Ties go
by the item's bytes. An empty table gives an empty result. Extra columns are ignored. Shares are
exact up to 2 ** 53 occurrences in a group (``share``); a sum over terms stays below 2 ** 63.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read, tidied

#: Documents of its language that a kept term occurs in, and terms listed for a source (both of the contract).
LEAST_DOCS, BEST = 3, 200
#: Terms and sources of a tile, on average.
TERMS, SOURCES = 1024, 64
#: Entries a task counts before it hands them on, some 200 bytes each.
HELD, DOC = 300_000, 1 << 40
#: Bytes to what separates or spells words: A-Z lower-cased, all bytes of characters beyond ASCII kept.
SPELL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * count / total), where count <= total, by long division in three digits at a time."""
    whole, rest = np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(count, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        whole, rest = whole * 1000 + digit, rest - digit * total
    return whole + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q)."""
    d = p - q
    return d * d // q


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), several rows for a term; a null term for each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # both counts in one number: documents above DOC, occurrences below
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                both = np.fromiter(counts.values(), np.int64, len(counts))
                terms = list(counts)
                for k in range(0, max(1, len(terms)), 20_000):
                    part, some = both[k : k + 20_000], [*terms[k : k + 20_000], None]
                    columns = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                    numbers = [pa.array(np.append(x, 0)) for x in (part % DOC, part // DOC)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, batch.column("text")):
                counts = held.setdefault((lang, source), {})
                before, words = len(counts), Counter(text.as_py().translate(SPELL).split())
                for term, n in words.items():
                    counts[term] = counts.get(term, 0) + n + DOC
                size += len(counts) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    part = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return part.mapInArrow(tidied(run), "lang string, source string, term string, n long, d long")


def tile(rows: pa.Table) -> pa.Table:
    """Partial pair sums and best terms of one tile (see ``tiles``)."""
    lang, block, side_a, side_b = (rows.column(c)[0].as_py() for c in ("lang", "block", "side_a", "side_b"))
    head = rows.filter(pc.is_null(rows.column("term")))
    body = rows.filter(pc.is_valid(rows.column("term")))
    names = np.array([x.encode() for x in head.column("source").to_pylist()], object)
    order = np.argsort(names)
    names, total, side = names[order], head.column("n").to_numpy()[order], head.column("side").to_numpy()[order]
    kept_terms, lang_total = head.column("vocabulary")[0].as_py(), head.column("lang_n")[0].as_py()
    found = body.column("term").combine_chunks().dictionary_encode()
    terms = np.array([x.encode() for x in found.dictionary.to_pylist()], object)
    by_bytes = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[by_bytes] = np.arange(len(terms))
    terms, column = terms[by_bytes], place[found.indices.to_numpy(zero_copy_only=False)]
    row = np.searchsorted(names, np.array([x.encode() for x in body.column("source").to_pylist()], object)) if len(body) else np.zeros(0, np.int64)
    count, lang_count = np.zeros((len(names), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    count[row, column] = body.column("n").to_numpy()
    lang_count[column] = body.column("lang_n").to_numpy()
    p = share(count + 1, (total + kept_terms)[:, None]) if len(terms) else count
    out = []
    a, b = np.flatnonzero(side == side_a), np.flatnonzero(side == side_b)
    forth, back = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
    width = max(1, 1_000_000 // max(1, len(a) * len(b)))
    # a kept term that no source of the tile has is no column: it counts as the share of nothing for
    # all kept terms, added once (in block 0), less those of the columns
    nothing = share(np.ones(len(names), np.int64), total + kept_terms) if kept_terms else np.zeros(len(names), np.int64)
    missed = (kept_terms if block == 0 else 0) - len(terms)
    if kept_terms:
        one, two = nothing[a][:, None], nothing[b][None, :]
        forth += missed * gain(one, two)
        back += missed * gain(two, one)
    for k in range(0, len(terms), width):
        one, two = p[a, k : k + width][:, None, :], p[b, k : k + width][None, :, :]
        forth += gain(one, two).sum(2)
        if side_a != side_b:
            back += gain(two, one).sum(2)
    i, j = np.nonzero(a[:, None] != b[None, :])
    out.append((names[a[i]], "pair", names[b[j]], forth[i, j]))
    if side_a != side_b:
        out.append((names[b[j]], "pair", names[a[i]], back[i, j]))
    elif len(terms):
        q = share(lang_count + 1, np.int64(lang_total + kept_terms))
        for s in a:
            at = np.flatnonzero((count[s] > 0) & (p[s] > q))
            value = gain(p[s, at], q[at])
            best = np.argsort(-value, kind="stable")[:BEST]  # terms stand in the order of their bytes
            out.append((np.repeat(names[s : s + 1], len(best)), "term", terms[at[best]], value[best]))
    text = lambda k: pa.array([x.decode() for part in out for x in part[k]], pa.string())
    n = sum(len(x[3]) for x in out)
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()), "source": text(0), "part": pa.array([x[1] for x in out for _ in x[3]], pa.string()),
        "item": text(2), "value": pa.array(np.concatenate([x[3] for x in out]), pa.int64()),
    })


def kept_counts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, term, n, lang_n, first (true in one row of each term) of kept terms, and a row of null term for each source."""
    sums = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    known = sums.select(
        "lang", "source", "term", "n", F.sum("d").over(of_term).alias("d"), F.sum("n").over(of_term).alias("lang_n"),
        (F.col("source") == F.min("source").over(of_term)).alias("first"),
    )
    return scratch.write(known.filter(F.col("term").isNull() | (F.col("d") >= LEAST_DOCS)).drop("d"), "kept")


def tiles(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of tiles (lang, block, side_a, side_b): kept counts, and a row of null term for each source with its N and its language's totals."""
    groups = scratch.write(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("vocabulary")), "groups"
    )
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("vocabulary").alias("vocabulary"), F.count(F.lit(1)).alias("sources"))
    most = langs.agg(F.max("vocabulary"), F.max("sources")).first()
    blocks, sides = -(-(most[0] or 1) // TERMS) or 1, -(-(most[1] or 1) // SOURCES) or 1
    side = F.pmod(F.xxhash64("source"), F.lit(sides)).cast("int").alias("side")
    body = kept.filter("term IS NOT NULL").select("lang", "source", "term", "n", "lang_n", F.lit(None).cast("long").alias("vocabulary"), side, F.pmod(F.xxhash64("term", F.lit(7)), F.lit(blocks)).alias("block"))
    head = groups.drop("vocabulary").join(langs.drop("sources"), "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "n", "lang_n", "vocabulary", side, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    met = body.unionByName(head).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    return met.withColumns({"side_a": F.least("side", "other"), "side_b": F.greatest("side", "other")}).drop("other")


def audit(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources of a language, and each source's best terms."""
    scratch = Scratch(spark, "divergence")
    parts = tiles(kept_counts(docs, scratch), scratch).groupBy("lang", "block", "side_a", "side_b").applyInArrow(tile, "lang string, source string, part string, item string, value long")
    # a term is in one tile of its source's own side, a pair in one tile of each block
    sums = scratch.write(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "sums")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = sums.filter("part = 'pair'").withColumn("rank", rank)
    terms = sums.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= BEST)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, read(spark, sf_dir, "documents"))


def op11_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda count, total: f"(1 + (1000000000::HUGEINT * ({count} + 1)) // ({total} + v))"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
langs AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
sized AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM langs GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN langs USING (lang, term) GROUP BY ALL),
totals AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, l.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "t.total")} AS p, {p("l.lang_n", "z.lang_total")} AS q
  FROM totals t JOIN sized z USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = l.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM sized)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {BEST}"""


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {"op11_source_divergence": op11_sql()}
