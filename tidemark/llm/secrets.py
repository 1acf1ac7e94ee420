"""Secret scans: fixed patterns plus the novelty of strings under a primed zstandard compressor.

Base patterns (leftmost, non-overlapping within a kind) report assignments, access ids and long
hexadecimal runs. The novelty rule adds token-like strings in a sensitive context. Its dictionary
is made of the words of code and identifiers: a fixed list of common ones, and the most frequent
words that stand around sensitive words anywhere in the documents, counted over all of them. With
that dictionary the text around a candidate is compressed with and without it, and the bytes that
it alone adds are counted. Prose and known identifiers add few bytes for their length, random
strings three quarters of a byte a character or more.

A context is sensitive within ``REACH`` characters on both sides of a sensitive word; candidates
there have ``LEAST_NOVEL`` characters or more. A string that such a word names directly (``is``,
``=``, ``:``) is a candidate from ``LEAST_NAMED`` characters on, against a higher threshold. Hosts,
paths, dates and other names made of words and short numbers are none (``is_name``), and
strings of digits alone are only where they are named.

Defined results. Null or empty text has no spans. Positions are code points, end exclusive.
A text of any length is searched whole, in time that grows with its length. Repeated rows have the
same spans. Words of equal counts enter the dictionary by name. Extra columns are kept by ``scan``
and ``redact`` and ignored by ``report``. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.decontaminate import merged
from tidemark.llm.tables import read, tidied

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)  # a shorter maximal run can't hold a match
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Words that make what lies within REACH characters sensitive. ``auth`` and the like must end where they end: "author" and "secretary" are other words.
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)|secrets?(?!(?-i:[a-z]))|tokens?(?!(?-i:[a-z]))|api.?key|credential|private.?key|bearer(?!(?-i:[a-z]))|authorization|signature|client.?id(?!(?-i:[a-z]))|access.?key"
    r"|(?<![A-Za-z])o?auth(?!(?-i:[a-z]))|(?-i:(?<=[a-z])Auth)(?!(?-i:[a-z]))", re.ASCII | re.IGNORECASE | re.DOTALL,
)
REACH = 128
LEAST_NOVEL, LEAST_NAMED = 16, 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_NOVEL},}}", re.ASCII)
#: What stands between a sensitive word and the string that it names.
NAMED = re.compile(rf"""["']?\s{{0,4}}(?:is|was|:=|=>|=|:)\s{{0,4}}["']?([A-Za-z0-9+/_.=-]{{{LEAST_NAMED},}})""", re.ASCII)
#: Parts of hosts, paths, versions, dates and other dotted or hyphened names: a word, a few digits, or a word with a few digits behind it.
NAME_PART = re.compile(r"[A-Za-z]{0,20}[0-9]{0,4}", re.ASCII)
SPLIT = re.compile(r"[./=+-]+")
DIGITS = re.compile(r"[0-9./_=+-]+", re.ASCII)
#: Words put together by their capitals, as identifiers are.
CAMEL = re.compile(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,})+[0-9]{0,4}", re.ASCII)
#: A candidate's own bytes for each of its characters, from which it counts as incompressible.
NOVELTY, NAMED_NOVELTY = 0.7, 0.85
#: Characters on each side that are compressed with a candidate.
AROUND = 64

#: Words of the documents in the dictionary, most frequent first, and bytes of the dictionary.
WORDS, DICTIONARY_BYTES = 4096, 16_000
WORD = re.compile(r"[^\W\d_]{3,}")
LONGEST_WORD = 20
COMMON = (
    "the and for with that this from have not are was were been which their there would about could should "
    "der die das und ist nicht mit von für eine les des est dans pour que une avec los las del para con por "
    "import from return def class self None True False public private static void final const var let function "
    "string int float bool null undefined async await export default require module include namespace template "
    "username password passwd secret token apikey access client authorization bearer "
    "signature credential private public key certificate session cookie header request response config configuration "
    "environment variable localhost example com https www http json yaml xml html usr local bin home name "
    "get element add event listener string value hash code equals iterator connection database "
    "select insert update delete where group order limit index primary foreign table column"
).split()


def trained(words: list[tuple[str, int]], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary made of words and their counts: a word comes the oftener the higher its count, but by logarithm."""
    counts = Counter({w: 1 << 15 for w in COMMON})
    counts.update(dict(words))
    order, deal = sorted(counts), random.Random(0)
    lines: list[bytes] = []
    for k in range(16):
        now = [w for w in order if (counts[w] + 1).bit_length() > k]
        deal.shuffle(now)
        lines += [" ".join(now[i : i + 12]).encode() for i in range(0, len(now), 12)]
    return zstandard.train_dictionary(min(size, sum(map(len, lines)) // 8), lines, k=64, d=8, level=3).as_bytes()


@functools.cache
def common_dictionary() -> bytes:
    return trained([])


class Novelty:
    """Marginal compressed sizes under the dictionary."""

    def __init__(self, dictionary: bytes | None = None):
        primed = zstandard.ZstdCompressionDict(dictionary or common_dictionary(), dict_type=zstandard.DICT_TYPE_FULLDICT)
        # the fast strategy keeps to the dictionary's code of letters, so sizes grow evenly with the text
        how = zstandard.ZstdCompressionParameters.from_level(
            1, source_size=1024, dict_size=len(primed), strategy=zstandard.STRATEGY_FAST, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        primed.precompute_compress(compression_params=how)
        self.packer = zstandard.ZstdCompressor(compression_params=how, dict_data=primed)

    def added(self, before: str, candidate: str, after: str) -> int:
        """Bytes that ``candidate`` adds to the compressed text around it."""
        around = len(self.packer.compress((before + after).encode(errors="replace")))
        return len(self.packer.compress((before + candidate + after).encode(errors="replace"))) - around

    def incompressible(self, text: str, a: int, b: int, threshold: float) -> bool:
        return self.added(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) >= threshold * (b - a)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def is_name(candidate: str, named: bool) -> bool:
    """Whether a string is put together of words and short numbers (hosts, paths, versions), or only of digits and nobody named it."""
    if DIGITS.fullmatch(candidate):
        return not named
    if CAMEL.fullmatch(candidate):
        return True
    parts = [p for p in SPLIT.split(candidate) if p]
    # any other string without separators is no name, whatever its letters
    return len(parts) > 1 and all(NAME_PART.fullmatch(p) and (len(p) < LEAST_NAMED or p.islower() or p.istitle() or p.isupper()) for p in parts)


class Places:
    """Disjoint spans in order, asked whether one of them touches a stretch of text."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def touch(self, a: int, b: int) -> bool:
        k = bisect_left(self.ends, a + 1)
        return k < len(self.starts) and self.starts[k] < b


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, threshold: float = NOVELTY, named: float = NAMED_NOVELTY) -> list[tuple[int, int, str]]:
    """Incompressible strings in the context of a sensitive word that no base span touches."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    a, b = merged(np.array([s for s, _, _ in base], np.int64), np.array([e for _, e, _ in base], np.int64))
    taken, near = Places(list(zip(a.tolist(), b.tolist(), strict=True))), Places([(s - REACH, e + REACH) for s, e in words])
    # contexts may overlap, but their starts and ends are both in order, which is all that is asked of them
    out = {
        m.span() for m in CANDIDATE.finditer(text)
        if near.touch(*m.span()) and not taken.touch(*m.span()) and len(m[0].strip("._-=/")) >= LEAST_NOVEL and not is_name(m[0], False) and novelty.incompressible(text, *m.span(), threshold)
    }
    for _, end in words:
        m = NAMED.match(text, end)
        if m and m.span(1) not in out and not taken.touch(*m.span(1)) and len(m[1].strip("._-=/")) >= LEAST_NAMED and not is_name(m[1], True) and novelty.incompressible(text, *m.span(1), named):
            out.add(m.span(1))
    return [(a, b, "novel") for a, b in sorted(out)]


#: A necessary condition on the UTF-8 bytes for a sensitive word: between two parts may lie one character, that is up to four bytes.
SENSITIVE_BYTES = re.compile(rb"pass(?:w|phrase)|secret|token|api.{0,4}key|credential|private.{0,4}key|bearer|auth|signature|client.{0,4}id|access.{0,4}key", re.IGNORECASE | re.DOTALL)
_HEXES = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def may_hold(raw: bytes) -> bool:
    """A cheap necessary condition on the UTF-8 bytes for any span."""
    if b"AKIA" in raw or b"h" * LEAST["hex"] in raw.translate(_HEXES):
        return True
    return SENSITIVE_BYTES.search(raw) is not None


def all_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str | None, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start and then kind."""
    return all_spans(text, novelty) if text and may_hold(text.encode(errors="replace")) else []


def surroundings(text: str) -> Iterator[str]:
    """Words within reach of sensitive words; token-like strings, which may be secrets, are left out."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    a, b = merged(np.array([max(0, s - REACH) for s, _ in words], np.int64), np.array([e + REACH for _, e in words], np.int64))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        yield from (w for w in WORD.findall(CANDIDATE.sub(" ", text[x:y])) if len(w) <= LONGEST_WORD)


def dictionary_of(docs: DataFrame, text: str = "text") -> bytes:
    """The dictionary for these documents: one scan, counts by word, and the ``WORDS`` most frequent (ties by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(text).cast(pa.binary()):
                raw = x.as_py()
                if raw and SENSITIVE_BYTES.search(raw):
                    counts.update(surroundings(raw.decode(errors="replace")))
                    if len(counts) > 100_000:
                        yield rows()
        if counts:
            yield rows()

    counted = docs.select(text).mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return trained([(r.word, r.n) for r in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()])  # at most WORDS rows


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def mask(text: str, spans: list[tuple[int, int, str]], by: str = "[secret]") -> str:
    """``text`` with every maximal run of spans replaced."""
    out, at, end = [], 0, 0
    for a, b, _ in sorted(spans):
        if a > end or not out:
            out += [text[at:a] if not out else text[end:a], by]
            end = b
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans`` added; a column of that name is replaced."""
    docs = docs.drop("secret_spans")
    dictionary = dictionary_of(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in find(x.as_py(), novelty)] for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPAN)], names=[*batch.schema.names, "secret_spans"])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField("secret_spans", SPANS)]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all found spans of ``text`` masked and ``n_chars``, if there, recounted; columns stay as they are."""
    dictionary = dictionary_of(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [x and mask(x, find(x, novelty)) for x in old]
            names, columns = batch.schema.names, list(batch.columns)
            columns[names.index(text)] = pa.array(new, batch.schema.field(text).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                counts = [n if x == y else len(y) for x, y, n in zip(old, new, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(counts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidied(run), docs.schema)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def report(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans and all spans as text."""
    dictionary = dictionary_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = [find(x.as_py(), novelty) for x in batch.column("text")]
            counts = [pa.array([sum(k == kind for _, _, k in r) for r in rows], pa.int64()) for kind in KINDS]
            base = [hashlib.sha256(joined([s for s in r if s[2] != "novel"]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts[:3], pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string()), counts[3]], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), RESULT)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


QUERIES = {"op8_secrets": op8_secrets}
