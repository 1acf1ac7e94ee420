"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The tokenizer file's pipeline is followed exactly: literal special tokens are cut out, text is
NFC-normalised and lower-cased character by character, split into letter runs, single digits,
contractions and symbol runs, and each piece is spelled in byte symbols of which the last carries
the word end. White space never enters a piece, so the work is done (and remembered) once for
each distinct stretch between white space.

A piece is encoded left to right. An Aho-Corasick automaton lists the tokens that start at each
place; the longest is tried first and taken if the pair it forms with its left neighbour is
compatible, that is, if merging would never join symbols over their border. A dead end marks the
place as unreachable and steps back. Every place is marked at most once, so the time is linear.

Defined results. Null text is empty: no tokens, and the digests of nothing. Texts are whole,
whatever their length, also where they are one stretch without white space: the time grows with the
length, and only short stretches are remembered. Repeated rows are encoded alike. An empty table
gives an empty result. Extra columns are kept by ``encode`` and ``decode``, but ``token_ids`` and
``decoded`` are replaced, and ignored by ``digests`` unless named.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.tables import read, tidied

#: White space as the tokenizer's pattern engine counts it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Below this character all editions of Unicode agree on letters, numbers and cases.
PLAIN = "\u0530"
#: Beyond it, punctuation and currency signs, which are neither letters nor numbers and compose with nothing.
MARKED = re.compile("[\x00-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]+")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
STRETCH = re.compile(f"[^{SPACE}]+")
#: Characters that Python, but not the pattern engine, takes for white space (fixed values).
ODD = re.compile("[\x1c-\x1f]")
#: Entries of a worker's memories of stretches, pieces and pairs; they are emptied when full, which costs time only.
REMEMBERED = 200_000
#: Characters or bytes of a stretch or piece that is remembered at all, so that the memories are bounded by bytes too (100 MB at most).
REMEMBERED_SIZE = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Tokens of one file as strings over symbol letters, with their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        self.spelling: list[str] = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in [*ids.items(), *self.special.items()]:
            self.spelling[i] = s
        letters = byte_letters()
        self.path, self.byte_of = path, {c: b for b, c in enumerate(letters)}
        self._library: Tokenizer | None = None
        self.inner = [ids[c] for c in letters]  # a byte within a piece
        self.last = [ids[c + self.end] for c in letters]  # the last byte of a piece
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}  # parts -> (rank, merged)
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        self.symbols: dict[int, str] = {i: chr(i) for i in (*self.inner, *self.last)}
        for rank, (a, b) in enumerate(merges):
            l, r, whole = ids[a], ids[b], ids[a + b]  # noqa: E741
            self.pair[l, r] = (rank, whole)
            self.made.setdefault(whole, (rank, l, r))
            self.symbols.setdefault(whole, self.symbols[l] + self.symbols[r])
        #: Tokens that merging their own symbols gives; no text is encoded with any other.
        self.reached: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for i, s in self.symbols.items():  # parts come before what is made of them
            if i in self.made:
                rank, l, r = self.made[i]  # noqa: E741
                if not (l in self.reached and r in self.reached and self._border_holds(l, r, (rank, 1))):
                    continue
            self.reached.add(i)
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        blob, offsets = bytearray(), [0]
        for s in self.spelling:
            blob += s.encode() + b" "
            offsets.append(len(blob))
        self.blob, self.offsets = np.frombuffer(bytes(blob), np.uint8), np.array(offsets, np.int64)
        self.mark = os.path.commonprefix(list(self.special)) or ""
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[bytes, list[int]] = {}
        self._inner_letters = {b: chr(i) for b, i in enumerate(self.inner)}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's symbols together would leave exactly a and b.

        Both tokens are taken apart from the border outwards, the later-made one first. At each
        point the two parts that touch the border are those present just then; if a merge of
        them ranks before the step that would have absorbed them, the border is crossed.
        """
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            known = self._fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, l: int, r: int, until: tuple[float, int] = (float("inf"), 0)) -> bool:  # noqa: E741
        # until: the step that absorbs a part at the border; equal ranks run from left to right
        while True:
            crossing = self.pair.get((l, r))
            if crossing and (crossing[0], 1) < until:
                return False
            a, b = self.made.get(l), self.made.get(r)
            if not a and not b:
                return True
            if not b or (a and a[0] > b[0]):
                until, l = (a[0], 1), a[2]  # noqa: E741
            else:
                until, r = (b[0], 2), b[1]

    def pieces(self, text: str) -> list[bytes]:
        """The UTF-8 pieces of text without white space."""
        if text.isascii():
            return [x.encode() for x in PIECES.findall(text.lower())]
        if max(text) < PLAIN or MARKED.fullmatch(text):
            return [x.encode() for x in PIECES.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())]
        # later scripts: letters and cases as the library's edition of Unicode has them
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        said = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in said]

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(data) > REMEMBERED_SIZE:
            return self._backtrack(data)
        known = self._pieces.get(data)
        if known is None:
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            known = self._pieces[data] = self._backtrack(data)
        return known

    def _backtrack(self, data: bytes) -> list[int]:
        s = data[:-1].decode("latin-1").translate(self._inner_letters) + chr(self.last[data[-1]])
        # the longest token at each place in turn, if all neighbours are compatible: nothing to step back from
        greedy = [i for _, (_, i) in self.automaton.iter_long(s)]
        fits = self._fits
        for pair in zip(greedy, greedy[1:]):  # noqa: B905
            if not (fits[pair] if pair in fits else self.compatible(*pair)):
                break
        else:
            return greedy
        end = len(s)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(end)]
        # matches come by their ends, so each list is in order of length, the longest last
        for at, (n, i) in self.automaton.iter(s):
            starts[at - n + 1].append((n, i))
        out: list[int] = []
        places, dead, at = [0], set(), 0
        left = {0: starts[0].copy()}
        while at < end:
            tries = left[at]
            while tries:
                n, i = tries.pop()
                if at + n not in dead and (not out or self.compatible(out[-1], i)):
                    out.append(i)
                    at += n
                    places.append(at)
                    if at < end:
                        left[at] = starts[at].copy()
                    break
            else:
                dead.add(at)
                places.pop()
                out.pop()
                at = places[-1]
        return out

    def stretch(self, text: str) -> bytes:
        """Little-endian ids of text without white space."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.mark in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for x in self.pieces(part):
                    ids += self.piece(x)
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray, block: int = 1 << 18) -> Iterator[bytes]:
        """The spelling of ids with a space between tokens, in blocks."""
        for k in range(0, len(ids), block):
            part = ids[k : k + block].astype(np.int64)
            first, n = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(n)
            out = self.blob[np.arange(ends[-1]) + np.repeat(first - ends + n, n)].tobytes()
            yield out[:-1] if k + block >= len(ids) else out


class Encoder(dict):
    """Remembers the ids of stretches: a dict that computes what it lacks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> bytes:
        out = self.vocabulary.stretch(text)
        if len(text) <= REMEMBERED_SIZE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = out
        return out

    def ids(self, text: str) -> bytes:
        words = STRETCH.findall(text) if ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def encoder(path: str) -> Encoder:
    """A new one for each task: what a task remembers is freed with it, so idle workers hold nothing."""
    return Encoder(Vocabulary(path))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) added; a column of that name is replaced."""
    path = path or default_vocabulary()
    docs = docs.drop("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(enc.ids(x or ""), "<u4").astype(np.int32) for x in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*batch.schema.names, "token_ids"])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded`` added: the tokens' spellings joined by spaces; null ids give an empty text."""
    path = path or default_vocabulary()
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [b"".join(vocabulary.decode(np.array(x or [], np.int64))).decode() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(tidied(run), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


DIGESTS = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, n_tokens and digests of ids and decoded text, without moving the ids between processes."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                raw = enc.ids(text.as_py() or "")
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                digest = hashlib.sha256()
                for x in enc.vocabulary.decode(np.frombuffer(raw, "<u4")):
                    digest.update(x)
                text_sha.append(digest.hexdigest())
            added = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, *(k for k, _ in DIGESTS)])

    kept = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {t}" for k, t in DIGESTS)])
    return kept.mapInArrow(tidied(run), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe": op9_bpe}
