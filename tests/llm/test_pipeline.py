"""The stages against plain versions of their decisions, and the whole run."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm import neardup, quality, secrets

WORD, PHRASE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_kept(rows, percent):
    """Ids of (id, text) that are the smallest of their group, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = WORD.findall(low(text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def plain_hits(text, items):
    """Whether a window of ten words of any item (all words of a shorter one) occurs in the text."""
    words = PHRASE.findall(low(text))
    grams = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in {min(10, len(w)) for w in items if w}}
    return any(tuple(w[k : k + 10]) in grams[min(10, len(w))] for w in items for k in range(max(1, len(w) - 9)) if w)


def test_stages_in_order_and_whole(spark, sf, docs):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "bpe encoding"]
    after = [docs]
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        after.append(stage(spark, after[-1], sf).cache())
        assert after[-1].columns == docs.columns, k
    texts = [{r.doc_id: r.text for r in x.collect()} for x in after]
    assert texts[1].keys() == {r.doc_id for r in quality.judge(spark, docs).filter("kept").collect()}
    assert texts[2].keys() == plain_kept(texts[1].items(), 80)
    items = [PHRASE.findall(low(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert texts[3].keys() == texts[4].keys() == texts[2].keys()
    assert {i for i, t in texts[2].items() if plain_hits(t, items)} == {i for i, t in texts[2].items() if t != texts[3][i]}
    assert not any(plain_hits(t, items) for t in texts[3].values())
    assert all(r.n_assign == r.n_access == r.n_hex == 0 for r in secrets.report(after[4]).collect())
    assert sum(texts[0][i] == t for i, t in texts[4].items()) > 0.8 * len(texts[4])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.no_truncation()
    plain.no_padding()
    want = []
    for i, t in texts[4].items():
        ids = plain.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = cp.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    now, left = odd_docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        now = stage(spark, now, sf)
        if k < len(cp.STAGES) - 1:
            assert now.columns == odd_docs.columns
        left.append(sorted((r.doc_id is not None, r.doc_id) for r in now.collect()))
    good = [(False, None), (True, 4), (True, 4), (True, 5), (True, 7)]  # too short ones, empty ones and nulls go
    assert left[0] == good
    # rows without an id are linked with nothing; rows of one id are one document; 7 has 8 of the 9 shingles of 4
    assert left[1] == left[2] == left[3] == left[4] == [x for x in good if x[1] != 7]
    now = no_docs
    for _, stage in cp.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_pipeline_links_from_four_fifths(spark, sf):
    base = [f"w{i}" for i in range(200)]
    # n words apart from each other make 5 n of 196 shingles new: 0.815 for four of them, 0.773 for five
    far = lambda n: [f"x{i}" if i % 40 == 20 and i < 40 * n else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(far(4))), (11, " ".join("b" + w for w in base)), (12, " ".join("b" + w for w in far(5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, sf).collect()) == [1, 11, 12]
    assert sorted(r.doc_id for r in neardup.groups(spark, docs).filter("kept").collect()) == [1, 2, 11, 12]
