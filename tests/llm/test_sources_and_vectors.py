"""Source divergence, centroid clustering and nearest neighbours against plain versions and on odd tables."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tidemark.llm import ann, clusters, divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows):
    """(lang, source, part, item, value, rank) by loops over Python's integers."""
    docs = collections.defaultdict(list)
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", TERM.findall(low)))
    out = []
    for lang, own in docs.items():
        seen = collections.Counter(t for _, words in own for t in set(words))
        kept = sorted((t for t, n in seen.items() if n >= 3), key=str.encode)
        counts = {s: collections.Counter() for s, _ in own}
        for s, words in own:
            counts[s].update(t for t in words if seen[t] >= 3)
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((shares[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


def audited(spark, df):
    return sorted(map(tuple, divergence.audit(spark, df).collect()))


def test_audit_equals_loops(spark, docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(spark, docs) == plain_audit(rows)


@pytest.mark.parametrize(("terms", "sources"), [(7, 2), (1000, 3), (5, 100)])
def test_audit_in_small_tiles(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rng = random.Random(terms)
    words = [f"{a}{b}" for a in "abcdeé日" for b in ("x", "Y", "zz", "ß")]
    rows = [(rng.choice(["en", "de", None]), rng.choice([None, *"pqrstuv", "ä"]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(150)]
    assert audited(spark, spark.createDataFrame(rows, "lang string, source string, text string")) == plain_audit(rows)


def test_audit_on_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert audited(spark, odd_docs) == plain_audit(rows)
    assert divergence.audit(spark, no_docs).count() == 0
    # a language that keeps no term, ties, a hot source, one very long text
    rows = [("xx", "a", "once"), ("xx", "b", None), ("one", "only", "w w w")] + [("hot", "s", "tie tea toe")] * 500 + [("hot", f"t{i}", "toe tie " + "tea " * 5000) for i in range(4)]
    table = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "side", "block")})
    got = audited(spark, table)
    assert got == plain_audit(rows)
    assert [r[3:] for r in got if r[0] == "xx"] == [("b", 0, 1), ("a", 0, 1)] and not [r for r in got if r[0] == "one"]


def test_shares_of_large_counts():
    counts, total = np.array([0, 1, 10**13, 2**52]), 2**53 - 5
    assert divergence.share(counts + 1, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def plain_clusters(rows, k=16, rounds=3):
    """Rows of (id, vector) to (id, cluster, distance, cluster's sum, sum, digest) in Python's integers."""
    grain = lambda x: math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x)
    kept = [(i, [grain(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        got = assign()
        for c in {c for _, c in got}:
            own = [v for (_, v), (_, at) in zip(kept, got) if at == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    got, sums = assign(), collections.Counter()
    for d, c in got:
        sums[c] += d
    fit = lambda x: x if x < 2**63 else None
    return [(i, c, fit(d), fit(sums[c]), fit(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, got)]


KEY = lambda r: tuple((x is not None, x) for x in r)


def clustered(spark, df):
    return sorted(map(tuple, clusters.cluster(spark, df).collect()), key=KEY)


def test_clusters_equal_loops(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert clustered(spark, table) == sorted(plain_clusters(rows), key=KEY)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_on_odd_vectors(spark, kind):
    rng = np.random.default_rng(5)
    small = lambda: rng.normal(size=64).astype(np.float32).tolist()
    same_one = small()
    rows = [(i, same_one) for i in range(100, 160)] + [(i, small()) for i in range(40)] + [(7, small()), (7, small()), (None, small()), (None, same_one)]
    rows += [(1000, None), (1001, []), (1002, same_one[:63]), (1003, [*same_one[:63], None]), (1004, [*same_one[:63], math.nan]), (1005, [*same_one[:63], -math.inf]), (1006, [0.0] * 64), (1007, [-1e-30] * 64)]
    rows += [(1008, [3e7] * 64), (1009, [float(np.float32(2.5e6)), *same_one[1:]])]
    table = lambda rows: spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("cluster", "ints", "distance")})
    assert clustered(spark, table(rows).repartition(5)) == sorted(plain_clusters(rows), key=KEY)
    huge = [*rows, (1010, [float(np.float32(1e30))] * 64), (1011, [float(np.float32(-3e38))] * 64)]
    assert clustered(spark, table(huge)) == sorted(plain_clusters(huge), key=KEY)
    few = rows[60:65]
    assert clustered(spark, table(few)) == sorted(plain_clusters(few), key=KEY)
    assert clusters.cluster(spark, table(rows).limit(0)).count() == 0


def test_screen_never_drops_the_nearest():
    rng = np.random.default_rng(1)
    near = rng.integers(-200, 200, (16, 64))
    ints = near[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))
    ints[:5] = (near[3] + near[4]) // 2  # ties and nearly so
    cluster, distance, measured = clusters.nearest(ints, *clusters.compressed(ints), near)
    every = ((ints[:, None, :] - near) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 0.2 * every.size  # the bounds leave little to measure where clusters lie apart


def plain_neighbours(rows, k=10):
    """{(query id, vector): [(distance, id)]} of every entry that takes part."""
    use = lambda i, v: i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in rows if use(i, v)})
    out = {}
    for i, v in kept:
        if i % 100 == 0:
            out[i, v] = sorted((math.dist(v, w), j) for j, w in kept if j != i and len(w) == len(v))[:k]
    return out


def neighbours(spark, df):
    out = collections.defaultdict(list)
    for r in ann.neighbours_of(spark, df).collect():
        out[r.query_id].append((r["rank"], r.score, r.vec_id))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("block", [4096, 64])
def test_recall(spark, sf, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)  # 64: many cells
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = {q: x for (q, _), x in plain_neighbours([(r.vec_id, r.embedding) for r in table.collect()]).items()}
    got = neighbours(spark, table)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, _, v in got[q]} & {v for _, v in x}) for q, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for found in got.values():
        assert [k for k, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda x: x[1:])


def test_exact_where_little_is_left_out(spark, monkeypatch):
    """Odd vectors, ties and copies: with a sure radius the search is exact."""
    monkeypatch.setattr(ann, "REACH", 1e6)
    rng = random.Random(3)
    copy = [0.5, -0.0, 1.5]
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(0, 900, 3)]
    rows += [(i, copy) for i in range(2000, 2400)] + [(2000, copy), (2100, copy), (2500, [0.5, 0.0, 1.5])]
    rows += [(3000, None), (3100, []), (3200, [0.0, 0.0, -0.0]), (3300, [1.0, None, 2.0]), (3400, [1.0, math.nan, 2.0]), (3500, [1.0, math.inf, 2.0]), (None, copy)]
    rows += [(4000, [1.0, 2.0]), (4001, [1.0, 4.0]), (4100, [7.0]), (4200, [1e308, -1e308]), (4201, [-1e308, 1e308])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("length", "cell", "vector", "rank")})
    want = {q: x for (q, _), x in plain_neighbours([(i, v) for i, v in rows if i not in (4200, 4201)]).items() if x}
    for block in (4096, 50):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = neighbours(spark, table.filter("vec_id IS NULL OR vec_id NOT IN (4200, 4201)"))
        assert {q: [(v, round(d, 9)) for _, d, v in x] for q, x in got.items()} == {q: [(v, round(d, 9)) for d, v in x] for q, x in want.items()}
    assert len(neighbours(spark, table)[4200]) == 3
    assert ann.neighbours_of(spark, table.limit(0)).count() == 0


def test_chi_square_quantiles():
    draws = (np.random.default_rng(2).standard_normal((200_000, 8)) ** 2).sum(1)
    for share in (0.5, 0.9, 0.975):
        assert abs((draws <= ann.chi_square_quantile(share, 8)).mean() - share) < 0.005
