"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Base rules reject documents of under ten words and documents of which over a fifth of the words
lie in repeated five-word windows. The method then looks at a vector of transformed statistics
(mean word length, shares of symbols, of repeated lines and of repeated words) within each
language and source: minimum-covariance-determinant estimates of centre and scatter are found by
concentration steps over the half of the rows nearest to the current estimate. They begin at three
fixed starts (medians with median deviations, moments of hyperbolic tangents, spatial signs) and go
on until no determinant falls any more; the start with the smallest determinant is reweighted.
Documents far off by Mahalanobis distance are rejected. Rows that the base rules reject take no
part in the estimates.

Groups of under ``least_rows`` rows that pass the base rules are judged with the other small sources of their language,
then with all remaining rows; if even those are too few, only the base rules judge them.

Defined results. Null text: all statistics zero, so the base rules reject it. Null language or
source is a group value of its own. Texts of any length count whole. A row at the cut-off itself is
kept; rows at the border of the nearest half all belong to it, and of starts with equal determinants
the first by name is taken. Repeated rows are judged alike. An empty table gives an empty result.
Extra columns are kept by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read

WHITE, NOT_WHITE, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("x0", "x1", "x2", "x3")
#: Scatter that a statistic has at least, in its own unit; many groups have none of their own.
FLOORS = (0.12, 0.04, 0.3, 0.12)
NEAREST, LEAST_ROWS = 0.5, 60
#: Rows of normal shape that the outlier rule may reject: one in 25 million.
REJECTED = 4e-8


def chi_below(x: float, freedom: int) -> float:
    """Chi-square distribution with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_quantile(share: float, freedom: int = len(VECTOR)) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_below(mid, freedom) < share else (lo, mid)
    return lo


def shrunk(share: float) -> float:
    """Makes up for the smaller scatter of the nearest ``share`` of rows of normal shape."""
    return share / chi_below(chi_quantile(share), len(VECTOR) + 2)


CHI_MEDIAN, CHI_975, CHI_REJECT = chi_quantile(0.5), chi_quantile(0.975), chi_quantile(1 - REJECTED)
CONSISTENT, REWEIGHTED = shrunk(NEAREST), shrunk(0.975)
STARTS = ("medians", "tangents", "signs")
#: Fall of the logarithm of a determinant under which a concentration step has changed nothing.
STILL = 1e-6
#: Groups up to which estimates are broadcast (about 200 bytes each), and rejected rows up to which their keys are (16 bytes each).
BROADCAST_GROUPS, BROADCAST_KEYS = 50_000, 1_000_000


def bound_to(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside of a lambda."""
    return F.transform(F.array(value), use)[0]


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def covered(s: Column) -> Column:
        again = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])),
        )
        at = F.sort_array(F.transform(again, lambda x: x["at"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound_to(placed, covered))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns and the five statistics of each whole text; one scan, no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(*keep, body.alias("_body"), F.filter(F.split(body, WHITE), lambda w: w != "").alias("_words"))
    hashed = words.select(
        *keep,
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.regexp_replace("_body", SYMBOL, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_body", "\n"), lambda x: F.rlike(x, F.lit(NOT_WHITE))).alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = hashed.withColumn(
        "_windows",
        F.when(
            F.col("_n") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return windows.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_windows")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics; square roots and logarithms pull in their long tails."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "x1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "x2": F.log1p(F.col("n_dup_lines")),
            "x3": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _distance(p: int = len(VECTOR)) -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution on the factor l00.."""
    z: list[Column] = []
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return _total([x * x for x in z])


def _moments(p: int = len(VECTOR)) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(p) for j in range(i + 1))]


def _factor(moments: DataFrame, scale: Column, keys: tuple[str, ...] = ("group",), p: int = len(VECTOR)) -> DataFrame:
    """Centre and Cholesky factor of the scaled scatter, with the floors added to its diagonal."""
    out = moments.withColumn("_scale", scale)
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}") * F.col("_scale") + (FLOORS[i] ** 2 if i == j else 0.0)
            rest = c - _total([F.lit(0.0), *(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j))])
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*keys, *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def _with(rows: DataFrame, params: DataFrame, n_groups: int) -> DataFrame:
    """Rows with their group's estimates; few groups are broadcast, many are joined by a shuffle."""
    return rows.join(F.broadcast(params) if n_groups <= BROADCAST_GROUPS else params, "group")


def _grouped(stats: DataFrame, least_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows with ``group``: language and source, or the pool that a small source belongs to; null where too few."""
    sizes = stats.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n"))
    own = F.col("n") >= least_rows
    pool = sizes.filter(~own).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rest = pool.filter(F.col("n_lang") < least_rows).groupBy(F.lit("rest").alias("_rest")).agg(F.sum("n_lang").alias("n_rest"))
    named = (
        sizes.join(pool.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("_rest", F.lit("rest"))
        .join(F.broadcast(rest), "_rest", "left")  # one row
        .select(
            F.col("lang").alias("_lang"),
            F.col("source").alias("_source"),
            F.when(own, F.to_json(F.struct(F.lit("source").alias("of"), "lang", "source")))
            .when(F.col("n_lang") >= least_rows, F.to_json(F.struct(F.lit("lang").alias("of"), "lang")))
            .when(F.col("n_rest") >= least_rows, F.lit("rest"))
            .alias("group"),
        )
    )
    named = scratch.write(named, "groups")
    n = named.count()
    named = F.broadcast(named) if n <= BROADCAST_GROUPS else named
    return stats.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source"), n


def _starts(rows: DataFrame, n_groups: int, scratch: Scratch) -> DataFrame:
    """Centre and factor of each group and start."""
    p = range(len(VECTOR))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    middle = scratch.write(rows.groupBy("group").agg(*(F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in p)), "middle")
    spread = _with(rows, middle, n_groups).groupBy("group").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in p),
        *(F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10_000), F.lit(FLOORS[i])).alias(f"s{i}") for i in p),
    )
    spread = scratch.write(spread, "spread")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in p]
    length = F.greatest(F.sqrt(_total([x * x for x in z])), F.lit(1e-9))
    pulled = _with(rows, spread, n_groups).select("group", *(f"{k}{i}" for k in "ms" for i in p), *(F.tanh(z[i]).alias(f"t{i}") for i in p), *((z[i] / length).alias(f"u{i}") for i in p))
    moments = pulled.groupBy("group").agg(
        *(F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ms" for i in p),
        *(F.avg(f"t{i}").alias(f"t{i}") for i in p),
        *(F.covar_pop(f"t{i}", f"t{j}").alias(f"t{i}{j}") for i, j in pairs),
        *((F.avg(F.col(f"u{i}") * F.col(f"u{j}")) * len(VECTOR)).alias(f"u{i}{j}") for i, j in pairs),
    )
    moments = scratch.write(moments, "starts-moments")
    scaled = lambda k, i, j: (F.col(f"{k}{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}")
    tangents = moments.select("group", F.lit("tangents").alias("start"), *((F.col(f"m{i}") + F.col(f"s{i}") * F.col(f"t{i}")).alias(f"m{i}") for i in p), *(scaled("t", i, j) for i, j in pairs))
    signs = moments.select("group", F.lit("signs").alias("start"), *(f"m{i}" for i in p), *(scaled("u", i, j) for i, j in pairs))
    medians = spread.select("group", F.lit("medians").alias("start"), *(f"m{i}" for i in p), *((F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in pairs))
    return medians.unionByName(_factor(tangents.unionByName(signs), F.lit(1.0), ("group", "start")))


def estimates(rows: DataFrame, n_groups: int, scratch: Scratch, nearest: float = NEAREST) -> DataFrame:
    """Reweighted minimum-covariance-determinant centre and factor of each group."""
    p = range(len(VECTOR))
    rows = rows.filter(F.col("group").isNotNull()).select("group", *VECTOR)
    keys, names = ("group", "start"), [*(f"m{i}" for i in p), *(f"l{i}{j}" for i in p for j in range(i + 1))]
    fields = [*names, "_det", "_step"]
    step = 0
    params = scratch.write(_starts(rows, n_groups, scratch).select(*keys, *names, F.lit(float("inf")).alias("_det"), F.lit(0).alias("_step")), "params0")
    # a group and start goes on as long as its determinant falls; floors bound it from below
    while not (moving := params.filter(F.col("_step") == step)).isEmpty():
        step += 1
        far = _with(rows, moving.select(*keys, *names), n_groups * len(STARTS)).withColumn("_d", _distance()).select(*keys, *VECTOR, "_d")
        cuts = scratch.write(far.groupBy(*keys).agg(F.percentile_approx("_d", nearest, 10_000).alias("_cut")), f"cuts{step}")
        cuts = F.broadcast(cuts) if n_groups * len(STARTS) <= BROADCAST_GROUPS else cuts
        near = far.join(cuts, list(keys)).filter(F.col("_d") <= F.greatest(F.col("_cut"), F.lit(1e-9)))
        new = _factor(near.groupBy(*keys).agg(*_moments()), F.lit(CONSISTENT), keys)
        new = new.withColumns({"_det": 2 * _total([F.log(f"l{i}{i}") for i in p]), "_step": F.lit(step)})
        both = params.unionByName(new).groupBy(*keys).agg(F.min_by(F.struct(*fields), F.col("_det") + F.when(F.col("_step") == step, STILL).otherwise(0.0)).alias("_least"))
        params = scratch.write(both.select(*keys, *(F.col(f"_least.{f}").alias(f) for f in fields)), f"params{step}")
    least = params.groupBy("group").agg(F.min_by(F.struct(*names), F.struct("_det", "start")).alias("_least"))
    least = scratch.write(least.select("group", *(F.col(f"_least.{f}").alias(f) for f in names)), "least")
    # the last round weighs rows by distances that are scaled to have the median they should have
    far = _with(rows, least, n_groups).withColumn("_d", _distance()).select("group", *VECTOR, "_d")
    cuts = far.groupBy("group").agg((F.greatest(F.percentile_approx("_d", 0.5, 10_000), F.lit(1e-9)) * (CHI_975 / CHI_MEDIAN)).alias("_cut"))
    near = _with(far, scratch.write(cuts, "cuts"), n_groups).filter(F.col("_d") <= F.col("_cut"))
    return scratch.write(_factor(near.groupBy("group").agg(*_moments()), F.lit(REWEIGHTED)), "estimates")


def judge(spark: SparkSession, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), least_rows: int = LEAST_ROWS) -> DataFrame:
    """Keys, statistics, base_failed, distance (null where no estimate) and kept of each row."""
    scratch = Scratch(spark, "quality")
    stats = scratch.write(statistics(docs, keep=(*keys, "lang", "source")), "stats")
    rows, n_groups = _grouped(vectors(stats), least_rows, scratch)
    params = estimates(rows.filter(~base_failed()), n_groups, scratch)
    params = F.broadcast(params) if n_groups <= BROADCAST_GROUPS else params
    # a left join: rows without a group have no estimate
    far = rows.join(params, "group", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CHI_REJECT, F.lit(False))
    return far.withColumn("base_failed", base_failed()).withColumn("kept", kept).select(*keys, *STATS, "base_failed", "kept", "distance")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    # text, language and source are in the key: rows that share an id may be judged differently
    # hashes pass over nulls, so which columns are null is in it, too
    key = lambda df: F.xxhash64(F.coalesce(df["text"], F.lit("")), df["lang"], df["source"], df["lang"].isNull(), df["source"].isNull())
    keyed = docs.select("doc_id", "text", "lang", "source", key(docs).alias("_key"))
    bad = Scratch(spark, "quality-bad").write(judge(spark, keyed, keys=("doc_id", "_key")).filter(~F.col("kept")).select("doc_id", "_key").distinct(), "bad")
    few = bad.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (key(docs) == bad["_key"]), "left_anti")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read(spark, sf_dir, "documents"))


QUERIES = {"op5_quality": op5_quality}
