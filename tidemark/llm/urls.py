"""URL filters: listed host and path rules, then association rules mined from labels.

URLs become sets of tokens (top domain, registered name, host labels, all path parts, kind of the
last part, query keys, fragment). FP-growth mines the token combinations of the labelled pages to
block; what share of all labelled pages that hold a combination is to be blocked is its
confidence. Rules are pruned by support, by a lower bound on their confidence, and where a shorter
rule is as sure. Each rule is posted in an inverted index under its rarest token; a URL looks up
its tokens and fires the posted rules that it holds.

Two things keep the mining small without changing its rules. A rule needs a certain number of
pages to pass the lower bound at all, however few pages there are. And tokens that occur in
exactly the same labelled pages are one class: a rule with two of a class is never surer than with
one, so one stands for all in the mining, and in the matching any of them does.

DataFrame and SQL functions only. A verdict depends on the URL alone, so rules are matched once
for each distinct URL.

Defined results. A null URL, or one without ``://``, has an empty host and path and no tokens: no
rule fits, it is allowed. A URL of any length gives all its tokens. Of the mined rules that fire,
the one of the highest confidence is named, of equal ones the last in the order of their sorted
tokens; of listed rules the longest decides, and two of one length can't both fit. Repeated rows are
judged alike. Without labelled pages nothing is mined. An empty table gives an empty result. Extra
columns are kept by ``judge`` if named.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the listed rules (fixed values).
LISTED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SUPPORT, CONFIDENCE, DEVIATIONS = 0.002, 0.5, 3.0
#: Mined rules up to which the index and its classes of tokens are broadcast (some 200 bytes each).
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; nulls where none does."""
    rule = verdict = None
    for said, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        rule = F.when(fits, at + prefix) if rule is None else rule.when(fits, at + prefix)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(labels)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kind = lambda x: F.when(F.rlike(x, F.lit("^[0-9]+$")), "number").when(F.rlike(x, F.lit(r"\.[A-Za-z]+$")), F.concat(F.lit("file."), F.regexp_extract(x, r"\.([A-Za-z]+)$", 1))).otherwise("name")
    return F.array_distinct(
        F.concat(
            F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("top:"), x)),
            F.when(n >= 2, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>")),
            F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("host:"), x)),
            # the first two parts keep their place, deeper ones don't
            F.transform(parts, lambda x, i: F.concat(F.lit("path"), F.when(i < 2, i.cast("string")).otherwise(""), F.lit(":"), F.when(kind(x) == "number", F.lit("0")).otherwise(x))),
            F.transform(F.slice(F.reverse(parts), 1, 1), lambda x: F.concat(F.lit("last:"), kind(x))),
            F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.element_at(F.split(x, "="), 1))),
            F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def least_hits(n: int, support: float, confidence: float, deviations: float) -> int:
    """Blocked pages that a rule needs: its share of ``n``, and no fewer than let its lower bound reach the confidence."""
    return max(1, math.ceil(support * n), math.ceil(deviations**2 * confidence / (1 - confidence)))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its rows are few; else a plain join follows."""
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def holding(sets: DataFrame, items: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs of ``sets`` (antecedent) and rows of ``items`` (row, items) that hold them, by the rarest token of each set."""
    index = sets.withColumn("token", F.explode("antecedent")).join(common, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    posted = items.select("row", "items", F.explode("items").alias("token"))
    return posted.join(sent(index, sets.count()), "token").filter(F.size(F.array_except("antecedent", "items")) == 0).select("row", "antecedent")


MINED = "antecedent array<string>, confidence double, bound double"


def mine(labelled: DataFrame, scratch: Scratch, support: float = SUPPORT, confidence: float = CONFIDENCE, deviations: float = DEVIATIONS) -> tuple[DataFrame, DataFrame]:
    """Rules to block from ``labelled`` (row, items, bad): (antecedent, confidence, bound), and the classes of tokens (token, name, n).

    Antecedents are sets of class names. ``bound`` is the Wilson lower bound of the confidence, so
    that a rule needs the more pages the less sure it is; a rule whose sub-rule has at least its
    bound says nothing new and goes.
    """
    spark, n = labelled.sparkSession, labelled.count()
    least = least_hits(n, support, confidence, deviations)
    seen = labelled.select("row", "bad", F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"), F.bit_xor(F.xxhash64("row")).alias("s"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("t")
    )
    # tokens with equal sets of pages (by count and 128 bits) go by the first one's name
    alike = Window.partitionBy("n", "s", "t")
    classes = scratch.write(seen.filter(F.col("hits") >= least).select("token", F.min("token").over(alike).alias("name"), "n"), "classes")
    names = classes.filter("token = name").select("token", "n")
    blocked = labelled.filter("bad").select("row", F.explode("items").alias("token")).join(sent(names, names.count()), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    blocked = scratch.write(blocked.select("items"), "blocked")
    count = blocked.count()
    if not count:
        return spark.createDataFrame([], MINED), classes
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / count).fit(blocked)
    sets = scratch.write(model.freqItemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("hits")), "sets")
    held = holding(sets.select("antecedent"), labelled.select("row", "items"), names).groupBy("antecedent").agg(F.count(F.lit(1)).alias("seen"))
    z2, p, m = deviations**2, F.col("hits") / F.col("seen"), F.col("seen")
    bound = (p + z2 / (2 * m) - deviations * F.sqrt(p * (1 - p) / m + z2 / (4.0 * m * m))) / (1 + z2 / m)
    rules = scratch.write(sets.join(held, "antecedent").select("antecedent", p.alias("confidence"), bound.alias("bound")).filter((F.col("bound") >= confidence) & (F.col("confidence") >= confidence)), "sure")
    # all sub-rules of a rule by leaving out one token at a time: the best of them decides
    shorter = rules.select(
        "antecedent", "bound", F.explode(F.transform("antecedent", lambda x: F.filter("antecedent", lambda y: y != x))).alias("part")
    ).join(rules.select(F.col("antecedent").alias("part"), F.col("bound").alias("part_bound")), "part")
    stale = shorter.filter("part_bound >= bound").select("antecedent").distinct()
    return rules.join(stale, "antecedent", "left_anti").select("antecedent", "confidence", "bound"), classes


JUDGED = ("host", "path", "rule", "verdict", "mined_rule", "confidence")


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = LISTED) -> DataFrame:
    """``keep``, host, path, rule, verdict, and the surest mined rule that fired with its confidence; these replace kept columns of their names.

    ``labels`` names pages by ``doc_id``; quality 0 or toxic 1 make a page one to block.
    """
    scratch = Scratch(spark, "urls")
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    of_pages = pages.select("page_id", tokens(F.col("url")).alias("items")).join(bad, F.col("page_id") == F.col("doc_id"))
    labelled = scratch.write(of_pages.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "labelled")
    mined, classes = mine(labelled, scratch)
    mined = scratch.write(mined, "rules")
    n = mined.count()
    # a rule is posted under its rarest class among the labelled pages; ties by the name
    wanted = mined.withColumn("name", F.explode("antecedent")).join(classes.filter("token = name").select("name", "n"), "name")
    index = scratch.write(wanted.groupBy("antecedent", "confidence").agg(F.min_by("name", F.struct("n", "name")).alias("post")), "index")
    used = scratch.write(classes.join(wanted.select("name").distinct(), "name").select("token", "name"), "used")
    # the classes that a URL holds, each by the last of its tokens
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    held = urls.join(sent(used, used.count()), "token").groupBy("url", "name").agg(F.max("token").alias("token")).groupBy("url").agg(F.collect_list(F.struct("name", "token")).alias("held"))
    fired = (
        held.select("url", "held", F.explode("held.name").alias("post"))
        .join(sent(index, n), "post")
        .filter(F.size(F.array_except("antecedent", "held.name")) == 0)
        .select("url", "confidence", F.array_sort(F.transform(F.filter("held", lambda x: F.array_contains("antecedent", x["name"])), lambda x: x["token"])).alias("antecedent"))
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "antecedent")).alias("best"))
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed_rule(host, path, rules)
    best = "_fired"
    kept = [c for c in keep if c not in JUDGED]
    judged = pages.select(*dict.fromkeys((*kept, "url"))).join(fired.withColumnRenamed("best", best), "url", "left")
    return judged.select(
        *kept, host.alias("host"), path.alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col(best).isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join(f"{best}.antecedent", " ").alias("mined_rule"), F.col(f"{best}.confidence").alias("confidence"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_url_filter": op1_url_filter}


def op1_sql(support: float = SUPPORT, confidence: float = CONFIDENCE, z: float = DEVIATIONS) -> str:
    """The listed rules, and mining by all token subsets of the labelled pages."""
    fits = lambda at, prefix: f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{prefix}'))"
    order = sorted(LISTED, key=lambda r: len(r[1] + r[2]), reverse=True)
    rule = " ".join(f"WHEN {fits(at, prefix)} THEN '{at + prefix}'" for _, at, prefix in order)
    verdict = " ".join(f"WHEN {fits(at, prefix)} THEN '{said}'" for said, at, prefix in order)
    kind = "CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'number' WHEN regexp_matches(x, '\\.[A-Za-z]+$') THEN 'file.' || regexp_extract(x, '\\.([A-Za-z]+)$', 1) ELSE 'name' END"
    return f"""
WITH urls AS MATERIALIZED (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1) AS query FROM (SELECT DISTINCT coalesce(url, '') AS url FROM pages)),
split_ AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p, list_filter(string_split(query, '&'), lambda x: x <> '') AS q FROM urls),
items AS MATERIALIZED (
  SELECT url, list_sort(list_distinct(
    CASE WHEN len(l) >= 1 THEN ['top:' || l[len(l)]] ELSE [] END || CASE WHEN len(l) >= 2 THEN ['site:' || l[len(l) - 1] || '.' || l[len(l)]] ELSE [] END
    || list_transform(l[1:greatest(len(l) - 2, 0)], lambda x: 'host:' || x)
    || list_transform(range(1, len(p) + 1), lambda i: 'path' || CASE WHEN i <= 2 THEN (i - 1)::VARCHAR ELSE '' END || ':' || CASE WHEN regexp_full_match(p[i], '[0-9]+') THEN '0' ELSE p[i] END)
    || CASE WHEN len(p) >= 1 THEN list_transform([p[len(p)]], lambda x: 'last:' || {kind}) ELSE [] END
    || list_transform(q, lambda x: 'query:' || string_split(x, '=')[1]) || CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END)) AS t FROM split_),
bad AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
labelled AS MATERIALIZED (SELECT row_number() OVER () AS rn, t, bad FROM pages JOIN items ON items.url = coalesce(pages.url, '') JOIN bad ON page_id = doc_id),
total AS (SELECT count(*) AS n FROM labelled),
subsets AS (SELECT rn, bad, list_transform(list_filter(range(0, len(t)), lambda i: (m >> i) & 1 = 1), lambda i: t[i + 1]) AS a FROM (SELECT *, unnest(range(1, (1 << len(t))::BIGINT)) AS m FROM labelled)),
counted AS (SELECT a, count(*) AS seen, count(*) FILTER (bad) AS hit FROM subsets GROUP BY a),
scored AS (SELECT a, hit / seen::DOUBLE AS c, seen, hit, n FROM counted, total WHERE hit >= ceil({support} * n)),
bounded AS MATERIALIZED (SELECT a, c, (c + {z * z} / (2 * seen) - {z} * sqrt(c * (1 - c) / seen + {z * z} / (4.0::DOUBLE * seen * seen))) / (1 + {z * z} / seen::DOUBLE) AS bound FROM scored WHERE c >= {confidence}),
sure AS MATERIALIZED (SELECT * FROM bounded WHERE bound >= {confidence}),
stale AS (SELECT DISTINCT s.a FROM (SELECT a, bound, unnest(list_transform(a, lambda x: list_filter(a, lambda y: y <> x))) AS part FROM sure) s JOIN sure o ON o.a = s.part WHERE o.bound >= s.bound),
rules AS MATERIALIZED (SELECT * FROM sure WHERE a NOT IN (SELECT a FROM stale)),
fired AS (SELECT url, max({{'c': c, 'a': a}}) AS best FROM items JOIN rules ON list_has_all(t, a) GROUP BY url)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(best.a, ' ') AS mined_rule, best.c AS confidence
FROM pages JOIN urls ON urls.url = coalesce(pages.url, '') LEFT JOIN fired ON fired.url = urls.url"""


SQL = {"op1_url_filter": op1_sql()}
