"""Documents that a fetcher landed as files: read whole by tasks, none lost, whatever their shape.

A document is parsed to VARIANT, so a feed may change its shape without a new schema: every field of a
table is asked for under the paths of all shapes, the first that has a value of its type counts.
Only the asked paths are taken out of a document. What can't be used is a row with its kind:

- ``retry``: an empty file, or one that breaks off; it may still be landing
- ``refused``: an answer that says so, or lacks what every good one has; asking again won't help
- ``broken``: whole, but not JSON
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OK, RETRY, REFUSED, BROKEN = "ok", "retry", "refused", "broken"
#: Where documents that refuse say so.
ERRORS = ("$.error", "$.errors", "$.message.error")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and ``raw`` of each file below a folder; one row a file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def first_of(doc: Column, paths: list[str], kind: str) -> Column:
    """The value of the first path that has one of this type."""
    return F.coalesce(*(F.try_variant_get(doc, p, kind) for p in paths))


def judged(files: DataFrame, required: list[str], raw: str = "raw") -> DataFrame:
    """``files`` with ``doc`` (VARIANT, NULL unless ok) and ``kind``. ``required``: paths of which a good document has one at least."""
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    doc = F.try_parse_json(text)
    whole = text.rlike(r"(?s)^\{.*\}$") | text.rlike(r"(?s)^\[.*\]$")
    has = lambda paths: first_of(doc, paths, "variant").isNotNull()
    kind = F.when(doc.isNotNull() & has(list(ERRORS)), REFUSED).when(doc.isNotNull() & has(required), OK).when(doc.isNotNull(), REFUSED).when((text == "") | ~whole, RETRY).otherwise(BROKEN)
    return files.withColumn("kind", kind).withColumn("doc", F.when(F.col("kind") == OK, doc))


def listed(docs: DataFrame, keep: dict[str, tuple[str, list[str]]], lists: list[str], fields: dict[str, tuple[str, list[str]]], doc: str = "doc") -> DataFrame:
    """One row for each entry of the first list found: the document's ``keep`` and the entry's ``fields`` (name: type and paths)."""
    entries = first_of(F.col(doc), lists, "array<variant>")
    rows = docs.select(*[c for c in docs.columns if c != doc], *(first_of(F.col(doc), p, t).alias(n) for n, (t, p) in keep.items()), F.posexplode(entries).alias("at", "_entry"))
    return rows.select(*[c for c in rows.columns if c != "_entry"], *(first_of(F.col("_entry"), p, t).alias(n) for n, (t, p) in fields.items()))


def drift(docs: DataFrame, by: list[str], doc: str = "doc") -> DataFrame:
    """What shapes a feed's documents have: their merged schema in each group."""
    return docs.filter(F.col(doc).isNotNull()).groupBy(*by).agg(F.schema_of_variant_agg(doc).alias("shape"), F.count(F.lit(1)).alias("n"))
