"""Tables, documents and text files of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "game_id string, i int, t double, visible boolean, similarity float, fields map<string, struct<text: string, conf: float>>"
TIMELINE = (
    "game_id string, i int, t_video double, bug_visible boolean, period int, clock double, shot_clock double, score_home int, score_away int, confidence float, "
    "live boolean, clock_running boolean, state tinyint, clock_read boolean, home_read boolean, away_read boolean, extra map<string, string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    seconds = F.unix_date(ts.cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def read_entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_entities(df: DataFrame, path: str, key: str = "game_id") -> None:
    """Partitioned by entity, so one entity's rewrite touches its folder only; NaN goes as NULL."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    clean.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def wide_samples(df: DataFrame, fields: list[str]) -> DataFrame:
    """The map of readings as a text and a confidence column for each field."""
    return df.select("game_id", "i", "t", "visible", "similarity", *(c for f in fields for c in (F.col("fields")[f]["text"].alias(f"{f}_text"), F.col("fields")[f]["conf"].alias(f"{f}_conf"))))


def narrow_samples(df: DataFrame) -> DataFrame:
    """The reverse; fields are found by their columns' names."""
    fields = [c[: -len("_text")] for c in df.columns if c.endswith("_text")]
    pairs = [x for f in fields for x in (F.lit(f), F.struct(F.col(f"{f}_text").alias("text"), F.col(f"{f}_conf").cast("float").alias("conf")))]
    return df.select("game_id", "i", "t", "visible", "similarity", F.create_map(*pairs).alias("fields"))


def chunks(games: DataFrame, seconds: float = 150.0, rate: float = 2.0) -> DataFrame:
    """Games (start, end) as chunks that begin on the sample grid: chunk, start, seconds."""
    step = int(seconds * rate)
    first, last = F.ceil(F.col("start") * rate - 1e-9), F.ceil(F.col("end") * rate - 1e-9)
    grid = F.when(last > first, F.sequence(first, last - 1, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    at = games.withColumn("_k", F.explode(grid))
    return at.select("game_id", ((F.col("_k") - first) / step).cast("int").alias("chunk"), (F.col("_k") / rate).alias("start"), (F.least(F.lit(step), last - F.col("_k")) / rate).alias("seconds"))


def settled(listings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files whose size was the same in two polls in a row: path, polled_at, size of the first such poll."""
    w = Window.partitionBy(*(key or ["path"])).orderBy("polled_at")
    same = listings.withColumn("_before", F.lag("size").over(w)).filter(F.col("size") == F.col("_before"))
    return same.groupBy(*(key or ["path"])).agg(F.min_by("size", "polled_at").alias("size"), F.min("polled_at").alias("polled_at"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object per row (events, cut lists, summaries)."""
    df.write.mode("overwrite").json(path)


def chapter_text(start: Column, end: Column, title: Column) -> Column:
    """A chapter of a metadata file; NULL for one of under a hundredth of a second."""
    plain = F.regexp_replace(F.regexp_replace(title, "\n", " "), r"([=;#\\])", r"\\$1")
    lines = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.bround(start * 1000).cast("long").cast("string")), F.concat(F.lit("END="), F.bround(end * 1000).cast("long").cast("string")), F.concat(F.lit("title="), plain))
    return F.when(end - start >= 0.01, lines)


def write_lines(df: DataFrame, path: str, text: str, key: str, order: list[str]) -> None:
    """One text file per entity folder, its lines in order."""
    lines = df.filter(F.col(text).isNotNull()).repartition(key).sortWithinPartitions(key, *order).select(key, F.col(text).alias("value"))
    lines.write.mode("overwrite").partitionBy(key).text(path)


def media_probe(raw: DataFrame, text: str) -> DataFrame:
    """Media metadata from stored probe JSON, frame rates as whole numerator and denominator; near-nominal rates snap."""
    schema = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string>>,format:struct<duration:string,size:string>>"
    d = raw.withColumn("_p", F.from_json(text, schema))
    v = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), 0)
    rate = lambda c: F.struct(F.get(F.split(v[c], "/"), 0).try_cast("long").alias("num"), F.get(F.split(v[c], "/"), 1).try_cast("long").alias("den"))
    avg, nominal = rate("avg_frame_rate"), rate("r_frame_rate")
    ratio = F.try_divide(avg["num"] * nominal["den"], avg["den"] * nominal["num"])
    fps = F.when(F.abs(ratio - 1) < 0.002, nominal).otherwise(avg)
    return d.select(*raw.columns, v["codec_name"].alias("codec"), v["width"].alias("width"), v["height"].alias("height"), fps["num"].alias("fps_num"), fps["den"].alias("fps_den"), F.col("_p.format.duration").try_cast("double").alias("duration"), F.col("_p.format.size").try_cast("long").alias("bytes")).drop("_p")
