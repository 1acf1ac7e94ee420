"""What leaves a game as documents: cut lists, summaries, and the filters of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.clips import DEFENSE_KINDS
from tidemark.plans.timeline import KEY

#: Below this confidence a clip is worth a look (fixed value).
LOW = 0.7
FILTERS = ("all", "team", "opp", "scores", "ft", "defense", "warnings", "low", "off", "edited")


def shown(name: str, follow: Column) -> Column:
    """Whether a clip (team, kind, points, confidence, warnings, enabled, edited) passes a filter of the review; an unknown name passes all."""
    free = F.col("kind") == "free_throws"
    return {
        "team": F.col("team") == follow, "opp": F.col("team") != follow, "scores": (F.col("points") > 0) & ~free, "ft": free, "defense": F.col("kind").isin(*DEFENSE_KINDS),
        "warnings": F.size("warnings") > 0, "low": F.col("confidence") < LOW, "off": ~F.col("enabled"), "edited": F.col("edited"),
    }.get(name, F.lit(True))


def by_filter(clips: DataFrame, follow: Column) -> DataFrame:
    """Clips once for each filter that they pass, as ``filter``, with their places in game order and by confidence.

    A place is the number of clips so far that pass, so clips are sorted as they are, and copied for their filters only then.
    """
    rows = clips.withColumn("_in", F.array(*(F.coalesce(shown(n, follow), F.lit(False)) for n in FILTERS)))

    def places(*order: str) -> Column:
        so_far = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.array(*(F.count_if(F.col("_in")[k]).over(so_far).cast("int") for k in range(len(FILTERS))))

    placed = rows.withColumn("_place", places("clip")).withColumn("_sure", places("confidence", "clip"))
    each = F.array(*(F.when(F.col("_in")[k], F.struct(F.lit(n).alias("filter"), F.col("_place")[k].alias("place"), F.col("_sure")[k].alias("place_by_confidence"))) for k, n in enumerate(FILTERS)))
    return placed.withColumn("_f", F.explode(F.filter(each, lambda f: f.isNotNull()))).select(*clips.columns, "_f.*")


def cut_rows(clips: DataFrame) -> DataFrame:
    """Clips (clip, segments) with ``seconds`` and their place in the cut, out_start and out_end; those that are off or empty are left out."""
    seconds = F.aggregate("segments", F.lit(0.0), lambda t, s: t + (s["b"] - s["a"]))
    rows = clips.filter(F.col("enabled") & (F.size("segments") > 0)) if "enabled" in clips.columns else clips.filter(F.size("segments") > 0)
    end = F.sum("seconds").over(Window.partitionBy(*KEY).orderBy("clip").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("seconds", seconds).withColumn("out_end", F.round(end, 3)).withColumn("out_start", F.round(end - F.col("seconds"), 3))


def cut_documents(clips: DataFrame, meta: list[str] = ()) -> DataFrame:
    """game_id and ``document``: a game's cut list as JSON: ``meta`` columns, runtime, number of clips, and the clips in order.

    A game's clips are some hundreds; they are one document by their nature.
    """
    rows = cut_rows(clips)
    own = [c for c in rows.columns if c not in (*KEY, *meta, "enabled")]
    listed = F.array_sort(F.collect_list(F.struct("clip", *[c for c in own if c != "clip"])))
    per = rows.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in meta), F.round(F.sum("seconds"), 3).alias("runtime_seconds"), F.count(F.lit(1)).alias("n_clips"), listed.alias("clips"))
    return per.select(*KEY, F.to_json(F.struct(*[c for c in per.columns])).alias("document"))


def final_scores(timeline: DataFrame) -> DataFrame:
    """The last known score of each side; NULL if it was never read."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("i"))).alias(c)
    return timeline.groupBy(*KEY).agg(last("score_away"), last("score_home"))


def summaries_of(timeline: DataFrame, clips: DataFrame, quality: DataFrame) -> DataFrame:
    """game_id and ``document``: final score, runtime and number of enabled clips, how well the game was read."""
    cut = cut_rows(clips).groupBy(*KEY).agg(F.round(F.sum("seconds"), 3).alias("runtime_seconds"), F.count(F.lit(1)).alias("n_clips"))
    rows = final_scores(timeline).join(cut, KEY, "left").join(quality, KEY, "left")
    read = [c for c in quality.columns if c not in KEY]
    doc = F.struct(
        *KEY, F.struct(F.col("score_away").alias("away"), F.col("score_home").alias("home")).alias("final_score"),
        F.coalesce("runtime_seconds", F.lit(0.0)).alias("runtime_seconds"), F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.struct(*read).alias("timeline"),
    )
    return rows.select(*KEY, F.to_json(doc).alias("document"))


def write(documents: DataFrame, path: str) -> None:
    """A folder for each game with its document; games that are written again replace their own only."""
    documents.repartition(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).text(path)
