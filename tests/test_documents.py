"""Cut lists and summaries as documents, written and read again."""

import json

from pyspark.sql import functions as F

from tidemark.plans import documents

CLIP = "game_id string, clip int, team string, kind string, points int, confidence double, warnings array<string>, enabled boolean, edited boolean, segments array<struct<a: double, b: double>>, title string"
ROWS = [
    ("g", 0, "home", "field_goal", 2, 0.9, [], True, False, [(10.0, 14.0), (20.0, 23.5)], "Q1 9:40 · +2"),
    ("g", 1, "away", "free_throws", 2, 0.6, ["two in one"], True, True, [(30.0, 31.25)], None),
    ("g", 2, "home", "steal", 0, 0.7, [], False, None, [(40.0, 47.0)], "off"),
    ("g", 3, "home", "field_goal", 3, None, None, True, False, [], "empty"),
    ("h", 0, "away", "block", 0, 0.2, [], True, False, [(1.0, 2.0)], "x"),
]


def test_cut_lists_are_written_by_game(spark, tmp_path):
    clips = spark.createDataFrame(ROWS, CLIP).withColumn("video", F.lit("a.mp4"))
    docs = documents.cut_documents(clips, ["video"])
    documents.write(docs, str(tmp_path))
    documents.write(docs.filter("game_id = 'h'").withColumn("document", F.lit("{}")), str(tmp_path))  # the other game stays
    got = {r.game_id: json.loads(r.value) for r in spark.read.text(str(tmp_path)).collect()}
    assert got["h"] == {}
    g = got["g"]
    assert (g["game_id"], g["video"], g["runtime_seconds"], g["n_clips"]) == ("g", "a.mp4", 8.75, 2)
    assert [(c["clip"], c["out_start"], c["out_end"], c["segments"]) for c in g["clips"]] == [(0, 0.0, 7.5, [{"a": 10.0, "b": 14.0}, {"a": 20.0, "b": 23.5}]), (1, 7.5, 8.75, [{"a": 30.0, "b": 31.25}])]


def test_filters_of_a_review(spark):
    rows = documents.by_filter(spark.createDataFrame(ROWS, CLIP), F.lit("home")).collect()
    got = {n: [r.clip for r in sorted(rows, key=lambda r: r.place) if r.game_id == "g" and r["filter"] == n] for n in documents.FILTERS}
    assert got == {"all": [0, 1, 2, 3], "team": [0, 2, 3], "opp": [1], "scores": [0, 3], "ft": [1], "defense": [2], "warnings": [1], "low": [1], "off": [2], "edited": [1]}
    by = [r.clip for r in sorted(rows, key=lambda r: r.place_by_confidence) if r.game_id == "g" and r["filter"] == "all"]
    assert by == [3, 1, 2, 0]  # unknown confidence first


def test_summaries(spark):
    line = spark.createDataFrame([("g", 0, 1, 2), ("g", 1, None, 4), ("g", 2, 3, None), ("i", 0, None, None)], "game_id string, i int, score_away int, score_home int")
    quality = spark.createDataFrame([("g", 3, 0.5)], "game_id string, samples int, score_unreadable double")
    docs = {r.game_id: json.loads(r.document) for r in documents.summaries_of(line, spark.createDataFrame(ROWS, CLIP), quality).collect()}
    assert docs["g"] == {"game_id": "g", "final_score": {"away": 3, "home": 4}, "runtime_seconds": 8.75, "n_clips": 2, "timeline": {"samples": 3, "score_unreadable": 0.5}}
    assert docs["i"]["final_score"] == {} and docs["i"]["n_clips"] == 0


def test_clips_are_sorted_before_they_are_copied_for_their_filters(spark):
    plan = documents.by_filter(spark.createDataFrame(ROWS, CLIP), F.lit("home"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")
