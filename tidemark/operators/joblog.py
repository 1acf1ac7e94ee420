"""Jobs as an append-only log: what every entry did, and where every job stands.

An entry either moves its job or, where the job isn't in a state that it applies to, does nothing (a claim of
a job that runs already). Whether it moves hangs on all before it, but a job has four states only: what
an entry does to each of them is four digits, and so is what a stretch of entries does. Stretches of
``CHUNK`` entries are composed apart, then the stretches of a job, then each entry gets the state it
met. A job's entries are never gathered as a whole, only one short text for each stretch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import spread

STATES = ("idle", "queued", "running", "done")
#: What each kind of entry does to the states it applies to.
MOVES = {
    "submit": {"idle": "queued", "done": "queued"}, "claim": {"queued": "running"}, "recover": {"running": "queued"}, "finish": {"running": "done"},
    "roll_back": {"queued": "idle", "running": "idle"},
}
CHUNK = 64
SAME = "".join(map(str, range(len(STATES))))


def effect(kind: Column) -> Column:
    """Where a kind of entry leads from each state, as digits."""
    out = F.lit(SAME)
    for name, moves in MOVES.items():
        out = F.when(kind == name, "".join(str(STATES.index(moves.get(s, s))) for s in STATES)).otherwise(out)
    return out


def led(effect_: Column, state: Column) -> Column:
    return F.substring(effect_, state.cast("int") + 1, F.lit(1))


def replayed(log: DataFrame, key: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """``log`` with the state that each entry met (``before``), left (``after``), and whether it moved the job."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    rows = log.withColumn("_n", n).withColumn("_chunk", F.floor(F.col("_n") / CHUNK)).withColumn("_e", effect(F.col(kind)))
    parts = rows.groupBy(*key, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_n", "_e"))).alias("_es"))  # at most CHUNK
    whole = F.aggregate("_es", F.lit(SAME), lambda acc, x: F.concat(*(led(x["_e"], F.substring(acc, k + 1, 1)) for k in range(len(STATES)))))
    one = parts.withColumn("_whole", whole)
    long_ = one.filter("_chunk > 0").select(*key).distinct()

    def starts(rows_: pd.DataFrame) -> pd.DataFrame:
        state, out = "0", []
        rows_ = rows_.sort_values("_chunk")
        for e in rows_["_whole"]:
            out.append(state)
            state = e[int(state)]
        return rows_.assign(_start=out).drop(columns="_whole")

    # jobs of one stretch start idle; of the others, each stretch is one row
    several = one.select(*key, "_chunk", "_whole").join(long_, key, "left_semi")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in several.schema.fields if f.name != "_whole")
    begun = spread(several, key).groupBy(*key).applyInPandas(starts, f"{kinds}, _start string")
    met = one.join(begun, [*key, "_chunk"], "left").withColumn("_start", F.coalesce("_start", F.lit("0")))
    seen = F.transform("_es", lambda x, i: F.struct(x["_n"].alias("_n"), F.aggregate(F.slice("_es", F.lit(1), i), F.col("_start"), lambda s, y: led(y["_e"], s)).alias("_before")))
    each = met.select(*key, F.explode(seen).alias("_s")).select(*key, "_s.*")
    named = lambda digit: F.element_at(F.array(*map(F.lit, STATES)), digit.cast("int") + 1)
    out = rows.join(each, [*key, "_n"]).withColumn("_after", led(F.col("_e"), F.col("_before")))
    return out.select(*log.columns, named(F.col("_before")).alias("before"), named(F.col("_after")).alias("after"), (F.col("_before") != F.col("_after")).alias("moved"))


def standing(played: DataFrame, key: list[str], order: list[str], kind: str = "kind", worker: str = "worker") -> DataFrame:
    """Where each job stands: state, the last entry that moved it, how often it was claimed, and by whom last."""
    at, moved = F.struct(*order), F.col("moved")
    claim = moved & (F.col(kind) == "claim")
    return played.groupBy(*key).agg(
        F.max_by("after", at).alias("state"), F.max(F.when(moved, at)).alias("_at"), F.count_if(claim).alias("claims"), F.max_by(worker, F.when(claim, at)).alias("claimed_by"), F.count_if(~moved).alias("ignored"),
    ).select(*key, "state", *(F.col("_at")[c].alias(f"moved_{c}") for c in order), "claims", "claimed_by", "ignored")


def next_queued(standing_: DataFrame, key: list[str], order: list[str], of: list[str] = ()) -> DataFrame:
    """The queued job that has waited longest (in each group ``of``): a least value, not a sort."""
    waiting = standing_.filter("state = 'queued'")
    first = F.min(F.struct(*(f"moved_{c}" for c in order), *key)).alias("_f")
    return waiting.groupBy(*of).agg(first).filter("_f IS NOT NULL").select(*of, "_f.*")
