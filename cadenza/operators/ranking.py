"""Orders: numbering without one task, interleaving, caps by artist, correlation of ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with place (from 0) in a total order: ranges are sorted apart, and counts of those before are added."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("place", (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def first_source_wins(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of candidates of one track from several sources, that which comes first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def capped(ranked: DataFrame, user: str, group: str, place: str, most: int = 2, top: int = 10) -> DataFrame:
    """ranked with slot: among the first top slots at most `most` of a group; what exceeds follows after them."""
    inside = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(user, group).orderBy(place)))
    fits = F.col("_k") <= most
    inside = inside.withColumn("_a", F.when(fits, F.sum(F.when(fits, 1).otherwise(0)).over(Window.partitionBy(user).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))))
    first = F.coalesce(F.col("_a") <= top, F.lit(False))
    return inside.withColumn("slot", F.row_number().over(Window.partitionBy(user).orderBy(F.when(first, 0).otherwise(1), place))).drop("_k", "_a")


def rank_agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau of two ranks within each group, whose size is bounded by the list it ranks."""
    left = pairs.select(*keys, F.col(a).alias("a1"), F.col(b).alias("b1"))
    right = pairs.select(*keys, F.col(a).alias("a2"), F.col(b).alias("b2"))
    both = left.join(right, keys).filter("a1 < a2")
    return both.groupBy(*keys).agg((F.sum(F.signum(F.col("b2") - F.col("b1"))) / F.count(F.lit(1))).alias("tau"))


def best_of_lists(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """user_id, track_id, score: the k best of each user's lists by greatest place, then id, each track with its best score.

    batches: user_id and lists track_id, score, place, in the order of users. Of a user whose lists go on in the
    next batch only the k best so far are held, since no other can be among the k best of all.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("track_id")
        of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets))))
        rows = pa.table([b.column("user_id").take(of), *(b.column(c).flatten() for c in ("track_id", "score", "place"))], ["user_id", "track_id", "score", "place"])
        best = _best(rows if held is None else pa.concat_tables([held, rows]), k)
        last = best.column("user_id").to_numpy() == b.column("user_id")[-1].as_py()
        yield from best.filter(pa.array(~last)).select(["user_id", "track_id", "score"]).combine_chunks().to_batches()
        held = best.filter(pa.array(last))
    if held is not None:
        yield from held.select(["user_id", "track_id", "score"]).combine_chunks().to_batches()


def _best(rows: pa.Table, k: int) -> pa.Table:
    one = rows.group_by(["user_id", "track_id"]).aggregate([("score", "max"), ("place", "max")]).rename_columns(["user_id", "track_id", "score", "place"])
    one = one.sort_by([("user_id", "ascending"), ("place", "descending"), ("track_id", "ascending")])
    user = one.column("user_id").to_numpy()
    starts = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]) if len(user) else np.zeros(0, int)
    nth = np.arange(len(user)) - np.repeat(starts, np.diff(np.r_[starts, len(user)]))
    return one.filter(pa.array(nth < k))
