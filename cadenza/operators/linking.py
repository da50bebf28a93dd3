"""Joins of events, tracks and charts: as-of, band, anti, semi, multi-key and cascading matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def never_played(impressions: DataFrame, plays: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys shown and never played."""
    return impressions.select(*keys).distinct().join(plays.select(*keys).distinct(), keys, "left_anti")


def with_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a flag that tells whether other holds its keys."""
    found = other.select(*keys).distinct().withColumn("_found", F.lit(True))
    return df.join(found, keys, "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_found")


def band_neighbours(tracks: DataFrame, bpm: float = 15.0, energy: float = 0.25) -> DataFrame:
    """Pairs of tracks of one mode within bpm and energy bands, by buckets of bpm so that no pair of distant ones meets."""
    left = tracks.select(F.col("track_id").alias("seed"), "mode", F.col("bpm").alias("seed_bpm"), F.col("energy").alias("seed_energy"), F.explode(F.sequence(F.floor(F.col("bpm") / bpm) - 1, F.floor(F.col("bpm") / bpm) + 1)).alias("bucket"))
    right = tracks.select("track_id", "mode", "bpm", "energy", F.floor(F.col("bpm") / bpm).alias("bucket"))
    near = (F.abs(F.col("bpm") - F.col("seed_bpm")) <= bpm) & F.col("energy").between(F.greatest(F.col("seed_energy") - energy, F.lit(0.0)), F.least(F.col("seed_energy") + energy, F.lit(1.0)))
    return left.join(right, ["mode", "bucket"]).filter(near & (F.col("track_id") != F.col("seed"))).select("seed", "track_id", "bpm", "energy")


def latest_as_of(entries: DataFrame, day: Column, keys: list[str]) -> DataFrame:
    """The entries of each key's last snapshot on or before day."""
    last = entries.filter(F.col("snapshot_date") <= day).groupBy(*keys).agg(F.max("snapshot_date").alias("snapshot_date"))
    return entries.join(last, [*keys, "snapshot_date"], "left_semi")


def position_change(entries: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Each entry with its position in the snapshot before of its chart, and the change (up is positive)."""
    dates = entries.select(*keys, "snapshot_date").distinct().withColumn("before", F.lag("snapshot_date").over(Window.partitionBy(*keys).orderBy("snapshot_date")))
    old = entries.select(*keys, F.col("snapshot_date").alias("before"), identity, F.col("position").alias("old_position"))
    return entries.join(dates, [*keys, "snapshot_date"]).join(old, [*keys, "before", identity], "left").withColumn("change", F.col("old_position") - F.col("position"))


def by_any_id(events: DataFrame, tracks: DataFrame, id_cols: list[str], event_id: str = "external_id") -> DataFrame:
    """events joined to the track of which any id column holds their id; the first column that does wins."""
    ids = F.array(*[F.struct(F.lit(i).alias("priority"), F.col(c).cast("string").alias(event_id)) for i, c in enumerate(id_cols)])
    long = tracks.select("track_id", F.explode(ids).alias("x")).select("track_id", "x.*").filter(F.col(event_id).isNotNull())
    one = long.groupBy(event_id).agg(F.min_by("track_id", F.struct("priority", "track_id")).alias("track_id"))
    return events.join(one, event_id, "left")


def cascade(left: DataFrame, right: DataFrame, steps: list[list[str]], left_id: str, right_id: str) -> DataFrame:
    """Record linkage in steps of key columns: the first step that names one right row only is the match."""
    out = left.select(left_id).withColumn("_m", F.lit(None).cast("string"))
    for n, keys in enumerate(steps):
        unique = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias(f"_{n}")).filter("_n = 1").drop("_n")
        found = left.join(unique, keys).select(left_id, f"_{n}")
        out = out.join(found, left_id, "left").withColumn("_step", F.when(F.col("_m").isNotNull(), F.col("_step") if n else F.lit(None).cast("int")).when(F.col(f"_{n}").isNotNull(), F.lit(n + 1))).withColumn("_m", F.coalesce("_m", F.col(f"_{n}").cast("string"))).drop(f"_{n}")
    return out.select(left_id, F.col("_m").alias("match"), F.col("_step").alias("step"))


def closest(tracks: DataFrame, targets: dict[str, tuple[float, float]], k: int) -> DataFrame:
    """The k tracks of least weighted distance to targets (value, scale); what is missing is at the target."""
    distance = sum((F.abs(F.coalesce(F.col(c).cast("double"), F.lit(v)) - v) / scale for c, (v, scale) in targets.items()), F.lit(0.0))
    return tracks.withColumn("distance", distance).orderBy("distance", "track_id").limit(k)


#: Cells of a grid over tempo and energy for each width of a band.
PARTS = 4


def band_sums(tracks: DataFrame, bpm: float = 15.0, energy: float = 0.25) -> DataFrame:
    """seed, n, bpm: how many other tracks of its mode are within bpm and energy bands of each track, and their mean bpm; tracks without any are left out.

    Equal points count as one. A grid holds the sums and extremes of its cells; cells that lie
    in a band whole are added up, and only points of cells on its border are compared. So each
    point meets a fixed number of cells, and no pairs of tracks are made.
    """
    known = tracks.filter("mode IS NOT NULL AND bpm IS NOT NULL AND energy IS NOT NULL").select("track_id", "mode", F.col("bpm").cast("double").alias("b"), F.col("energy").cast("double").alias("e"))
    side = lambda x, width: F.floor(x / (width / PARTS))
    points = known.groupBy("mode", "b", "e").agg(F.count(F.lit(1)).alias("n")).withColumn("cb", side(F.col("b"), bpm)).withColumn("ce", side(F.col("e"), energy))
    cells = points.groupBy("mode", "cb", "ce").agg(F.sum("n").alias("cn"), F.sum(F.col("n") * F.col("b")).alias("cs"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    around = F.array([F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-PARTS - 1, PARTS + 2) for j in range(-PARTS - 1, PARTS + 2)])
    asked = points.select("mode", "b", "e", "cb", "ce", F.explode(around).alias("d")).select("mode", "b", "e", (F.col("cb") + F.col("d.i")).alias("cb"), (F.col("ce") + F.col("d.j")).alias("ce"))
    low, high = F.greatest(F.col("e") - energy, F.lit(0.0)), F.least(F.col("e") + energy, F.lit(1.0))
    within = lambda x, y: (F.abs(F.col(x) - F.col("b")) <= bpm) & F.col(y).between(low, high)
    met = asked.join(cells, ["mode", "cb", "ce"]).withColumn("whole", within("b0", "e0") & within("b1", "e1"))
    apart = ((F.col("b0") - F.col("b")) > bpm) | ((F.col("b") - F.col("b1")) > bpm) | (F.col("e0") > high) | (F.col("e1") < low)
    inner = met.filter("whole").select("mode", "b", "e", "cn", "cs")
    border = met.filter(~F.col("whole") & ~apart).select("mode", "b", "e", "cb", "ce").join(points.select("mode", "cb", "ce", F.col("b").alias("pb"), F.col("e").alias("pe"), F.col("n").alias("cn")), ["mode", "cb", "ce"])
    border = border.filter(within("pb", "pe")).select("mode", "b", "e", "cn", (F.col("cn") * F.col("pb")).alias("cs"))
    sums = inner.unionByName(border).groupBy("mode", "b", "e").agg(F.sum("cn").alias("n"), F.sum("cs").alias("s"))
    own = F.when(F.col("e").between(low, high), 1).otherwise(0)
    others = known.join(sums, ["mode", "b", "e"]).withColumn("s", F.col("s") - own * F.col("b")).withColumn("n", (F.col("n") - own).cast("long"))
    return others.filter("n > 0").select(F.col("track_id").alias("seed"), "n", (F.col("s") / F.col("n")).alias("bpm"))
