"""Derived tables kept up to date by increments: deltas by batch, folded into a base now and then.

A table is a folder. Each batch of events is reduced to mergeable states by key (counts,
sums, extremes, a sketch of what is distinct) and written to `delta/batch=<id>`, which a
repeated batch replaces by the same rows. A fold writes a new base of all batches up to
some id and then names it in a marker; what is read is the last named base and the deltas
after it, merged. A reader never sees half a batch, and nothing is rewritten that a batch
does not hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: How a state is made of rows and how states of a key are merged, by the name of the state.
State = tuple[Column, Column]


def total(name: str, made: Column) -> State:
    return made.alias(name), F.sum(name).alias(name)


def latest(name: str, made: Column) -> State:
    return made.alias(name), F.max(name).alias(name)


def earliest(name: str, made: Column) -> State:
    return made.alias(name), F.min(name).alias(name)


def distinct(name: str, of: str) -> State:
    """A sketch; F.hll_sketch_estimate tells how many."""
    return F.hll_sketch_agg(of).alias(name), F.hll_union_agg(name).alias(name)


@dataclass
class Table:
    """A table of states by keys, in folder."""

    folder: str
    keys: list[str]
    states: list[State]

    def reduced(self, events: DataFrame) -> DataFrame:
        return events.groupBy(*self.keys).agg(*[made for made, _ in self.states])

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys).agg(*[merge for _, merge in self.states])

    def add(self, events: DataFrame, batch: int) -> None:
        """One batch, which may have been added before; a batch that a base holds already is left."""
        if batch > self._base(events.sparkSession):
            self.reduced(events).write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")

    def _fs(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, spark: SparkSession, part: str, prefix: str) -> list[int]:
        fs, path = self._fs(spark)
        at = path(f"{self.folder}/{part}")
        found = fs.listStatus(at) if fs.exists(at) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].lstrip("-").isdigit())

    def _base(self, spark: SparkSession) -> int:
        """The last batch that the last base holds; -1 without one. A base counts once its marker is there."""
        return max(self._names(spark, "bases", "upto-"), default=-1)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All states, merged; None while no batch was added."""
        base = self._base(spark)
        fs, path = self._fs(spark)
        done = [b for b in self._names(spark, "delta", "batch=") if b > base and fs.exists(path(f"{self.folder}/delta/batch={b}/_SUCCESS"))]
        parts = [f"{self.folder}/base-{base}"] * (base >= 0) + [f"{self.folder}/delta/batch={b}" for b in done]
        return self.merged(spark.read.parquet(*parts)) if parts else None

    def fold(self, spark: SparkSession) -> None:
        """Merges what is there into a new base; deltas that it holds are dropped after its marker is written."""
        deltas = [b for b in self._names(spark, "delta", "batch=") if b > self._base(spark)]
        if not deltas:
            return
        fs, path = self._fs(spark)
        now = self.read(spark)
        now.write.mode("overwrite").parquet(f"{self.folder}/base-{max(deltas)}")
        fs.create(path(f"{self.folder}/bases/upto-{max(deltas)}"), True).close()
        for b in deltas:
            fs.delete(path(f"{self.folder}/delta/batch={b}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, fold_every: int = 20):
        """Adds every batch of a stream, and folds now and then; stops when nothing new is there."""

        def each(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            if number % fold_every == fold_every - 1:
                self.fold(batch.sparkSession)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_signals(folder: str) -> Table:
    """Plays, likes, skips, time heard, first and last event and number of sessions of each user's track."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    states = [
        total("plays", kind("play_start")), total("likes", kind("like")), total("skips", kind("skip")), total("completed", F.count_if((F.col("event_type") == "play_end") & (F.col("value") >= 0.8))),
        latest("last_ts", F.max("ts")), earliest("first_ts", F.min("ts")), latest("last_id", F.max("id")), distinct("days", "day"),
    ]
    return Table(folder, ["user_id", "track_id"], states)


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.floor(F.col("ts") / 86400))
