"""Archives of JSON documents and files of a library, read where Spark deals them."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text

#: Documents in a batch that leaves an archive.
BATCH = 5000
#: Paths of the numbers that a document may hold; null where a part of the path is missing.
NUMBERS = {"bpm": "$.rhythm.bpm", "loudness": "$.lowlevel.average_loudness", "danceable": "$.highlevel.danceability.all.danceable", "happy": "$.highlevel.mood_happy.all.happy", "sad": "$.highlevel.mood_sad.all.sad", "aggressive": "$.highlevel.mood_aggressive.all.aggressive", "relaxed": "$.highlevel.mood_relaxed.all.relaxed"}
NAMES = {"artist": "$.metadata.tags.artist[0]", "title": "$.metadata.tags.title[0]", "album": "$.metadata.tags.album[0]", "key": "$.tonal.key_key", "mode": "$.tonal.key_scale"}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """member, body: the JSON members of all archives (.tar.zst, .tar) under path; an archive is read as a stream by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = io.BytesIO(content)
                stream = zstandard.ZstdDecompressor().stream_reader(raw) if name.endswith(".zst") else raw
                rows: list[tuple[str, str]] = []
                with tarfile.open(fileobj=stream, mode="r|") as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".json"):
                            rows.append((member.name, archive.extractfile(member).read().decode("utf-8", "replace")))
                        if len(rows) >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["member", "body"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["member", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar*").load(path)
    return files.select("path", "content").mapInArrow(read, "member string, body string")


def catalogue(found: DataFrame) -> DataFrame:
    """A flat row for each key in the members' names; of members of one key the first in the order of their names."""
    one = found.withColumn("mbid", F.regexp_extract("member", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})-\d+\.json$", 1)).filter("mbid != ''")
    one = one.groupBy("mbid").agg(F.min_by("body", "member").alias("body"))
    number = {n: F.get_json_object("body", p).try_cast("double") for n, p in NUMBERS.items()}
    name = {n: F.get_json_object("body", p) for n, p in NAMES.items()}
    flat = one.select("mbid", *[v.alias(n) for n, v in {**name, **number}.items()])
    none = lambda n: F.coalesce(n, F.lit(0.5))
    energy = F.greatest(F.least((none("aggressive") + 1 - none("relaxed")) / 2, F.lit(1.0)), F.lit(0.0))
    return flat.withColumn("energy", energy).withColumn("valence", text.clamp((none("happy") + 1 - none("sad")) / 2))


def audio_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("mp3", "flac", "ogg", "m4a")) -> DataFrame:
    """path, size, changed of the files under root whose extension is one of these, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed")).filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
