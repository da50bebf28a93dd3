"""JSON documents of any depth, walked level by level as VARIANT: what is secret is hidden, long texts are cut, values are counted by kind.

Each level is one lateral explode of the containers found in the one before, so the number
of steps is the depth of the deepest document and every level is spread like any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored

# Names whose values are hidden, whatever they hold; what stands for them; the longest text kept.
HIDDEN = ("password", "token", "api_key", "authorization", "secret")
MARK, MOST = "[redacted]", 200


def _kind(v: Column) -> Column:
    """object, array, string, null, boolean or number."""
    schema = F.schema_of_variant(v)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").otherwise("number")


def leaves(docs: DataFrame, hidden: tuple[str, ...] = HIDDEN, most: int = MOST) -> DataFrame:
    """id, path, kind, value of each value of documents (id, json) that is no container, or an empty one; hidden ones have the kind redacted.

    Names are compared without case. Texts beyond most characters end in three dots. A document that
    is no JSON has the one kind invalid; a null one has no rows.
    """
    root = F.try_parse_json("json")
    level = docs.filter("json IS NOT NULL").select("id", F.lit("$").alias("path"), F.lit(False).alias("hide"), F.when(root.isNotNull(), F.to_json(root)).alias("json"))
    out = None
    while True:
        now = stored(level.withColumn("kind", F.when(F.col("hide"), "redacted").when(F.col("json").isNull(), "invalid").otherwise(_kind(F.parse_json("json")))), "documents")
        inside = F.col("kind").isin("object", "array") & ~F.col("json").isin("{}", "[]")
        text = F.parse_json("json").cast("string")
        value = F.when(F.col("kind") == "redacted", MARK).when(F.col("kind") == "string", F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)).otherwise(F.col("json"))
        done = now.filter(~inside).select("id", "path", "kind", value.alias("value"))
        out = done if out is None else out.unionByName(done)
        open_ = now.filter(inside)
        if open_.isEmpty():
            return out
        spark = docs.sparkSession
        parts = open_.select("id", "path", F.parse_json("json").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = parts.select("id", F.concat("path", step).alias("path"), F.coalesce(F.lower("key").isin(*hidden), F.lit(False)).alias("hide"), F.to_json("value").alias("json"))


def summary(found: DataFrame) -> DataFrame:
    """id, kind, n, longest: how many values of each kind a document has, and the length of the longest."""
    return found.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("longest"))
