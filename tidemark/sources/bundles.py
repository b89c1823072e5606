"""Export of tables as one verified bundle, and its restore.

A bundle is a folder of JSON lines a table and a manifest: rows, digest and
schema of each table.  Rows are counted and digested in the pass that writes
them (observed metrics, no second scan); the manifest is written last, by a
commit of its own, so a folder without one is no bundle, however many executors
were lost on the way.  Digests do not depend on the order of rows or files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import c

MANIFEST = "manifest"
#: Times to the microsecond, in lines and digests alike.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _row_digest(columns: list[str]) -> Column:
    """A 52-bit number of a row that follows from its values; NULLs are left out, as in the lines themselves."""
    return F.conv(F.substring(F.sha2(F.to_json(F.struct(*[c(f"`{x}`") for x in columns]), FORMATS), 256), 1, 13), 16, 10).cast("decimal(38,0)")


def _metrics(columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_digest(columns)), F.lit(0)).cast("string").alias("digest")]


def export_bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write the tables and then the manifest (returned: ``name, rows, digest, schema``); an existing folder is an error."""
    spark, entries = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        seen = Observation(f"export {name}")
        df.observe(seen, *_metrics(df.columns)).write.mode("errorifexists").options(**FORMATS).json(f"{folder}/tables/{name}")
        entries.append((name, int(seen.get["rows"]), seen.get["digest"], df.schema.json()))
    manifest = spark.createDataFrame(entries, "name string, rows bigint, digest string, schema string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/{MANIFEST}")
    return manifest


def _entries(spark: SparkSession, folder: str) -> list:
    return spark.read.schema("name string, rows bigint, digest string, schema string").json(f"{folder}/{MANIFEST}").orderBy("name").collect()


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    # a line that is broken has no values, so the digest differs
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).options(mode="PERMISSIVE", **FORMATS).json(f"{folder}/tables/{name}")


def verified_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """``name, rows, expected_rows, status`` of each table of a bundle: ``verified``, ``rows differ`` or ``digest differs``."""
    found = None
    for e in _entries(spark, folder):
        df = _read(spark, folder, e["name"], e["schema"])
        status = F.when(c("rows") != e["rows"], "rows differ").when(c("digest") != e["digest"], "digest differs").otherwise("verified")
        one = df.agg(*_metrics(df.columns)).select(F.lit(e["name"]).alias("name"), "rows", F.lit(e["rows"]).cast("bigint").alias("expected_rows"), status.alias("status"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError(f"{folder} has no manifest entries")
    return found


def restored_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle with the types they had; an error if any of them is not what was exported."""
    bad = [f"{r['name']}: {r['status']}" for r in verified_bundle(spark, folder).where("status <> 'verified'").collect()]
    if bad:
        raise ValueError("the bundle is not what was exported: " + ", ".join(sorted(bad)))
    return {e["name"]: _read(spark, folder, e["name"], e["schema"]) for e in _entries(spark, folder)}
