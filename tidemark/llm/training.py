"""The bounded sample of labelled documents on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod

#: Bounds of a training sample: rows of each class, and characters of a document in it.
ROWS_PER_CLASS = 2500
MAX_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, modulus: int, held_out: int, rows: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) of each class, the same ones on every run.

    Documents whose crc32(id) mod ``modulus`` is ``held_out`` never enter, nor
    do documents over ``max_chars`` characters (left out whole, not cut), NULL
    texts or labels other than 0 and 1.  Ids are drawn from the labels alone,
    so one broadcast of at most 2 x ``rows`` ids picks the texts in one scan.
    Where an id stands on several rows, one of them speaks for it (the one of
    the least hash of its text), chosen on the executors.
    """
    drawn = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (crc_mod("_id", modulus) != held_out))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_label")]
    some = drawn.where("_label = 0").distinct().orderBy(*order).limit(rows).unionByName(drawn.where("_label = 1").distinct().orderBy(*order).limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= max_chars)
    one = texts.join(F.broadcast(some), "_id").groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"))
    found = one.collect()
    found.sort(key=lambda r: (str(r["_id"]), r["_label"]))
    return [(r["_text"], r["_label"]) for r in found]
