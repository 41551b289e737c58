"""Differences between recorded and expected tables, and fingerprints of row sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reconcile import WIDE_SET, hash_tree


def registry_diff(recorded: DataFrame, approved: DataFrame) -> DataFrame:
    """Rows on one side only, all columns compared, counted by copies. Empty when the registries agree."""
    cols = approved.columns
    tagged = recorded.select(*cols, F.lit(1).alias("d")).unionByName(approved.select(*cols, F.lit(-1).alias("d")))
    g = tagged.groupBy(*cols).agg(F.sum("d").alias("d")).where("d <> 0")
    return g.select(*cols, F.when(F.col("d") > 0, "recorded").otherwise("approved").alias("side"), F.abs("d").alias("copies"))


def identity_diff(a: DataFrame, b: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Per key: the labels of fields that differ, in the given order, joined by commas; NULL equals NULL.

    A key on one side only differs in every field that is not NULL there, or is ``absent`` on the other if all of them are.

    ``fields`` maps a column to its label.
    """
    left = a.select(key, *fields, F.lit(True).alias("__left"))
    right = b.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__right"))
    labels = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(label)) for c, label in fields.items()])
    text = F.array_join(F.filter(labels, lambda x: x.isNotNull()), ", ")
    one_sided = F.col("__left").isNull() | F.col("__right").isNull()
    text = F.when(one_sided & (text == ""), "absent").otherwise(text)
    return left.join(right, key, "full").select(key, text.alias("differences")).where("differences <> ''")


def inventory_diff(manifest: DataFrame, files: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Faults between a manifest and the files there are: missing, extra, repeated, size, hash."""
    m = manifest.groupBy("path").agg(
        F.count(F.lit(1)).alias("entries"), F.max("size").alias("m_size"), F.max("sha256").alias("m_sha"),
    )
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"))
    fault = (
        F.when(F.col("f_size").isNull(), "missing").when(F.col("entries").isNull(), "extra").when(F.col("entries") > 1, "repeated")
        .when((F.col("m_size") != F.col("f_size")) | (F.col("f_size") > max_bytes), "size").when(F.col("m_sha") != F.col("f_sha"), "hash")
    )
    return m.join(f, "path", "full").select("path", fault.alias("fault")).where("fault IS NOT NULL")


def canonical_bytes(row: Column) -> Column:
    """Compact JSON with ``& < >`` as unicode escapes."""
    text = F.to_json(row, {"ignoreNullFields": "false"})
    for c, esc in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(c), F.lit(esc))
    return text


def fingerprint(df: DataFrame, by: Sequence[str], fields: Sequence[str], wide: int = WIDE_SET) -> DataFrame:
    """(by, members, fingerprint): one hash per group of any size, whatever the row order.

    Each row's canonical text is hashed; the hashes with their copies are the members of a hash tree, whose leaves stay small.
    """
    by = list(by)
    h = df.select(*by, F.sha2(canonical_bytes(F.struct(*fields)), 256).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("c"))
    h = h.withColumn("entry", F.concat("h", F.lit(":"), F.col("c").cast("string")))
    return hash_tree(h, by, F.substring("entry", 1, 64), "entry", "c", F.to_json, wide).withColumnRenamed("root", "fingerprint")


def small_fingerprint(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The hash of the sorted member hashes as a JSON list, for control tables of a few rows per group."""
    by = list(by)
    h = F.sha2(canonical_bytes(F.struct(*fields)), 256)
    return df.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(h))), 256).alias("fingerprint"))
