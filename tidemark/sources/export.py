"""Report files: one line per repetition or case, unavailable values as empty cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import open_path


def run_report(runs: DataFrame) -> DataFrame:
    """Report lines; the visibility percentile is NULL unless observation is complete."""
    shown = F.when(F.col("observation_status") == "complete", F.col("visibility_p95_ns"))
    return runs.withColumn("visibility_p95_ns", shown)


def case_summary(cases: DataFrame) -> DataFrame:
    """case, kind, status, attempt, completed repetitions, artifact, sha256."""
    return cases.select(
        "case", "kind", "status", "attempt", F.size("completed").cast("bigint").alias("completed_repetitions"), "artifact", "sha256"
    )


def write_report(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines and as CSV with a header; NULL is an empty cell, never 0."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/csv")


def write_files(files: DataFrame, base: str) -> int:
    """One file for each (path, content) below ``base``, a folder that every executor reaches; a path written twice ends as one of both. Returns their number."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                fs, place = open_path(f"{base}/{path}")
                fs.create_dir(place.rsplit("/", 1)[0])
                with fs.open_output_stream(place, compression=None) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
