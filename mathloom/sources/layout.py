"""Folders of an evaluation: one for each source, with its manifest, images and logs of each phase."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import text as T
from mathloom.operators.evaluate import SOURCE_ORDER, with_source


def source_root(base: str, source: str) -> str:
    return f"{base}/{source}"


def image_dir(base: str, source: str) -> str:
    return f"{source_root(base, source)}/images"


def manifest_path(base: str, source: str) -> str:
    return f"{source_root(base, source)}/manifest"


def results_path(base: str, source: str, phase: str) -> str:
    return f"{source_root(base, source)}/{phase}_results"


def image_paths(rows: DataFrame, base: str) -> DataFrame:
    """Adds image_path, where the rendered page of each row (source, id) lies."""
    name = F.concat(T.safe_name(F.col("id")), F.lit(".png"))
    return rows.withColumn("image_path", F.concat_ws("/", F.lit(base), F.col("source"), F.lit("images"), name))


def parse_sources(names: str | None) -> tuple[str, ...]:
    """Known sources from names parted by commas, in their fixed order; nothing means all, unknown ones are an error."""
    asked = {n.strip().lower() for n in (names or "").split(",") if n.strip()}
    if unknown := asked - set(SOURCE_ORDER):
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    return tuple(s for s in SOURCE_ORDER if not asked or s in asked)


def append_results(rows: DataFrame, base: str, source: str, phase: str) -> None:
    """Add results of a batch to the log of a phase; a run that stops continues after its last batch."""
    rows.write.mode("append").parquet(results_path(base, source, phase))


def clear_results(base: str, phase: str, sources: tuple[str, ...] = tuple(SOURCE_ORDER)) -> None:
    """Delete the logs of a phase."""
    for s in sources:
        shutil.rmtree(results_path(base, s, phase), ignore_errors=True)


def split_flat(spark: SparkSession, flat: str, base: str, tasks: DataFrame, phase: str) -> dict[str, int]:
    """Deal one flat log to the folders of its sources; rows without a source take it from ``tasks`` (id, source).
    Repeating it changes nothing: a source whose log is there keeps it. Gives the rows written by source."""
    rows = with_source(spark.read.parquet(flat), tasks.groupBy("id").agg(F.min("source").alias("source")))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row a source
    todo = {s: n for s, n in counts.items() if not Path(results_path(base, s, phase)).exists()}
    for s in todo:
        rows.where(F.col("source") == s).write.parquet(results_path(base, s, phase))
    return todo
