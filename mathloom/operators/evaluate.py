"""Evaluation of searches: samples, rewritten queries, flags, rates, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mathloom.functions import plain
from mathloom.operators.index import Index
from mathloom.operators.search import prepare_queries, search, search_images
from mathloom.sources.files import image_manifest
from mathloom.storage import materialize

#: The order in which sources are reported; others follow by name.
SOURCE_ORDER = ["ape", "cm17k", "geometry3k", "math"]
FLAGS = ["hit", "first", "gold_original", "empty"]


@F.pandas_udf(StringType())
def with_other_numbers(text: pd.Series) -> pd.Series:
    """The text with its numbers changed by a fixed rule, null if it has none."""
    return text.map(plain.with_other_numbers)


def hash_order(*key: str, seed: int = 0) -> Column:
    """A reproducible shuffle: the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))))


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: dict[str, int], seed: int = 0) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order; other strata are left out. Every task keeps at
    most its quota before rows move, so a large stratum is no large group."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col(stratum))
    known = df.where(F.col(stratum).isin(list(quota)))
    w = Window.partitionBy(stratum).orderBy(hash_order(key, seed=seed), key)
    most = max(quota.values(), default=0)
    return known.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("_n") <= limit)).drop("_n")


def score(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Flags of each task (qid, gold): hit, first, gold_original, extra_originals, empty, returned. A task
    without results keeps its row."""
    r = results.join(tasks.select("qid", "gold"), "qid")
    is_gold, original = F.col("id") == F.col("gold"), F.col("relation") == "original"
    per = r.groupBy("qid").agg(
        F.max(is_gold).alias("hit"), F.max(is_gold & (F.col("place") == 1)).alias("first"), F.max(is_gold & original).alias("gold_original"),
        F.count_if(original & ~is_gold).cast("int").alias("extra_originals"), F.count("*").cast("int").alias("returned"),
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return tasks.join(per, "qid", "left").select(
        "qid", "gold", flag("hit"), flag("first"), flag("gold_original"), F.coalesce("extra_originals", F.lit(0)).alias("extra_originals"),
        F.col("returned").isNull().alias("empty"), F.coalesce("returned", F.lit(0)).alias("returned"),
    )


def packed_results(results: DataFrame) -> DataFrame:
    """(qid, results): the shown rows of a query as one array in order."""
    row = F.struct("place", "id", "relation", "final", "surface", "structure", "formula")
    return results.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("v")).select("qid", F.transform("v", lambda x: x.dropFields("place")).alias("results"))


def logged_rows(tasks: DataFrame, scored: DataFrame, results: DataFrame, phase: str) -> DataFrame:
    """Rows of the evaluation log: task, flags and packed results; tasks that failed get an empty row."""
    out = tasks.join(scored.drop("gold"), "qid", "left").join(packed_results(results), "qid", "left")
    cut = F.left("query_text", F.lit(400)).alias("query_text") if "query_text" in tasks.columns else F.lit(None).cast("string").alias("query_text")
    flags = [F.coalesce(F.col(c), F.lit(c == "empty")).alias(c) for c in FLAGS]
    return out.select("qid", "gold", *flags, F.coalesce("extra_originals", F.lit(0)).alias("extra_originals"), F.coalesce("returned", F.lit(0)).alias("returned"), cut, "results", F.lit(phase).alias("phase"))


def _rates() -> list[Column]:
    n = F.count("*")
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    extra = F.count_if(F.coalesce("extra_originals", F.lit(0)) > 0)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), n), F.lit(0.0))
    counts = {"hit": count("hit"), "first": count("first"), "gold_original": count("gold_original"), "extra_original": extra, "empty": count("empty")}
    rates = [F.round(F.coalesce(F.try_divide(v, n), F.lit(0.0)), 6).alias(f"{k}_rate") for k, v in counts.items()]
    means = [F.round(mean("returned"), 6).alias("avg_returned"), F.round(mean("elapsed_s"), 6).alias("avg_elapsed_s")]
    return [n.alias("samples"), *(v.alias(k) for k, v in counts.items()), *rates, *means]


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts and rates; all zero for an empty log."""
    return rows.agg(*_rates())


def known(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))


def summary_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, ...): the summary by every value of each key, in one pass over grouping sets."""
    named = rows.select("*", *(known(k).alias(f"_{k}") for k in keys))
    spread = named.select("hit", "first", "gold_original", "empty", "extra_originals", "returned", "elapsed_s", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value")) for k in keys))).alias("g"))
    return spread.groupBy(F.col("g.key").alias("key"), F.col("g.value").alias("value")).agg(*_rates())


def combined(parts: DataFrame) -> DataFrame:
    """One summary from those of parts: counts add up, means weigh by samples."""
    n = F.sum("samples")
    sums = ["hit", "first", "gold_original", "extra_original", "empty"]
    return parts.where("samples > 0").agg(
        F.coalesce(n, F.lit(0)).alias("samples"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
        *(F.round(F.coalesce(F.try_divide(F.sum(c), n), F.lit(0.0)), 6).alias(f"{c}_rate") for c in sums),
        *(F.round(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("samples")), n), F.lit(0.0)), 6).alias(c) for c in ("avg_returned", "avg_elapsed_s")),
    )


def failures(rows: DataFrame, limit: int = 30, order: str = "row_id") -> DataFrame:
    """(sample, n, rank, key): up to ``limit`` rows of each kind of failure with the full count of the kind."""
    hit = F.coalesce("hit", F.lit(False))
    kinds = {
        "miss": ~hit, "not_first": hit & ~F.coalesce("first", F.lit(False)), "hit_not_marked_original": hit & ~F.coalesce("gold_original", F.lit(False)),
        "extra_original": F.coalesce("extra_originals", F.lit(0)) > 0,
    }
    tagged = rows.select(order, "id", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in kinds.items())))).alias("sample"))
    counts = tagged.groupBy("sample").agg(F.count("*").alias("n"))
    first = tagged.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(order, "id"))).where(F.col("rank") <= limit)
    return first.join(F.broadcast(counts), "sample").select("sample", "n", "rank", order, "id")


def counts_by(rows: DataFrame, keys: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(what, value, n): several counts over one row set at once. ``keys``: name -> (column, source it is
    restricted to or None)."""
    one = [F.when(F.lit(True) if src is None else F.col("source") == src, F.struct(F.lit(k).alias("what"), F.col(c).cast("string").alias("value"))) for k, (c, src) in keys.items()]
    return rows.select(F.explode(F.array_compact(F.array(*one))).alias("g")).groupBy("g.what", "g.value").agg(F.count("*").alias("n"))


def pending(tasks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Tasks without a result yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def with_source(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with their source, looked up by id where it is missing, else unknown. ``ids``: (id, source) unique."""
    found = rows.join(ids.select("id", F.col("source").alias("_s")), "id", "left")
    return found.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), "_s", F.lit("unknown"))).drop("_s")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of a key in both the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def source_rank(c: str = "source") -> Column:
    known_at = F.array_position(F.array(*(F.lit(s) for s in SOURCE_ORDER)), F.col(c))
    return F.when(known_at > 0, known_at).otherwise(len(SOURCE_ORDER) + 1)


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def run_eval(index: Index, limit: int = 200, seed: int = 0, use_formula: bool = True) -> DataFrame:
    """One row of rates over a sample of items: found by their own text, and by their text with other numbers.
    Both kinds of query are answered in one batch."""
    sample = index.items.orderBy(hash_order("id", seed=seed), "pos").limit(limit).select("pos", "id", "original_text")
    own = sample.select(F.concat(F.lit("o"), F.col("pos").cast("string")).alias("qid"), F.col("original_text").alias("text"), F.col("id").alias("gold"))
    other = sample.select(F.concat(F.lit("v"), F.col("pos").cast("string")).alias("qid"), with_other_numbers("original_text").alias("text"), F.col("id").alias("gold"))
    tasks = own.union(other.where("text is not null"))
    flags = score(search(index, prepare_queries(tasks.select("qid", "text"), use_formula), use_formula), tasks)
    o, v = flags.where("qid like 'o%'"), flags.where("qid like 'v%'")
    left = o.select("*", F.lit(0.0).alias("elapsed_s")).agg(*_rates(), F.coalesce(F.max("returned"), F.lit(0)).alias("max_returned"))
    right = v.agg(F.count("*").alias("variant_samples"), F.round(F.coalesce(F.try_divide(F.count_if("hit"), F.count("*")), F.lit(0.0)), 6).alias("variant_recall_at_3"))
    return left.crossJoin(right)  # one row each


def run_image_eval(index: Index, spark: SparkSession, folder: str, make_reader=None, use_formula: bool = True) -> DataFrame:
    """Flags of every image of a folder's manifest (qid is its path): searched by what a reader finds in it and
    held against its gold id. Images without text are empty answers."""
    tasks = materialize(image_manifest(spark, folder).select(F.col("path").alias("qid"), "gold"), "tasks")
    images = spark.read.format("image").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(folder)
    plain_path = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two file sources spell local paths differently
    shown = search_images(index, images, make_reader, use_formula=use_formula).withColumn("qid", plain_path("qid"))
    return score(shown, tasks.withColumn("qid", plain_path("qid")))
