"""Queries over the evaluation log and the task manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.config import SearchConfig
from mathloom.operators import evaluate as E
from mathloom.operators import search as S
from mathloom.tables import read_table as read

#: Rows of each source that a task set takes.
QUOTA = {"ape": 1328, "cm17k": 4554, "geometry3k": 797, "math": 3321}


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The log without rows that were written twice, labels in one spelling."""
    rows = read(spark, d, "eval_rows").dropDuplicates(["row_id"])
    return rows.withColumn("source", F.lower(F.trim("source"))).withColumn("kind", F.lower(F.trim("kind")))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "task_manifest").distinct()
    return m.withColumn("source", F.lower(F.trim("source"))).withColumn("kind", F.lower(F.trim("kind")))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(_log(spark, d))


def eval_by_key(spark: SparkSession, d: str) -> DataFrame:
    return E.summary_by(_log(spark, d), ["source", "kind", "phase"])


def eval_combined(spark: SparkSession, d: str) -> DataFrame:
    return E.combined(E.summary_by(_log(spark, d), ["source"]))


def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    return E.failures(_log(spark, d))


def task_counts(spark: SparkSession, d: str) -> DataFrame:
    keys = {
        "source": ("source", None), "kind": ("kind", None), "has_diagram": ("has_diagram", None), "math_type": ("type", "math"), "math_split": ("split", "math"),
        "math_level": ("level", "math"), "geometry3k_split": ("split", "geometry3k"),
    }
    return E.counts_by(_tasks(spark, d), keys)


def task_sample(spark: SparkSession, d: str) -> DataFrame:
    """The task set: a fixed number of rows of each source in hash order."""
    one = _tasks(spark, d).groupBy("id").agg(F.min("source").alias("source"), F.min("kind").alias("kind"))
    return E.stratified_sample(one, "source", "id", QUOTA)


def pending_tasks(spark: SparkSession, d: str) -> DataFrame:
    done = _log(spark, d).where("phase = 'text'")
    return E.pending(_tasks(spark, d).select("id", "source").distinct(), done)


def known_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose item exists, and how many do not, by source."""
    t, items = _tasks(spark, d).select("id", "source").distinct(), read(spark, d, "items").select("id").distinct()
    known = t.join(items, "id", "left_semi").groupBy("source").agg(F.count("*").alias("known"))
    unknown = t.join(items, "id", "left_anti").groupBy("source").agg(F.count("*").alias("skipped"))
    out = known.join(unknown, "source", "full")
    return out.select("source", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def looked_up_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the log without a source take it from the manifest, else unknown."""
    ids = _tasks(spark, d).groupBy("id").agg(F.min("source").alias("source"))
    return E.with_source(_log(spark, d), ids).groupBy("source", "phase").agg(F.count("*").alias("n"))


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """The text run with the rows of the image run in place of its own where both have the id."""
    log = _log(spark, d).where("id is not null").select("id", "phase", "row_id")
    out = E.merged(log.where("phase = 'text'"), log.where("phase = 'image'"), "id")
    return out.groupBy("phase").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def result_relations(spark: SparkSession, d: str) -> DataFrame:
    """Results by relation and place, with mean scores and how many are the asked item."""
    r = _log(spark, d).select("id", F.posexplode("results").alias("place", "r"))
    avg = lambda c: F.round(F.avg(f"r.{c}"), 6).alias(c)
    return r.groupBy(F.col("r.relation").alias("relation"), (F.col("place") + 1).alias("place")).agg(F.count("*").alias("n"), F.count_if(F.col("r.id") == F.col("id")).alias("gold"), avg("final"), avg("surface"), avg("structure"), avg("formula"))


def result_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flags of every logged query computed again from its packed results."""
    log = _log(spark, d)
    tasks = log.select(F.col("row_id").alias("qid"), F.col("id").alias("gold"))
    shown = log.select(F.col("row_id").alias("qid"), F.posexplode("results").alias("n", "r")).select("qid", (F.col("n") + 1).alias("place"), "r.id", "r.relation")
    return E.score(shown, tasks)


def rates_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = E.summary_by(_log(spark, d), ["source"])
    return s.select(F.col("value").alias("source"), E.source_rank("value").alias("rank"), E.percent(F.col("hit_rate")).alias("hit"), E.percent(F.col("first_rate")).alias("first"))


def feature_scores(spark: SparkSession, d: str) -> DataFrame:
    """Logged results scored and ordered again from their similarities, as if they had been recalled in logged order."""
    r = _log(spark, d).select("row_id", F.posexplode("results").alias("rank", "r"))
    c = r.select(
        F.col("row_id").alias("qid"), "rank", F.col("r.id").alias("id"), F.coalesce(F.col("r.relation") == "original", F.lit(False)).alias("is_original"),
        F.coalesce(F.col("r.relation") == "variant", F.lit(False)).alias("is_variant"), *(F.coalesce(f"r.{x}", F.lit(0.0)).alias(x) for x in ("surface", "structure")),
        F.coalesce("r.formula", F.lit(0.0)).alias("formula_score"), F.lit(0.5).alias("retrieval"), F.lit(None).cast("double").alias("diagram_score"),
    )
    ranked = S.rerank(c, SearchConfig(), use_formula=True)
    return ranked.select("qid", "rank", "id", "place", F.round("final_score", 6).alias("score"))


def packed_logs(spark: SparkSession, d: str) -> DataFrame:
    """The log written again from its tasks, flags and results."""
    log = _log(spark, d)
    shown = log.select(F.col("row_id").alias("qid"), F.posexplode("results").alias("n", "r")).select("qid", (F.col("n") + 1).alias("place"), "r.*")
    tasks = log.select(F.col("row_id").alias("qid"), F.col("id").alias("gold"), "query_text")
    rows = E.logged_rows(tasks, E.score(shown, tasks), shown, "again")
    return rows.select("qid", "gold", "hit", "first", "gold_original", "empty", "extra_originals", "returned", "query_text", F.coalesce(F.size("results"), F.lit(0)).alias("packed"), F.col("results")[0]["id"].alias("best"), "phase")


QUERIES = {
    f.__name__: f
    for f in (
        eval_summary, eval_by_key, eval_combined, eval_failures, task_counts, task_sample, pending_tasks, known_tasks, looked_up_sources, merged_runs, result_relations,
        result_flags, rates_by_source, feature_scores, packed_logs,
    )
}

_LOG = """l AS (SELECT * REPLACE (lower(trim(source)) AS source, lower(trim(kind)) AS kind) FROM
  (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY logged_at) rn FROM eval_rows) WHERE rn = 1)"""
_TASKS = "m AS (SELECT DISTINCT * REPLACE (lower(trim(source)) AS source, lower(trim(kind)) AS kind) FROM (SELECT DISTINCT * FROM task_manifest))"
_SUMS = """count(*) samples, count(*) FILTER (hit) hit, count(*) FILTER ("first") AS "first", count(*) FILTER (gold_original) gold_original,
  count(*) FILTER (extra_originals > 0) extra_original, count(*) FILTER ("empty") AS "empty",
  round(coalesce(count(*) FILTER (hit) / count(*), 0), 6) hit_rate, round(coalesce(count(*) FILTER ("first") / count(*), 0), 6) first_rate,
  round(coalesce(count(*) FILTER (gold_original) / count(*), 0), 6) gold_original_rate, round(coalesce(count(*) FILTER (extra_originals > 0) / count(*), 0), 6) extra_original_rate,
  round(coalesce(count(*) FILTER ("empty") / count(*), 0), 6) empty_rate, round(coalesce(sum(coalesce(returned, 0)) / count(*), 0), 6) avg_returned,
  round(coalesce(sum(coalesce(elapsed_s, 0)) / count(*), 0), 6) avg_elapsed_s"""
_KEYS = " UNION ALL ".join(f"SELECT '{k}' AS key, coalesce(nullif({k}, ''), 'unknown') AS value, * FROM l" for k in ("source", "kind", "phase"))
ORACLE = {
    "feature_scores": f"""
WITH {_LOG}, r AS (SELECT row_id qid, unnest(results) x, unnest(range(len(results))) "rank" FROM l),
  c AS (SELECT qid, "rank", x.id id, coalesce(x.relation = 'original', false) o, coalesce(x.relation = 'variant', false) v, coalesce(x.surface, 0) su, coalesce(x.structure, 0) st, coalesce(x.formula, 0) fo FROM r),
  p AS (SELECT *, sum(o::INT) OVER (PARTITION BY qid) os, sum(v::INT) OVER (PARTITION BY qid ORDER BY "rank") n FROM c WHERE o OR v),
  f AS (SELECT *, CASE WHEN o THEN 1.25 ELSE 0.4 * st + 0.1 + 0.15 * fo + 0.1 * greatest(0, st - su) + CASE WHEN v THEN 0.15 ELSE 0 END - 0.15 * su END s FROM p WHERE o OR n <= greatest(0, {SearchConfig().rerank_k} - os))
SELECT qid, CAST("rank" AS INTEGER) AS "rank", id, CAST(row_number() OVER (PARTITION BY qid ORDER BY o DESC, s DESC, "rank") AS INTEGER) place, round(s, 6) score FROM f""",
    "packed_logs": f"""
WITH {_LOG}, r AS (SELECT row_id, id gold, unnest(results) r, unnest(range(1, len(results) + 1)) place FROM l),
  s AS (SELECT row_id, bool_or(r.id = gold) hit, bool_or(r.id = gold AND place = 1) f, bool_or(r.id = gold AND r.relation = 'original') g,
    count(*) FILTER (r.relation = 'original' AND r.id <> gold) e, count(*) n FROM r GROUP BY row_id)
SELECT l.row_id qid, id gold, coalesce(s.hit, false) hit, coalesce(f, false) AS "first", coalesce(g, false) gold_original, n IS NULL AS "empty", CAST(coalesce(e, 0) AS INTEGER) extra_originals,
  CAST(coalesce(n, 0) AS INTEGER) returned, left(query_text, 400) query_text, CAST(CASE WHEN n > 0 THEN len(results) ELSE 0 END AS INTEGER) packed, CASE WHEN n > 0 THEN results[1].id END best, 'again' phase
FROM l LEFT JOIN s ON s.row_id = l.row_id""",
    "eval_summary": f"WITH {_LOG} SELECT {_SUMS} FROM l",
    "eval_by_key": f"WITH {_LOG} SELECT key, value, {_SUMS} FROM ({_KEYS}) GROUP BY key, value",
    "eval_combined": f"WITH {_LOG} SELECT {_SUMS} FROM l",
    "eval_failures": f"""
WITH {_LOG}, t AS (SELECT row_id, id, unnest(list_filter([CASE WHEN NOT coalesce(hit, false) THEN 'miss' END,
    CASE WHEN hit AND NOT coalesce("first", false) THEN 'not_first' END, CASE WHEN hit AND NOT coalesce(gold_original, false) THEN 'hit_not_marked_original' END,
    CASE WHEN extra_originals > 0 THEN 'extra_original' END], lambda x: x IS NOT NULL)) AS "sample" FROM l),
  r AS (SELECT "sample", count(*) OVER (PARTITION BY "sample") n, CAST(row_number() OVER (PARTITION BY "sample" ORDER BY row_id, id) AS INTEGER) AS "rank", row_id, id FROM t)
SELECT * FROM r WHERE "rank" <= 30""",
    "task_counts": f"""
WITH {_TASKS} SELECT what, value, count(*) n FROM (
  SELECT 'source' what, source AS value FROM m UNION ALL SELECT 'kind', kind FROM m UNION ALL SELECT 'has_diagram', CAST(has_diagram AS VARCHAR) FROM m
  UNION ALL SELECT 'math_type', type FROM m WHERE source = 'math' UNION ALL SELECT 'math_split', split FROM m WHERE source = 'math'
  UNION ALL SELECT 'math_level', level FROM m WHERE source = 'math' UNION ALL SELECT 'geometry3k_split', split FROM m WHERE source = 'geometry3k') GROUP BY ALL""",
    "task_sample": f"""
WITH {_TASKS}, o AS (SELECT id, min(source) AS source, min(kind) AS kind FROM m GROUP BY id)
SELECT id, source, kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || '|0'), id) rn FROM o) WHERE
  rn <= CASE source {" ".join(f"WHEN '{k}' THEN {max(1, v // 40)}" for k, v in QUOTA.items())} ELSE 0 END""",
    "pending_tasks": f"WITH {_LOG}, {_TASKS} SELECT DISTINCT id, source FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = m.id AND phase = 'text')",
    "known_tasks": f"""
WITH {_TASKS}, t AS (SELECT DISTINCT id, source FROM m) SELECT source, count(*) FILTER (EXISTS (SELECT 1 FROM items i WHERE i.id = t.id)) known,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM items i WHERE i.id = t.id)) skipped FROM t GROUP BY source""",
    "looked_up_sources": f"""
WITH {_LOG}, {_TASKS}, i AS (SELECT id, min(source) s FROM m GROUP BY id)
SELECT coalesce(nullif(source, ''), s, 'unknown') AS source, phase, count(*) n FROM l LEFT JOIN i USING (id) GROUP BY ALL""",
    "merged_runs": f"""
WITH {_LOG}, u AS (SELECT id, phase FROM l WHERE id IS NOT NULL AND (phase = 'image' OR (phase = 'text' AND id NOT IN (SELECT id FROM l WHERE phase = 'image' AND id IS NOT NULL))))
SELECT phase, count(*) n, count(DISTINCT id) ids FROM u GROUP BY phase""",
    "result_relations": f"""
WITH {_LOG}, t AS (SELECT id, unnest(results) x, unnest(range(1, len(results) + 1)) place FROM l)
SELECT x.relation relation, CAST(place AS INTEGER) place, count(*) n, count(*) FILTER (x.id = t.id) gold, round(avg(x.final), 6) AS "final", round(avg(x.surface), 6) surface,
  round(avg(x.structure), 6) structure, round(avg(x.formula), 6) formula FROM t GROUP BY ALL""",
    "result_flags": f"""
WITH {_LOG}, r AS (SELECT row_id, id gold, unnest(results) r, unnest(range(1, len(results) + 1)) place FROM l),
  s AS (SELECT row_id, bool_or(r.id = gold) hit, bool_or(r.id = gold AND place = 1) f, bool_or(r.id = gold AND r.relation = 'original') g,
    count(*) FILTER (r.relation = 'original' AND r.id <> gold) e, count(*) n FROM r GROUP BY row_id)
SELECT l.row_id qid, id gold, coalesce(s.hit, false) hit, coalesce(f, false) AS "first", coalesce(g, false) gold_original, CAST(coalesce(e, 0) AS INTEGER) extra_originals,
  n IS NULL AS "empty", CAST(coalesce(n, 0) AS INTEGER) returned FROM l LEFT JOIN s ON s.row_id = l.row_id""",
    "rates_by_source": f"""
WITH {_LOG} SELECT coalesce(nullif(source, ''), 'unknown') AS source, CAST(coalesce(list_position(['ape', 'cm17k', 'geometry3k', 'math'], source), 5) AS INTEGER) AS "rank",
  format('{{:.1f}}%', round(count(*) FILTER (hit) / count(*), 6) * 100) hit, format('{{:.1f}}%', round(count(*) FILTER ("first") / count(*), 6) * 100) AS "first" FROM l GROUP BY 1, 2""",
}
