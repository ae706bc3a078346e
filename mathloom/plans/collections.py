"""Queries over the raw question collections and the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.operators import index as I
from mathloom.plans.texts import normalized_sql, structure_sql
from mathloom.sources import records as R
from mathloom.tables import read_table as read


def word_problems(spark: SparkSession, d: str) -> DataFrame:
    return R.word_problems(read(spark, d, "mwp_raw")).select("pos", "id", "source", "kind", "type", "ans", "equation")


def word_problem_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.word_problems(read(spark, d, "mwp_raw")).select("pos", "original_text", "normalized_text", "structure_text", "equation_template", "variant_group_id")


def competition_problems(spark: SparkSession, d: str) -> DataFrame:
    return R.competition_problems(read(spark, d, "math_raw")).select("id", "source", "kind", "type", "level", "split", "original_text")


def competition_answers(spark: SparkSession, d: str) -> DataFrame:
    return R.competition_problems(read(spark, d, "math_raw")).select("id", "ans", "normalized_text", "structure_text")


def geometry_problems(spark: SparkSession, d: str) -> DataFrame:
    return R.geometry_problems(read(spark, d, "geometry3k_raw")).select("id", "source", "kind", "split", "stem", "ans", F.size("graph").alias("graphs"), F.size("goal").alias("goals"))


def all_sources(spark: SparkSession, d: str) -> DataFrame:
    """Items of all sources in the fixed order of ingest; of a repeated id the first one."""
    mwp = R.word_problems(read(spark, d, "mwp_raw"))
    parts = [mwp.where("source = 'ape'"), mwp.where("source = 'cm17k'"), R.geometry_problems(read(spark, d, "geometry3k_raw")), R.competition_problems(read(spark, d, "math_raw"))]
    return R.first_of_each(parts).select("id", "source", "kind", "normalized_text")


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.source_counts(read(spark, d, "items").withColumn("source", F.lower(F.trim("source"))))


def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Of every item id the row delivered first, by an aggregate without a window."""
    items = read(spark, d, "items").where("id is not null")
    return items.groupBy("id").agg(F.min("pos").alias("pos"), F.count("*").alias("deliveries"))


def redelivered_figures(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and differing bits between the first delivery of an item and each later one."""
    items = read(spark, d, "items").where("id is not null").select("id", "pos", "diagram_vector", "phash")
    first = items.groupBy("id").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n > 1").drop("n")
    a = items.join(first, ["id", "pos"]).select("id", F.col("pos").alias("pos_a"), F.col("diagram_vector").alias("va"), F.col("phash").alias("ha"))
    b = items.select("id", F.col("pos").alias("pos_b"), F.col("diagram_vector").alias("vb"), F.col("phash").alias("hb"))
    pairs = a.join(b, "id").where("pos_a < pos_b")
    finite = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    cos = F.when(finite("va") & finite("vb"), F.round(I.cosine(F.col("va"), F.col("vb")), 4))
    return pairs.select("pos_a", "pos_b", cos.alias("cosine"), I.hamming(F.col("ha"), F.col("hb")).alias("bits"))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows of all items."""
    items = read(spark, d, "items")
    return R.manifest_rows(items.where("id is not null")).select("id", "source", "kind", "type", "split", "level", "has_diagram")


def source_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every source in the fixed order of ingest, each counted where it comes first."""
    mwp = R.word_problems(read(spark, d, "mwp_raw"))
    parts = [mwp.where("source = 'ape'"), mwp.where("source = 'cm17k'"), R.geometry_problems(read(spark, d, "geometry3k_raw")), R.competition_problems(read(spark, d, "math_raw"))]
    return R.first_of_each(parts).groupBy("source").agg(F.count("*").alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        word_problems, word_problem_texts, competition_problems, competition_answers, geometry_problems, all_sources, source_counts, first_deliveries, redelivered_figures, manifest_rows,
        source_sizes,
    )
}

_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_TRIM = rf"'^{_SPACE}+|{_SPACE}+$', '', 'g'"
_first = lambda *names: "coalesce(" + ", ".join(f"nullif(json_extract_string(record, '$.{n}'), '')" for n in names) + ")"
_cjk = rf"'([一-鿿]){_SPACE}+([一-鿿])', '\1\2', 'g'"
_BRACES = r"(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*"  # braces three deep
ORACLE = {
    "manifest_rows": """
SELECT id, source, kind, type, split, level, coalesce(phash, '') <> '' OR coalesce(len(diagram_vector) > 0, false) OR coalesce(image, '') <> '' has_diagram FROM items WHERE id IS NOT NULL""",
    "word_problems": rf"""
WITH r AS (SELECT line_no, lower(trim(source)) = 'cm17k' cm, record FROM mwp_raw WHERE json_valid(record)),
  f AS (SELECT line_no pos, cm, coalesce({_first('original_text', 'text', 'segmented_text')}, '') t0,
    coalesce(nullif({_first('id')}, '0'), nullif({_first('pid')}, '0')) rid, json_extract_string(record, '$.equation') e, json_extract_string(record, '$.ans') ans,
    {_first('type', 'problem_type')} typed FROM r),
  t AS (SELECT *, CASE WHEN cm THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(t0, {_cjk}), {_cjk}), '{_SPACE}+', ' ', 'g'), {_TRIM}) ELSE t0 END t FROM f)
SELECT pos, CASE WHEN rid IS NULL THEN CASE WHEN cm THEN 'cm17k' ELSE 'ape' END || '-' || substr(sha1(t), 1, 12) WHEN cm THEN 'cm17k-' || rid ELSE rid END id,
  CASE WHEN cm THEN 'cm17k' ELSE 'ape' END source,
  CASE WHEN contains(lower(typed), 'non') THEN 'function'
    WHEN contains(lower(typed), '方程') OR contains(lower(typed), 'equation') THEN CASE WHEN contains(lower(typed), 'set') OR contains(lower(typed), '组') THEN 'equationset' ELSE 'algebra' END
    WHEN contains(t, '函数') THEN 'function' WHEN contains(e, '^') OR contains(e, '**') THEN 'function' WHEN contains(e, ';') THEN 'equationset' ELSE 'algebra' END kind,
  typed AS type, ans, e AS equation
FROM t WHERE regexp_replace(t, '[\s\p{{Z}}\p{{Cc}}\\${{}}&]', '', 'g') <> ''""",
    "competition_problems": rf"""
WITH r AS (SELECT *, regexp_replace(problem, {_TRIM}) p, coalesce(nullif(regexp_extract(path, '_(train|test|valid|val)\.[^./]*$', 1), ''), regexp_extract(path, '^(?:.*/)?(train|test|valid|val)/', 1)) s0,
    coalesce(nullif(replace(regexp_extract(path, '([^/]+)/[^/]+$', 1), '_', ' '), ''), nullif(type, ''), 'unknown') subject,
    regexp_extract(path, '([^/]+?)(?:\.[^./]*)?$', 1) AS file FROM math_raw WHERE solution IS NOT NULL AND problem IS NOT NULL),
  s AS (SELECT *, CASE WHEN s0 = 'val' THEN 'valid' ELSE s0 END sp, regexp_replace(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug,
    regexp_replace(regexp_replace(p, '(?is)\[asy\].*?\[/asy\]', chr(10), 'g'), {_TRIM}) stem FROM r WHERE p <> '')
SELECT 'math-' || CASE WHEN sp <> '' THEN sp || '-' ELSE '' END || slug || '-' || regexp_replace(regexp_replace(lower(file), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') id,
  'math' source, CASE WHEN contains(slug, 'geometry') THEN 'geometry' WHEN slug IN ('algebra', 'intermediate-algebra', 'precalculus') OR ends_with(slug, 'calculus') THEN 'function'
    ELSE 'algebra' END kind, subject AS type, level, nullif(sp, '') split, coalesce(nullif(stem, ''), p) original_text FROM s""",
    "geometry_problems": rf"""
WITH r AS (SELECT *, {", ".join(f"regexp_replace(regexp_replace(replace(coalesce({c}, ''), '<image>', ''), '{_SPACE}+', ' ', 'g'), {_TRIM}) {n}" for c, n in (("problem_text", "a"), ("annotat_text", "b"), ("compact_text", "c")))},
    list_filter(coalesce(problem_type_graph, []), lambda x: x <> '') g, list_filter(coalesce(problem_type_goal, []), lambda x: x <> '') o,
    len(list_filter(coalesce(logic_form.text_logic_form, []), lambda x: x <> '')) + len(list_filter(coalesce(logic_form.diagram_logic_form, []), lambda x: x <> '')) l FROM geometry3k_raw)
SELECT 'g3k-' || id AS id, 'geometry3k' source, 'geometry' kind, data_type AS split, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) stem,
  coalesce(CASE WHEN answer IN ('A', 'B', 'C', 'D') THEN choices[ascii(answer) - 64] END, answer) ans, CAST(len(g) AS INTEGER) graphs, CAST(len(o) AS INTEGER) goals
FROM r WHERE coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) IS NOT NULL OR len(g) + len(o) + l > 0""",
    "source_counts": "SELECT coalesce(nullif(lower(trim(source)), ''), 'unknown') AS source, count(*) items FROM items GROUP BY 1",
    "first_deliveries": "SELECT id, min(pos) pos, count(*) deliveries FROM items WHERE id IS NOT NULL GROUP BY id",
    "redelivered_figures": """
WITH f AS (SELECT id, min(pos) pos FROM items WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1),
  p AS (SELECT a.pos pos_a, b.pos pos_b, a.diagram_vector va, b.diagram_vector vb, a.phash ha, b.phash hb
    FROM f JOIN items a ON a.id = f.id AND a.pos = f.pos JOIN items b ON b.id = f.id AND b.pos > a.pos),
  ok AS (SELECT *, coalesce(len(va) = len(vb) AND len(va) > 0 AND len(list_filter(va, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vb, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) fine,
    coalesce(regexp_full_match(ha, '[0-9a-fA-F]{16}') AND regexp_full_match(hb, '[0-9a-fA-F]{16}'), false) hex FROM p)
SELECT pos_a, pos_b, CASE WHEN fine THEN round(coalesce(list_sum(list_transform(range(1, len(va) + 1), lambda i: va[i]::DOUBLE * vb[i]::DOUBLE))
    / nullif(sqrt(list_sum(list_transform(va, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(vb, lambda x: x::DOUBLE * x::DOUBLE))), 0), 0), 4) END cosine,
  CASE WHEN hex THEN CAST(bit_count(xor(CAST('0x' || substr(ha, 1, 8) AS BIGINT), CAST('0x' || substr(hb, 1, 8) AS BIGINT)))
    + bit_count(xor(CAST('0x' || substr(ha, 9, 8) AS BIGINT), CAST('0x' || substr(hb, 9, 8) AS BIGINT))) AS INTEGER) END bits FROM ok""",
}
ORACLE["source_sizes"] = f"""
WITH w AS ({ORACLE["word_problems"]}), g AS ({ORACLE["geometry_problems"]}), c AS ({ORACLE["competition_problems"]}),
  u AS (SELECT CASE source WHEN 'ape' THEN 0 ELSE 1 END part, id, source FROM w UNION ALL SELECT 2, id, source FROM g UNION ALL SELECT 3, id, source FROM c)
SELECT source, count(*) items FROM (SELECT id, arg_min(source, part) AS source FROM u GROUP BY id) GROUP BY source"""
_MATH_ROWS, _MATH_COLUMNS = ORACLE["competition_problems"].split("\nSELECT ")
_LAST_BOX = r"regexp_replace(regexp_extract(solution, '(?s)^.*\\boxed(.*)$', 1), '^[\s]+', '')"
ORACLE["competition_answers"] = rf"""{_MATH_ROWS},
  a AS (SELECT {_MATH_COLUMNS.split(" id,")[0]} id, coalesce(nullif(stem, ''), p) t, contains(solution, '\boxed') has, {_LAST_BOX} b FROM s),
  n AS (SELECT id, has, b, {normalized_sql('t')} normalized_text FROM a)
SELECT id, CASE WHEN NOT has THEN NULL WHEN starts_with(b, '{{') THEN nullif(regexp_replace(regexp_extract(b, '^\{{({_BRACES})\}}', 1), {_TRIM}), '') ELSE nullif(regexp_extract(b, '^[^\s]+'), '') END ans,
  normalized_text, {structure_sql('normalized_text')} structure_text FROM n WHERE normalized_text <> ''"""
_WORD_ROWS = ORACLE["word_problems"].split("\nSELECT ")[0]
ORACLE["word_problem_texts"] = f"""
{_WORD_ROWS}, n AS (SELECT pos, t original_text, e, {normalized_sql('t')} normalized_text, {normalized_sql('e')} q FROM t),
  s AS (SELECT *, {structure_sql('normalized_text')} structure_text FROM n WHERE normalized_text <> '')
SELECT pos, original_text, normalized_text, structure_text, CASE WHEN e IS NOT NULL THEN nullif({structure_sql('q')}, '') END equation_template,
  'vg_' || substr(sha1(structure_text), 1, 16) variant_group_id FROM s"""
