"""Question collections as one item table.

Every projection is a select over raw columns; ``pos`` is the row's place in its source and replaces
list positions. The raw tables are read lazily and only the columns used are scanned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mathloom.functions import plain
from mathloom.functions import text as T

#: Items of every source: the columns in order and their types.
ITEM_COLUMNS = {
    "pos": "bigint", "id": "string", "original_text": "string", "normalized_text": "string", "structure_text": "string", "equation": "string",
    "equation_template": "string", "original_cluster_id": "string", "variant_group_id": "string", "ans": "string", "source": "string",
    "kind": "string", "type": "string", "level": "string", "split": "string", "stem": "string", "graph": "array<string>", "goal": "array<string>",
    "text_logic": "array<string>", "image": "string",
}
# Subjects that are read as functions.
_FUNCTION_SUBJECTS = ["algebra", "intermediate-algebra", "precalculus"]


def _filled(c: Column) -> Column:
    """Null for the empty text: the first non-empty of several values is their coalesce."""
    return F.nullif(c, F.lit(""))


def items_from(df: DataFrame, **columns: Column) -> DataFrame:
    """The item table of ``df``: given columns, canonical forms of ``original_text`` (or of ``index_text``
    where that is given) and nulls for the rest. Items without any canonical text are left out."""
    index = columns.pop("index_text", None)
    made = df.select(*(c.alias(n) for n, c in columns.items()), (columns["original_text"] if index is None else index).alias("_index"))
    made = made.withColumn("normalized_text", T.normalize(F.col("_index"))).withColumn("structure_text", T.structure(F.col("normalized_text")))
    made = made.withColumn("original_cluster_id", F.col("id")).withColumn("variant_group_id", T.variant_group(F.col("structure_text")))
    if "equation" in columns:
        made = T.with_template(made, F.col("equation"), "equation_template")
    return made.select(*((F.col(n) if n in made.columns else F.lit(None)).cast(t).alias(n) for n, t in ITEM_COLUMNS.items())).where("normalized_text <> ''")


def word_problem_kind(text: Column, equation: Column, typed: Column) -> Column:
    """Kind of a word problem from its declared type, its words and its equation."""
    t, e = F.lower(F.coalesce(typed, F.lit(""))), F.coalesce(equation, F.lit(""))
    return (
        F.when(t.contains("non"), "function")
        .when(t.contains("方程") | t.contains("equation"), F.when(t.contains("set") | t.contains("组"), "equationset").otherwise("algebra"))
        .when(F.coalesce(text, F.lit("")).contains("函数"), "function")
        .when(e.contains("^") | e.contains("**"), "function")
        .when(e.contains(";"), "equationset")
        .otherwise("algebra")
    )


_MWP = "id string, pid string, original_text string, text string, segmented_text string, equation string, ans string, type string, problem_type string"


def word_problems(raw: DataFrame) -> DataFrame:
    """Items of ape and cm17k from rows (line_no, source, record). Lines that are no JSON object, or whose
    text is null or empty, are left out; fields may be numbers."""
    r = F.from_json("record", _MWP, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})
    whole = F.try_parse_json("record").isNotNull()
    rows = raw.where(whole).select(F.col("line_no").alias("pos"), F.lower(T.trimmed(F.col("source"))).alias("src"), r.alias("r"))
    first = F.coalesce(_filled(F.col("r.original_text")), _filled(F.col("r.text")), _filled(F.col("r.segmented_text")), F.lit(""))
    cm = F.col("src") == "cm17k"
    text = F.when(cm, T.without_cjk_spaces(first)).otherwise(first)
    raw_id = F.coalesce(*(F.nullif(_filled(F.col(f"r.{k}")), F.lit("0")) for k in ("id", "pid")))
    name = F.when(cm, "cm17k").otherwise("ape")
    item_id = F.when(raw_id.isNull(), F.concat(name, F.lit("-"), F.substring(F.sha1(text), 1, 12))).when(cm, F.concat(F.lit("cm17k-"), raw_id)).otherwise(raw_id)
    typed = F.coalesce(_filled(F.col("r.type")), _filled(F.col("r.problem_type")))
    rows = rows.select("pos", item_id.alias("id"), text.alias("t"), F.col("r.equation").alias("e"), F.col("r.ans").alias("ans"), name.alias("name"), typed.alias("typed"))
    return items_from(
        rows, pos=F.col("pos"), id=F.col("id"), original_text=F.col("t"), equation=F.col("e"), ans=F.col("ans"), source=F.col("name"), type=F.col("typed"),
        kind=word_problem_kind(F.col("t"), F.col("e"), F.col("typed")),
    )


@F.pandas_udf(StringType())
def boxed_answer(s: pd.Series) -> pd.Series:
    """Content of the last boxed answer of a solution."""
    return s.map(plain.boxed_answer)


def subject_kind(subject: Column) -> Column:
    s = T.slug(subject)
    return F.when(s.contains("geometry"), "geometry").when(s.isin(_FUNCTION_SUBJECTS) | s.endswith("calculus"), "function").otherwise("algebra")


def competition_problems(raw: DataFrame) -> DataFrame:
    """Items of math from rows (path, problem, level, type, solution); split, subject and file name come
    from the path. Rows without problem or solution are no records."""
    rows = raw.where((T.trimmed(F.coalesce("problem", F.lit(""))) != "") & F.col("solution").isNotNull())
    named = F.regexp_extract("path", r"_(train|test|valid|val)\.[^./]*$", 1)
    split = F.coalesce(_filled(named), F.regexp_extract("path", r"^(?:.*/)?(train|test|valid|val)/", 1))
    split = F.when(split == "val", "valid").otherwise(split)
    folder = F.replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("_"), F.lit(" "))
    subject = F.coalesce(_filled(folder), _filled(F.col("type")), F.lit("unknown"))
    file = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    problem = T.trimmed(F.col("problem"))
    stem = F.coalesce(_filled(T.without_drawing(problem)), problem)
    item_id = F.concat_ws("-", F.lit("math"), F.when(split != "", T.slug(split)), T.slug(subject), T.slug(file))
    return items_from(
        rows, pos=F.monotonically_increasing_id() if "pos" not in raw.columns else F.col("pos"), id=item_id, original_text=stem, source=F.lit("math"),
        kind=subject_kind(subject), type=subject, level=F.col("level"), split=_filled(split), stem=T.one_spaced(stem), ans=boxed_answer("solution"),
    )


def _words(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def geometry_problems(raw: DataFrame) -> DataFrame:
    """Items of geometry3k: the readable stem as text, and the stem with figure, goal and logic forms as
    index text, from which the canonical forms come."""
    text = {k: F.replace(F.coalesce(F.col(k), F.lit("")), F.lit("<image>"), F.lit("")) for k in ("problem_text", "annotat_text", "compact_text")}
    stem = F.coalesce(*(_filled(T.one_spaced(text[k])) for k in ("problem_text", "annotat_text", "compact_text")), F.lit(""))
    first = F.coalesce(*(_filled(F.col(k)) for k in ("annotat_text", "problem_text", "compact_text")), F.lit(""))
    problem = T.trimmed(F.replace(first, F.lit("<image>"), F.lit("")))
    lists = [_words(F.col(c)) for c in ("problem_type_graph", "problem_type_goal", "logic_form.text_logic_form", "logic_form.diagram_logic_form")]
    index = F.concat_ws(" ", _filled(problem), *(_filled(F.array_join(x, " ")) for x in lists))
    letter = F.locate("A", F.lit("A"))  # keeps the type an int
    place = F.when(F.col("answer").isin("A", "B", "C", "D"), F.ascii("answer") - 65 + letter)
    choice = F.when(place <= F.size("choices"), F.try_element_at("choices", place))
    item_id = F.concat(F.lit("g3k-"), F.coalesce(F.col("id").cast("string"), F.substring(F.sha1(index), 1, 12)))
    return items_from(
        raw, pos=F.monotonically_increasing_id() if "pos" not in raw.columns else F.col("pos"), id=item_id, original_text=F.coalesce(_filled(stem), index),
        index_text=index, source=F.lit("geometry3k"), kind=F.lit("geometry"), split=F.col("data_type"), stem=_filled(stem), graph=lists[0], goal=lists[1],
        text_logic=lists[2], ans=F.coalesce(choice, F.col("answer")),
    )


def first_of_each(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Union of item tables in order; of a repeated id the first row stays. The limit counts rows over all
    parts in order. Without a window over everything: a repeated id is settled by an aggregate of its key."""
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    every = numbered[0]
    for p in numbered[1:]:
        every = every.unionByName(p)
    key = F.struct("part", "pos", F.xxhash64("original_text"))
    firsts = every.groupBy("id").agg(F.min(key).alias("k")).select("id", "k.part", "k.pos", F.col("k.col3").alias("tie"))
    out = every.withColumn("tie", F.xxhash64("original_text")).join(firsts, ["id", "part", "pos", "tie"], "left_semi").drop("tie")
    return (out.orderBy("part", "pos").limit(limit) if limit is not None else out).drop("part")


def manifest_rows(items: DataFrame) -> DataFrame:
    """Rows of a task manifest from items: labels, text, figure; has_diagram is true where a hash, a vector or an image
    is known."""
    known = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    has = (F.coalesce(known("phash", "string"), F.lit("")) != "") | F.coalesce(F.size(known("diagram_vector", "array<float>")) > 0, F.lit(False)) | (F.coalesce(known("image", "string"), F.lit("")) != "")
    labels = [known(c, "string").alias(c) for c in ("source", "kind", "type", "split", "level")]
    return items.select("id", *labels, has.alias("has_diagram"), known("image", "string").alias("image"), "original_text")
