"""Batched question search: recall, originals, variants, ranking, cutoff.

All queries are answered at once. Everything that depends on one text only is a stored column; only
similarities of pairs run in Python, after the k best of each query are known.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathloom.config import SearchConfig
from mathloom.functions import formula, plain, reader
from mathloom.functions import text as T
from mathloom.operators import index as I
from mathloom.storage import materialize


def text_features(df: DataFrame, text: str) -> DataFrame:
    """Adds the stored columns of a text: normalised source text ``plain_stem`` (drawing code removed),
    the same with formulas masked ``masked_stem``, template ``blob`` and ``atoms`` of its formulas."""
    with_formulas = df.withColumn("_f", formula.formula_features(F.col(text)))
    return with_formulas.select(
        "*", T.normalize(T.without_drawing(F.col(text))).alias("plain_stem"), F.col("_f.masked").alias("masked_stem"), F.col("_f.blob").alias("blob"), F.col("_f.atoms").alias("atoms")
    ).drop("_f")


def with_features(items: DataFrame) -> DataFrame:
    """Items with the features of their original_text; those of a saved index have them already."""
    return items if "masked_stem" in items.columns else text_features(items, "original_text")


def prepare_queries(queries: DataFrame, use_formula: bool = True) -> DataFrame:
    """Query rows from qid and text, and optionally read_text, read_latex, phash, diagram_vector, from_image.

    Text of the user comes before text that a reader found. With formulas, brackets and dashes that stand for
    bars and minus signs are mended before anything else, LaTeX of a reader is used for the formula template in
    any case, and a text with a matrix takes no part in figure comparison. Queries without any text are left out.
    """
    has = lambda c, kind: F.col(c) if c in queries.columns else F.lit(None).cast(kind)
    text = F.coalesce(F.nullif(T.trimmed(F.col("text")), F.lit("")), F.nullif(T.trimmed(has("read_text", "string")), F.lit("")))
    text = formula.repaired_text(text) if use_formula else text
    shown = lambda c: F.when(~text.rlike(r"\\begin\{[pbBv]?matrix\}"), c) if use_formula else c
    latex = has("read_latex", "string") if use_formula else F.lit(None).cast("string")
    q = queries.select(
        "qid", text.alias("text"), latex.alias("latex"), shown(has("phash", "string")).alias("phash"),
        shown(has("diagram_vector", "array<float>")).alias("diagram_vector"), F.coalesce(has("from_image", "boolean"), F.lit(False)).alias("from_image"),
    ).where("text is not null")
    q = text_features(q, "text").withColumnRenamed("blob", "text_blob")
    q = T.with_template(q, F.regexp_replace("latex", r"^[ ;,.]+|[ ;,.]+$", ""), "_read")
    read = F.col("_read")
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    known = F.coalesce(F.col("text_blob"), F.lit(""))
    added = F.when(read.isNull() | F.contains(squeezed(known), squeezed(read)), F.col("text_blob")).otherwise(F.nullif(T.trimmed(F.concat_ws(" ", "text_blob", read)), F.lit("")))
    q = q.withColumn("query_blob", added).withColumn("normalized_text", T.normalize(F.col("text")))
    return q.withColumn("structure_text", T.structure(F.col("normalized_text"))).drop("_read")


_PAIR = "surface double, structure double, stem double, formula_score double, formula_ok boolean"


def _can_be_shown(r, config: SearchConfig, use_formula: bool) -> bool:
    """Can the pair be an original or a variant? A likeness is a mean of a ratio, which is at most 1, and the
    overlap of the grams, which is cheap; no pair that passes a threshold fails here."""
    slack = 1e-9
    if 0.5 + 0.5 * plain.jaccard(r.q_struct, r.i_struct) >= config.t_var - slack:
        return True
    least = min(config.t_same, config.t_ocr_same) - slack
    if 0.6 + 0.4 * plain.jaccard(r.q_stem, r.i_stem) >= least or (not use_formula and 0.6 + 0.4 * plain.jaccard(r.q_norm, r.i_norm) >= least):
        return True
    return r.q_stem == r.i_norm or r.q_stem in r.i_stem or r.i_stem in r.q_stem


def _pair_scores(config: SearchConfig, use_formula: bool, all_pairs: bool):
    """Arrow UDF over the texts of a (query, item) pair; only pairs that recall kept come here. Without
    ``all_pairs`` the scores of pairs that can be neither original nor variant are null."""

    @F.pandas_udf(f"struct<{_PAIR.replace(' double', ':double').replace(' boolean', ':boolean')}>")
    def scores(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in df.itertuples(index=False):
            if not all_pairs and not _can_be_shown(r, config, use_formula):
                out.append((None,) * 5)
                continue
            surface, structure = plain.surface(r.q_norm, r.i_norm), plain.likeness(r.q_struct, r.i_struct)
            stem = surface if (r.q_stem, r.i_stem) == (r.q_norm, r.i_norm) else plain.surface(r.q_stem, r.i_stem)
            if not use_formula:
                out.append((surface, structure, stem, 0.0, True))
                continue
            blob = r.text_blob if r.prefer_text else r.query_blob or r.text_blob
            like = plain.likeness(blob, r.i_blob) if blob and r.i_blob else 0.0
            ok = formula.compatible(blob, r.i_blob, config.t_formula, config.formula_containment_chars, config.t_lost_fraction)
            if not ok and not r.disagree and len(r.q_atoms) and list(r.q_atoms) == list(r.i_atoms):
                ok, like = True, 1.0
            out.append((surface, structure, stem, like, ok))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in _PAIR.split(", ")])
        return made.astype({c: float for c in made.columns[:4]}).astype({"formula_ok": object})

    return scores


def _numbers(c: Column) -> Column:
    return T.quantities(c)


def classify(pairs: DataFrame, config: SearchConfig, use_formula: bool, all_pairs: bool = True) -> DataFrame:
    """Adds similarities, figure scores, is_original, is_variant and relation to recalled pairs.

    ``pairs`` has query columns with prefix q_ and item columns with prefix i_. Without ``all_pairs`` pairs
    whose gram overlap alone rules out both relations are left out before the costly ratios; originals and
    variants are the same either way.
    """
    stem = "masked_stem" if use_formula else "plain_stem"
    q, i = F.col(f"q_{stem}"), F.col(f"i_{stem}")
    differs = (F.coalesce("q_query_blob", F.lit("")) != F.coalesce("q_text_blob", F.lit(""))) & F.col("q_query_blob").isNotNull() & F.col("q_text_blob").isNotNull()
    inside = F.contains(F.replace("q_query_blob", F.lit(" "), F.lit("")), F.replace("q_text_blob", F.lit(" "), F.lit("")))
    args = F.struct(
        F.col("q_normalized_text").alias("q_norm"), F.col("i_normalized_text").alias("i_norm"), F.col("q_structure_text").alias("q_struct"),
        F.col("i_structure_text").alias("i_struct"), q.alias("q_stem"), i.alias("i_stem"), F.col("q_query_blob").alias("query_blob"),
        F.col("q_text_blob").alias("text_blob"), F.col("i_blob"), F.col("q_atoms"), F.col("i_atoms"), F.coalesce(differs & inside, F.lit(False)).alias("prefer_text"),
        F.coalesce(differs & ~inside, F.lit(False)).alias("disagree"),
    )
    p = pairs.withColumn("_s", _pair_scores(config, use_formula, all_pairs)(args)).select("*", "_s.*").drop("_s")
    p = p if all_pairs else p.where("formula_ok is not null")
    least = F.when(F.col("q_from_image"), config.t_ocr_same).otherwise(config.t_same)
    qn, sn, fn = _numbers(q), _numbers(i), _numbers(F.col("i_normalized_text"))
    short, long = F.when(F.length(q) <= F.length(i), q).otherwise(i), F.when(F.length(q) <= F.length(i), i).otherwise(q)
    stem_ok = (
        ((q != "") & ((q == F.col("i_normalized_text")) | (q == i)))
        | ((qn == sn) & (F.col("stem") >= least))
        | ((F.size(qn) > 0) & (qn == sn) & (F.length(short) >= config.containment_chars) & F.contains(long, short))
        | ((qn == fn) & ((F.col("stem") if use_formula else F.col("surface")) >= least))
    )
    p = p.withColumn("diagram_score", I.cosine(F.col("q_diagram_vector"), F.col("i_diagram_vector")))
    p = p.withColumn("phash_distance", I.hamming(F.col("q_phash"), F.col("i_phash")))
    has = lambda s: F.coalesce(F.size(f"{s}_diagram_vector") > 0, F.lit(False)) | (F.coalesce(f"{s}_phash", F.lit("")) != "")
    near = (F.col("diagram_score") >= config.t_diagram) | (F.col("phash_distance") <= config.phash_hamming_max)
    figure_ok = ~has("q") | ~has("i") | F.coalesce(near, F.lit(False))
    p = p.withColumn("is_original", stem_ok & F.col("formula_ok") & figure_ok)
    other_figure = (F.length("q_normalized_text") <= config.generic_stem_chars) & (F.col("diagram_score") < config.t_diagram)
    numbers_differ = _numbers(F.col("q_normalized_text")) != fn
    relation = (
        F.when(F.col("is_original"), "original")
        .when(F.coalesce(other_figure, F.lit(False)), "unrelated")
        .when(numbers_differ & (F.col("structure") >= config.t_var), "variant")
        .when(F.col("structure") < config.unrelated_structure_max, "unrelated")
        .otherwise("related")
    )
    return p.withColumn("relation", relation).withColumn("is_variant", F.col("relation") == "variant")


def feature_score(use_formula: bool) -> Column:
    """Final score of an original or a variant."""
    gap = F.greatest(F.lit(0.0), F.col("structure") - F.col("surface"))
    structure, diagram, form = (0.40, 0.15, 0.15) if use_formula else (0.50, 0.20, 0.0)
    score = (
        structure * F.col("structure") + 0.20 * F.col("retrieval") + form * F.col("formula_score") + diagram * F.coalesce("diagram_score", F.lit(0.0))
        + 0.10 * gap + F.when(F.col("is_variant"), 0.15).otherwise(0.0) - 0.15 * F.col("surface")
    )
    return F.when(F.col("is_original"), 1.2 + 0.1 * F.col("retrieval")).otherwise(score)


def rerank(candidates: DataFrame, config: SearchConfig, use_formula: bool) -> DataFrame:
    """Originals and the first variants in retrieval order, at most rerank_k, with final_score and order.
    All windows are over the rows of a query, so the pool is shuffled once."""
    pool = candidates.where("is_original or is_variant")
    query = Window.partitionBy("qid")
    pool = pool.withColumn("originals", F.count_if("is_original").over(query)).withColumn("nth", F.count_if("is_variant").over(query.orderBy("rank")))
    pool = pool.where(F.col("is_original") | (F.col("nth") <= F.greatest(F.lit(0), config.rerank_k - F.col("originals"))))
    scored = pool.withColumn("final_score", feature_score(use_formula))
    place = F.row_number().over(query.orderBy(F.desc("is_original"), F.desc("final_score"), "rank"))
    return scored.withColumn("place", place).drop("nth", "originals")


def cutoff(ranked: DataFrame, config: SearchConfig) -> DataFrame:
    """The ranked rows that are shown of each query, at most max_results, with their new ``place``. A row is left
    out if its score is too low or it nearly repeats a shown row of its own kind. At most recall_k rows a query
    come here, so a group is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["final_score"] >= config.min_final_score].sort_values("place")
        shown: list[int] = []
        for at, (kind, text) in enumerate(zip(pdf["is_original"], pdf["i_normalized_text"])):
            repeats = (plain.surface(text, pdf["i_normalized_text"].iloc[s]) >= config.t_same for s in shown if pdf["is_original"].iloc[s] == kind)
            if len(shown) < config.max_results and not any(repeats):
                shown.append(at)
        return pdf.iloc[shown].assign(place=range(1, len(shown) + 1))

    return ranked.groupBy("qid").applyInPandas(run, ranked.schema)


_ITEM = ["normalized_text", "structure_text", "plain_stem", "masked_stem", "blob", "atoms", "phash", "diagram_vector"]
_QUERY = ["normalized_text", "structure_text", "plain_stem", "masked_stem", "query_blob", "text_blob", "atoms", "phash", "diagram_vector", "from_image"]


def candidates(index: I.Index, queries: DataFrame, use_formula: bool = True, all_pairs: bool = True) -> DataFrame:
    """All recalled pairs with their similarities and relation. Queries come from :func:`prepare_queries`.

    The recalled pairs are written once; item features are computed for recalled items only, each once."""
    config = index.config
    queries = materialize(queries, "queries")
    hits = materialize(I.recall(index, queries), "hits")
    wanted = with_features(index.items.join(hits.select("pos").distinct(), "pos", "left_semi"))
    for c, kind in (("phash", "string"), ("diagram_vector", "array<float>")):
        if c not in wanted.columns:
            wanted = wanted.withColumn(c, F.lit(None).cast(kind))
    items = wanted.select("pos", "id", "original_text", *(F.col(c).alias(f"i_{c}") for c in _ITEM))
    asked = queries.select("qid", *(F.col(c).alias(f"q_{c}") for c in _QUERY))
    return classify(hits.join(items, "pos").join(asked, "qid"), config, use_formula, all_pairs)


def _shown(ranked: DataFrame, config: SearchConfig, use_formula: bool) -> DataFrame:
    need = ["qid", "place", "pos", "id", "original_text", "relation", "is_original", "i_normalized_text", "final_score", "retrieval", "surface", "structure", "formula_score", "diagram_score", "phash_distance"]
    form = F.round("formula_score", 4) if use_formula else F.lit(None).cast("double")
    return cutoff(ranked.select(*need), config).select(
        "qid", "place", "pos", "id", "original_text", "relation", F.round("final_score", 4).alias("final"), F.round("retrieval", 4).alias("retrieval"),
        F.round("surface", 4).alias("surface"), F.round("structure", 4).alias("structure"), form.alias("formula"), F.round("diagram_score", 4).alias("diagram"), "phash_distance",
    )


def search(index: I.Index, queries: DataFrame, use_formula: bool = True) -> DataFrame:
    """At most three results of every query: qid, place, id, relation and rounded scores.

    Queries without a result have no row. The formula score is null when formulas take no part.
    """
    ranked = rerank(candidates(index, queries, use_formula, all_pairs=False), index.config, use_formula)
    return _shown(ranked, index.config, use_formula)


def responses(index: I.Index, queries: DataFrame, use_formula: bool = True) -> DataFrame:
    """One row a query: text, has_diagram, math_ocr, how many items were recalled, marked as originals and
    ranked, and the shown results as an array in order (empty where nothing is shown)."""
    ranked = materialize(rerank(candidates(index, queries, use_formula, all_pairs=False), index.config, use_formula), "ranked")
    counts = ranked.groupBy("qid").agg(F.count_if("is_original").alias("originals"), F.count("*").alias("reranked"))
    shown = _shown(ranked, index.config, use_formula)
    row = F.struct("place", *(c for c in shown.columns if c not in ("qid", "place")))
    packed = shown.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("results"))  # at most max_results rows a query
    most = index.vectors.agg(F.least(F.count("*"), F.lit(index.config.recall_k)).alias("recalled"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    has = F.coalesce(F.size("diagram_vector") > 0, F.lit(False)) | (F.coalesce("phash", F.lit("")) != "")
    out = queries.join(counts, "qid", "left").join(packed, "qid", "left").crossJoin(F.broadcast(most))
    return out.select(
        "qid", F.col("text").alias("query_text"), has.alias("has_diagram"), F.lit(use_formula).alias("math_ocr"), "recalled", zero("originals"), zero("reranked"),
        F.coalesce("results", F.array().cast(packed.schema["results"].dataType)).alias("results"),
    )


def image_queries(features: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rows for :func:`prepare_queries` from the features of images (path, phash, diagram_vector, read_text);
    qid is the path. ``texts``: (path, text) typed beside an image, which comes before what was read."""
    f = features.select(F.col("path").alias("qid"), "phash", "diagram_vector", "read_text", F.lit(True).alias("from_image"))
    typed = texts.select(F.col("path").alias("qid"), "text") if texts is not None else None
    return f.join(typed, "qid", "left") if typed is not None else f.withColumn("text", F.lit(None).cast("string"))


def search_images(index: I.Index, images: DataFrame, make_reader=None, texts: DataFrame | None = None, use_formula: bool = True) -> DataFrame:
    """:func:`search` of images from ``spark.read.format("image")``: their largest figure is compared, their text
    read by the reader that each worker builds. Images without any text have no result."""
    features = materialize(reader.image_features(images, make_reader), "images")
    return search(index, prepare_queries(image_queries(features, texts), use_formula), use_formula)
