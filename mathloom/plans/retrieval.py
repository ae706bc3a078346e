"""Queries over the retrieval index: vocabulary, weights, recall, classification, whole searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.config import SearchConfig
from mathloom.functions import text as T
from mathloom.operators import evaluate as E
from mathloom.operators import index as I
from mathloom.operators import search as S
from mathloom.plans.texts import quoted, structure_sql
from mathloom.tables import read_table as read

CONFIG = SearchConfig()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").where("normalized_text <> ''")


def _text_index(spark: SparkSession, d: str) -> I.Index:
    return I.Index.build(_items(spark, d).select("pos", "id", "original_text", "normalized_text", "structure_text"), CONFIG)


def _index(spark: SparkSession, d: str) -> I.Index:
    return I.Index.build(_items(spark, d).select("pos", "id", "original_text", "normalized_text", "structure_text", "phash", "diagram_vector"), CONFIG)


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "probe_items").select(F.col("id").alias("qid"), F.col("original_text").alias("text"))


def tfidf_vocab(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).vocab.select("gram", "df", F.round("idf", 6).alias("idf"))


def tfidf_norms(spark: SparkSession, d: str) -> DataFrame:
    """Grams of each item's vector: their number, their weights' sum and length."""
    total = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x * x)
    v = _text_index(spark, d).weights().where(F.size("ws") > 0)
    return v.select("pos", F.size("ws").cast("long").alias("grams"), F.round(total, 5).alias("total"), F.round(F.sqrt(square), 6).alias("norm"))


def _probe_structures(spark: SparkSession, d: str) -> DataFrame:
    p = _probes(spark, d).withColumn("normalized_text", T.normalize(F.col("text")))
    return p.select("qid", T.structure(F.col("normalized_text")).alias("structure_text"))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The recall_k most similar items of each probe."""
    hits = I.recall(_text_index(spark, d), _probe_structures(spark, d))
    return hits.select("qid", "pos", F.round("retrieval", 5).alias("retrieval"))


def tfidf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The recall_k items most similar to every item whose pos is divisible by 50, by text alone."""
    asked = read(spark, d, "items").where("pos % 50 = 0").select(F.col("pos").alias("qid"), "structure_text")
    return I.recall(_text_index(spark, d), asked).select("qid", "pos", F.round("retrieval", 5).alias("retrieval"), "rank")


def blended_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The same by text and figure."""
    asked = read(spark, d, "items").where("pos % 50 = 0").select(F.col("pos").alias("qid"), "structure_text", "diagram_vector")
    return I.recall(_index(spark, d), asked).select("qid", "pos", F.round("retrieval", 5).alias("retrieval"), "rank")


class _Stored:
    """An encoder that looks its vectors up in the text itself: numbers parted by blanks."""

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[float(x) for x in t.split()] for t in texts])


def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten embeddings most similar to every one whose vec_id is divisible by 50, through a dense encoder."""
    text = F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("double").cast("string")))
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), text.alias("structure_text"), F.lit("x").alias("normalized_text"))
    index = I.Index.build(rows, CONFIG, encoder=_Stored)
    hits = I.recall(index, rows.where("pos % 50 = 0").select(F.col("pos").alias("qid"), "structure_text"), 10)
    return hits.select("qid", "pos", F.round("retrieval", 5).alias("retrieval"), "rank")


def candidates_classified(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(_index(spark, d), S.prepare_queries(_probes(spark, d)))
    return c.select("qid", "pos", "rank", "relation", F.round("surface", 4).alias("surface"), F.round("structure", 4).alias("structure"), F.round("formula_score", 4).alias("formula"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The probes, and every item whose pos is divisible by 50 with other numbers and its own figure."""
    items = read(spark, d, "items").where("pos % 50 = 0")
    other = items.select(F.concat(F.lit("v"), F.col("pos").cast("string")).alias("qid"), E.with_other_numbers("original_text").alias("text"), "diagram_vector", "phash")
    return _probes(spark, d).unionByName(other.where("text is not null"), allowMissingColumns=True)


def search_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Questions searched by text and figure. No item is an original of a probe; those asked with other numbers
    have variants, their own item among them."""
    return S.search(_index(spark, d), S.prepare_queries(_asked(spark, d)))


def search_without_formula(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_index(spark, d), S.prepare_queries(_asked(spark, d), False), use_formula=False)


def search_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose pos is divisible by 50 searched by its own text; qid is the pos, as ids repeat."""
    asked = read(spark, d, "items").where("pos % 50 = 0").select(F.col("pos").alias("qid"), F.col("original_text").alias("text"))
    return S.search(_index(spark, d), S.prepare_queries(asked))


def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every response: recalled, originals, ranked, shown."""
    asked = read(spark, d, "items").where("pos % 50 = 0").select(F.col("pos").alias("qid"), F.col("original_text").alias("text"))
    r = S.responses(_index(spark, d), S.prepare_queries(asked))
    return r.select("qid", "has_diagram", "recalled", "originals", "reranked", F.size("results").alias("shown"))


def search_scored(spark: SparkSession, d: str) -> DataFrame:
    """The answers of search_end_to_end held against the items the questions were made of; a probe's own id
    is no item, so it counts as missed."""
    items = read(spark, d, "items").where("pos % 50 = 0")
    gold = items.select(F.concat(F.lit("v"), F.col("pos").cast("string")).alias("qid"), F.col("id").alias("gold"))
    tasks = gold.union(_probes(spark, d).select("qid", F.col("qid").alias("gold")))
    return E.score(search_end_to_end(spark, d), tasks)


def latest_items(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups: the item of every id of the evaluation log, of a repeated id the last delivered."""
    ids = read(spark, d, "eval_rows").where("id is not null").select("id").distinct()
    return I.lookup(_items(spark, d), ids).select("id", "pos", "source")


def sampled_eval(spark: SparkSession, d: str) -> DataFrame:
    """Rates over a sample of items asked again as they are and with other numbers."""
    return E.run_eval(_index(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_vocab, tfidf_norms, tfidf_topk, tfidf_neighbours, blended_neighbours, dense_neighbours, candidates_classified, search_end_to_end, search_without_formula,
        search_samples, search_responses, search_scored, latest_items, sampled_eval,
    )
}

_TERMS = "unnest(list_concat(" + ", ".join(f"list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))" for n in I.SIZES) + ")) gram"
_VOCAB = f"""
i AS (SELECT pos, lower(structure_text) t FROM items WHERE normalized_text <> ''), n AS (SELECT count(*) n FROM i),
c AS (SELECT pos, gram, count(*) tf FROM (SELECT pos, {_TERMS} FROM i) GROUP BY ALL),
v AS (SELECT gram, count(*) df, sum(tf) total FROM c GROUP BY gram ORDER BY total DESC, gram LIMIT {CONFIG.max_features}),
x AS (SELECT gram, df, ln((1 + n) / (1 + df)) + 1 idf FROM v, n)"""
_WEIGHTS = """
w AS (SELECT pos, gram, tf * idf w FROM c JOIN x USING (gram)), m AS (SELECT pos, greatest(sqrt(sum(w * w)), 1e-8) norm FROM w GROUP BY pos),
p AS (SELECT pos, gram, w / norm w FROM w JOIN m USING (pos))"""
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_PLAIN = rf"regexp_replace(translate(translate(original_text, '{quoted(T.PUNCT_FROM)}', '{quoted(T.PUNCT_TO)}'), '$', ''), '{_SPACE}+', '', 'g')"
_ASKED = f"""
qt AS (SELECT id qid, lower({structure_sql(_PLAIN)}) t FROM probe_items),
qc AS (SELECT qid, gram, count(*) tf FROM (SELECT qid, {_TERMS} FROM qt) GROUP BY ALL), qw AS (SELECT qid, gram, tf * idf w FROM qc JOIN x USING (gram)),
qm AS (SELECT qid, greatest(sqrt(sum(w * w)), 1e-8) norm FROM qw GROUP BY qid), q AS (SELECT qid, gram, w / norm w FROM qw JOIN qm USING (qid)), ids AS (SELECT qid FROM qt)"""
_EVERY_50TH = """
it AS (SELECT pos qid, lower(structure_text) t FROM items WHERE pos % 50 = 0),
qc AS (SELECT qid, gram, count(*) tf FROM (SELECT qid, {terms} FROM it) GROUP BY ALL), qw AS (SELECT qid, gram, tf * idf w FROM qc JOIN x USING (gram)),
qm AS (SELECT qid, greatest(sqrt(sum(w * w)), 1e-8) norm FROM qw GROUP BY qid), q AS (SELECT qid, gram, w / norm w FROM qw JOIN qm USING (qid)), ids AS (SELECT qid FROM it)""".format(terms=_TERMS)
_TEXT_SCORES = "s AS (SELECT qid, pos, sum(q.w * p.w) s FROM q JOIN p USING (gram) GROUP BY ALL), a AS (SELECT qid, pos, coalesce(s, 0) s FROM ids CROSS JOIN i LEFT JOIN s USING (qid, pos))"
_TOP = "SELECT qid, pos, s, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 10) DESC, pos) AS INTEGER) r FROM {0}"
_K = CONFIG.recall_k
_FINE = "len({0}) > 0 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
ORACLE = {
    "tfidf_vocab": f"WITH {_VOCAB} SELECT gram, df, round(idf, 6) idf FROM x",
    "tfidf_norms": f"WITH {_VOCAB}, {_WEIGHTS} SELECT pos, count(*) grams, round(sum(w), 5) total, round(sqrt(sum(w * w)), 6) norm FROM p GROUP BY pos",
    "tfidf_topk": f"WITH {_VOCAB}, {_WEIGHTS}, {_ASKED}, {_TEXT_SCORES} SELECT qid, pos, round(s, 5) retrieval FROM ({_TOP.format('a')}) WHERE r <= {_K}",
    "tfidf_neighbours": f"""WITH {_VOCAB}, {_WEIGHTS}, {_EVERY_50TH}, {_TEXT_SCORES} SELECT qid, pos, round(s, 5) retrieval, r AS "rank" FROM ({_TOP.format('a')}) WHERE r <= {_K}""",
    "blended_neighbours": f"""
WITH {_VOCAB}, {_WEIGHTS}, {_EVERY_50TH}, {_TEXT_SCORES},
  f AS (SELECT pos, CASE WHEN {_FINE.format('diagram_vector')} THEN CAST(diagram_vector AS DOUBLE[]) END v FROM items),
  has AS (SELECT DISTINCT pos FROM p), hasq AS (SELECT DISTINCT qid FROM q),
  b AS (SELECT qid, a.pos, s, CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) ELSE 0 END c,
      sqrt((a.pos IN (SELECT pos FROM has))::INT + {CONFIG.visual_blend**2} * (x.v IS NOT NULL)::INT) n1, sqrt((qid IN (SELECT qid FROM hasq))::INT + {CONFIG.visual_blend**2} * (y.v IS NOT NULL)::INT) n2
    FROM a JOIN f x ON x.pos = a.pos JOIN f y ON y.pos = a.qid),
  e AS (SELECT qid, pos, CASE WHEN n1 * n2 > 0 THEN (s + {CONFIG.visual_blend**2} * coalesce(c, 0)) / (n1 * n2) ELSE 0 END s FROM b)
SELECT qid, pos, round(s, 5) retrieval, r AS "rank" FROM ({_TOP.format('e')}) WHERE r <= {_K}""",
    "dense_neighbours": f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings), a AS (SELECT q.vec_id qid, i.vec_id pos, list_cosine_similarity(q.v, i.v) s FROM e q CROSS JOIN e i WHERE q.vec_id % 50 = 0)
SELECT qid, pos, round(s, 5) retrieval, r AS "rank" FROM ({_TOP.format('a')}) WHERE r <= 10""",
    "latest_items": "SELECT id, max(pos) pos, max_by(source, pos) AS source FROM items WHERE normalized_text <> '' AND id IN (SELECT id FROM eval_rows) GROUP BY id",
}
