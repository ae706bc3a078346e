"""Problem 10: long passages that documents share word for word.

Positions of a text are covered by a difference cover: for any two positions there is a shift of
less than the period that takes both into the cover. So two equal passages of MIN_SHARED characters
hold a window of WINDOW characters that begins at a covered position in both texts; only these
windows are hashed, each once a text, and texts that have one in common are a pair. Each pair meets its two
texts once, where a match is extended to all neighbouring windows of MIN_SHARED characters that are shared too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.llm.shingles import mix64
from mathloom.llm.skew import join_to_groups, pairs_within, sampled
from mathloom.llm.tables import read
from mathloom.storage import drop, materialize

MIN_SHARED = 150
#: A perfect difference set modulo 73: every residue but 0 is a difference of two members exactly once.
PERIOD, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
WINDOW = MIN_SHARED - PERIOD + 1
CHUNK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _chunks(sizes: list[int]) -> Iterator[slice]:
    """Ranges of neighbouring rows of about CHUNK_CHARS characters."""
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= CHUNK_CHARS or i == len(sizes) - 1:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def windows(texts: list, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, position, 64-bit hash) of all windows of ``width`` characters at covered positions, of
    texts that have MIN_SHARED characters."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    whole = np.maximum(0, sizes - width + 1) * (sizes >= MIN_SHARED)
    places = np.array(cover)
    many = -(-whole // period)
    doc = np.repeat(np.arange(len(texts)), many * len(places))
    step = np.arange(len(doc)) - np.repeat((np.cumsum(many) - many) * len(places), many * len(places))
    at = step // len(places) * period + places[step % len(places)]
    ok = at < whole[doc]
    doc, at = doc[ok], at[ok]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat) * _powers(_BASE, len(flat)), dtype=np.uint64)])
    lo = starts[doc] + at
    back = _powers(_INVERSE, len(flat) + 1)
    return doc, at, mix64((sums[lo + width] - sums[lo]) * back[lo])


def anchors(texts: DataFrame) -> DataFrame:
    """(h, doc_id): the hash of every covered window of the texts of at least MIN_SHARED characters, once a text
    however often it stands there."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for part in _chunks([len(t or "") for t in texts]):
                doc, _, h = windows(texts[part], WINDOW, PERIOD, COVER)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(doc)]
                doc, h = doc[new], h[new].view(np.int64)
                for k in range(0, len(doc), 500_000):
                    s = slice(k, k + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(ids[part][doc[s]], pa.int64())], ["h", "doc_id"])

    return texts.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


def text_classes(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): a 128-bit key of the text of every document of at least MIN_SHARED characters."""
    long = docs.where((F.length("text") >= MIN_SHARED) & F.col("doc_id").isNotNull())
    return long.select(F.unhex(F.md5("text")).alias("k"), "doc_id")


def passages(left: list, right: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, begin, n) of the longest passages of each left text all of whose windows of MIN_SHARED characters
    stand in the right text at the same place of the lists, too."""
    (own, at, h), (other, there, g) = (windows(t, MIN_SHARED, 1, (0,)) for t in (left, right))
    of_pair = lambda pair, h: mix64(h ^ mix64(pair.astype(np.uint64) + np.uint64(1)))
    mine, theirs = of_pair(own, h), of_pair(other, g)
    order = np.argsort(theirs, kind="stable")
    theirs = theirs[order]
    near = np.minimum(np.searchsorted(theirs, mine), max(0, len(theirs) - 1))
    shared = theirs[near] == mine if len(theirs) else np.zeros(len(mine), bool)
    own, at, near = own[shared], at[shared], order[near[shared]]
    first = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])[: len(own)]
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(own))) + MIN_SHARED - 1
    same = [left[p][a : a + MIN_SHARED] == right[p][b : b + MIN_SHARED] for p, a, b in zip(own[begin].tolist(), at[begin].tolist(), there[near[begin]].tolist())]
    keep = np.array(same, bool)
    return own[begin][keep], at[begin][keep], n[keep]


def _extended(batches):
    """The shared passages of each pair of texts, in both of them; pairs that share none have no row."""
    for b in batches:
        ids = [b.column(c).to_numpy() for c in ("a", "b")]
        texts = [b.column(c).to_pylist() for c in ("text_a", "text_b")]
        for part in _chunks([len(s) + len(t) for s, t in zip(*texts)]):
            for x, y in ((0, 1), (1, 0)):
                pair, begin, n = passages(texts[x][part], texts[y][part])
                cols = [pa.array(ids[x][part][pair]), pa.array(ids[y][part][pair]), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "other", "begin", "n"])


def shared_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, spans). members: (doc_id, rep) of every document long enough, rep the smallest doc_id
    with the same text; spans: (rep, other, begin, n), the passages of a representative's text of which each
    window of MIN_SHARED characters stands in the other's text too, as position and length in code points."""
    keyed = materialize(text_classes(docs), "keyed")
    reps = keyed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    members = materialize(join_to_groups(keyed, reps, ["k"], "n", keyed.count()).select("doc_id", "rep"), "members")
    drop(keyed)
    texts = materialize(docs.select("doc_id", "text").join(members.where("doc_id = rep").select("doc_id"), "doc_id"), "texts")
    expected = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] * len(COVER) // PERIOD
    met = pairs_within(anchors(texts), ["h"], "doc_id", expected, None, ["doc_id"], sample=anchors(texts.where(sampled("doc_id"))))
    pairs = materialize(met.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct(), "met")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    spans = both.select("a", "b", "text_a", "text_b").mapInArrow(_extended, "rep long, other long, begin int, n int")
    spans = materialize(spans, "spans")
    drop(pairs)
    drop(texts)
    return members, spans


def found_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of all documents that share a passage, copies of one text included."""
    members, spans = shared_spans(docs)
    pairs = spans.where("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    p = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("p"))
    q = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("q"))
    across = pairs.join(p, "a").join(q, "b").select("p", "q")
    same = pairs_within(members, ["rep"], "doc_id", members.count(), None, ["doc_id"]).select(F.col("x_doc_id").alias("p"), F.col("y_doc_id").alias("q"))
    return across.union(same).select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))


def shared_amounts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, partners, copies): of every document its code points, how many of
    them lie in passages that another document has too, the other texts it shares with and the
    documents with the same text, itself included.

    Null, empty and short texts share nothing; a text that another document repeats is shared whole.
    A repeated doc_id gives one row a document. Extra columns do not matter.
    """
    members, spans = shared_spans(docs)
    partners = spans.select("rep", "other").distinct().groupBy("rep").agg(F.count("*").alias("partners"))
    steps = spans.select("rep", F.col("begin").alias("lo"), (F.col("begin") + F.col("n")).alias("hi")).distinct()
    before = F.max("hi").over(Window.partitionBy("rep").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce("before", F.lit(0))))
    covered = steps.withColumn("before", before).groupBy("rep").agg(F.sum(new).alias("covered"))
    per = covered.join(partners, "rep")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    known = members.join(copies, "rep").join(per, "rep", "left")
    out = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(known, "doc_id", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)).cast("int"))
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("copies", F.lit(1)).alias("copies"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_pairs(read(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_amounts(read(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_shared": p10_shared}
_WINDOWS = f"""
WITH d AS (SELECT doc_id, text, md5(text) k FROM documents WHERE length(text) >= {MIN_SHARED}),
  w AS (SELECT doc_id, k, i, md5(substr(text, i, {MIN_SHARED})) h FROM (SELECT doc_id, k, text, unnest(range(1, length(text) - {MIN_SHARED - 2})) i FROM d))"""
ORACLE = {
    "p10_found": _WINDOWS + ", u AS (SELECT DISTINCT doc_id, h FROM w) SELECT DISTINCT a.doc_id doc_id_a, b.doc_id doc_id_b FROM u a JOIN u b USING (h) WHERE a.doc_id < b.doc_id",
    "p10_shared": _WINDOWS
    + f""", u AS (SELECT DISTINCT k, h FROM w), m AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
  c AS (SELECT doc_id, sum(step) c FROM (SELECT doc_id, least({MIN_SHARED}, lead(i, 1, i + {MIN_SHARED}) OVER (PARTITION BY doc_id ORDER BY i) - i) step FROM w WHERE h IN (SELECT h FROM m)) GROUP BY doc_id),
  p AS (SELECT a.k, count(DISTINCT b.k) n FROM u a JOIN u b ON a.h = b.h AND a.k <> b.k GROUP BY a.k), e AS (SELECT k, count(*) copies FROM d GROUP BY k)
SELECT x.doc_id, CAST(coalesce(length(x.text), 0) AS INTEGER) n_chars, CAST(CASE WHEN copies > 1 THEN length(x.text) ELSE coalesce(c.c, 0) END AS INTEGER) shared_chars,
  coalesce(p.n, 0) partners, coalesce(e.copies, 1) copies
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id LEFT JOIN e ON e.k = d.k LEFT JOIN p ON p.k = d.k LEFT JOIN c ON c.doc_id = x.doc_id""",
}
