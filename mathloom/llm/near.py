"""Problems 3 and 5: overlaps between splits and groups of near-duplicate records.

Both work on the 4-gram similarity of :mod:`shingles` and find candidates by equal parts of
a minwise sketch, test a fingerprint of 128 values inside the join and verify what remains exactly.
Pairs of unrelated texts of one template grow with the square of the rows; they are 0.1 to 0.45
similar, so four equal values and a long fingerprint keep nearly all of them out of both steps.
Rows with the same cleaned text form a class first; only one row of a class is sketched
against others, so copies never meet each other in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm import shingles as S
from mathloom.llm.components import connected_components
from mathloom.llm.skew import join_to_groups, pairs_within
from mathloom.llm.tables import label, read
from mathloom.storage import drop, materialize

#: Characters of text that are sketched at once in a Python worker.
CHUNK_CHARS = 2_000_000
THRESHOLD = 0.7


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters; a longer text is one range."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _sketched(texts: list, count: int):
    """(index, digests, fingerprints, mins) of the texts that have a similarity."""
    for lo, hi in _chunks(texts):
        cp, off = S.code_points(texts[lo:hi])
        size = np.diff(off)
        at = np.flatnonzero(size >= S.MIN_CHARS)
        if not len(at):
            continue
        cp = cp[np.repeat(size >= S.MIN_CHARS, size)]
        off = np.concatenate([[0], np.cumsum(size[at])])
        mins = S.sketches(cp, off, count)
        raw = cp.tobytes()
        digest = b"".join(xxhash.xxh3_128_digest(raw[4 * a : 4 * b]) for a, b in zip(off, off[1:]))
        yield at + lo, np.frombuffer(digest, np.int64).reshape(-1, 2), S.fingerprints(mins), mins


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


#: Columns of the fingerprint: two words for each bit of a symbol.
FP = [f"fp{k + 1}" for k in range(S.SYMBOL_BITS * S.SYMBOLS // 64)]
_SKETCH = f"pos long, field int, h1 long, h2 long, {', '.join(f'{c} long' for c in FP)}, mins binary"


def sketch_table(rows: DataFrame, fields: list[str], count: int) -> DataFrame:
    """A row for each row and field whose text has a similarity: its class digest (128 bits),
    its fingerprint (384 bits) and the low 8 bits of ``count`` minwise values."""
    drawn = max(count, S.SYMBOLS)

    def run(batches):
        for batch in batches:
            pos = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(len(fields)):
                for at, digest, fp, mins in _sketched(batch.column(k + 1).to_pylist(), drawn):
                    cols = [pa.array(pos[at], pa.int64()), pa.array(np.full(len(at), k, np.int32))]
                    cols += [pa.array(np.ascontiguousarray(x)) for x in (*digest.T, *fp.T)]
                    yield pa.RecordBatch.from_arrays([*cols, _binary(mins[:, :count].astype(np.uint8))], ["pos", "field", "h1", "h2", *FP, "mins"])

    return rows.select("pos", *fields).mapInArrow(run, _SKETCH)


def _differing_symbols() -> Column:
    differs = lambda c: F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))
    return reduce(add, (F.bit_count(reduce(Column.bitwiseOR, map(differs, FP[half::2]))) for half in (0, 1)))


def _differing_bits(c: str) -> Column:
    return F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))


#: Signatures that are joined at once. What one join shuffles is deleted before the next begins, so the disk
#: holds a part of the signatures at a time.
TOGETHER = 11


def candidates(reps: DataFrame, signature, count: int, row_id: str, near: Column, sides: tuple[Column, Column] | None = None, together: int = TOGETHER) -> DataFrame:
    """Written distinct pairs (x_..., y_... of ``row_id``) of ``reps``, a written table, that are ``near`` and have
    ``signature(reps, k)`` in common for any k below ``count``."""
    n, found = reps.count(), []
    kept = [c for c in reps.columns if c != "mins"]
    for begin in range(0, count, together):
        some = range(begin, min(count, begin + together))
        rows = reps.select(F.explode(F.array(*(signature(k) for k in some))).alias("sig"), *kept)
        met = pairs_within(rows, ["sig"], row_id, n * len(some), near, [row_id], sides)
        found.append(materialize(met.distinct(), "met"))
    pairs = materialize(reduce(DataFrame.union, found).distinct(), "pairs")
    for x in found:
        drop(x)
    return pairs


#: Rows of texts and pairs that one task of the verification gets.
ROWS_A_TASK = 50_000


def verified(pairs: DataFrame, texts: DataFrame, keys: list[str], threshold: float, n_texts: int) -> DataFrame:
    """Pairs (keys, a, b), a written table, whose texts (keys, pos, text), about ``n_texts``, have at least the
    similarity. The texts are shuffled once for both sides, into as many partitions as their number asks for."""

    def run(batches):
        for batch in batches:
            sim = S.jaccard_pairs(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            keep = pa.array(np.nan_to_num(sim) >= threshold - 1e-12)
            yield batch.select([*keys, "a", "b"]).filter(keep)

    kinds = dict(texts.dtypes)
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_texts + 2 * pairs.count()) // ROWS_A_TASK)
    dealt = texts.select(*keys, "pos", "text").repartition(parts, *keys, "pos")
    side = lambda x: dealt.select(*keys, F.col("pos").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    joined = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"a {kinds['pos']}", f"b {kinds['pos']}"])
    return joined.select(*keys, "a", "b", "text_a", "text_b").mapInArrow(run, schema)


# --- Problem 5: near-duplicate records -------------------------------------------------------

#: PartEnum over the minwise sketch, a set of fixed size for every text: the domain of 128 values is cut into 32
#: parts of 4 cells, and a part is a signature. Sketches that differ in fewer than PARTS values share one for
#: certain; of pairs at the threshold 0.016 % share none. Signatures of 3 cells met 7 times as many unrelated texts.
#: The sketches are sets of equal size, so all of them lie in one size band.
PARTS, CELLS = 32, 4
#: Fingerprints may differ in so many of 128 symbols of three bits; at the threshold 33.6 are expected, deviation
#: 5, so this loses 4 pairs in 100 000 there. Of pairs of similarity 0.4 it keeps 1 %; 28 of 64 symbols of two bits
#: kept half, and as many symbols of two bits 5 %.
MAX_SYMBOLS = 54
#: Rows of signatures are wider here than in problem 3, so fewer are joined at once.
SIGNATURES_TOGETHER = 8


#: Signatures have so many bits, which travel 32 times a text; equal ones of different parts only cost a comparison.
SIGNATURE_BITS = 48


def partenum_signature(part: int, field: str = "field", mins: str = "mins") -> Column:
    """Signature of one part of a sketch of 8-bit values."""
    return F.shiftrightunsigned(F.xxhash64(F.col(field), F.lit(part), F.substring(mins, CELLS * part + 1, CELLS)), 64 - SIGNATURE_BITS)


def similarity_links(rows: DataFrame, fields: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, classes, links) of the texts in one or two ``fields``; rows have a unique ``pos`` of at most 62 bits.

    classes: one row per field and cleaned text with its smallest pos ``rep`` and its rows ``n``;
    links: verified pairs (field, a, b) of class representatives.
    """
    made = materialize(sketch_table(rows, fields, PARTS * CELLS), "sketches")
    sk = materialize(made.select("field", "h1", "h2", "pos"), "digests")
    classes = sk.groupBy("field", "h1", "h2").agg(F.min("pos").alias("rep"), F.count("*").alias("n"))
    own = F.shiftleft("pos", 1).bitwiseOR(F.col("field").cast("long"))  # field and pos as one number, as every byte counts here
    first = classes.select("field", F.col("rep").alias("pos"))
    reps = materialize(made.join(first.hint("merge"), ["field", "pos"]).select(own.alias("own"), "field", *FP, "mins"), "reps")
    drop(made)
    near = _differing_symbols() <= MAX_SYMBOLS
    same_field = F.col("x.own").bitwiseXOR(F.col("y.own")).bitwiseAND(F.lit(1).cast("long")) == 0
    met = candidates(reps, partenum_signature, PARTS, "own", same_field & near, together=SIGNATURES_TOGETHER)
    pairs = met.select(F.col("x_own").bitwiseAND(F.lit(1).cast("long")).cast("int").alias("field"), F.shiftright("x_own", 1).alias("a"), F.shiftright("y_own", 1).alias("b"))
    drop(reps)
    # a union and no explode, so that both sides of the verification share one shuffle of the texts
    texts = reduce(DataFrame.union, (rows.select("pos", F.lit(k).alias("field"), F.col(f).alias("text")) for k, f in enumerate(fields)))
    links = materialize(verified(pairs, texts.where("text is not null"), ["field"], threshold, sk.count()), "links")
    drop(met)
    return sk, classes, links


def near_duplicate_rows(items: DataFrame) -> DataFrame:
    """Rows of items as problem 5 compares them: geometry3k has no structure text."""
    own = F.when(F.coalesce(label("source"), F.lit("")) != "geometry3k", F.col("structure_text"))
    return items.where("pos is not null").select("pos", "original_text", own.alias("structure_text"))


def near_duplicate_groups(items: DataFrame) -> DataFrame:
    """(pos, group_pos, links): group_pos is the smallest pos of the row's group, links its number of
    verified links to other texts (through the representative of its class).

    Null, empty and short texts have no links; a row without any is its own group of one. Repeated
    texts are one class. Extra columns of items do not matter; an empty table gives no rows.
    """
    rows = near_duplicate_rows(items)
    sk, classes, links = similarity_links(rows, ["original_text", "structure_text"])
    members = join_to_groups(sk.select("field", "h1", "h2", "pos"), classes, ["field", "h1", "h2"], "n", sk.count())
    members = members.select("field", "pos", "rep")
    edges = links.select("a", "b").union(members.where("pos <> rep").select("pos", "rep"))
    groups = connected_components(edges, "a", "b")
    degree = links.select("field", F.explode(F.array("a", "b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("d"))
    degree = members.join(degree, ["field", "rep"]).groupBy("pos").agg(F.sum("d").alias("links"))
    return (
        rows.select("pos")
        .join(groups.withColumnRenamed("node", "pos"), "pos", "left")
        .join(degree, "pos", "left")
        .select("pos", F.coalesce("component", "pos").alias("group_pos"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def found_groups(items: DataFrame) -> DataFrame:
    """(group_pos, pos) of every row that is in a group but not its first."""
    sk, classes, links = similarity_links(near_duplicate_rows(items), ["original_text", "structure_text"])
    members = join_to_groups(sk.select("field", "h1", "h2", "pos"), classes, ["field", "h1", "h2"], "n", sk.count())
    edges = links.select("a", "b").union(members.where("pos <> rep").select("pos", "rep"))
    return connected_components(edges, "a", "b").where("node <> component").select(F.col("component").alias("group_pos"), F.col("node").alias("pos"))


# --- Problem 3: overlaps across splits -------------------------------------------------------

#: The fingerprint of a text is 1216 bits: 152 minwise values of 8 bits, in 38 segments of four. Bits of
#: minwise values are used instead of signs of random projections: at similarity 0.7 they differ less often.
#: Fingerprints that differ in fewer than SEGMENTS values share a segment for certain, as each of these values
#: spoils one of 38; texts at the threshold, most of which differ in 38 to 53, share none with probability 3e-5.
SEGMENTS, WIDTH = 38, 4
#: The Hamming radius is taken on the 256 bits of the fingerprint that travel through the join, the two low bits
#: of its first 128 values. At the threshold 38.4 bits are expected, deviation 6.8, so the radius loses 1 pair
#: in a million there; and the 37 values that are found for certain change at most 74.
RADIUS = 74
RADIUS_FP = FP[:4]


def segment(k: int) -> Column:
    """Signature of one segment of a fingerprint."""
    return F.xxhash64(F.lit(k), F.substring("mins", WIDTH * k + 1, WIDTH))


def overlap_rows(items: DataFrame) -> DataFrame:
    """Rows with a split: pos, original_text, train or not, split, source."""
    rows = items.where("pos is not null").select("pos", "original_text", label("split").alias("split"), label("source").alias("source"))
    return rows.where("split is not null").withColumn("train", F.col("split") == "train")


def cross_split_links(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has pos, rep, train, split, source of every row that can overlap;
    links has class pairs (t, e): rows of class t in train overlap rows of class e in other splits.
    A class with rows on both sides is linked to itself."""
    rows = overlap_rows(items)
    sk = materialize(sketch_table(rows, ["original_text"], SEGMENTS * WIDTH), "codes")
    sided = sk.join(rows.select("pos", "train", "split", "source"), "pos")
    sides = materialize(sided.select("pos", "h1", "h2", "train", "split", "source"), "sides")
    classes = sides.groupBy("h1", "h2").agg(
        F.min("pos").alias("rep"), F.count("*").alias("n"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")
    )
    members = materialize(join_to_groups(sides, classes, ["h1", "h2"], "n", sides.count()).drop("h1", "h2"), "members")
    drop(sides)
    reps = sk.join(members.where("pos = rep").select("pos", "in_train", "in_eval").hint("merge"), "pos")
    reps = materialize(reps.select("pos", *RADIUS_FP, "mins", "in_train", "in_eval"), "reps")
    n_rows = sk.count()
    drop(sk)
    near = reduce(add, map(_differing_bits, RADIUS_FP)) <= RADIUS
    met = candidates(reps, segment, SEGMENTS, "pos", near, sides=(F.col("in_train"), F.col("in_eval")))
    drop(reps)
    pairs = met.select(F.col("x_pos").alias("a"), F.col("y_pos").alias("b"))
    texts = rows.select("pos", F.col("original_text").alias("text"))
    links = verified(pairs, texts, [], threshold, n_rows).select(F.col("a").alias("t"), F.col("b").alias("e"))
    same = members.where("pos = rep and in_train and in_eval").select(F.col("pos").alias("t"), F.col("pos").alias("e"))
    return members, materialize(links.union(same), "links")


def found_overlaps(items: DataFrame) -> DataFrame:
    """(pos_a, pos_b) of all overlapping rows, pos_a < pos_b: class links spread over their rows."""
    members, links = cross_split_links(items)
    train = members.where("train").select(F.col("rep").alias("t"), F.col("pos").alias("p"))
    held = members.where("not train").select(F.col("rep").alias("e"), F.col("pos").alias("q"))
    both = links.hint("merge").join(train, "t").join(held.hint("merge"), "e")
    return both.select(F.least("p", "q").alias("pos_a"), F.greatest("p", "q").alias("pos_b"))


def overlap_report(items: DataFrame) -> DataFrame:
    """(split, source, rows, overlapping, exact, train_rows): of each evaluation split and source the
    rows with a split, those that overlap the training split, those with an exactly equal cleaned
    text there, and the number of overlapping (row, train row) pairs.

    Null source is its own group. Texts without similarity count as rows only. Copies are counted
    through their classes and never paired up.
    """
    members, links = cross_split_links(items)
    trained = members.where("train").groupBy(F.col("rep").alias("t")).agg(F.count("*").alias("train_n"))
    per = links.join(trained, "t").groupBy(F.col("e").alias("rep")).agg(
        F.sum("train_n").alias("pairs"), F.max((F.col("t") == F.col("e")).cast("int")).alias("same")
    )
    hit = members.where("not train").groupBy("rep", "split", "source").agg(F.count("*").alias("k")).join(per, "rep")
    hit = hit.groupBy("split", "source").agg(
        F.sum("k").alias("overlapping"), F.sum(F.col("k") * F.col("same")).alias("exact"), F.sum(F.col("k") * F.col("pairs")).alias("train_rows")
    )
    every = overlap_rows(items).where("not train").groupBy("split", "source").agg(F.count("*").alias("rows"))
    b = hit.alias("b")
    joined = every.alias("a").join(b, (F.col("a.split") == F.col("b.split")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c)
    return joined.select("a.split", "a.source", "a.rows", zero("overlapping"), zero("exact"), zero("train_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_overlaps(read(spark, sf_dir, "items"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(read(spark, sf_dir, "items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_groups(read(spark, sf_dir, "items"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "items"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_groups": p5_groups}


_TRIMMED = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_GRAMS = f"unnest(list_distinct(list_transform(range(1, length(t) - {S.GRAM - 2}), lambda i: substr(t, i, {S.GRAM}))))"
_CLEANED = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_SIMILAR = f"c / (x.n + y.n - c) >= {THRESHOLD} - 1e-12"
_OVERLAPS = f"""
WITH r AS (SELECT pos, {_TRIMMED.format('split')} s, {_TRIMMED.format('source')} src, {_CLEANED.format('original_text')} t FROM items WHERE pos IS NOT NULL),
  k AS (SELECT * FROM r WHERE s IS NOT NULL AND length(t) >= {S.MIN_CHARS}), g AS (SELECT pos, s = 'train' train, {_GRAMS} g FROM k), n AS (SELECT pos, count(*) n FROM g GROUP BY pos),
  c AS (SELECT a.pos p, b.pos q, count(*) c FROM g a JOIN g b USING (g) WHERE a.train AND NOT b.train GROUP BY ALL),
  o AS (SELECT p, q FROM c JOIN n x ON x.pos = p JOIN n y ON y.pos = q WHERE {_SIMILAR})"""
_LINKS = f"""
WITH RECURSIVE r AS (SELECT pos, 0 f, {_CLEANED.format('original_text')} t FROM items WHERE pos IS NOT NULL
    UNION ALL SELECT pos, 1, CASE WHEN coalesce({_TRIMMED.format('source')}, '') <> 'geometry3k' THEN {_CLEANED.format('structure_text')} END FROM items WHERE pos IS NOT NULL),
  k AS (SELECT f, t, min(pos) pos FROM r WHERE length(t) >= {S.MIN_CHARS} GROUP BY f, t), g AS (SELECT f, pos, {_GRAMS} g FROM k), n AS (SELECT f, pos, count(*) n FROM g GROUP BY ALL),
  c AS (SELECT a.f, a.pos p, b.pos q, count(*) c FROM g a JOIN g b ON a.f = b.f AND a.g = b.g WHERE a.pos < b.pos GROUP BY ALL),
  l AS (SELECT c.f, p, q FROM c JOIN n x ON x.f = c.f AND x.pos = p JOIN n y ON y.f = c.f AND y.pos = q WHERE {_SIMILAR}),
  m AS (SELECT r.f, r.pos, k.pos rep FROM r JOIN k ON k.f = r.f AND k.t = r.t),
  e AS (SELECT p, q FROM l UNION SELECT q, p FROM l UNION SELECT pos, rep FROM m WHERE pos <> rep UNION SELECT rep, pos FROM m WHERE pos <> rep),
  z AS (SELECT p, q FROM e UNION SELECT z.p, e.q FROM z JOIN e ON e.p = z.q), h AS (SELECT p pos, min(q) group_pos FROM z GROUP BY p)"""
ORACLE = {
    "p3_found": _OVERLAPS + " SELECT least(p, q) pos_a, greatest(p, q) pos_b FROM o",
    "p3_report": _OVERLAPS
    + """, e AS (SELECT a.s, a.src, q, bool_or(a.t = b.t) same, count(*) n FROM o JOIN r a ON a.pos = q JOIN r b ON b.pos = p GROUP BY ALL)
SELECT r.s AS split, r.src AS source, count(*) AS "rows", count(e.q) overlapping, CAST(coalesce(sum(e.same::INT), 0) AS BIGINT) exact, CAST(coalesce(sum(e.n), 0) AS BIGINT) train_rows
FROM r LEFT JOIN e ON e.q = r.pos WHERE r.s <> 'train' GROUP BY r.s, r.src""",
    "p5_found": _LINKS + " SELECT group_pos, pos FROM h WHERE group_pos < pos",
    "p5_groups": _LINKS
    + """, d AS (SELECT f, p rep FROM l UNION ALL SELECT f, q FROM l), s AS (SELECT m.pos, count(*) n FROM m JOIN d ON d.f = m.f AND d.rep = m.rep GROUP BY m.pos)
SELECT i.pos, least(i.pos, coalesce(group_pos, i.pos)) group_pos, coalesce(n, 0) links FROM items i LEFT JOIN h ON h.pos = i.pos LEFT JOIN s ON s.pos = i.pos WHERE i.pos IS NOT NULL""",
}
