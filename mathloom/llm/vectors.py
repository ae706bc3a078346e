"""Problem 7: the most similar figures of every figure, by vector and by perceptual hash.

A block matrix join: rows are dealt to blocks, every pair of blocks is one tile, and a task works
one tile, a strip of its rows at a time. Vectors are quantised to int8; the product of a strip (whole
numbers, exact in float32) gives each cosine with a bound on its error. Pairs whose bound reaches the
threshold and the k-th best that either side has so far are computed again in float64 and merged into
the heaps, which are arrays of the k best of every row and every column; a strip is forgotten before the
next one, so a cluster of near-equal figures does not gather its pairs. The heaps of all tiles are merged
in the end. Perceptual hashes take the same way as vectors of 64 signs, whose products are exact. Equal
figures form one class and enter the join once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.llm.skew import join_to_groups
from mathloom.llm.tables import read
from mathloom.storage import materialize

DIMS = 256
NEIGHBOURS = 5
MIN_COSINE = 0.9
MAX_BITS = 4
#: Rows of a block at most, which bounds a task's memory, and blocks at least, for parallel tiles.
BLOCK_ROWS, MIN_BLOCKS = 32768, 8
#: Rows of a tile whose products are held at once.
STRIP = 512
#: Cosines are compared at so many decimals: stored vectors are float32, copies may be scaled.
DECIMALS = 6
VECTOR, PHASH = 0, 1

_HASH = re.compile("[0-9a-fA-F]{16}")


def _vector_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index, [n, DIMS] float32) of the usable vectors of a list column."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    at = np.flatnonzero(sizes == DIMS)
    if not len(at):
        return at, np.zeros((0, DIMS), np.float32)
    flat = column.take(pa.array(at)).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIMS)
    ok = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return at[ok], rows[ok]


def usable(items: DataFrame) -> DataFrame:
    """(field, pos, d1, d2, payload) of every usable vector (DIMS finite numbers, not all zero) and
    hash (16 hex digits of either case); d1, d2 is a 128-bit digest of the payload."""

    def run(batches):
        for b in batches:
            pos = b.column(0).to_numpy(zero_copy_only=False)
            at, rows = _vector_bytes(b.column(1))
            yield _payload_batch(VECTOR, pos[at], [(r + np.float32(0)).tobytes() for r in rows])
            found = [(i, bytes.fromhex(h)) for i, h in enumerate(b.column(2).to_pylist()) if h and _HASH.fullmatch(h)]
            yield _payload_batch(PHASH, pos[[i for i, _ in found]] if found else pos[:0], [h for _, h in found])

    rows = items.where("pos is not null and (diagram_vector is not null or phash is not null)")
    return rows.select("pos", "diagram_vector", "phash").mapInArrow(run, "field int, pos long, d1 long, d2 long, payload binary")


def _payload_batch(field: int, pos: np.ndarray, payload: list[bytes]) -> pa.RecordBatch:
    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in payload), np.int64).reshape(-1, 2)
    cols = [pa.array(np.full(len(pos), field, np.int32)), pa.array(pos, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
    return pa.RecordBatch.from_arrays([*cols, pa.array(payload, pa.binary())], ["field", "pos", "d1", "d2", "payload"])


def _decoded(field: int, payload: list[bytes]) -> np.ndarray:
    """Unit vectors in float64, or vectors of 64 signs."""
    raw = np.frombuffer(b"".join(payload), np.float32 if field == VECTOR else np.uint8)
    if field == PHASH:
        return np.unpackbits(raw.reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
    x = raw.reshape(-1, DIMS).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, so that products run at full speed and stay exact), scale and the norm of the rest."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


class _Best:
    """The k best partners of each of n rows: scores from the highest, equal ones in order of id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score that a new partner of each row has to reach."""
        return self.score[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge partners of some rows with those known."""
        k = self.score.shape[1]
        touched, row = np.unique(rows, return_inverse=True)
        row = np.concatenate([row, np.repeat(np.arange(len(touched)), k)])
        ids, scores = np.concatenate([ids, self.id[touched].ravel()]), np.concatenate([scores, self.score[touched].ravel()])
        order = np.lexsort((ids, -scores, row))
        first = np.searchsorted(row[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(k)]
        self.id[touched], self.score[touched] = ids[best], scores[best]

    def rows(self, own: np.ndarray):
        """(row, partner, score) of all that were found."""
        i, j = np.nonzero(np.isfinite(self.score))
        return own[i], self.id[i, j], self.score[i, j]


#: Bounds are compared with scores that were rounded, so ties are not lost by them.
_SLACK = 2 * 10.0**-DECIMALS
#: Candidates of a strip above this share of its pairs are computed as one product.
_DENSE = 1 / 16


def _tile(x: np.ndarray, y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, field: int, k: int, same: bool):
    """(row, partner, score) of the best k partners in y of each row of x and the other way round; scores are
    rounded cosines or negative Hamming distances, equal ones in order of id."""
    least = MIN_COSINE if field == VECTOR else 64 - 2 * MAX_BITS
    if field == VECTOR:
        (qx, sx, ex), (qy, sy, ey) = _quantised(x), _quantised(y)
    else:
        qx, sx, ex, qy, sy, ey = x.astype(np.float32), np.ones(len(x)), np.zeros(len(x)), y.astype(np.float32), np.ones(len(y)), np.zeros(len(y))
    # as Hamming distances are scored by half the distance from 64, the product that a score stands for
    product_of = (lambda score: score) if field == VECTOR else (lambda score: 64 + 2 * score)
    best_x, best_y = _Best(len(x), k), _Best(len(y), k)
    for lo in range(0, len(x), STRIP):
        s = slice(lo, lo + STRIP)
        product = qx[s] @ qy.T
        # the cosine differs from the scaled product by at most ex + ey + ex * ey, as unit vectors have norm 1
        worst = ex[s] + ey.max() + ex[s] * ey.max()
        i, j = np.nonzero(product >= ((least - worst - 1e-9) / (sx[s] * sy.max()))[:, None].astype(np.float32) - 1)
        if same:
            i, j = i[i + lo != j], j[i + lo != j]
        near, error = product[i, j].astype(np.float64) * sx[s][i] * sy[j], ex[s][i] + ey[j] + ex[s][i] * ey[j]
        keep = near + error >= least - 1e-9
        i, j, near, error = i[keep], j[keep], near[keep], error[keep]
        if len(i) > 8 * k * len(product):
            keep = near + error >= np.minimum(_kth(i, near - error, len(product), k)[i], np.inf if same else product_of(best_y.least())[j]) - _SLACK
            i, j = i[keep], j[keep]
        if len(i) > _DENSE * product.size:
            exact = (x[s] @ y.T)[i, j]
        else:
            exact = np.empty(len(i))
            for at in range(0, len(i), 65536):
                c = slice(at, at + 65536)
                exact[c] = np.einsum("nd,nd->n", x[lo + i[c]], y[j[c]])
        ok = exact >= least - 1e-9
        i, j, exact = i[ok] + lo, j[ok], exact[ok]
        score = np.round(exact, DECIMALS) if field == VECTOR else np.rint((exact - 64) / 2)
        best_x.add(i, ids_y[j], score)
        if not same:
            fits = score >= best_y.least()[j]
            best_y.add(j[fits], ids_x[i[fits]], score[fits])
    yield best_x.rows(ids_x)
    if not same:
        yield best_y.rows(ids_y)


def _kth(rows: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th highest value of each of n rows, minus infinity where a row has fewer; rows are sorted."""
    order = np.lexsort((-values, rows))
    first = np.searchsorted(rows, np.arange(n))
    have = np.diff(np.append(first, len(rows)))
    at = np.minimum(first + k - 1, max(0, len(rows) - 1))
    return np.where(have >= k, values[order[at]] if len(rows) else 0.0, -np.inf)


def block_join(classes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(field, rep, other, score): for every class the best k others. ``classes`` has field, rep (unique
    within a field, smallest pos of the class) and payload."""
    counts = {r["field"]: r["n"] for r in classes.groupBy("field").agg(F.count("*").alias("n")).collect()}  # two rows at most
    blocks = {f: max(-(-n // BLOCK_ROWS), min(MIN_BLOCKS, -(-n // 256))) for f, n in counts.items()}
    if not blocks:
        blocks = {VECTOR: 1}
    of = F.element_at(F.create_map(*(F.lit(x) for f, g in blocks.items() for x in (f, g))), F.col("field"))
    dealt = classes.withColumn("g", of).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("g").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("partner")
    spread = dealt.select("field", "rep", "payload", "block", other)
    spread = spread.select("field", F.least("block", "partner").alias("x"), F.greatest("block", "partner").alias("y"), "block", "rep", "payload")

    def run(key, table):
        field, bx, by = (v.as_py() for v in key)
        block = table.column("block").to_numpy()
        ids = table.column("rep").to_numpy()
        data = _decoded(field, table.column("payload").to_pylist())
        order = np.argsort(ids, kind="stable")
        block, ids, data = block[order], ids[order], data[order]
        a, b = block == bx, block == by
        out = list(_tile(data[a], data[b], ids[a], ids[b], field, k, bx == by)) if a.any() and b.any() else []
        cat = lambda i, t: np.concatenate([o[i] for o in out]).astype(t) if out else np.zeros(0, t)
        rep = cat(0, np.int64)
        return pa.table({"field": np.full(len(rep), field, np.int32), "rep": rep, "other": cat(1, np.int64), "score": cat(2, np.float64)})

    best = spread.groupBy("field", "x", "y").applyInArrow(run, "field int, rep long, other long, score double")
    w = Window.partitionBy("field", "rep").orderBy(F.desc("score"), "other")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def nearest_figures(items: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(field, pos, other, score, rank): the up to k most similar figures of every usable one, of cosine
    at least MIN_COSINE, or of at most MAX_BITS differing bits (score is then minus their number).

    Null, malformed, all-zero and non-finite figures have no neighbours and are none. Equal scores come
    in order of pos; a figure is never its own neighbour, an equal one of another row is. Extra columns
    do not matter.
    """
    rows = materialize(usable(items), "figures")
    by = ["field", "d1", "d2"]
    groups = rows.groupBy(*by).agg(F.min("pos").alias("rep"), F.count("*").alias("n"))
    members = materialize(join_to_groups(rows.drop("payload"), groups, by, "n", rows.count()).select("field", "pos", "rep"), "members")
    classes = rows.join(members.where("pos = rep").select("field", "pos", "rep").hint("merge"), ["field", "pos"]).select("field", "rep", "payload")
    links = materialize(block_join(classes, k), "links")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("field", "rep").orderBy("pos"))).where(F.col("r") <= k + 1)
    own = first.select("field", "rep", F.col("pos").alias("other"), F.when(F.col("field") == VECTOR, 1.0).otherwise(0.0).alias("score"))
    spread = links.hint("merge").join(first.select("field", F.col("rep").alias("other"), F.col("pos").alias("p")), ["field", "other"])
    every = own.union(spread.select("field", "rep", F.col("p").alias("other"), "score"))
    w = Window.partitionBy("field", "rep").orderBy(F.desc("score"), "other")
    best = every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    lists = best.groupBy("field", "rep").agg(F.array_sort(F.collect_list(F.struct("r", "other", "score"))).alias("v"), F.max("r").alias("m"))
    sizes = members.groupBy("field", "rep").agg(F.count("*").alias("n"))
    lists = materialize(lists.where("m > 1").join(sizes.hint("merge"), ["field", "rep"]), "lists")
    mine = join_to_groups(members, lists.select("field", "rep", "v", "n"), ["field", "rep"], "n", members.count())
    rest = F.slice(F.filter("v", lambda x: x["other"] != F.col("pos")), 1, k)
    out = mine.select("field", "pos", F.posexplode(rest).alias("i", "x"))
    name = F.when(F.col("field") == VECTOR, "diagram_vector").otherwise("phash").alias("field")
    return out.select(name, "pos", F.col("x.other").alias("other"), F.col("x.score").alias("score"), (F.col("i") + 1).alias("rank"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_figures(read(spark, sf_dir, "items"))
    return near.select("field", F.least("pos", "other").alias("pos_a"), F.greatest("pos", "other").alias("pos_b")).distinct()


def p7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_figures(read(spark, sf_dir, "items"))


QUERIES = {"p7_found": p7_found, "p7_nearest": p7_nearest}
_NEAREST = f"""
WITH v AS (SELECT pos, CAST(diagram_vector AS DOUBLE[]) v FROM items WHERE len(diagram_vector) = {DIMS} AND len(list_filter(diagram_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(diagram_vector, lambda x: x <> 0)) > 0),
  h AS (SELECT pos, CAST('0x' || substr(phash, 1, 8) AS BIGINT) a, CAST('0x' || substr(phash, 9, 8) AS BIGINT) b FROM items WHERE regexp_full_match(phash, '[0-9a-fA-F]{{16}}')),
  s AS (SELECT 'diagram_vector' field, a.pos, b.pos other, list_cosine_similarity(a.v, b.v) s FROM v a JOIN v b ON a.pos <> b.pos
    UNION ALL SELECT 'phash', x.pos, y.pos, 0 - CAST(bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) AS DOUBLE) FROM h x JOIN h y ON x.pos <> y.pos),
  t AS (SELECT field, pos, other, CASE WHEN field = 'phash' THEN s ELSE round(s, {DECIMALS}) END score FROM s WHERE s >= CASE WHEN field = 'phash' THEN -{MAX_BITS} ELSE {MIN_COSINE} - 1e-9 END),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field, pos ORDER BY score DESC, other) AS INTEGER) AS "rank" FROM t)"""
ORACLE = {
    "p7_nearest": _NEAREST + f' SELECT field, pos, other, score, "rank" FROM r WHERE "rank" <= {NEIGHBOURS}',
    "p7_found": _NEAREST + f' SELECT DISTINCT field, least(pos, other) pos_a, greatest(pos, other) pos_b FROM r WHERE "rank" <= {NEIGHBOURS}',
}
