"""Problem 2: a sample that matches target proportions of categories.

Per plan the expected counts of its categories are raked by iterative proportional fitting over the
margins of source, kind and figure, never above the supply: what a short category cannot give goes to
others of the same margins. Every row of a category gets an exponential key whose rate is made of the raked
count, and is drawn if its key is at most 1, so the draw meets the raked counts on average. The draw is then
repaired: raking once more with the minimums as lower bounds gives the counts to end with, and each category
comes to one of the two whole numbers beside its count by the next keys or without the last ones; the plan's
size is met as far as supply goes. Categories that could not be met are reported with their gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.llm.tables import label, read
from mathloom.storage import materialize

CELL = ["source", "kind", "has_diagram"]
MARGINS = (("source",), ("kind",), ("has_diagram",))
#: Rounds of the fitting at most, and the share of the size that a margin may be off when it ends.
ROUNDS, TOLERANCE = 1000, 1e-7
#: Keys are cut into so many ranges, so that only the range that holds the cut is ranked.
RANGES = 4096
SEED = 17


def target_cells(targets: DataFrame) -> DataFrame:
    """The plans' categories with labels in one spelling and the number of rows wanted."""
    exact = F.ceil(F.round(F.col("share") * F.col("sample_size"), 6))
    return targets.select(
        F.col("plan_id").cast("int").alias("plan_id"), F.col("sample_size").cast("int").alias("sample_size"), label("source").alias("source"),
        label("kind").alias("kind"), F.col("has_diagram").cast("int").alias("has_diagram"), "share", F.col("min_rows").cast("int").alias("min_rows"),
        F.greatest(F.col("min_rows").cast("long"), exact).alias("wanted"),
    )


def supply(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(source, kind, has_diagram, id): every distinct id of the categories that a plan names. Rows with
    null id, source, kind or has_diagram belong to no category. ``cells`` is as small as the plans."""
    named = F.broadcast(cells.select(*CELL).distinct())
    rows = items.select(label("source").alias("source"), label("kind").alias("kind"), F.col("has_diagram").cast("int").alias("has_diagram"), "id")
    return rows.where("id is not null").join(named, CELL).distinct()


def rake(goal: np.ndarray, have: np.ndarray, groups: list[np.ndarray], total: float, least: np.ndarray | float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Expected counts between ``least`` and ``have`` whose sums over each grouping are those of ``goal`` as far as
    these bounds allow. ``groups``: for every margin the group number of each cell. Cells begin at ``start``, else at
    their goal, and are scaled margin by margin; cells at a bound leave the change to the others of their group. What
    the margins leave open of ``total`` goes to, or comes from, all cells that have room."""
    x = np.clip(np.maximum(goal, 0) if start is None else start, least, have)
    wanted = [np.bincount(g, goal) for g in groups]
    for _ in range(ROUNDS):
        for g, want in zip(groups, wanted):
            for _ in range(8):  # cells that reach a bound leave the rest to the others
                now = np.bincount(g, x)
                moves = np.where((want >= now)[g], x < have, x > least) & (x > 0)
                free = np.bincount(g, x * moves)
                factor = np.divide(np.maximum(want - now + free, 0), free, out=np.ones_like(want), where=free > 0)
                x = np.where(moves, np.clip(x * factor[g], least, have), x)
                if (np.abs(np.bincount(g, x) - want) <= TOLERANCE * total).all():
                    break
        if all((np.abs(np.bincount(g, x) - want) <= TOLERANCE * total).all() for g, want in zip(groups, wanted)):
            break
    for _ in range(2 * len(x)):
        missing = min(total, have.sum()) - x.sum()
        room = (have - x) * (goal > 0) if missing > 0 else x - least
        room = room if room.sum() > 0 or missing < 0 else have - x
        if abs(missing) <= TOLERANCE * total or room.sum() <= 0:
            break
        x = np.clip(x + missing * room / room.sum(), least, have)
    return x


def whole(n: np.ndarray, low: np.ndarray, high: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers between ``low`` and ``high`` whose sum is ``total``, or as near to it as these allow, and
    that differ from ``n`` by as little as possible: all move by one common amount up to their bounds."""
    total = int(np.clip(total, low.sum(), high.sum()))
    at = lambda shift: np.clip(n + shift, low, high)
    span = int(np.abs(high - n).max(initial=0) + np.abs(low - n).max(initial=0)) + 1
    under, over = -span, span
    while over - under > 1:  # the largest common shift that does not exceed the sum
        middle = (under + over) // 2
        under, over = (middle, over) if at(middle).sum() <= total else (under, middle)
    made = at(under)
    rest = total - int(made.sum())
    return made + np.isin(np.arange(len(n)), np.flatnonzero(at(under + 1) > made)[:rest])


def repair(drawn: np.ndarray, near: np.ndarray, have: np.ndarray, size: int) -> np.ndarray:
    """The counts that the sample ends with: drawn ones brought to one of the two whole numbers beside ``near``, the
    raked counts with their minimums."""
    low, high = np.floor(near + 1e-6).astype(np.int64), np.minimum(np.ceil(near - 1e-6).astype(np.int64), have)
    if high.sum() < min(size, have.sum()):
        high = have
    return whole(np.clip(drawn, low, high), low, high, size)


def _cells(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list, int]:
    pdf = pdf.sort_values(CELL, kind="stable").reset_index(drop=True)
    return pdf, [pdf.groupby(list(m), dropna=False).ngroup().to_numpy() for m in MARGINS], int(pdf["sample_size"].iloc[0])


def _raked(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, groups, size = _cells(pdf)
    return pdf.assign(raked=rake(pdf["share"].to_numpy(float) * size, pdf["supply"].to_numpy(float), groups, float(size)))


def _repaired(pdf: pd.DataFrame) -> pd.DataFrame:
    """Minimums are repaired by raking once more above them, so that the margins still hold where they can."""
    pdf, groups, size = _cells(pdf)
    drawn, raked, have, least = (pdf[c].to_numpy() for c in ("drawn_first", "raked", "supply", "min_rows"))
    floor = np.minimum(least, have).astype(float)
    near = rake(pdf["share"].to_numpy(float) * size, have.astype(float), groups, float(size), floor, raked)
    return pdf.assign(repaired=near, quota=repair(drawn, near, have, size))


_PLAN = "plan_id int, sample_size int, source string, kind string, has_diagram int, share double, min_rows int, wanted long, supply long"
_COLUMNS = [c.split()[0] for c in _PLAN.split(", ")]


def raked_plan(items: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, plan): the distinct ids by category, and each category of each plan with its supply and raked count."""
    cells = target_cells(targets)
    ids = materialize(supply(items, cells), "supply")
    counts = ids.groupBy(*CELL).agg(F.count("*").alias("supply"))
    known = cells.join(F.broadcast(counts), CELL, "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    plan = known.select(*_COLUMNS).groupBy("plan_id").applyInPandas(_raked, _PLAN + ", raked double")
    return ids, materialize(plan, "plan")


def keyed_rows(ids: DataFrame, plan: DataFrame) -> DataFrame:
    """Every id of each plan's categories with its exponential ``key``, of rate -log(1 - raked / supply), so that
    raked of supply rows are expected to have a key of at most 1, and the ``range`` its uniform number lies in."""
    rate = -F.log(1 - F.least(F.col("raked") / F.col("supply"), F.lit(1 - 1e-12)))
    use = F.broadcast(plan.where("supply > 0").select("plan_id", *CELL, F.greatest(rate, F.lit(1e-12)).alias("rate")))
    u = (F.pmod(F.xxhash64("id", "plan_id", F.lit(SEED)), F.lit(2**52)) + 0.5) / float(2**52)
    keyed = ids.join(use, CELL).withColumn("u", u)
    cut = F.least(F.floor((1 - F.col("u")) * RANGES), F.lit(RANGES - 1)).cast("int")  # keys fall as u rises
    return keyed.withColumn("key", -F.log("u") / F.col("rate")).withColumn("range", cut).drop("rate", "u")


def sample(items: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the drawn (plan_id, source, kind, has_diagram, id), and the categories of the plans with supply,
    raked count, ``drawn_first``, the rows that the keys alone drew, and ``quota``, their number after the repair.

    Draws do not depend on the cluster. An id counts once in a category. Plans without supply give no
    rows; empty tables give empty results. Rows of a category are cut by key ranges, so none is one task's window.
    """
    ids, plan = raked_plan(items, targets)
    cell = ["plan_id", *CELL]
    keyed = keyed_rows(ids, plan)
    counts = materialize(keyed.groupBy(*cell, "range").agg(F.count("*").alias("n"), F.count_if(F.col("key") <= 1).alias("first")), "counts")  # at most RANGES a category
    drawn = counts.groupBy(*cell).agg(F.sum("first").alias("drawn_first"))
    known = plan.join(F.broadcast(drawn), cell, "left").withColumn("drawn_first", F.coalesce("drawn_first", F.lit(0)))
    done = _PLAN + ", raked double, drawn_first long, repaired double, quota long"
    plan = materialize(known.select(*_COLUMNS, "raked", "drawn_first").groupBy("plan_id").applyInPandas(_repaired, done), "quotas")
    upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.join(F.broadcast(plan.select(*cell, "quota")), cell).withColumn("before", upto - F.col("n"))
    # the range that holds the last row taken; a category that is taken whole has the last range there is
    cut = F.broadcast(cut.where("before < quota").groupBy(*cell).agg(F.max("range").alias("last"), F.max_by(F.col("quota") - F.col("before"), "range").alias("more")))
    marked = keyed.join(cut, cell).where("range <= last")
    edge = marked.where("range = last").withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "id")))
    return marked.where("range < last").select(*cell, "id").union(edge.where("r <= more").select(*cell, "id")), plan


def report(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Every category of every plan: wanted, supply, raked, rows that the keys alone drew and drawn rows, and the gaps
    left: to the target share (drawn share minus target share), to the minimum, and ``short``, whether the supply
    is below what was wanted."""
    rows, plan = sample(items, targets)
    drawn = rows.groupBy("plan_id", *CELL).agg(F.count("*").alias("drawn"))
    out = plan.join(F.broadcast(drawn), ["plan_id", *CELL], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    size = F.sum("drawn").over(Window.partitionBy("plan_id"))
    gap = F.round(F.coalesce(F.try_divide(F.col("drawn"), size), F.lit(0.0)) - F.col("share"), 6)
    return out.select(
        "plan_id", *CELL, "share", "min_rows", "wanted", "supply", F.round("raked", 4).alias("raked"), F.round("repaired", 4).alias("repaired"), "drawn_first", "drawn", gap.alias("share_gap"),
        F.greatest(F.lit(0), F.col("min_rows") - F.col("drawn")).alias("minimum_gap"), (F.col("supply") < F.col("wanted")).alias("short"),
    )


def margin_report(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, margin, value, target, raked, repaired, drawn, possible): of every value of each margin the rows that
    its share asks for, raked ones without and with the minimums, drawn ones, and whether the minimums and the supply
    of its categories allow as many."""
    r = report(items, targets).join(F.broadcast(targets.select(F.col("plan_id").cast("int").alias("plan_id"), "sample_size").distinct()), "plan_id")
    values = F.array(*(F.struct(F.lit(m[0]).alias("margin"), F.col(m[0]).cast("string").alias("value")) for m in MARGINS))
    target = F.sum(F.col("share") * F.col("sample_size"))
    per = r.withColumn("m", F.explode(values)).groupBy("plan_id", "m").agg(
        F.round(target, 4).alias("target"), F.round(F.sum("raked"), 2).alias("raked"), F.round(F.sum("repaired"), 2).alias("repaired"), F.sum("drawn").alias("drawn"),
        ((F.sum("supply") >= target - 1e-6) & (F.sum(F.least("min_rows", "supply")) <= target + 1e-6)).alias("possible"),
    )
    return per.select("plan_id", "m.margin", "m.value", "target", "raked", "repaired", "drawn", "possible")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that the report of the sample lists as short."""
    return p2_report(spark, sf_dir).where("short").select("plan_id", *CELL)


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(read(spark, sf_dir, "items"), read(spark, sf_dir, "sample_targets"))[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "items"), read(spark, sf_dir, "sample_targets"))


def p2_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margin_report(read(spark, sf_dir, "items"), read(spark, sf_dir, "sample_targets"))


QUERIES = {"p2_found": p2_found, "p2_sample": p2_sample, "p2_report": p2_report, "p2_margins": p2_margins}
ORACLE = {
    "p2_found": r"""
WITH t AS (SELECT CAST(plan_id AS INTEGER) plan_id, lower(trim(source)) source, lower(trim(kind)) kind, CAST(has_diagram AS INTEGER) has_diagram,
    greatest(CAST(min_rows AS BIGINT), CAST(ceil(round(share * sample_size, 6)) AS BIGINT)) wanted FROM sample_targets),
  s AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) source, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) kind,
    CAST(has_diagram AS INTEGER) has_diagram, count(DISTINCT id) n FROM items WHERE has_diagram IS NOT NULL AND kind IS NOT NULL GROUP BY ALL)
SELECT plan_id, source, kind, has_diagram FROM t LEFT JOIN s USING (source, kind, has_diagram) WHERE coalesce(n, 0) < wanted""",
}
