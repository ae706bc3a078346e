"""Problem 9: filling containers of fixed capacity with documents.

Bounded-space online packing: every partition keeps a fixed number of open containers; an item goes
into the fullest one that has room, and if none has, the fullest is emitted and a new one opened.
What is left open in the end is merged across partitions, again with a bounded number open. An item
above the capacity is cut into full containers and a remainder, which is packed like any item.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Window_
from pyspark.sql import functions as F

from mathloom.llm.bpe import TOKENIZER_DIR, token_counts
from mathloom.llm.tables import read
from mathloom.storage import materialize

CAPACITY = 4096
#: Containers that a partition keeps open.
OPEN = 64
#: Tokens that a partition packs at least; fixes the number of partitions, so leftovers stay few.
PARTITION_TOKENS = 4_000_000
#: Leftover containers that one task merges at a time.
MERGED_AT_ONCE = 4096


class Window:
    """A bounded set of open containers ordered by fill, packed best-fit."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound, self.open, self.made = capacity, bound, [], 0

    def place(self, size: int) -> tuple[int, list[tuple[int, int]]]:
        """(container, emitted containers as (fill, number)) for an item of at most the capacity."""
        emitted = []
        at = bisect.bisect_right(self.open, (self.capacity - size, float("inf"))) - 1
        if at >= 0:
            fill, number = self.open.pop(at)
        else:
            if len(self.open) == self.bound:
                emitted.append(self.open.pop())
            fill, number = 0, self.made
            self.made += 1
        if fill + size == self.capacity:
            emitted.append((fill + size, number))
        else:
            bisect.insort(self.open, (fill + size, number))
        return number, emitted


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, pieces, start, n): every item cut at the capacity; an item of size 0 or null is one empty piece."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    cut = sizes.select(key, n.alias("whole"), F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int").alias("pieces"))
    each = cut.select(key, "whole", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    start = (F.col("piece").cast("long") * capacity).alias("start")
    return each.select(key, "piece", "pieces", start, F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece").cast("long") * capacity).alias("n"))


def _packed(part: DataFrame, key: str, kind: str, capacity: int, bound: int) -> DataFrame:
    """Pack each partition on its own: one row a piece with the number of its container in the partition
    and whether that container was closed before the end."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        window = Window(capacity, bound)
        waiting: dict[int, list] = {}

        def rows(number: int, closed: bool) -> list:
            return [(*r, task, number, closed) for r in waiting.pop(number)]

        columns = [key, "piece", "pieces", "start", "n", "part", "number", "closed"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                number, emitted = window.place(int(r[4]))
                waiting.setdefault(number, []).append(r)
                for _, done in emitted:
                    out += rows(done, True)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if waiting:
            yield pd.DataFrame([x for number in list(waiting) for x in rows(number, False)], columns=columns)

    return part.mapInPandas(run, f"{key} {kind}, piece int, pieces int, start long, n long, part int, number int, closed boolean")


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, bound: int = OPEN) -> DataFrame:
    """(container, key, piece, pieces, start, n): the container of every piece of every item.

    A container's id is a string. Items of size 0 or null take a place of no tokens, so every row of
    ``sizes`` comes out; only items above the capacity have more than one piece. Items of equal size
    and repeated keys are separate items. The packing depends on the keys' order and on the
    numbers of tokens and items, which fix the partitions, not on the cluster.
    """
    kind = dict(sizes.dtypes)[key]
    items = materialize(pieces(sizes, key, size, capacity), "pieces")
    total, rows = items.agg(F.sum("n"), F.count("*")).first()
    parts = max(1, (total or 0) // PARTITION_TOKENS, rows // 1_000_000)
    again = F.row_number().over(Window_.partitionBy(key, "piece").orderBy("pieces"))  # of items with the same key
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("again").cast("string"))
    full = items.where(F.col("n") == capacity).withColumn("again", again).select(
        name.alias("container"),
        key, "piece", "pieces", "start", "n",
    )
    loose = items.where(F.col("n") < capacity)
    spread = loose.repartition(int(parts), F.xxhash64(key, "piece")).sortWithinPartitions(key, "piece", "n")
    done = materialize(_packed(spread, key, kind, capacity, bound), "packed")
    ident = F.concat(F.lit("c"), F.col("part").cast("string"), F.lit("-"), F.col("number").cast("string"))
    closed = done.where("closed").select(ident.alias("container"), key, "piece", "pieces", "start", "n")
    merged = _merge_left(done.where("not closed").select(ident.alias("container"), key, "piece", "pieces", "start", "n"), capacity, bound)
    columns = ["container", key, "piece", "pieces", "start", "n"]
    return full.select(*columns).unionByName(closed).unionByName(merged.select(*columns))


def _merge_left(rows: DataFrame, capacity: int, bound: int) -> DataFrame:
    """Merge containers that partitions left open, largest first, by best fit; a task takes at most about
    MERGED_AT_ONCE of them. There are at most OPEN a partition, so these are few rows."""
    fills = rows.groupBy("container").agg(F.sum("n").alias("n"))
    fills = materialize(fills, "left")
    tasks = max(1, fills.count() // MERGED_AT_ONCE)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        window = Window(capacity, bound)
        for pdf in batches:
            numbers = [window.place(int(n))[0] for n in pdf["n"]]
            yield pd.DataFrame({"container": pdf["container"], "into": [f"m{task}-{x}" for x in numbers]})

    spread = fills.repartition(tasks, F.xxhash64("container")).sortWithinPartitions(F.desc("n"), "container")
    return rows.join(spread.mapInPandas(run, "container string, into string"), "container").drop("container").withColumnRenamed("into", "container")


def packed_documents(docs: DataFrame, folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """:func:`pack` of the documents by their number of tokens of the public tokenizer."""
    return pack(materialize(token_counts(docs, folder=folder), "sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents")).where("piece = 0 and pieces > 1").select("doc_id")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, fill, least): how full the containers are and the fewest that could hold all."""
    made = packed_documents(read(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("n").alias("n")).where("n > 0")
    tokens = F.coalesce(F.sum("n"), F.lit(0))
    return made.agg(
        F.count("*").alias("containers"), tokens.alias("tokens"),
        F.round(F.try_divide(tokens, F.count("*") * CAPACITY), 4).alias("fill"), F.ceil(tokens / CAPACITY).alias("least"),
    )


QUERIES = {"p9_found": p9_found, "p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
