"""Measurements that are too long for the tests.

    python tests/llm/measure.py compare FOLDER [QUERY...]    queries against their SQL on all rows of a data folder
    python tests/llm/measure.py recall [PAIRS]               pairs of similarity 0.70 to 0.72 that the candidate search of problems 3 and 5 loses
"""

from __future__ import annotations

import random
import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def compare(folder: str, names: list[str]) -> None:
    import duckdb
    from pyspark.sql import SparkSession

    from mathloom.llm import queries as Q

    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    for name, sql in Q.oracle_sql().items():
        if not names or name in names:
            begin = time.time()
            rows = [sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.to_dict("records")))) for df in (Q.queries()[name](spark, folder).toPandas(), con.sql(sql).df())]
            print(f"{name}: {len(rows[0])} and {len(rows[1])} rows, {'equal' if rows[0] == rows[1] else 'DIFFERENT'}, {time.time() - begin:.0f} s", flush=True)


def pair(rng: random.Random) -> tuple[str, str]:
    """Two texts of a similarity of 0.70 to 0.72: one with scattered edits of the other."""
    from mathloom.llm import shingles as S

    while True:
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(150, 500))]
        other = list(text)
        a = S.gram_set("".join(text))
        while True:
            other[rng.randrange(len(other))] = rng.choice("abcdefghijklmnopqrstuvwxyz0123456789")
            b = S.gram_set("".join(other))
            sim = len(a & b) / len(a | b)
            if sim <= 0.72:
                break
        if sim >= 0.70:
            return "".join(text), "".join(other)


def recall(pairs: int) -> None:
    from mathloom.llm import near
    from mathloom.llm import shingles as S

    rng = random.Random(11)
    count = max(near.SEGMENTS * near.WIDTH, near.PARTS * near.CELLS, S.SYMBOLS)
    lost = dict.fromkeys(("p5 no common signature", "p5 fingerprint", "p5", "p3 no common segment", "p3 fingerprint", "p3"), 0)
    for begin in range(0, pairs, 2000):
        n = min(2000, pairs - begin)
        cp, off = S.code_points([t for _ in range(n) for t in pair(rng)])
        mins = S.sketches(cp, off, count)
        a, b = mins[::2], mins[1::2]
        two = (a[:, : S.SYMBOLS] ^ b[:, : S.SYMBOLS]) & 3
        symbol = (a[:, : S.SYMBOLS] ^ b[:, : S.SYMBOLS]) & (2**S.SYMBOL_BITS - 1)
        wide = (a[:, : near.PARTS * near.CELLS] & 255) == (b[:, : near.PARTS * near.CELLS] & 255)
        signed = wide.reshape(n, near.PARTS, near.CELLS).all(2).any(1)
        close = (symbol > 0).sum(1) <= near.MAX_SYMBOLS
        k = near.SEGMENTS * near.WIDTH
        joined = ((a[:, :k] & 255) == (b[:, :k] & 255)).reshape(n, near.SEGMENTS, near.WIDTH).all(2).any(1)
        inside = ((two & 1) + (two >> 1)).sum(1) <= near.RADIUS
        for name, found in (("p5 no common signature", signed), ("p5 fingerprint", close), ("p5", signed & close), ("p3 no common segment", joined), ("p3 fingerprint", inside), ("p3", joined & inside)):
            lost[name] += int((~found).sum())
    for name, n in lost.items():
        print(f"{name}: {n} of {pairs} lost, recall {1 - n / pairs:.6f}")


if __name__ == "__main__":
    compare(sys.argv[2], sys.argv[3:]) if sys.argv[1] == "compare" else recall(int((sys.argv[2:] or ["100000"])[0]))
