"""Problem 1: records that differ only in formatting.

A record's key is the pair of its normalized text and its equation after dropping letter case and
everything but letters, marks, numbers, symbols, the signs + - * / % and points between two digits;
digits that dropped characters separated stay separate. Equation parts between semicolons are
sorted. All of it runs as column expressions; the key is hashed to 128 bits and counted with
map-side combining, and every group is checked for collisions by a second hash and the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm.skew import join_to_groups
from mathloom.llm.tables import read
from mathloom.storage import materialize

#: A character that does not count; a point counts only between two digits.
_DROPPED = r"(?:[^\p{L}\p{M}\p{N}\p{S}+\-*/%.]|(?<!\p{Nd})\.|\.(?!\p{Nd}))"
#: Stands for dropped characters between digits; itself dropped from the input beforehand.
_GAP = "\u0001"


def canonical_text(c: Column) -> Column:
    """The counted characters of a text; null gives the empty text."""
    x = F.translate(F.lower(F.coalesce(c, F.lit(""))), _GAP, " ")
    x = F.regexp_replace(x, rf"(?<=\p{{Nd}}){_DROPPED}++(?=\p{{Nd}})", _GAP)
    return F.regexp_replace(x, rf"(?!{_GAP}){_DROPPED}", "")


def canonical_equation(c: Column) -> Column:
    """Sorted non-empty canonical parts of an equation, joined by ';' (which no part contains)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;；]"), canonical_text)
    return F.concat_ws(";", F.array_sort(F.filter(parts, lambda p: p != "")))


def keyed_rows(items: DataFrame) -> DataFrame:
    """(pos, h, chk, len) of every row: 128-bit hash of its key, a second hash and the key's length."""
    key = F.concat_ws("\u0002", canonical_text(F.col("normalized_text")), canonical_equation(F.col("equation")))
    rows = items.where("pos is not null").select("pos", key.alias("key"))
    return rows.select("pos", F.unhex(F.md5("key")).alias("h"), F.xxhash64("key").alias("chk"), F.length("key").alias("len"))


def formatting_groups(rows: DataFrame) -> DataFrame:
    """(h, chk, len, keep_pos, n): one row per record. A group of one 128-bit hash in which the second
    hash or the length differ is a collision; it stays split by them."""
    by_hash = rows.groupBy("h", "chk", "len").agg(F.min("pos").alias("keep_pos"), F.count("*").alias("n"))
    return by_hash


def collisions(groups: DataFrame) -> DataFrame:
    """Hashes shared by different keys, with the number of different keys; normally empty."""
    return groups.groupBy("h").agg(F.count("*").alias("keys")).where("keys > 1")


def collapsed(items: DataFrame) -> DataFrame:
    """(keep_pos, copies): one row per record with the number of its rows, the kept row included.

    Rows with null or empty text and equation are one record. Ties and repeated rows count as copies;
    rows without pos are left out; other columns do not matter; an empty table gives no rows.
    """
    return formatting_groups(keyed_rows(items)).select("keep_pos", F.col("n").alias("copies"))


def duplicates(items: DataFrame) -> DataFrame:
    """(keep_pos, pos) of every row that is not the first of its record."""
    rows = materialize(keyed_rows(items), "keys")
    groups = formatting_groups(rows).where("n > 1")
    return join_to_groups(rows, groups, ["h", "chk", "len"], "n", rows.count()).where("pos <> keep_pos").select("keep_pos", "pos")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "items"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(read(spark, sf_dir, "items"))


def p1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions(formatting_groups(keyed_rows(read(spark, sf_dir, "items"))))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_collisions": p1_collisions}


def _sql_text(c: str) -> str:
    keep = r"\p{L}\p{M}\p{N}\p{S}+\-*/%"
    x = f"lower(replace(coalesce({c}, ''), chr(57344), ' '))"
    for _ in range(2):  # neighbouring matches share a digit
        x = rf"regexp_replace({x}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(57344) || '\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{Nd}})[^{keep}' || chr(57344) || ']+(\p{{Nd}})', '\1' || chr(57345) || '\2', 'g')"
    return rf"regexp_replace({x}, '[^{keep}' || chr(57344) || chr(57345) || ']', '', 'g')"


_SQL_KEYS = f"""
WITH k AS (SELECT pos, {_sql_text("normalized_text")} AS t,
  array_to_string(list_sort(list_filter(list_transform(string_split(replace(coalesce(equation, ''), '；', ';'), ';'),
    lambda e: {_sql_text("e")}), lambda e: e <> '')), ';') AS e FROM items WHERE pos IS NOT NULL)
"""
ORACLE = {
    "p1_found": _SQL_KEYS + "SELECT keep_pos, pos FROM (SELECT pos, min(pos) OVER (PARTITION BY t, e) AS keep_pos FROM k) WHERE pos <> keep_pos",
    "p1_records": _SQL_KEYS + "SELECT min(pos) AS keep_pos, count(*) AS copies FROM k GROUP BY t, e",
}
