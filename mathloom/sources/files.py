"""Question collections in their own file layouts: recognising, reading, joining figures, writing.

Recognising a layout looks at a few file heads on the driver; the records themselves are read by Spark.
"""

from __future__ import annotations

import json
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.sources import records as R

# Figure file names, best first, and files that hold no problems.
FIGURES = ["img_diagram.png", "img_diagram.jpg", "img.png", "image.png"]
SKIPPED = ["data.json", "logic_form.json", "prompts_4shot.jsonl"]
_HEAD = 256 * 1024

_GEOMETRY = (
    "id bigint, annotat_text string, problem_text string, compact_text string, choices array<string>, compact_choices array<string>, answer string, "
    "problem_type_graph array<string>, problem_type_goal array<string>, data_type string, logic_form struct<text_logic_form:array<string>, diagram_logic_form:array<string>>"
)
_MATH = "problem string, level string, type string, solution string"


def looks_like_lines(path: Path) -> bool:
    """Are the first non-blank lines one object each? Three decide, of a shorter file two."""
    with path.open(encoding="utf-8", errors="ignore") as f:
        lines = list(islice((x.strip() for x in f if x.strip()), 3))
    return len(lines) >= 2 and all(x.startswith("{") for x in lines)


def peek(path: Path) -> dict:
    """The first object near the beginning of a file; an array that was cut gives its first object."""
    with path.open("rb") as f:
        head = f.read(_HEAD).decode("utf-8", "ignore").lstrip()
    text = head[head.find("{") :] if head.startswith("[") else head.splitlines()[0] if looks_like_lines(path) else head
    found, _ = json.JSONDecoder().raw_decode(text)
    return found if isinstance(found, dict) else {}


def is_math(record: dict) -> bool:
    return bool(record.get("problem")) and record.get("solution") is not None and not record.get("original_text") and not record.get("problem_text")


def _safe_peek(path: Path) -> dict:
    try:
        return peek(path)
    except (ValueError, IndexError, OSError):
        return {}


def detect_source(path: str | Path) -> str:
    """ape, cm17k, geometry3k or math, from names and the first record."""
    path = Path(path)
    if path.is_dir():
        if next(path.rglob("data.json"), None):
            return "geometry3k"
        files = sorted(p for p in path.rglob("*.json*") if p.suffix in (".json", ".jsonl"))
        if any(is_math(_safe_peek(p)) for p in files if p.name not in SKIPPED):
            return "math"
        whole = [p for p in files if p.suffix == ".json"] or files
        if not whole:
            raise FileNotFoundError(f"no records below {path}")
        return detect_source(whole[0])
    first = _safe_peek(path)
    if path.suffix == ".jsonl" or path.name.endswith(".ape.json"):
        return "math" if is_math(first) else "ape"
    if is_math(first):
        return "math"
    return "geometry3k" if {"annotat_text", "problem_text", "problem_type_graph"} & first.keys() else "cm17k"


def _placed_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, n, record): the lines of files that begin an object, numbered from 0 in each file. Files are split as
    Spark splits text, so a file of any size is read in parallel: a line's number is its place in its split plus
    the lines of the splits before it; only one row a split is gathered for that."""
    lines = spark.read.text(str(path), recursiveFileLookup=True, pathGlobFilter=pattern)
    lines = lines.select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.col("record").rlike(r"^\s*\{")).withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("n"), "record")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, record, lined): every JSON object below a path as text, in order of file and place. Lines of .jsonl
    files and of .json files that hold one object a line (lined), elements of arrays, and values of keyed objects are
    records; cut lines are left out. A .json file is one value and therefore one row, as nothing tells where to cut it."""
    whole = spark.read.text(str(path), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("*", F.col("_metadata.file_path").alias("path"))
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    opens = lambda x: x.rlike(r"^\s*\{")
    each = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"\S"))
    lined = (F.size(each) >= 2) & F.forall(F.slice(each, 1, 3), opens)  # as in looks_like_lines
    listed = F.from_json("value", "array<string>")
    keyed = F.map_values(F.from_json("value", "map<string,string>"))
    own = F.when(kind.startswith("ARRAY"), listed).when(F.exists(F.map_keys(F.from_json("value", "map<string,string>")), lambda k: k.isin("id", "pid", "original_text", "problem", "problem_text", "annotat_text")), F.array("value")).otherwise(keyed)
    own = F.when(lined, F.filter(each, opens)).otherwise(own)
    objects = whole.select("path", lined.alias("lined"), F.posexplode(own).alias("n", "record")).select("path", F.col("n").cast("long"), "record", "lined")
    lines = _placed_lines(spark, path, "*.jsonl").withColumn("lined", F.lit(True))
    return objects.where(F.trim("record").startswith("{")).unionByName(lines).where(F.try_parse_json("record").isNotNull())


def numbered(df: DataFrame) -> DataFrame:
    """Adds pos, the place in order of file and record: record numbers within a file plus the sizes of the files before
    it. One row a file is sorted for that, and joined as its size allows."""
    sizes = df.groupBy("path").agg((F.max("n") + 1).cast("bigint").alias("size"))
    before = sizes.select("path", (F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return df.join(before, "path").withColumn("pos", F.coalesce("before", F.lit(0)) + F.col("n")).drop("before")


def figures_of_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder, image): the best figure file of each folder; only names are listed, no image is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg}").load(str(path)).select("path")
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    known = F.array_position(F.array(*(F.lit(x) for x in FIGURES)), F.col("name"))
    ranked = named.where((known > 0) | F.col("name").endswith(".png")).withColumn("rank", F.when(known > 0, known).otherwise(len(FIGURES) + 1))
    return ranked.groupBy("folder").agg(F.min_by("path", F.struct("rank", "name")).alias("image"))


def read_source(spark: SparkSession, path: str, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Items of a path; the layout is recognised where no source is named. ``limit``: only the first items."""
    items = _read_source(spark, path, source or detect_source(path))
    return items if limit is None else items.orderBy("pos").limit(limit)


def _read_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = numbered(raw_records(spark, path))
    if source in ("ape", "cm17k"):
        return R.word_problems(rows.select(F.col("pos").alias("line_no"), F.lit(source).alias("source"), "record"))
    if source == "math":
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        r = rows.where(~name.isin(SKIPPED)).withColumn("r", F.from_json("record", _MATH)).select("pos", "path", "n", "lined", "r.*")
        stem = F.regexp_extract("path", r"([^/]+(?:\.jsonl|_(?:train|test|valid|val)\.json))$", 1)
        stem = F.when(F.col("lined"), F.regexp_replace(stem, r"\.jsonl?$", "")).otherwise("")
        subject = F.replace(F.regexp_replace(stem, "_(train|test|valid|val)$", ""), F.lit("_"), F.lit(" "))
        split = F.regexp_extract(stem, "_(train|test|valid|val)$", 1)
        place = F.when(stem != "", F.concat_ws("/", split, subject, F.col("n").cast("string"))).when(F.col("lined"), F.concat(F.regexp_replace("path", "[^/]+$", ""), F.col("n").cast("string"))).otherwise(F.col("path"))
        return R.competition_problems(r.withColumn("path", place))
    if source == "geometry3k":
        r = rows.withColumn("r", F.from_json("record", _GEOMETRY)).select("pos", "path", "r.*").withColumn("choices", F.coalesce("choices", "compact_choices"))
        items = R.geometry_problems(r)
        folder = r.select("pos", F.regexp_extract("path", r"^(?:file:)?/*(/.*)/[^/]+$", 1).alias("folder"))
        found = figures_of_folders(spark, path).withColumn("folder", F.regexp_replace("folder", "^(?:file:)?/*/", "/"))
        return items.drop("image").join(folder, "pos").join(found, "folder", "left").drop("folder").select(*R.ITEM_COLUMNS)
    raise ValueError(f"unknown source {source}")


def image_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, gold): images and the ids of their questions, from manifest.txt (name, tab, id; # comments) or, without
    one, from the names of the PNG files. Names without a file are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(str(folder)).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    if not (Path(folder) / "manifest.txt").is_file():
        return files.where(F.col("name").endswith(".png")).select("path", F.regexp_replace("name", r"\.png$", "").alias("gold"))
    lines = spark.read.text(f"{folder}/manifest.txt").select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    cut = lines.select(F.split("v", "\t").alias("c")).where("size(c) >= 2").select(F.trim(F.col("c")[0]).alias("name"), F.trim(F.col("c")[1]).alias("gold"))
    return cut.where("gold <> ''").join(files, "name").select("path", "gold")


def write_by_source(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rows in one folder a source; a repeated write replaces only the sources it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").format(fmt).save(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
