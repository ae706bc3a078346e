"""Problem 6: texts that look the same but are written in other characters.

A transducer rewrites a text in one pass, longest match first over grapheme clusters (a base with
its combining marks). Its table is computed by rule from the Unicode data plus a short list of
look-alike letters, and is checked for conflicts when it is compiled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm.skew import join_to_groups, pairs_within
from mathloom.llm.tables import read
from mathloom.storage import drop, materialize

FIELDS = ("original_text", "normalized_text")
#: Fields with fewer letters and digits are left out of the comparison.
MIN_CHARS = 20

# Cyrillic and Greek letters drawn like a Latin letter, each above its Latin letter.
_LIKE = "АВЕЅІЈКМНОРСТХаеоурсхѕіјһԁԛԝԚԜѵѴӏҺΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳͿνУҮϹϲ"
_LATIN = "ABESIJKMHOPCTXaeoypcxsijhdqwQWvVlhABEZHIKMNOPTYXojJvYYCc"
# Radicals of the supplement block and the ideographs they are forms of.
_RADICALS = "⺁⺂⺃⺄⺅⺆⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺳⺴⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲"
_IDEOGRAPHS = "厂乛乚乙亻冂𠘨刀刂卜㔾小小兀尣尢𡯂巳幺彑彐忄心扌攵旡日月歺民氵氺灬爫爫丬牛犭王𤴔目示礻竹糹纟罓罒㓁冗𦉫羊𦍌𦍋耂肀聿肉𦥑艹艹艹虎衤覀西见角𧢲讠贝𧾷车辶辶辶阝钅長镸长门𨸏阝雨青韦页风飞食𩙿飠饣𩠐马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"


def _single(c: str) -> str | None:
    """What one character becomes on its own; None if it stays."""
    kind = unicodedata.category(c)
    o = ord(c)
    if kind == "Cf" or 0xFE00 <= o <= 0xFE0F or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xE0100 <= o <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " " if c != " " else None
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>")) or 0x2F00 <= o <= 0x2FD5 or o in (0x2E9F, 0x2EF3):
        return unicodedata.normalize("NFKC", c)
    if how and not how.startswith("<"):
        composed = unicodedata.normalize("NFC", c)
        return composed if composed != c else None
    return None


@functools.cache
def table() -> dict[str, str]:
    """Single characters and what they become. Raises if a rule and a list disagree or if an output
    holds a character that is itself rewritten."""
    made: dict[str, str] = {}
    for src, dst in [*zip(_LIKE, _LATIN, strict=True), *zip(_RADICALS, _IDEOGRAPHS, strict=True)]:
        if made.setdefault(src, dst) != dst:
            raise ValueError(f"two outputs for U+{ord(src):04X}")
    for o in range(0x80, 0x110000):
        if not 0xD800 <= o <= 0xDFFF and (to := _single(chr(o))) is not None:
            if made.setdefault(chr(o), to) != to:
                raise ValueError(f"two outputs for U+{o:04X}")
    for c in map(chr, range(0x80, 0x110000)):
        if c not in made and unicodedata.decomposition(c)[:1] not in ("", "<"):
            apart = unicodedata.normalize("NFD", c)
            if (to := unicodedata.normalize("NFC", "".join(made.get(x, x) for x in apart))) != c:
                made[c] = to  # an accented letter follows its base
    for src, dst in made.items():
        if any(c in made for c in dst):
            made[src] = "".join(made.get(c, c) for c in dst)
    if any(c in made for dst in made.values() for c in dst):
        raise ValueError("an output is rewritten again")
    return made


def _chars(found: set[str]) -> str:
    """A character class of single characters, neighbours joined to ranges."""
    o = np.array(sorted(map(ord, found)))
    cuts = np.flatnonzero(np.diff(o) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(np.concatenate([o[:1], o[cuts + 1]]), np.concatenate([o[cuts], o[-1:]])))


@functools.cache
def transducer() -> Callable[[str], str]:
    """The compiled rewriting of a text. ASCII and empty texts stay as they are."""
    single = table()
    combining = {chr(o) for o in range(0x300, 0x20000) if unicodedata.combining(chr(o))}
    apart = (unicodedata.normalize("NFD", chr(o)) for o in range(0x80, 0x20000))
    marks = _chars(combining | {x for t in apart for x in t[1:]})  # also vowel signs and Hangul letters that compose with what precedes
    gone = _chars({c for c, to in single.items() if to == ""})
    rewritten = _chars(set(single))
    match = re.compile(f"[^{marks}{gone}](?=[{gone}]*[{marks}])(?:[{gone}]*[{marks}])+|[{rewritten}]", re.S)
    known: dict[str, str] = {}

    def cluster(m: re.Match) -> str:
        c = m.group()
        if (to := single.get(c)) is None and (to := known.get(c)) is None:
            to = unicodedata.normalize("NFC", "".join(single.get(x, x) for x in c))
            if len(known) < 100_000:
                known[c] = to
        return to

    any_mark = re.compile(f"[{marks}]")
    one = re.compile(f"[{rewritten}]")

    def run(text: str) -> str:
        if text.isascii():
            return text
        return match.sub(cluster, text) if any_mark.search(text) else one.sub(lambda m: single[m.group()], text)

    return run


def consistent(text: str | None) -> str | None:
    """One form of a text for all spellings that look like it; null stays null."""
    return None if text is None else transducer()(text)


def consistent_texts(items: DataFrame) -> DataFrame:
    """(pos, original_text, normalized_text) in consistent characters. Nulls stay null, empty texts
    empty; rows are neither dropped nor joined; extra columns are not carried on."""

    def run(batches):
        f = transducer()
        for b in batches:
            cols = [pa.array([None if t is None else f(t) for t in b.column(k).to_pylist()], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["pos", *FIELDS])

    return items.select("pos", *FIELDS).mapInArrow(run, "pos long, original_text string, normalized_text string")


def spelling_hashes(items: DataFrame) -> DataFrame:
    """(pos, field, s1, s2, raw): 128-bit hash of the consistent form and 64-bit hash of the characters
    as they are, of every field with enough letters and digits."""

    def run(batches):
        f = transducer()
        for b in batches:
            pos = b.column(0).to_numpy(zero_copy_only=False)
            for k, field in enumerate(FIELDS):
                texts = b.column(k + 1).to_pylist()
                at, shown, raw = [], [], []
                for i, t in enumerate(texts):
                    if t and len(t) >= MIN_CHARS and _enough(s := f(t)):
                        at.append(i)
                        shown.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
                        raw.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")))
                s = np.frombuffer(b"".join(shown), np.int64).reshape(-1, 2)
                cols = [pa.array(pos[at], pa.int64()), pa.array([field] * len(at), pa.string()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(raw, np.uint64).view(np.int64))], ["pos", "field", "s1", "s2", "raw"])

    return items.where("pos is not null").select("pos", *FIELDS).mapInArrow(run, "pos long, field string, s1 long, s2 long, raw long")



def _enough(text: str) -> bool:
    """Has the text MIN_CHARS letters and digits?"""
    n = 0
    for c in text:
        if c.isalnum() or unicodedata.category(c)[0] in "LN":
            n += 1
            if n == MIN_CHARS:
                return True
    return False


def same_looking(items: DataFrame) -> DataFrame:
    """(field, pos_a, pos_b) of rows whose field has the same consistent form but other characters.

    Null, empty and short fields are left out, equal spellings are never paired, rows without pos
    are left out. Rows first collapse to spellings, so that only forms with several spellings are
    joined; rows come back in the end.
    """
    form = ["field", "s1", "s2"]
    rows = materialize(spelling_hashes(items), "spellings")
    spelt = rows.groupBy(*form).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(join_to_groups(rows, spelt.select(*form, "n"), form, "n", rows.count()), "mixed")
    drop(rows)
    kinds = mixed.select(*form, "raw").distinct()
    met = pairs_within(kinds, form, "raw", mixed.count(), None, [*form, "raw"])
    pairs = met.select(*(F.col(f"x_{c}").alias(c) for c in form), F.col("x_raw").alias("raw_a"), F.col("y_raw").alias("raw_b"))
    a = mixed.select(*form, F.col("raw").alias("raw_a"), F.col("pos").alias("p"))
    b = mixed.select(*form, F.col("raw").alias("raw_b"), F.col("pos").alias("q"))
    both = pairs.join(a, [*form, "raw_a"]).join(b, [*form, "raw_b"])
    return both.select("field", F.least("p", "q").alias("pos_a"), F.greatest("p", "q").alias("pos_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(read(spark, sf_dir, "items"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_texts(read(spark, sf_dir, "items"))


QUERIES = {"p6_found": p6_found, "p6_consistent": p6_consistent}
ORACLE: dict[str, str] = {}
