"""Canonical text of questions as column expressions.

Only NFKC has no built-in counterpart and runs as one Arrow UDF; everything else stays in the JVM.
``(?U)`` gives the regular expressions Unicode classes.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Punctuation and what it becomes, each above its counterpart.
PUNCT_FROM = "，。；：？！（）【】「」『』、．—～“”‘’　×÷＊＝−–‐"
PUNCT_TO = ",.;:?!()[]\"\"\"\",.-~\"\"'' */*=---"
# LaTeX symbols in the order in which they are replaced.
SYMBOLS = [
    (r"\leq", "<="), (r"\geq", ">="), (r"\le", "<="), (r"\ge", ">="), (r"\neq", "!="), (r"\cdots", "..."), (r"\dotsb", "..."),
    (r"\ldots", "..."), (r"^\circ", "degrees"), (r"\circ", "o"), (r"\sin", "sin"), (r"\cos", "cos"), (r"\tan", "tan"),
    (r"\log", "log"), (r"\ln", "ln"),
]
# Words with numerals that name a kind of problem and are no quantities; the first match wins.
TYPE_WORDS = (
    "一次函数|二次函数|三次函数|一次式|二次式|一元一次方程|一元二次方程|二元一次方程组|二元一次方程|"
    r"[一二三四五六七八九]年级|[两一二三四五六七八九十]位数|(?U:第[一二三四五六七八九十零〇\d]+[天步次条项问])"
)
# Forms of a quantity, masked in this order.
QUANTITIES = [
    r"(?U)\d+\(\s*\d+\s*/\s*\d+\s*\)", r"(?U)\(\s*\d+\s*/\s*\d+\s*\)", r"(?U)\d+\s*/\s*\d+", r"(?U)\d+(?:\.\d+)?%", r"(?U)\d+\.\d+", r"(?U)\d+",
]


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _unwrap(c: Column) -> Column:
    """One pass of fractions, roots, environments and commands with one argument."""
    c = F.regexp_replace(c, r"(?U)\\[dt]?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "($1/$2)")
    c = F.regexp_replace(c, r"(?U)\\sqrt\s*\{([^{}]+)\}", "sqrt($1)")
    c = F.regexp_replace(c, r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", " ")
    return F.regexp_replace(c, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")


def strip_latex(c: Column) -> Column:
    """LaTeX to plain signs. Passes go on until nothing changes: each takes a command, so their number is bounded by the backslashes."""
    commands = F.length(c) - F.length(F.replace(c, F.lit("\\"), F.lit("")))
    c = F.when(commands == 0, c).otherwise(F.aggregate(F.sequence(F.lit(1), commands + 1), c, lambda acc, _: _unwrap(acc)))
    c = F.regexp_replace(c, r"\\(left|right)\.?", "")
    for src, dst in SYMBOLS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?", "")
    c = F.translate(c, "$", "")
    return F.translate(F.replace(F.replace(c, F.lit(r"\["), F.lit(" ")), F.lit(r"\]"), F.lit(" ")), "&{}\\", " ")


def normalize(c: Column, nfkc: bool = True) -> Column:
    """Normalised text; null gives the empty text. Without ``nfkc`` no Python worker is needed, for texts
    known to be in that form."""
    c = F.coalesce(c, F.lit(""))
    c = F.translate(_nfkc(c) if nfkc else c, PUNCT_FROM, PUNCT_TO)
    return F.regexp_replace(strip_latex(c), r"(?U)\s+", "")


def _mask(c: Column) -> Column:
    for p in QUANTITIES:
        c = F.regexp_replace(c, p, "NUM")
    return F.regexp_replace(c, "(?:NUM)+", "NUM")


def structure(normalized: Column) -> Column:
    """Normalised text with its quantities masked; words that name a kind of problem stay."""
    words = F.regexp_extract_all(normalized, F.lit(f"({TYPE_WORDS})"), F.lit(1))
    parts = F.split(normalized, TYPE_WORDS)
    plain = F.array_join(F.transform(parts, lambda p, i: F.concat(_mask(p), F.coalesce(F.get(words, i), F.lit("")))), "")
    return F.when(F.size(words) == 0, _mask(normalized)).otherwise(plain)


def with_template(df: DataFrame, equation: Column, name: str) -> DataFrame:
    """Adds the structure of an equation, null if there is none. A Python UDF may not stand inside the
    lambda functions of :func:`structure`, so its result is a column of its own first."""
    made = df.withColumn("_normal", normalize(equation))
    return made.withColumn(name, F.nullif(structure(F.col("_normal")), F.lit(""))).drop("_normal")


def quantities(normalized: Column) -> Column:
    """array<struct<kind, val>> of the quantities in order: kind is n or pct; digits of other scripts than
    full-width ones, which NFKC leaves, give a null value."""
    found = F.regexp_extract_all(normalized, F.lit(r"(?U)(\d+(?:\.\d+)?%?)"), F.lit(1))
    return F.transform(
        found,
        lambda x: F.struct(F.when(x.endswith("%"), "pct").otherwise("n").alias("kind"), F.round(F.translate(x, "０１２３４５６７８９%", "0123456789").try_cast("double"), 6).alias("val")),
    )


def variant_group(structure_text: Column) -> Column:
    return F.concat(F.lit("vg_"), F.substring(F.sha1(structure_text), 1, 16))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_spaced(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def without_cjk_spaces(c: Column) -> Column:
    return one_spaced(F.regexp_replace(c, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", ""))


def without_drawing(c: Column) -> Column:
    """The text without [asy] drawing code."""
    return trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)\[asy\].*?\[/asy\]", "\n"))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "x").otherwise(s)


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), F.lit(180))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams in order; a shorter text is its own gram, an empty one has none. The text is cut into
    characters once, so its length counts once."""
    chars = F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, n), ""))
    each = F.array_distinct(F.flatten(F.transform(F.array(chars), grams)))  # a lambda binds the characters, so they are cut once
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(each)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two gram arrays: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    ratio = common / (F.size(a) + F.size(b) - common)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio)
