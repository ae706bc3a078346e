"""Question texts for the page: bodies for a LaTeX page, plain text for one without formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathloom.functions import text as T

# What LaTeX becomes in plain text, in this order; patterns first, then signs, then what is left over.
STRUCTURES = [
    (r"\r\n?", "\n"), (r"\\(?:begin|end)\{(?:cases|align\*?)\}|\\begin\{array\}(?:\{[^}]*\})?|\\end\{array\}", "\n"), (r"\\\\", "\n"), ("&", " "),
    (r"\\(?:text|mathrm)\{([^}]*)\}", r"\1"), *[(r"\\[dt]?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"(\1)/(\2)")] * 4, (r"\\sqrt\s*\{([^{}]+)\}", r"sqrt(\1)"),
    (r"\\left|\\right", ""), (r"\\\[|\\\]", " "),
]
SIGNS = [
    (r"\leq", "<="), (r"\geq", ">="), (r"\le", "<="), (r"\ge", ">="), (r"\neq", "!="), (r"\cdots", "..."), (r"\dotsb", "..."), (r"\ldots", "..."), (r"^\circ", " degrees"),
    (r"\circ", " o "),
]
NAMES = [(r"\\log_\{([^}]+)\}", r"log_\1"), (r"\\(log|ln|sin|cos|tan)", r"\1"), (r"([\^_])\{([^{}]+)\}", r"\1\2"), (r"\\[a-zA-Z]+\*?", " "), (r"[${}\[\]]", ""), (r"\\", " ")]
# A command with its option and arguments.
MACRO = r"\\[a-zA-Z]+(?:\s*\[[^\]]*\])?(?:\s*\{[^{}]*\})*"


def java(replacement: str) -> str:
    """Group references in the notation of Java."""
    return replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2")


def latex_to_plain(c: Column) -> Column:
    """Readable text without LaTeX: fractions as quotients, signs in ASCII, one blank between words, no empty line."""
    c = reduce(lambda x, r: F.regexp_replace(x, r[0], java(r[1])), STRUCTURES, F.coalesce(c, F.lit("")))
    c = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), SIGNS, c)
    c = reduce(lambda x, r: F.regexp_replace(x, r[0], java(r[1])), NAMES, c)
    lines = F.transform(F.split(c, "\n"), T.one_spaced)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_drawings(c: Column) -> Column:
    """The text without drawing code and with at most one empty line in a row."""
    return T.trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)\[asy\].*?\[/asy\]", "\n"), "\n{3,}", "\n\n"))


def page_body(text: Column, source: Column) -> Column:
    """The body of a LaTeX page: drawing code removed, $$ as brackets, percent signs escaped. Stems of geometry3k
    write commands outside of formulas; where a text has no formula at all each of them becomes one."""
    body = F.regexp_replace(without_drawings(text), r"(?s)\$\$(.+?)\$\$", r"\\[$1\\]")
    body = F.regexp_replace(body, r"(?<!\\)%", r"\\%")
    bare = (source == "geometry3k") & ~F.contains(body, F.lit("$")) & ~F.contains(body, F.lit(r"\["))
    return F.when(F.coalesce(bare, F.lit(False)), F.regexp_replace(body, f"({MACRO})", r"\$$1\$")).otherwise(body)


def has_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[一-鿿]")


def shown_text(text: Column, source: Column, item_id: Column) -> Column:
    """What a page without formulas shows: plain text for math and for texts in LaTeX without Chinese, else the text
    as it is; the id where there is none."""
    raw = F.coalesce(F.nullif(T.trimmed(text), F.lit("")), item_id)
    latex = (source == "math") | (~has_cjk(raw) & (F.contains(raw, F.lit("\\")) | F.contains(raw, F.lit("$"))))
    return F.when(F.coalesce(latex, F.lit(False)), F.coalesce(F.nullif(latex_to_plain(raw), F.lit("")), raw)).otherwise(raw)


def competition_id(stem: Column, place: Column) -> Column:
    """math-split-subject-place from the name of a file subject_split."""
    return F.concat_ws("-", F.lit("math"), F.substring_index(stem, "_", -1), F.replace(F.regexp_replace(stem, "_[^_]*$", ""), F.lit("_"), F.lit("-")), place.cast("string"))
