"""Formulas inside question texts: spans, templates and masks.

Finding spans needs balanced braces and merging of intervals, so it runs in one Arrow UDF per text;
what comes out are columns, computed once a row and stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mathloom.functions import plain

# Patterns that formulas are recognised by.
_HEAD = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z][A-Za-z0-9]*\s*\([^)]{0,48}\)|[A-Za-z][A-Za-z0-9]*)\s*[=＝]\s*")
_STOP = re.compile(r"[，。；;？?\n]|(\s+(?:for|when|if|then|where|Find|find|have|does)\b)|(?=[的时求则])")
_BARS = r"(?:\|[^|]{1,48}\||\[[^\[\]]{1,48}\])"
_BAR_EQUATION = re.compile(rf"{_BARS}\s*[=＝]\s*{_BARS}")
_BRACKET = re.compile(r"(?<!\\)\[([^\[\]]{1,48})\]")
_COMMAND = re.compile(r"\\(?:d?frac|tfrac|sqrt|sum|int|log|ln|sin|cos|tan|lim|times|cdot)")
_KEPT_COMMAND = re.compile(r"\\(?:frac|sqrt|sum|int|log|ln|sin|cos|tan|lim|times|cdot)")
_WORD = re.compile(r"\b(?:sin|cos|tan|log|ln|sqrt)\b", re.I)
_DELIMITED = re.compile(r"\$\$(?:.*?)\$\$|\$[^$]*\$", re.S)
_DISPLAY = re.compile(r"\\\[.*?\\\]", re.S)
_ENVIRONMENT = re.compile(r"\\begin\{([A-Za-z*]+)\}")
_DRAWING = re.compile(r"\[asy\].*?\[/asy\]", re.I | re.S)
_FREE_LENGTH = 96
_COVERED = 0.8
_PLACEHOLDER = " EQ "


def without_drawing(text: str | None) -> str:
    return _DRAWING.sub("\n", text or "").strip()


def repaired(text: str) -> str:
    """Dashes become minus signs, brackets that stand for bars become bars; no position moves."""
    text = text.translate({ord("−"): "-", ord("–"): "-", ord("‐"): "-"})
    bars = re.compile(r"[A-Za-z].*\d|\d.*[A-Za-z]|[+\-]")
    return _BRACKET.sub(lambda m: f"|{m[1]}|" if bars.search(m[1]) else m[0], text)


def repaired_text(c: Column) -> Column:
    """:func:`repaired` as a column expression."""
    inner = r"[^\[\]\n]*"
    bars = rf"\[[^\[\]]*?(?:[A-Za-z]{inner}\p{{Nd}}|\p{{Nd}}{inner}[A-Za-z]|[+\-])"
    return F.regexp_replace(F.translate(c, "−–‐", "---"), rf"(?<!\\)(?={bars})\[([^\[\]]{{1,48}})\]", "|$1|")


def _group_end(text: str, at: int) -> int:
    """Position after the balanced group in braces that begins at ``at``; -1 if it never closes."""
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return -1


_BLANKS = re.compile(r"\s*")


def _command_end(text: str, at: int) -> int:
    """Position after the arguments of a command: an option in brackets and up to two groups."""
    skip = lambda i: _BLANKS.match(text, i).end()
    at = skip(at)
    if text[at : at + 1] == "[":
        close = text.find("]", at + 1)
        if close < 0:
            return at
        at = skip(close + 1)
    for _ in range(2):
        end = _group_end(text, at) if text[at : at + 1] == "{" else -1
        if end < 0:
            break
        at = skip(end)
    return at


def _delimited(text: str) -> Iterator[tuple[int, int]]:
    """Dollar formulas from the left; an opening sign without its counterpart ends the search."""
    at = text.find("$")
    while at >= 0:
        m = _DELIMITED.match(text, at)
        if not m or (text.startswith("$$", at) and not m[0].startswith("$$")) or (text.startswith("$$", at) and len(m[0]) < 4):
            return
        yield m.span()
        at = text.find("$", m.end())


def _raw_spans(text: str) -> Iterator[tuple[int, int]]:
    yield from _delimited(text)
    yield from (m.span() for m in _DISPLAY.finditer(text))
    for m in _ENVIRONMENT.finditer(text):
        closing = f"\\end{{{m[1]}}}"
        end = text.find(closing, m.end())
        if end >= 0:
            yield m.start(), end + len(closing)
    for m in _COMMAND.finditer(text):
        end = _command_end(text, m.end())
        if end > m.end():
            yield m.start(), end
    yield from (m.span() for m in _BAR_EQUATION.finditer(text))
    for m in _HEAD.finditer(text):
        stop = _STOP.search(text[m.end() :])
        end = m.end() + stop.start() if stop else min(len(text), m.end() + _FREE_LENGTH)
        if end - m.start() >= 3:
            yield m.start(), end


def _joined(spans: list[tuple[int, int]], text: str) -> list[list[int]]:
    """Spans that overlap, touch, or have only light punctuation between them become one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and (lo <= out[-1][1] + 1 or re.fullmatch(r"[\s,;:]+", text[out[-1][1] : lo])):
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _rows(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The rows of an aligned block, or the span itself."""
    if "\\begin{align" not in text[lo:hi]:
        yield lo, hi
        return
    found = False
    at = lo
    for cut in [m.start() + lo for m in re.finditer(r"\\\\", text[lo:hi])] + [hi]:
        if text[at:cut].strip():
            found = True
            yield at, cut
        at = cut + 2
    if not found:
        yield lo, hi


def _is_formula(s: str) -> bool:
    if len("".join(s.strip().strip("$").split())) < 3:
        return False
    return bool(_KEPT_COMMAND.search(s) or "=" in s or "＝" in s or (_WORD.search(s) and re.search(r"[()^_]", s)))


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, formula) of the formulas of a text."""
    if not text:
        return []
    t = repaired(text)
    out = []
    for lo, hi in _joined(list(_raw_spans(t)), t):
        for a, b in _rows(t, lo, hi):
            s = t[a:b].strip()
            if _is_formula(s):
                s = s.strip("$ ").strip(" ;,.")
                if len("".join(s.split())) >= 3:
                    out.append((a, b, s))
    return out


def formulas(text: str | None) -> list[str]:
    """Distinct normalised formulas in order."""
    return list(dict.fromkeys(f for _, _, s in spans(text) if len(f := plain.normalize(s)) >= 3))


def _template(formula: str) -> str:
    return plain.structure(plain.normalize(formula))


def template_blob(text: str | None, equation: str | None = None) -> str | None:
    """Distinct templates of the formulas, joined by blanks; null if there are none."""
    found = [_template(f) for f in formulas(without_drawing(text))]
    if equation:
        found.append(_template(equation.strip(" ;,.")))
    return " ".join(dict.fromkeys(t for t in found if t)) or None


def atoms(text: str | None) -> list[str]:
    """Distinct templates, one for each formula or row of an aligned block."""
    return list(dict.fromkeys(t for _, _, s in spans(without_drawing(text)) if (t := _template(s))))


def masked(text: str | None) -> str:
    """The text with EQ in the place of formulas, unless they make up most of it."""
    t = without_drawing(text)
    found = spans(t)
    if not found or sum(b - a for a, b, _ in found) >= _COVERED * len(t.strip()):
        return t
    parts, at = [], 0
    for a, b, _ in found:
        parts += [t[at:a], _PLACEHOLDER]
        at = b
    return " ".join("".join([*parts, t[at:]]).split())


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("snippet", StringType())])
_FEATURES = StructType(
    [StructField("spans", ArrayType(_SPAN)), StructField("blob", StringType()), StructField("atoms", ArrayType(StringType())), StructField("masked", StringType())]
)


@F.pandas_udf(_FEATURES)
def formula_features(text: pd.Series) -> pd.DataFrame:
    """All formula columns of a text in one pass: spans, template blob, atom templates and the
    normalised text with its formulas masked."""
    rows = [
        ([{"start": a, "end": b, "snippet": s} for a, b, s in spans(t)], template_blob(t), atoms(t), plain.normalize(masked(t))) for t in text
    ]
    return pd.DataFrame(rows, columns=["spans", "blob", "atoms", "masked"])


def compatible(query: str | None, item: str | None, threshold: float, contained: int = 12, lost: float = 0.80) -> bool:
    """Do two template blobs describe the same formulas? Both without a formula agree, one alone does not."""
    if bool(query) != bool(item):
        return False
    return not query or any(test(query, item) for test in (_same_templates, _within(contained), _alike(threshold), _lost_bar(lost)))


def _same_templates(query: str, item: str) -> bool:
    return set(query.split()) == set(item.split())


def _within(least: int):
    """Is the shorter blob, of at least so many signs, a part of the longer one?"""

    def test(query: str, item: str) -> bool:
        q, i = "".join(query.split(" ")), "".join(item.split(" "))
        return min(len(q), len(i)) >= least and (q in i or i in q)

    return test


def _alike(threshold: float):
    return lambda query, item: plain.likeness(query, item) >= threshold


_RATIO = re.compile(r"\(([^()/]+)/([^()]+)\)")


def _lost_bar(threshold: float):
    """Has the reader lost the fraction bar: is the right side of the query the denominator of the item's?"""

    def test(query: str, item: str) -> bool:
        side, ratio = query.split("=", 1)[-1], _RATIO.search(item.split("=", 1)[-1])
        return ratio is not None and "/" not in side and plain.likeness(side, ratio[2]) >= threshold

    return test
