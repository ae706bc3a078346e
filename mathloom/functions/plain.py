"""The text rules on single Python strings.

The Arrow UDFs that work on spans of formulas need them inside a worker; tests hold the column
expressions of :mod:`text` against them.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

from mathloom.functions import text as T

_PUNCT = str.maketrans(T.PUNCT_FROM, T.PUNCT_TO)
_UNWRAP = [
    (re.compile(r"\\[dt]?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"), r"(\1/\2)"),
    (re.compile(r"\\sqrt\s*\{([^{}]+)\}"), r"sqrt(\1)"),
    (re.compile(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?"), " "),
    (re.compile(r"\\[a-zA-Z]+\*?\{([^{}]*)\}"), r"\1"),
]
_TYPE_WORDS = re.compile(T.TYPE_WORDS.replace("(?U:", "(?:"))
_QUANTITIES = [re.compile(p.removeprefix("(?U)")) for p in T.QUANTITIES]


def normalize(text: str | None) -> str:
    t = unicodedata.normalize("NFKC", text or "").translate(_PUNCT)
    if "\\" in t:
        done = False
        while not done:
            was = t
            for p, to in _UNWRAP:
                t = p.sub(to, t)
            done = t == was
    t = re.sub(r"\\(left|right)\.?", "", t)
    for src, dst in T.SYMBOLS:
        t = t.replace(src, dst)
    t = re.sub(r"\\[a-zA-Z]+\*?", "", t).replace("$", "").replace(r"\[", " ").replace(r"\]", " ")
    return "".join(t.translate({ord("&"): " ", ord("{"): None, ord("}"): None, ord("\\"): None}).split())


def _mask(t: str) -> str:
    for p in _QUANTITIES:
        t = p.sub("NUM", t)
    return re.sub("(?:NUM)+", "NUM", t)


def structure(normalized: str) -> str:
    out, at = [], 0
    for m in _TYPE_WORDS.finditer(normalized):
        out += [_mask(normalized[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, _mask(normalized[at:])])


def quantities(normalized: str) -> list[tuple[str, float]]:
    found = re.findall(r"\d+(?:\.\d+)?%?", normalized)
    return [("pct" if q.endswith("%") else "n", round(float(q.rstrip("%")), 6)) for q in found]


def grams(t: str, n: int = 3) -> set[str]:
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()


#: Gram sets of the texts that a worker has seen last: a query meets many items.
_grams = functools.lru_cache(4096)(lambda t: frozenset(grams(t)))


def jaccard(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0


def ratio(a: str, b: str) -> float:
    """Matching-blocks ratio of the standard library; the order of the texts matters."""
    return 1.0 if not a and not b else difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def surface(a: str, b: str) -> float:
    return 0.6 * ratio(a, b) + 0.4 * jaccard(a, b)


def likeness(a: str, b: str) -> float:
    """Similarity of two structures."""
    return 0.5 * ratio(a, b) + 0.5 * jaccard(a, b)


_NUMBER = re.compile(r"\d+(?:\.\d+)?%?")


# A percentage moves on by so much within a range and from a least value; other numbers grow by so much.
_PERCENT_STEP, _PERCENT_RANGE, _PERCENT_LEAST, _DECIMAL_STEP, _WHOLE_STEP = 17, 90, 5, 1.7, 13


def _next_number(m: re.Match) -> str:
    number, percent = m.group().removesuffix("%"), m.group().endswith("%")
    if "." not in number and not percent:
        return str(int(number) + _WHOLE_STEP)
    value = (float(number) + _PERCENT_STEP) % _PERCENT_RANGE + _PERCENT_LEAST if percent else float(number) + _DECIMAL_STEP
    return (f"{value:.1f}" if "." in number else str(int(value))) + "%" * percent


def with_other_numbers(text: str | None) -> str | None:
    """The text with every number changed by a fixed rule; null if it has none."""
    changed = _NUMBER.sub(_next_number, text or "")
    return changed if changed != (text or "") else None


def boxed_answer(solution: str | None) -> str | None:
    """Content of the last boxed answer: a balanced group in braces or the next word."""
    at = (solution or "").rfind("\\boxed")
    if at < 0:
        return None
    rest = solution[at + len("\\boxed") :].lstrip()
    if not rest.startswith("{"):
        word = rest.split(maxsplit=1)
        return word[0] if word else None
    depth = 0
    for i, c in enumerate(rest):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return rest[1:i].strip() or None
    return None
