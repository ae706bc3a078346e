"""Problem 4: texts with left-over HTML, Markdown, wiki or LaTeX markup.

The named method, a suffix array over the documents of a host, finds passages that repeat across
documents; it cannot tell markup from text or keep headings and lists (README has figures). A lexer does
this instead: formulas and code are set aside, markup constructs are recognised and rewritten to plain text
with one block a line, then formulas and code come back unchanged.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm.glyphs import consistent
from mathloom.llm.tables import read

FIELDS = ("original_text", "normalized_text")

# Names that are read as HTML tags, as mathematical environments and as text commands.
_TAGS = (
    "a abbr address article aside b big blockquote body br caption center cite code col dd del div dl dt em figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main math meta nav ol option p pre q ref s script section "
    "select small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video wbr"
)
_MATH_ENV = (
    "align alignat aligned alignedat array bmatrix Bmatrix cases displaymath eqnarray equation flalign gather gathered math matrix "
    "multline pmatrix smallmatrix split subequations vmatrix Vmatrix"
)
_TEXT_COMMANDS = (
    "author bf bigskip caption centering chapter cite clearpage date emph footnote footnotesize hfill href hline hspace huge "
    "includegraphics indent it item label large maketitle medskip newline newpage noindent paragraph par pagebreak ref section "
    "setlength small smallskip subsection subsubsection textbf textit textmd textrm textsc textsf textsl texttt textup tiny title "
    "underline url usepackage verb vfill vspace documentclass"
)

_ENV = "|".join(_MATH_ENV.split())
FORMULA = re.compile(
    rf"\\begin\{{(?P<e>(?:{_ENV})\*?)\}}.*?\\end\{{(?P=e)\}}|\$\$.+?\$\$|(?<!\\)\$[^$]+?(?<!\\)\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S
)
_NAMES = "|".join(sorted(_TAGS.split(), key=len, reverse=True))
_TAG = rf"</?(?P<tag>{_NAMES})(?:\s[^<>]*|[a-z-]+\s*=[^<>]*)?\s*/?>"
_ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_BOLD = r"\*\*(?=[^\s*])(?P<bold>[^*]*(?:\*(?!\*)[^*]*|\*\*(?=\d)[^*]*)*?)(?<=[^\s*])\*\*"
_CONSTRUCTS = {
    "html": [r"<!--.*?-->", _TAG, _ENTITY],
    "markdown": [
        r"```", r"`[^`\n]+`", r"(?m:^[ ]{0,3}\#{1,6}[ \t]+\S)", r"(?m:^[ ]{0,3}>[ \t]+\S)", r"(?m:^[ \t]*[-*+][ \t]+\S)",
        r"!?\[[^\[\]\n]*\]\([^()\s]*[./\#][^()\s]*\)", r"~~(?=[^\s~])[^~\n]+~~", r"(?<!_)__(?=[^\s_])[^_\n]*(?:_[^_\n]+)*?(?<=[^\s_])__(?!_)",
        r"(?<![\w*)])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*(])", r"(?m:^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*$)",
    ],
    "wiki": [
        r"'{2,5}(?=[^'])[^'\n]+(?:'[^'\n]+)*?'{2,5}", r"(?m:^={2,6}[^=\n]+={2,6}[ \t]*$)", r"\[\[[^\[\]\d][^\[\]]*\]\]",
        r"\{\{[A-Za-z\u4e00-\u9fff#][^{}]*\}\}", r"\{\|", r"(?m:^\|[-}])",
    ],
}


@functools.cache
def _patterns() -> tuple[re.Pattern, dict[str, re.Pattern], dict[str, re.Pattern]]:
    kinds = {k: re.compile("|".join(f"(?:{p})" for p in ps), re.S | re.I if k == "html" else re.S) for k, ps in _CONSTRUCTS.items()}
    latex = {
        "normalized_text": re.compile(r"\\[A-Za-z]+"),
        "original_text": re.compile(rf"\\(?:{'|'.join(_TEXT_COMMANDS.split())})(?![A-Za-z])|\\(?:begin|end)\{{(?!(?:{_ENV})\*?\}})"),
    }
    return re.compile(r"[<&*`#>\-+~_'=\[{|\\]"), kinds, latex


_ANY_MATH = re.compile(r"\$|\\[(\[)\]]|\\begin")
_BARE = re.compile(r"\\[A-Za-z]{2,}")
_STARS = re.compile(r"\*\*")


def _is_bold(text: str) -> bool:
    """Are there two ** that enclose text, at least one of which is no power sign?"""
    at = [m.start() for m in _STARS.finditer(text)]
    if len(at) < 2:
        return False
    power = [0 < i and (text[i - 1].isalnum() or text[i - 1] in ")]}") and text[i - 1].isascii() and i + 2 < len(text) and (text[i + 2].isdigit() or text[i + 2] in "({-") for i in at]
    return not all(power)


def markup_kinds(text: str | None, field: str) -> list[str]:
    """Kinds of markup in a field, of html, latex, markdown and wiki; empty for null and plain texts.

    Formulas of original_text are content; in normalized_text any LaTeX command is markup.
    """
    trigger = _patterns()[0]
    if not text or not trigger.search(text):
        return []
    return _kinds(text if text.isascii() else consistent(text), field)


def _kinds(text: str, field: str) -> list[str]:
    _, kinds, latex = _patterns()
    bare = FORMULA.sub(" \ufffc ", text) if field == "original_text" and _ANY_MATH.search(text) else text
    found = [k for k, p in kinds.items() if p.search(bare)]
    if "markdown" not in found and "**" in bare and _is_bold(bare):
        found.append("markdown")
    if "\\" in bare and (latex[field].search(bare) or (field == "original_text" and _BARE.search(bare) and not _ANY_MATH.search(text))):
        found.append("latex")
    return sorted(found)


# Heading levels of LaTeX, commands that only set type or space, and the signs of commands.
_LEVELS = {"title": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_SILENT = (
    "left right big Big bigg Bigg bigl bigr Bigl Bigr middle displaystyle textstyle scriptstyle limits nolimits mathrm mathbf mathit mathsf mathtt mathcal mathbb "
    "mathfrak boldsymbol operatorname text mbox hbox textnormal overline widehat widetilde hat bar vec tilde dot ddot phantom boxed tag rm sf tt sl sc em "
    "normalsize Large LARGE Huge quad qquad " + _TEXT_COMMANDS
).split()
_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi pi rho sigma tau upsilon phi chi psi omega"
_SIGNS = {
    "times": "×", "div": "÷", "cdot": "·", "pm": "±", "mp": "∓", "ast": "*", "le": "≤", "leq": "≤", "leqslant": "≤", "ge": "≥", "geq": "≥", "geqslant": "≥", "ne": "≠", "neq": "≠",
    "lt": "<", "gt": ">", "approx": "≈", "equiv": "≡", "sim": "∼", "cong": "≅", "angle": "∠", "measuredangle": "∡", "triangle": "△", "circ": "°", "degree": "°", "perp": "⊥",
    "parallel": "∥", "odot": "⊙", "infty": "∞", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩", "emptyset": "∅", "therefore": "∴", "because": "∵",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftrightarrow": "⇔", "ldots": "...", "cdots": "...", "dots": "...", "sum": "∑", "prod": "∏", "int": "∫",
    "sqrt": "√", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "mid": "|", "prime": "′", "backslash": "", "partial": "∂", "forall": "∀", "exists": "∃", "bmod": "mod",
    **{w: unicodedata.lookup(f"GREEK SMALL LETTER {w.upper()}") for w in _GREEK.split()},
    **{w.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {w.upper()}") for w in _GREEK.split()},
    "varphi": "φ", "varepsilon": "ε", "lambda": "λ", "Lambda": "Λ", **dict.fromkeys(_SILENT, ""),
    **{w: w for w in "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln lg exp lim max min gcd lcm det dim arg mod sup inf deg ker".split()},
}
_PREFIXES = re.compile("|".join(sorted(_SIGNS, key=len, reverse=True)))
_INLINE = [
    (re.compile(r"\\(?:text\w\w|emph|underline|href\{[^{}]*\}|url|caption)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\{\\(?:bf|it|rm|sf|tt|sl|sc|em|tiny|small|footnotesize|large|huge)(?![A-Za-z])\s*([^{}]*)\}"), r"\1"),
    (re.compile(r"\\footnote(?:\[[^\]]*\])?\{([^{}]*)\}"), lambda m: f" ({m[1].strip()})" if m[1].strip() else ""),
]
_TEXT_LEFT = [
    (re.compile(rf"\\(?:{'|'.join(_TEXT_COMMANDS.split())})(?![A-Za-z])\*?(?:\[[^\]]*\])?\{{([^{{}}]*)\}}"), r"\1"),
    (re.compile(rf"\\(?:{'|'.join(_TEXT_COMMANDS.split())})(?![A-Za-z])\*?[ \t]?"), ""),
]
_BARE_LEFT = [
    (re.compile(r"\\[dtc]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"), r"(\1/\2)"),
    (re.compile(r"\\[dtc]?frac\s*(\d)\s*(\d)"), r"(\1/\2)"),
    (re.compile(r"\\[dt]?binom\s*\{([^{}]*)\}\s*\{([^{}]*)\}"), r"C(\1,\2)"),
    (re.compile(r"\\sqrt\s*\[([^\[\]]*)\]\s*\{([^{}]*)\}"), r"√[\1](\2)"),
    (re.compile(r"\\sqrt\s*\{([^{}]*)\}"), r"√(\1)"),
    (re.compile(r"\\pmod\s*\{([^{}]*)\}"), r"(mod \1)"),
]
_WITH_ARGUMENT = re.compile(r"\\([A-Za-z]+)\*?\{([^{}]*)\}")
_WITH_ONE_ARGUMENT = re.compile(r"\\(?![dtc]?frac|[dt]?binom)([A-Za-z]+)\*?\{([^{}]*)\}")


def _all_of(subs: list[tuple[re.Pattern, object]], t: str) -> str:
    """The rules again and again until nothing changes, from the innermost braces."""
    was = None
    while was != t:
        was = t
        for p, to in subs:
            t = p.sub(to, t)
    return t


def _sign(name: str, cut: bool) -> str:
    """The sign of a command, an unknown one its name. ``cut``: blanks are gone and other letters may follow the name."""
    if name in _SIGNS or not cut:
        return _SIGNS.get(name, name)
    known = _PREFIXES.match(name)
    return _SIGNS[known.group()] + name[known.end() :] if known else name


def _without_commands(t: str, cut: bool) -> str:
    """Every command outside formulas by its sign, argument or name."""
    t = re.sub(r"\^\s*(?:\{\s*\\circ\s*\}|\\circ(?![A-Za-z]))", "°", t)
    by_name = lambda m: ("" if m[1] not in _SIGNS and not cut else _sign(m[1], cut)) + m[2]
    t = _all_of([*_BARE_LEFT, (_WITH_ONE_ARGUMENT, by_name)], t)  # what stands inside a fraction before the fraction
    t = _all_of([*_BARE_LEFT, (_WITH_ARGUMENT, by_name)], t)
    return re.sub(r"\\([A-Za-z]+)\*?" if cut else r"\\([A-Za-z]{2,})\*?", lambda m: _sign(m[1], cut), t)


def _item(depth: int) -> str:
    """The mark of a list item of a depth from 1."""
    return f"\u241f{min(9, max(1, depth))}"


_LISTS = re.compile(
    r"(?P<open><[uo]l\b[^<>]*>|\\begin\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?)|(?P<close></[uo]l\s*>|\\end\{(?:itemize|enumerate|description)\})"
    r"|(?P<item><li\b[^<>]*>|\\item\b\s*(?:\[[^\]]*\])?)", re.I,
)
_NUMBERED = re.compile(r"(?m)^([ \t]*)(?=\d{1,3}[.)][ \t]+\S)")
_NUMBER = re.compile(r"\d{1,3}[.)] ")
_WIKI_MATH = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>|\{\{math\|((?:[^{}]|\{[^{}]*\})*)\}\}", re.S | re.I)


def _with_depths(t: str) -> str:
    """Items of nested lists marked with their depth; numbered lines of lists of at least two keep their number."""
    depth = 0

    def mark(m: re.Match) -> str:
        nonlocal depth
        depth = max(0, depth + (m["open"] is not None) - (m["close"] is not None))
        return "\n" + (_item(depth) if m["item"] else "")

    t = _LISTS.sub(mark, t)
    many = len(_NUMBERED.findall(t)) > 1
    return _NUMBERED.sub(lambda m: _item(len(m[1].expandtabs(4)) // 2 + 1), t) if many else t


_SUBS: list[tuple[re.Pattern, object]] = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I), ""),
    (re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", re.S | re.I), lambda m: f"\n\u241e{m[1]}{m[2].strip()}\n"),
    (re.compile(r"</(?:td|th)\s*>\s*(?=<t[dh]\b)", re.I), "\t"),
    (re.compile(r"<img\b[^<>]*?\balt\s*=\s*\"([^\"]*)\"[^<>]*>", re.I), r"\1"),
    (re.compile(r"<ref\b[^<>]*/>", re.I), ""),
    (re.compile(r"<ref\b[^<>]*>(.*?)</ref\s*>", re.S | re.I), lambda m: f" ({m[1].strip()})" if m[1].strip() else ""),
    (re.compile(r"</?(?:br|p|div|ol|ul|table|tr|blockquote|hr|section|article|pre|li)\b[^<>]*>", re.I), "\n"),
    (re.compile(_TAG, re.I), ""),
    (re.compile(r"\\(title|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}"), lambda m: f"\n\u241e{_LEVELS[m[1]]}{m[2]}\n"),
    (re.compile(r"\\(?:label|cite|ref|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\setlength\{[^{}]*\}\{[^{}]*\}"), " "),
    (re.compile(r"\\(?:usepackage|documentclass|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), "\n"),
    (re.compile(r"\\(?:author|date)\{([^{}]*)\}"), r"\n\1\n"),
    (re.compile(r"\\begin\{(?:tabular|array)\*?\}(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), "\n"),
    (re.compile(r"\\(?:noindent|centering|par|newline|newpage|clearpage|pagebreak|indent|medskip|bigskip|smallskip|hfill|vfill|maketitle|hline)(?![A-Za-z])\s?|\\\\"), "\n"),
    (re.compile(r"(?m)^[ \t]*\{\|.*$|^[ \t]*\|[-}].*$|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*$"), ""),
    (re.compile(r"(?m)^(={2,6})[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$|^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t#]*$"), lambda m: f"\u241e{len(m[1] or m[3])}{m[2] or m[4]}"),
    (re.compile(r"(?m)^[ ]{0,3}>[ \t]+"), ""),
    (re.compile(r"(?m)^([ \t]*)([-+]|\*{1,6})[ \t]+(?=\S)"), lambda m: _item(len(m[1].expandtabs(4)) // 2 + len(m[2]))),
    (re.compile(r"(?m)^[ \t]*\|(.*?)\|?[ \t]*$"), lambda m: "\t".join(c.strip() for c in re.split(r"\|{1,2}", m[1]))),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*[./#][^()\s]*\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[A-Za-z\u4e00-\u9fff#][^{}]*\}\}"), ""),
    (re.compile(r"'{2,5}([^'\n]+(?:'[^'\n]+)*?)'{2,5}"), r"\1"),
    (re.compile(r"~~([^~\n]+)~~"), r"\1"),
    (re.compile(r"(?<!_)__(?=[^\s_])([^_\n]*(?:_[^_\n]+)*?)(?<=[^\s_])__(?!_)"), r"\1"),
    (re.compile(r"(?<![\w*)])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*(])"), r"\1"),
]
_CODE = re.compile(r"```[ \t]*\w*\n?(.*?)```|`([^`\n]+)`|<(pre|code)\b[^<>]*>(.*?)</\3\s*>", re.S | re.I)
_VERB = re.compile(r"\\verb\*?([^A-Za-z*\s{])(.*?)\1")
_HEADING, _ITEM, _HELD = "\u241e", "\u241f", re.compile("\ufff9(\\d+)\ufffa")


def clean_blocks(text: str | None, field: str = "original_text") -> list[tuple[str, str, int | None]] | None:
    """(kind, text, level) of each block: heading, item, code, formula or text; headings have a level and items a depth, from 1. Null gives null, an
    empty text no block; a text without markup is one block of text, unchanged."""
    if text is None:
        return None
    if not text.strip():
        return []
    if not markup_kinds(text, field):
        return [("text", text, None)]
    if not text.isascii() and _kinds(text, field) != _kinds(plain := consistent(text), field):
        text = plain  # its markup is only recognised in consistent characters
    held: list[tuple[str, str]] = []

    def hold(kind: str, s: str) -> str:
        held.append((kind, s))
        return f"\ufff9{len(held) - 1}\ufffa"

    def code(m: re.Match) -> str:
        block = m[1] if m[1] is not None else m[4] if (m[3] or "").lower() == "pre" else None
        return f"\n{hold('code', block.strip(chr(10)))}\n" if block is not None else hold("inline", m[2] or m[4] or "")

    def math(m: re.Match) -> str:
        body = (m[1] if m[1] is not None else m[2]).strip()
        return body if field == "normalized_text" else hold("formula", f"${body}$" if "\\" in body else body)

    t = _CODE.sub(code, re.sub("[\ufff9\ufffa\u241e\u241f]", "", text))
    bare = field == "normalized_text" or not _ANY_MATH.search(t)
    t = FORMULA.sub(lambda m: hold("formula", m.group()), t) if field == "original_text" else t
    t = _with_depths(_WIKI_MATH.sub(math, t))
    t = _all_of(_INLINE, _VERB.sub(lambda m: hold("inline", m[2]), t))
    for p, to in _SUBS:
        t = p.sub(to, t)
    if _is_bold(t):
        t = re.sub(r"\*\*(?!\d)|(?<![\w)])\*\*", "", t)
    t = _all_of(_TEXT_LEFT, t)
    t = _without_commands(t, field == "normalized_text") if bare and "\\" in t else t
    t = html.unescape(t).replace("\xa0", " ")
    blocks = []
    for line in t.split("\n"):
        line = re.sub(r"[ \r]{2,}", " ", line).strip(" \r")
        if not line:
            continue
        kind = "heading" if line.startswith(_HEADING) else "item" if line.startswith(_ITEM) else "text"
        whole = _HELD.fullmatch(line)
        if whole and held[int(whole[1])][0] in ("code", "formula"):
            kind = held[int(whole[1])][0]
        level = int(line[1]) if kind in ("heading", "item") else None
        line = re.sub(f"[{_HEADING}{_ITEM}]\\d", "", line).strip() if level else re.sub(f"[{_HEADING}{_ITEM}]", "", line)
        while _HELD.search(line):
            line = _HELD.sub(lambda m: held[int(m[1])][1], line)
        if line:
            blocks.append((kind, line, level))
    return blocks


def rendered(blocks: list[tuple[str, str, int | None]] | None) -> str | None:
    """Blocks as a text of one block a line; items begin with a bullet or their number."""
    return None if blocks is None else "\n".join("• " + t if kind == "item" and not _NUMBER.match(t) else t for kind, t, _ in blocks)


def clean_text(text: str | None, field: str = "original_text") -> str | None:
    """The blocks of a text, one a line."""
    return rendered(clean_blocks(text, field))


_OUT = "pos long, field string, kinds array<string>, blocks array<struct<kind:string, text:string, level:int>>, clean_text string"


def without_markup(items: DataFrame, only_marked: bool = False) -> DataFrame:
    """(pos, field, kinds, blocks, clean_text) of both fields of every row.

    Null fields give null blocks and text; ``only_marked`` keeps fields with markup. Other columns
    are not read. One pass without a shuffle.
    """

    def run(batches):
        for b in batches:
            pos, out = b.column(0).to_pylist(), []
            for k, field in enumerate(FIELDS):
                for p, t in zip(pos, b.column(k + 1).to_pylist()):
                    kinds = markup_kinds(t, field)
                    if kinds or not only_marked:
                        blocks = clean_blocks(t, field)
                        out.append((p, field, kinds, None if blocks is None else [{"kind": x, "text": y, "level": n} for x, y, n in blocks], rendered(blocks)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["pos", "field", "kinds", "blocks", "clean_text"])

    return items.select("pos", *FIELDS).mapInArrow(run, _OUT)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_markup(read(spark, sf_dir, "items"), only_marked=True).where(F.size("kinds") > 0).select("pos", "field")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_markup(read(spark, sf_dir, "items"))


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
ORACLE: dict[str, str] = {}
