"""Queries over the texts of whole tables: canonical forms, grams, formulas, names."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import formula
from mathloom.functions import text as T
from mathloom.functions import typeset as P
from mathloom.operators import evaluate as E
from mathloom.tables import read_table as read


def normalize_items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").select("pos", T.normalize(F.col("original_text")).alias("normalized"))


def strip_items(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation without NFKC of every text."""
    t = read(spark, d, "items").where("original_text is not null")
    return t.select("pos", T.normalize(F.col("original_text"), nfkc=False).alias("normalized"))


def structure_items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").select("pos", T.structure(F.coalesce("normalized_text", F.lit(""))).alias("structure"))


def equation_templates(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "items").where("equation is not null").select("pos", "equation")
    return T.with_template(items, F.col("equation"), "template").select("pos", "template")


def quantity_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "items").select("pos", T.quantities(F.coalesce("normalized_text", F.lit(""))).alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x["val"])
    return q.select("pos", F.size("q").alias("n"), F.size(F.filter("q", lambda x: x["kind"] == "pct")).alias("n_pct"), F.round(total, 4).alias("total"))


def variant_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "items").where("structure_text is not null").select(T.variant_group(F.col("structure_text")).alias("variant_group"))
    return g.groupBy("variant_group").agg(F.count("*").alias("n"))


def gram_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").select("pos", F.size(T.ngrams(F.coalesce("structure_text", F.lit("")))).alias("grams"))


def jaccard_probes(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every probe with the items that share a gram, through the grams themselves."""
    lower = lambda t: F.coalesce(F.col(t), F.lit(""))
    items = read(spark, d, "items").select("pos", T.ngrams(lower("original_text")).alias("g"))
    probes = read(spark, d, "probe_items").select(F.col("id").alias("probe"), T.ngrams(lower("original_text")).alias("h"))
    sizes = items.select("pos", F.size("g").alias("ng"))
    a = items.select("pos", F.explode("g").alias("gram"))
    b = F.broadcast(probes.select("probe", F.size("h").alias("nh"), F.explode("h").alias("gram")))  # a fixed table of 12 questions
    common = a.join(b, "gram").groupBy("pos", "probe", "nh").agg(F.count("*").alias("c")).join(sizes, "pos")
    return common.select("probe", "pos", F.round(F.col("c") / (F.col("ng") + F.col("nh") - F.col("c")), 6).alias("jaccard"))


def formula_items(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "items").select("pos", formula.formula_features(F.col("original_text")).alias("f"))
    return f.select("pos", F.size("f.spans").alias("spans"), F.col("f.blob").alias("blob"), F.size("f.atoms").alias("atoms"), F.col("f.masked").alias("masked"))


def formula_spans(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "items").select("pos", F.posexplode(formula.formula_features(F.col("original_text"))["spans"]).alias("n", "s"))
    return f.select("pos", "n", "s.start", "s.end", "s.snippet")


def other_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").select("pos", E.with_other_numbers("original_text").alias("text"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "task_manifest").distinct()
    return m.select("id", T.safe_name(F.col("id")).alias("file"), T.slug(F.col("type")).alias("slug"), T.one_spaced(F.col("original_text")).alias("text"))


def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "items").select("pos", P.latex_to_plain(F.col("original_text")).alias("plain"))


def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """What pages without formulas show of the tasks, and whether it needs a Chinese font."""
    m = read(spark, d, "task_manifest").where("id is not null").distinct()
    shown = P.shown_text(F.col("original_text"), F.lower(F.trim("source")), F.col("id"))
    return m.select("id", shown.alias("shown"), P.has_cjk(shown).alias("cjk"))


def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of LaTeX pages of all items."""
    return read(spark, d, "items").select("pos", P.page_body(F.col("original_text"), F.lower(F.trim("source"))).alias("body"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_items, strip_items, structure_items, equation_templates, quantity_tokens, variant_group_sizes, gram_counts, jaccard_probes, formula_items,
        formula_spans, other_numbers, file_names, plain_texts, shown_texts, page_bodies,
    )
}

_MASKS = [p.removeprefix("(?U)").replace(r"\d", r"\p{Nd}") for p in T.QUANTITIES]


def _mask(c: str) -> str:
    for p in _MASKS:
        c = f"regexp_replace({c}, '{p}', 'NUM', 'g')"
    return f"regexp_replace({c}, '(?:NUM)+', 'NUM', 'g')"


_WORDS = T.TYPE_WORDS.replace("(?U:", "(?:").replace(r"\d", r"\p{Nd}")


def structure_sql(c: str) -> str:
    """Structure of a normalised text in SQL."""
    parts, words = f"string_split_regex({c}, '{_WORDS}')", f"regexp_extract_all({c}, '{_WORDS}')"
    return f"array_to_string(list_transform({parts}, lambda p, i: {_mask('p')} || coalesce({words}[i], '')), '')"


def quoted(s: str) -> str:
    return s.replace("'", "''")


def _grams(c: str) -> str:
    return f"CASE WHEN length({c}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({c}) - 2, 1) + 1), lambda i: substr({c}, i, 3))) END"


_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _replaced(c: str, rules: list[tuple[str, str]], literal: bool = False) -> str:
    for src, dst in rules:
        dst = quoted(dst).replace("\n", "' || chr(10) || '")
        c = f"replace({c}, '{quoted(src)}', '{dst}')" if literal else f"regexp_replace({c}, '{quoted(src)}', '{dst}', 'g')"
    return c


def plain_sql(c: str) -> str:
    """Plain text of LaTeX in SQL."""
    c = _replaced(_replaced(_replaced(f"coalesce({c}, '')", P.STRUCTURES), P.SIGNS, True), P.NAMES)
    line = f"regexp_replace(regexp_replace(x, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {line}), lambda x: x <> ''), chr(10))"


@functools.cache
def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and these forms; SQL has NFC only."""
    pairs = [(c, to) for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF and len(to := unicodedata.normalize("NFKC", c)) == 1 and to != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def nfkc_sql(c: str) -> str:
    """NFKC in SQL; of characters that become several, those of the blocks before arrows, units and squared words."""
    several = [(x, to) for x in map(chr, range(0x80, 0x2190)) if len(to := unicodedata.normalize("NFKC", x)) > 1]
    c = _replaced(c, several, True)
    return f"nfc_normalize(translate({c}, '{quoted(_compatible()[0])}', '{quoted(_compatible()[1])}'))"


def normalized_sql(c: str) -> str:
    """Normalised text in SQL: eight passes take off nested commands."""
    whole = nfkc_sql(f"coalesce({c}, '')")
    c = f"translate({whole}, '{quoted(T.PUNCT_FROM)}', '{quoted(T.PUNCT_TO)}')"
    for _ in range(8):
        c = _replaced(c, [(r"\\[dt]?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"(\1/\2)"), (r"\\sqrt\s*\{([^{}]+)\}", r"sqrt(\1)"), (r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", " "), (r"\\[a-zA-Z]+\*?\{([^{}]*)\}", r"\1")])
    c = _replaced(_replaced(_replaced(c, [(r"\\(left|right)\.?", "")]), T.SYMBOLS, True), [(r"\\[a-zA-Z]+\*?", ""), (r"\$", ""), (r"\\\[|\\\]", " ")])
    return f"regexp_replace(translate(replace({c}, '&', ' '), '{{}}\\', ''), '{_BLANK}+', '', 'g')"


_VALUE = "CAST(translate(rtrim(n, '%'), '０１２３４５６７８９', '0123456789') AS DOUBLE)"
_WHOLE = "CAST(translate(rtrim(n, '%'), '０１２３４５６７８９', '0123456789') AS HUGEINT)"
_OTHER = f"""CASE WHEN ends_with(n, '%') AND contains(n, '.') THEN printf('%.1f', fmod({_VALUE} + 17, 90) + 5) || '%' WHEN ends_with(n, '%') THEN CAST(CAST(floor(fmod({_VALUE} + 17, 90) + 5) AS BIGINT) AS VARCHAR) || '%'
  WHEN contains(n, '.') THEN printf('%.1f', {_VALUE} + 1.7) ELSE CAST({_WHOLE} + 13 AS VARCHAR) END"""
_NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?%?"
_OTHERS = f"array_to_string(list_transform(string_split_regex(t, '{_NUMBER}'), lambda p, i: p || coalesce(list_transform(regexp_extract_all(t, '{_NUMBER}'), lambda n: {_OTHER})[i], '')), '')"
ORACLE = {
    "normalize_items": f"SELECT pos, {normalized_sql('original_text')} AS normalized FROM items",
    "plain_texts": f"SELECT pos, {plain_sql('original_text')} AS plain FROM items",
    "shown_texts": f"""
WITH m AS (SELECT DISTINCT * FROM task_manifest WHERE id IS NOT NULL),
  r AS (SELECT id, lower(trim(source)) s, coalesce(nullif(regexp_replace(original_text, '^{_BLANK}+|{_BLANK}+$', '', 'g'), ''), id) t FROM m),
  x AS (SELECT id, CASE WHEN s = 'math' OR (NOT regexp_matches(t, '[一-鿿]') AND (contains(t, '\\') OR contains(t, '$'))) THEN coalesce(nullif({plain_sql('t')}, ''), t) ELSE t END shown FROM r)
SELECT id, shown, regexp_matches(shown, '[一-鿿]') cjk FROM x""",
    "equation_templates": f"SELECT pos, nullif({structure_sql('t')}, '') AS template FROM (SELECT pos, {normalized_sql('equation')} t FROM items WHERE equation IS NOT NULL)",
    "other_numbers": f"SELECT pos, nullif({_OTHERS}, t) AS text FROM (SELECT pos, original_text t FROM items)",
    "strip_items": rf"""
SELECT pos, regexp_replace(regexp_replace(translate(translate(original_text, '{quoted(T.PUNCT_FROM)}', '{quoted(T.PUNCT_TO)}'), '&{{}}$', ' '),
  '[\s\p{{Z}}\x1c-\x1f\x85]+', '', 'g'), '[\x0b]', '', 'g') AS normalized FROM items WHERE original_text IS NOT NULL AND NOT contains(original_text, '\')""",
    "structure_items": f"SELECT pos, {structure_sql('t')} AS structure FROM (SELECT pos, coalesce(normalized_text, '') t FROM items)",
    "quantity_tokens": r"""
WITH q AS (SELECT pos, regexp_extract_all(coalesce(normalized_text, ''), '\p{Nd}+(?:\.\p{Nd}+)?%?') q FROM items)
SELECT pos, CAST(len(q) AS INTEGER) n, CAST(len(list_filter(q, lambda x: ends_with(x, '%'))) AS INTEGER) n_pct,
  round(coalesce(list_sum(list_transform(q, lambda x: round(TRY_CAST(translate(x, '０１２３４５６７８９%', '0123456789') AS DOUBLE), 6))), 0), 4) total FROM q""",
    "variant_group_sizes": "SELECT 'vg_' || substr(sha1(structure_text), 1, 16) variant_group, count(*) n FROM items WHERE structure_text IS NOT NULL GROUP BY ALL",
    "gram_counts": f"SELECT pos, CAST(len({_grams('t')}) AS INTEGER) grams FROM (SELECT pos, coalesce(structure_text, '') t FROM items)",
    "jaccard_probes": f"""
WITH a AS (SELECT pos, {_grams('t')} g FROM (SELECT pos, coalesce(original_text, '') t FROM items)),
  b AS (SELECT id probe, {_grams('t')} h FROM (SELECT id, coalesce(original_text, '') t FROM probe_items)),
  c AS (SELECT probe, pos, len(list_intersect(g, h)) c, len(g) ng, len(h) nh FROM a, b)
SELECT probe, pos, round(c / (ng + nh - c), 6) jaccard FROM c WHERE c > 0""",
    "file_names": r"""
SELECT id, left(regexp_replace(id, '[<>:"/\\|?*]', '_', 'g'), 180) AS file,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim(type)), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') slug,
  regexp_replace(regexp_replace(original_text, '[\s\p{Z}\x1c-\x1f\x85\x0b]+', ' ', 'g'), '^ | $', '', 'g') AS text
FROM (SELECT DISTINCT * FROM task_manifest)""",
}
