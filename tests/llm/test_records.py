"""Problems 1, 2, 4, 6, 8 and 9."""

import base64
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.llm import bpe, canonical, glyphs, markup, packing, sampling


def test_formatting_duplicates(spark):
    rows = [
        (1, "A b, 1.5 + 2", "x=1; y=2"), (2, "ab 1.5+2。", "Y=2；x = 1；"), (3, "ab 15+2", "x=1;y=2"), (4, "ab 1 5+2", "x=1;y=2"), (5, None, None), (6, "", ";；"), (7, " ,", ""),
        (8, "3. 5", None), (9, "3 5", ""), (10, "35", None), (11, "ＡＢ", None), (12, "ab", None), (13, "A b, 1.5 + 2", "x=1; y=2"),
    ]
    df = spark.createDataFrame(rows, "pos long, normalized_text string, equation string").withColumn("h", F.lit(0)).withColumn("n", F.lit(9))
    assert {tuple(r) for r in canonical.duplicates(df).collect()} == {(1, 2), (1, 13), (5, 6), (5, 7), (8, 9)}
    assert {tuple(r) for r in canonical.collapsed(df).collect()} == {(1, 3), (3, 1), (4, 1), (5, 3), (8, 2), (10, 1), (11, 1), (12, 1)}
    assert canonical.duplicates(df.limit(0)).count() == 0


def test_sampling(spark):
    rng = random.Random(1)
    items = [(rng.choice(["Math ", "ape"]), rng.choice(["algebra", "FUNCTION", None]), rng.choice([True, False, None]), f"i{k % 900}") for k in range(1000)]
    items += [("math", "geometry", True, "g1"), ("math", "geometry", True, "g1"), ("math", "geometry", True, None)]
    df = spark.createDataFrame(items, "source string, kind string, has_diagram boolean, id string").withColumn("supply", F.lit(1))
    plans = [(1, 100, s, k, d, 0.115, 5) for s in ("math", "ape") for k in ("algebra", "function") for d in (True, False)] + [(1, 100, "math", "geometry", True, 0.08, 1)]
    targets = spark.createDataFrame(plans, "plan_id int, sample_size int, source string, kind string, has_diagram boolean, share double, min_rows int")
    rows, plan = sampling.sample(df, targets)
    got = rows.collect()
    assert len(got) == 100 and len({tuple(r) for r in got}) == 100
    report = sampling.report(df, targets).collect()
    short = [r for r in report if r.short]
    assert [(r.kind, r.supply, r.drawn, r.wanted) for r in short] == [("geometry", 1, 1, 8)]
    by = {(r.margin, r.value): r for r in sampling.margin_report(df, targets).collect()}
    # what geometry lacks goes to categories of the same source and the same kind of figure
    assert all(abs(by[m].drawn - by[m].target) <= 1 for m in [("source", "math"), ("source", "ape"), ("has_diagram", "1"), ("has_diagram", "0")])
    assert by["kind", "geometry"].drawn == 1 and not by["kind", "geometry"].possible and all(r.drawn >= 5 for r in report if r.kind != "geometry")
    assert sampling.sample(df.limit(0), targets)[0].count() == 0


def margins(x, groups):
    return [np.bincount(g, x) for g in groups]


def test_raking_meets_margins():
    """Two cells are short; supply allows all three margins to be met by the others."""
    rng = np.random.default_rng(1)
    groups = [np.repeat(np.arange(3), 6), np.tile(np.repeat(np.arange(3), 2), 3), np.tile(np.arange(2), 9)]
    goal = rng.dirichlet(np.ones(18) * 3) * 1000
    have = np.floor(goal * 3 + 5)
    have[[4, 11]] = 5, 9
    x = sampling.rake(goal, have, groups, 1000.0)
    assert (x <= have + 1e-9).all() and x[4] == pytest.approx(5)
    for got, want, cut in zip(margins(x, groups), margins(goal, groups), margins(np.minimum(goal, have), groups)):
        assert np.abs(got - want).max() < 0.01 < 80 < np.abs(cut - want).max()
    floor = np.minimum(have, 12.0)
    y = sampling.rake(goal, have, groups, 1000.0, floor, x)
    assert (y >= floor - 1e-9).all() and all(np.abs(a - b).max() < 0.01 for a, b in zip(margins(y, groups), margins(goal, groups)))
    drawn = rng.binomial(have.astype(int), x / have)
    n = sampling.repair(drawn, y, have.astype(int), 1000)
    assert n.sum() == 1000 and np.abs(n - y).max() < 1 and (n >= floor).all() and (n <= have).all()


def test_raking_where_supply_does_not_allow_it():
    goal, have = np.array([10.0, 20, 30, 40]), np.array([5.0, 100, 100, 100])
    groups = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    x = sampling.rake(goal, have, groups, 100.0)
    assert x == pytest.approx([5, 25, 35, 35], abs=0.01)
    y = sampling.rake(goal, have, groups, 100.0, np.array([5.0, 0, 50, 0]), x)
    assert y.sum() == pytest.approx(100) and y[0] == pytest.approx(5) and y[2] >= 50 - 1e-6
    none = sampling.rake(goal, np.zeros(4), groups, 100.0)
    assert (none == 0).all() and (sampling.repair(np.zeros(4, int), none, np.zeros(4, int), 100) == 0).all()
    few = sampling.rake(goal, np.full(4, 3.0), groups, 100.0)
    assert (few == 3).all()


def test_draws_follow_the_keys(spark):
    """Rows with smaller keys are in, and the draw by keys alone is near the raked counts."""
    items = spark.createDataFrame([("math" if k % 3 else "ape", "algebra", k % 2 == 0, f"i{k}") for k in range(6000)], "source string, kind string, has_diagram boolean, id string")
    plans = [(1, 1000, s, "algebra", d, p, 5) for (s, d), p in {("math", True): 0.4, ("math", False): 0.1, ("ape", True): 0.2, ("ape", False): 0.3}.items()]
    targets = spark.createDataFrame(plans, "plan_id int, sample_size int, source string, kind string, has_diagram boolean, share double, min_rows int")
    report = sampling.report(items, targets).collect()
    assert all(abs(r.drawn - 1000 * r.share) <= 1 and 0 < abs(r.drawn_first - r.raked) < 5 * r.raked**0.5 + 1 for r in report)
    rows, plan = sampling.sample(items, targets)
    ids, raked = sampling.raked_plan(items, targets)
    keyed = sampling.keyed_rows(ids, raked).join(rows.withColumn("taken", F.lit(True)), ["plan_id", *sampling.CELL, "id"], "left")
    ends = keyed.groupBy(*sampling.CELL).agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("last"), F.min(F.when(F.col("taken").isNull(), F.col("key"))).alias("next")).collect()
    assert len(ends) == 4 and all(e.last <= e.next for e in ends)
    per = sampling.margin_report(items, targets).collect()
    assert len(per) == 5 and all(r.possible and abs(r.drawn - r.target) <= 1 for r in per)


def test_a_collision_of_the_first_hash_is_listed_and_kept_apart(spark):
    rows = spark.createDataFrame([(1, b"a", 5, 3), (2, b"a", 6, 3), (3, b"a", 5, 3), (4, b"b", 5, 4)], "pos long, h binary, chk long, len int")
    groups = canonical.formatting_groups(rows)
    assert sorted((bytes(r.h), r.keep_pos, r.n) for r in groups.collect()) == [(b"a", 1, 2), (b"a", 2, 1), (b"b", 4, 1)]
    assert [(bytes(r.h), r["keys"]) for r in canonical.collisions(groups).collect()] == [(b"a", 2)]


MARKED = [
    ("<p>ab<br/>c</p>", ["html"], "ab\nc"), ("a&nbsp;b", ["html"], "a b"), ("x <!-- c --> y", ["html"], "x y"), ("## 题\n- a\n- b", ["markdown"], "题\n• a\n• b"),
    ("**粗** [t](a/b.md) `k=2`", ["markdown"], "粗 t k=2"), ("```python\nprint(1)\n```\nend", ["markdown"], "print(1)\nend"), ("== T ==\n'''b''' [[x|y]]", ["wiki"], "T\nb y"),
    ("{{quiz|1}}ab", ["wiki"], "ab"), (r"\section*{T} \textbf{b} $\frac{1}{2}$", ["latex"], "T\nb $\\frac{1}{2}$"), (r"\begin{enumerate}\item a \item b\end{enumerate}", ["latex"], "• a\n• b"),
]
PLAIN = ["3<x<8", "[2, 6]内", "____*5=35，编号#7。", "Use 5 * 3 * 2 and 2**3 for room #4.", r"$\frac{1}{2}$ \[x\] \(y\)", r"\begin{align*}a&=b\\c&=d\end{align*}", "|x-92|<2", "", "Fill in ____ and ____ with 3 < x_1 < 9."]


@pytest.mark.parametrize("text,kinds,clean", MARKED)
def test_markup_is_cleaned(text, kinds, clean):
    assert markup.markup_kinds(text, "original_text") == kinds
    assert markup.clean_text(text) == clean


def test_plain_text_stays():
    for t in PLAIN:
        assert markup.markup_kinds(t, "original_text") == [] and markup.clean_text(t) == t
    assert markup.clean_text(None) is None and markup.markup_kinds(r"a\dfrac12", "normalized_text") == ["latex"]


def test_markup_table(spark):
    df = spark.createDataFrame([(1, "<b>a</b>", None), (2, None, ""), (3, "plain", "x**2")], "pos long, original_text string, normalized_text string").withColumn("field", F.lit(0))
    got = {(r.pos, r.field): (list(r.kinds), r.clean_text) for r in markup.without_markup(df).collect()}
    assert len(got) == 6 and got[1, "original_text"] == (["html"], "a") and got[2, "original_text"] == ([], None) and got[2, "normalized_text"] == ([], "")


def test_look_alikes(spark):
    base = "Harmony of numbers 12 and café words"
    same = [base, "Ｈarmony of numbers 12 and café words", "Harmony of numbers 12 and café words", "Harm­ony of numbers 12 and café words", "Нarmоny of numbers 12 and café words"]
    other = [base.lower(), base.replace(" ", "  ", 1), base + "."]
    rows = [(i, t, "短") for i, t in enumerate([*same, *other, base, None, ""])]
    df = spark.createDataFrame(rows, "pos long, original_text string, normalized_text string").withColumn("raw", F.lit(0))
    got = {tuple(r) for r in glyphs.same_looking(df).collect()}
    alike = [0, 1, 2, 3, 4, 8]
    assert got == {("original_text", a, b) for a in alike for b in alike if a < b and (a, b) != (0, 8)}
    assert [glyphs.consistent(t) for t in same] == [base] * 5 and glyphs.consistent(None) is None
    assert glyphs.same_looking(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_consistent_is_stable(t):
    once = glyphs.consistent(t)
    assert unicodedata.normalize("NFC", glyphs.consistent(once)) == unicodedata.normalize("NFC", once)


@pytest.fixture(scope="module")
def tiktoken_encode():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_library(spark, tiktoken_encode):
    texts = ["Hello  world 123", "<|endoftext|> a", "a" * 3000, "苔岚" * 2000, None, "", " ", "ab́c\n\n\t x", "it's we'll 'd", "٣ ½ 🎲👩‍👩‍👧", "​﻿", "x" * 70 + " " * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert got == {i: tiktoken_encode(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encoded(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_property(tiktoken_encode, t):
    t = t.encode("utf-8", "ignore").decode()
    assert list(bpe.Encoder(bpe.vocabulary(bpe.TOKENIZER_DIR))([t])[0]) == tiktoken_encode(t)


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.randint(0, 900) for _ in range(3000)] + [4096, 4097, 9000, 0, None, 5, 5]
    df = spark.createDataFrame([(i // 2 if i > 3004 else i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long").withColumn("container", F.lit("x"))
    rows = packing.pack(df.select("doc_id", "n_tokens")).collect()
    fill: dict = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n
    total = sum(n or 0 for n in sizes)
    assert max(fill.values()) <= 4096 and sum(fill.values()) == total
    assert len([r for r in rows if r.pieces > 1]) == 2 + 3 and sum(r.piece == 0 for r in rows) == len(sizes)
    assert len([f for f in fill.values() if f]) <= -(-total // 4096) * 1.03 + 1
    assert packing.pack(df.limit(0).select("doc_id", "n_tokens")).count() == 0


def test_window_is_best_fit():
    w = packing.Window(10, 2)
    assert [w.place(n)[0] for n in (6, 5, 4, 5)] == [0, 1, 0, 1]
    assert w.open == []
