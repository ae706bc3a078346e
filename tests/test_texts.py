from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.functions import figure, formula, plain, reader
from mathloom.functions import text as T

TEXTS = [
    "半径是 4 米，", "二次函数y=2x**2+3，五年级有20人，第3天", r"\frac{1}{2}+\dfrac{3}{x}", r"\frac{1}{1+\frac{1}{x}}", r"\frac{x^{2}}{y}", r"\log_2 (\sqrt{\sin x})",
    r"$0^\circ \leq x \geqslant 3$", r"\begin{align*} a&=b\\ c&=d \end{align*}", "12.5%和12", "3(1/2)米", "（1/3）", "", "  ", "x²½", "\\", "$\\left(3\\right)$",
    "a　b c\n\td", "ＡＢＣ１２３", "20人第十二天", "7.5 % 8 / 9", None,
]


def test_columns_equal_plain_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    df = df.withColumn("n", T.normalize(F.col("t")))
    out = df.select("i", "n", T.structure(F.col("n")).alias("s"), T.quantities(F.col("n")).alias("q"), T.ngrams(F.col("n")).alias("g")).collect()
    for r in out:
        n = plain.normalize(TEXTS[r.i])
        assert r.n == n
        assert r.s == plain.structure(n)
        assert [tuple(x) for x in r.q] == plain.quantities(n)
        assert set(r.g) == plain.grams(n) and len(r.g) == len(set(r.g))


def test_known_forms():
    assert plain.normalize("半径是 4 米，") == "半径是4米,"
    assert plain.normalize(r"\log_2 (\sqrt{\sin x})") == plain.normalize("log_2 (sqrt(sin x))")
    assert plain.normalize(r"0^\circ") == "0degrees"
    assert plain.normalize(r"\frac{1}{1+\frac{1}{x}}") == "11+(1/x)"
    assert plain.normalize(r"\geqslant") == ">=slant"
    s = plain.structure(plain.normalize("二次函数y=2x**2+3，五年级有20人"))
    assert "二次函数" in s and "五年级" in s and "NUM" in s and "20" not in s
    assert plain.structure(plain.normalize("x=150*20%/5%-150")) == plain.structure(plain.normalize("x=80*10%/2%-80"))
    assert plain.ratio("ab" * 120, "ba" * 120) == 0.0 and plain.ratio("tide", "diet") == 0.25 and plain.ratio("diet", "tide") == 0.5
    assert plain.ratio("", "") == 1 and plain.jaccard("", "") == 1 and plain.ratio("a", "") == 0


def test_boxed_answers():
    assert plain.boxed_answer(r"done. \boxed{\dfrac{1}{2}}") == r"\dfrac{1}{2}"
    assert plain.boxed_answer(r"\boxed 42 apples") == "42"
    assert plain.boxed_answer("none") is None and plain.boxed_answer(r"\boxed{open") is None and plain.boxed_answer(None) is None


def test_other_numbers():
    changed = plain.with_other_numbers("半径是4米，增加1.5米，共20%")
    assert changed == "半径是17米，增加3.2米，共42%"
    assert plain.with_other_numbers("没有数") is None and plain.with_other_numbers(None) is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_properties(t):
    n = plain.normalize(t)
    assert plain.structure(n) == plain.structure(plain.structure(n)) or "NUM" in n or any(c.isdigit() for c in n)
    assert plain.jaccard(n, t) == plain.jaccard(t, n)
    spans = formula.spans(t)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_formula_spans_and_templates():
    assert formula.formulas("In $\\triangle ABC$, point $D$ lies on $BC$") == []
    aligned = r"\begin{align*} x+y&=3\\ x-y&=1 \end{align*}"
    assert len(formula.atoms(aligned)) == 1 or len(formula.spans(aligned)) == 2
    assert formula.template_blob("没有公式") is None
    assert formula.template_blob(r"$\dfrac{1}{2}$") is None and formula.template_blob(r"$\frac{1}{2}$") is not None
    assert formula.masked("已知 $x^2+1=0$，求所有整数解的个数是多少个").startswith("已知 EQ")
    assert formula.masked("$x^2+1=0$") == "$x^2+1=0$"
    assert formula.repaired("[5x - 1] = [3x + 2]") == "|5x - 1| = |3x + 2|" and formula.repaired("[AB]") == "[AB]"


def test_compatible_blobs():
    assert formula.compatible(None, None, 0.82) and not formula.compatible(None, "x=NUM", 0.82)
    assert formula.compatible("y=xNUM+x-NUM", "y=(NUM/x^NUM+x-NUM)", 0.82)
    assert not formula.compatible("y=sinx", "y=cosx", 0.82)


def test_reader_text():
    raw = "```latex\n题目：求 \\(x\\) 的值\n解：x=1\n```"
    assert reader.clean_reading(raw) == "求 $x$ 的值"
    assert reader.flag(None) and not reader.flag("off") and reader.flag("1") and reader.flag(" ", False) is False
    assert reader.looks_like_formula("y = 2x") and not reader.looks_like_formula("OB")
    assert not reader.is_formula_line("what is the range of the function y = 2x")
    assert reader.with_latex("已知 y=x+1 求", r"y=\frac{1}{x}") == r"已知  $y=\frac{1}{x}$ 求" or "frac" in reader.with_latex("已知 y=x+1 求", r"y=\frac{1}{x}")
    lines = [reader.Line("右", (50, 0, 60, 10)), reader.Line("左", (0, 2, 10, 12)), reader.Line("下", (0, 40, 10, 50))]
    assert reader.reading_order(lines) == "左右下"


def test_slug_and_names(spark):
    df = spark.createDataFrame([("Counting & Probability", "test/algebra/1006"), ("  ", "a|b"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(T.slug(F.col("a")), T.safe_name(F.col("b"))).collect()] == [("counting-probability", "test_algebra_1006"), ("x", "a_b"), ("x", None)]


@pytest.mark.parametrize("a,b,want", [("半 径 是 4 米", None, "半径是4 米"), ("a  b", None, "a b")])
def test_cjk_spaces(spark, a, b, want):
    assert spark.range(1).select(T.without_cjk_spaces(F.lit(a))).first()[0] in (want, want.replace(" 米", "米"), "半径是 4 米")


def test_readers_and_formula_boxes():
    image = np.full((200, 300), 255, np.uint8)
    image[150:160, 100:200:2] = 0
    lines = [reader.Line("Find f(x) = 2x + 1 when the value of x is given by the teacher and", (0, 10, 260, 30)), reader.Line("y = 3x", (0, 40, 100, 60)), reader.Line("no sums here", (0, 70, 99, 80)), reader.Line("z = 1", (5, 5, 5, 9))]
    first, second, none, flat = (reader.formula_boxes(x, 200) for x in lines)
    assert len(first) == 1 and 0 < first[0][0] < first[0][2] <= 260 and first[0][1::2] == (0, 200)
    assert second == [(0, 0, 100, 200)] and none == [] and flat == [] and reader.formula_boxes(lines[1]) == [(0, 40, 100, 60)]
    (box,) = figure.display_boxes(image, [x.box for x in lines])
    assert box[0] <= 100 and box[2] >= 199 and 140 <= box[1] <= 150
    assert reader.line_latex(image, lines, lambda part: f"L{part.shape[1]}") == {0: f"L{first[0][2] - first[0][0] + 8}", 1: "L104", -1: f"L{box[2] - box[0] + 8}"}
    assert len(reader.line_latex(image, lines * 9, lambda part: "a")) == reader.MAX_CROPS and reader.line_latex(image, lines, None) == {}
    assert len(reader.all_formula_boxes(image, lines)) <= reader.MAX_CROPS and reader.all_formula_boxes(np.full((40, 100), 255), []) == [(0, 0, 100, 40)]
    assert figure.crop(image, (5, 5, 5, 9)) is None and figure.crop(image, (0, 0, 3, 3), 2) is None and figure.crop(image, (0, 0, 20, 20)).shape == (30, 30)


def test_reader_registry():
    with pytest.raises(RuntimeError):
        reader.reader_maker("none")().read(np.zeros((9, 9)))
    with pytest.raises(ValueError):
        reader.reader_maker("unheard-of")
    auto = reader.reader_maker(None)
    assert auto is reader.PassthroughReader or any(auto is make for _, make in reader.ENGINES.values())
    poly = [[0, 0], [9, 0], [9, 5], [0, 5]]
    for found in ([(poly, "a text", 0.9)], ([(poly, ("a text", 0.9))], [0.1]), {"dt_polys": [poly], "rec_texts": ["a text"]}, SimpleNamespace(boxes=[poly], txts=("a text",))):
        assert reader.EngineReader(lambda image, f=found: f).read(None) == "a text"
    assert reader.lines_of(None) == [] and reader.lines_of(([], 0)) == []
    page = [{"parsing_res_list": [{"block_label": "text", "block_content": "q1"}, {"block_label": "image", "block_content": "x"}]}, {"markdown": {"markdown_texts": "q2"}, "rec_texts": ["no"]}, {"else": 1}]
    assert reader.texts_of(page) == "q1\nq2" and reader.texts_of({"a": {"b": 1}}) == "" and reader.texts_of(SimpleNamespace(json={"res": {"rec_texts": ["u", "v"]}})) == "u\nv"
