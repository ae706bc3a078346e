"""Problem 4: what is reported as markup is gone after cleaning."""

import pytest

from mathloom.llm import markup as M

ORIGINAL = [
    (r"\documentclass{article}\usepackage{x}\title{T}\author{A}\date{D} a \newpage b\clearpage c", "T\nA\nD\na\nb\nc"),
    (r"{\bf a} \it b \large c \tiny d \small e \huge f \hline g", None), (r"x \verb|y_1| z \includegraphics[width=1cm]{p.png}", "x y_1 z"),
    (r"a\footnote{see \textbf{b}} c", "a (see b) c"), (r"\textbf{a \emph{b \underline{c}}}", "a b c"), ("a<ref>n 2</ref> b", "a (n 2) b"),
    (r"\angle ABC = 30^\circ, \sqrt{2} \times \mathrm{cm} \foo", "∠ ABC = 30°, √(2) × cm foo"), (r"\textbf{a} $\sqrt{2}$", r"a $\sqrt{2}$"), ("\\t\u0435xtbf{a}", "a"),
]
NORMALIZED = [
    (r"5\sqrt{2}\times3", "5√(2)×3"), (r"\angleABC=90^\circ", "∠ABC=90°"), (r"5\mathrm{cm}", "5cm"), (r"a\dfrac{8}{7}b", "a(8/7)b"), (r"\textbf{a\textbf{b}}", "ab"),
    (r"\dfrac12\pi\sin\alpha\geq\infty", "(1/2)πsinα≥∞"), (r"\left(\binom{n}{k}\right)", "(C(n,k))"), (r"x\y", "xy"),
]


@pytest.mark.parametrize("field,text,want", [("original_text", *x) for x in ORIGINAL] + [("normalized_text", *x) for x in NORMALIZED])
def test_nothing_reported_is_left(field, text, want):
    assert M.markup_kinds(text, field)
    clean = M.clean_text(text, field)
    assert M.markup_kinds(clean, field) == [] and (want is None or clean == want)


@pytest.mark.parametrize("name", M._TEXT_COMMANDS.split())
def test_every_text_command(name):
    for text in (rf"a \{name} b $x$", rf"a \{name}{{c}} b $x$", rf"a \{name}{{\textbf{{c}}}} b"):
        clean = M.clean_text(text)
        assert M.markup_kinds(clean, "original_text") == [] and clean[0] == "a" and "b" in clean


def test_heading_levels():
    text = "# A\n### B\n== C ==\n<h4>D</h4>\n\\subsection{E}\nf"
    assert M.clean_blocks(text) == [("heading", "A", 1), ("heading", "B", 3), ("heading", "C", 2), ("heading", "D", 4), ("heading", "E", 3), ("text", "f", None)]


@pytest.mark.parametrize("text,want", [
    ("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</ul>", [("item", "a", 1), ("item", "b", 2), ("item", "c", 2), ("item", "d", 1)]),
    ("# A\n1. x\n2) y", [("heading", "A", 1), ("item", "1. x", 1), ("item", "2) y", 1)]), ("- a\n  - b\n    + c", [("item", "a", 1), ("item", "b", 2), ("item", "c", 3)]),
    ("* a\n** b", [("item", "a", 1), ("item", "b", 2)]), (r"\begin{itemize}\item a \begin{enumerate}\item b\end{enumerate}\item c\end{itemize}", [("item", "a", 1), ("item", "b", 2), ("item", "c", 1)]),
    ("<math>x^2</math>", [("formula", "x^2", None)]), ("{{math|x^2+1}} is", [("text", "x^2+1 is", None)]), (r"a <math>\frac{1}{2}</math>", [("text", r"a $\frac{1}{2}$", None)]),
])
def test_lists_and_formulas_are_kept(text, want):
    assert M.markup_kinds(text, "original_text") and M.clean_blocks(text) == want


@pytest.mark.parametrize("text,want", [(r"\frac{1}{2}+x", "(1/2)+x"), (r"\dfrac{a}{b}", "(a/b)"), (r"\frac{\frac{1}{2}}{3}", "((1/2)/3)"), (r"<math>\frac{1}{2}</math>", "(1/2)")])
def test_fractions_of_normalized_text(text, want):
    assert M.clean_text(text, "normalized_text") == want
