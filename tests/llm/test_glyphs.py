"""Problem 6: one output for every spelling of a letter."""

import unicodedata

import pytest

from mathloom.llm import glyphs


def test_composed_and_decomposed_forms_have_one_output():
    wrong = []
    for o in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(o)
        forms = {c, unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)}
        if len(forms) > 1 and len({glyphs.consistent(f"x {t}y") for t in forms}) > 1:
            wrong.append(f"U+{o:04X}")
    assert wrong == []


@pytest.mark.parametrize("a,b", [("ё", "ë"), ("ї", "ї"), ("ό", "ό"), ("У", "Y"), ("Ϲ", "C"), ("ϲ", "c")])
def test_letters_drawn_alike(a, b):
    assert glyphs.consistent(a) == glyphs.consistent(b)


def test_all_radicals_of_the_supplement():
    """All but U+2E80, which is the form of no ideograph."""
    left = [c for c in map(chr, range(0x2E81, 0x2EF4)) if unicodedata.category(c) != "Cn" and glyphs.consistent(c) == c]
    assert left == [] and [glyphs.consistent(c) for c in "⺠⺩⺝⻑⻖"] == list("民王月長阝")
