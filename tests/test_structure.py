"""Headings in running text, lists and tables as Markdown, formulas that rules leave alone."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import structure as S


def test_rising_is_the_longest():
    rnd = random.Random(6)
    for _ in range(300):
        found = [S.Heading(k, k, tuple(rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 4)))) for k in range(rnd.randrange(0, 10))]
        got = S.rising(found)
        assert all(a.number < b.number and a.start < b.start for a, b in combinations(got, 2))
        longest = max((n for n in range(len(found) + 1) for c in combinations(found, n) if all(a.number < b.number for a, b in zip(c, c[1:], strict=False))), default=0)
        assert len(got) == longest


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Всё о реках. 1. 4. 2. Течение рек и притоков Река течёт. Ещё одно. 1. 4. 3. Виды берегов, обрывов и кос Берега бывают разными.", "Всё о реках. Река течёт. Ещё одно. Берега бывают разными."),
        ("1 Introduction\nText of one. It has 3 Parts of it.\n2 Methods used\nMore text.\n", "Text of one. It has 3 Parts of it.\nMore text.\n"),
        ("1. Start here\nA. 5. Late one\nB. 2. Next one\nC. 3. Third one\nD.", "A. 5. Late one\nB. C. D."),
        ("См. рис. 1. 2. Только один заголовок\nТекст.", "См. рис. 1. 2. Только один заголовок\nТекст."),
        ("1. First item ends. 2. Second item ends.", "1. First item ends. 2. Second item ends."),
        ("", ""),
    ],
)
def test_headings(text, expected):
    assert S.without_headings(text) == expected


def test_headings_are_found_in_linear_time():
    import time

    began = time.monotonic()
    S.without_headings("".join(f"{k % 900}. Title of it\nText. " for k in range(100_000)))
    S.without_headings("1. 2. 3. 4. 5. " * 200_000)
    S.without_headings("1. A" + " b" * 1_000_000)
    assert time.monotonic() - began < 30


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("• one\n  – two\n  – three\n• four", "- one\n  - two\n  - three\n- four"),
        ("1) one\n2) two\n   a) x\n   b) y\n3) three", "1. one\n2. two\n  1. x\n  2. y\n3. three"),
        ("(1) one\n\n(2) two\ntext", "1. one\n\n2. two\ntext"),
        ("Name   Size   Kind\nabc      12   x y\ndef       3   z|w\nend", "| Name | Size | Kind |\n| --- | --- | --- |\n| abc | 12 | x y |\n| def | 3 | z\\|w |\nend"),
        ("Name   Size\n------------\nabc      12", "| Name | Size |\n| --- | --- |\n| abc | 12 |"),
        ("a\tb\nc\td", "| a | b |\n| --- | --- |\n| c | d |"),
        ("one line  with a gap\nand one without", "one line  with a gap\nand one without"),
        ("A year 1999. It was\n3.5 of them", "A year 1999. It was\n3.5 of them"),
        ("- kept\n1. kept", "- kept\n1. kept"),
        ("", ""),
    ],
)
def test_markdown_structure(text, expected):
    assert S.markdown_structure(text) == expected
    assert S.markdown_structure(expected) == expected  # what is Markdown stays


def test_tables_round_trip():
    rnd = random.Random(8)
    for _ in range(200):
        rows = [["".join(rnd.choices("ab|\\ c", k=rnd.randrange(1, 8))).strip() or "x" for _ in range(3)] for _ in range(rnd.randrange(2, 6))]
        rows = [[" ".join(c.split()) for c in row] for row in rows]
        assert S.parsed_table(S.pipe_table(rows)) == rows
        widths = [max(len(r[k]) for r in rows) + 2 for k in range(3)]
        plain = "\n".join("".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in rows)
        assert S.parsed_table(S.markdown_structure("\n" + plain).split("\n")[1:]) == rows or "- " in S.markdown_structure(plain)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (r"ряд $1,1 2,2 3,3 4,4 5,5 6,6$ [3] и \(x [1]\) (2) конец", r"ряд $1,1 2,2 3,3 4,4 5,5 6,6$ и \(x [1]\) конец"),
        ("a  $$x²  + ﬁ$$  b", "a $$x²  + ﬁ$$ b"),
        ("costs $5 and $6 [1] or more", "costs $5 and $6 or more"),
        ("junk$$$ [1] more$$$ [2] end", "junk$$$ more$$$ end"),
        (r"\[ a [1] \( b \) [2]", r"\[ a \( b \)"),
        ("Рис. 1. Схема $a.b$ опыта. Далее", "Схема $a.b$ опыта. Далее"),
        ("own ﷒﷕﷓ $y$", "own $y$"),
        (None, None),
        ("", ""),
    ],
)
def test_formulas_stay(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(R.rule_clean(F.col("t")).alias("x")).first().x == expected


def test_udfs(spark):
    df = spark.createDataFrame([(None,), ("1. One title\nx\n2. Two title\ny",)], "t string")
    assert [r[0] for r in df.select(S.drop_headings("t")).collect()] == [None, "x\ny"]
    assert [r[0] for r in df.select(S.to_markdown_structure("t")).collect()] == [None, "1. One title\nx\n2. Two title\ny"]


def test_many_formulas_are_restored_in_linear_time(spark):
    import time

    began = time.monotonic()
    text = spark.range(1).select(R.rule_clean(F.repeat(F.lit("$x  [1]$ и [2] "), 30_000)).alias("x")).first().x
    assert text == " ".join(["$x  [1]$ и"] * 30_000)
    assert time.monotonic() - began < 20


def test_spaced_letters_beside_noncharacters(spark):
    df = spark.createDataFrame([("ab\ufdd0 c d, e f g h i",), ("a\ufdd1 b",), (None,)], "t string")
    assert [r[0] for r in df.select(R.join_spaced_letters(F.col("t"))).collect()] == ["ab c d, efghi", "a b", None]


def test_formulas_whose_marks_the_rules_move(spark):
    reverse = R.with_formulas_kept(lambda c: F.array_join(F.reverse(F.split(c, " ")), " "))
    drop = R.with_formulas_kept(lambda c: F.array_join(F.slice(F.split(c, " "), 3, 9), " "))
    got = spark.createDataFrame([("$a$ b $c$ d $e$",)], "t string").select(reverse(F.col("t")), drop(F.col("t"))).first()
    assert tuple(got) == ("$e$ d $c$ b $a$", "$c$ d $e$")


def test_headings_beyond_999():
    text = "".join(f"{k}. Состав вод\nстрока {k}\n" for k in range(1, 2501))
    assert S.without_headings(text) == "".join(f"строка {k}\n" for k in range(1, 2501))
    assert S.without_headings("1. One title\nx\n2. Two title\ny\n1999. Год начала\nz") == "x\ny\n1999. Год начала\nz"
    assert S.candidates("1000. Big title\nx\n") == []


def test_addresses_are_no_headings():
    lines = [f"строка {k}" for k in range(1, 31)]
    lines[27] = "28.68.191.238 Den weiter Text dazu"
    text = "".join(f"{k}. Состав вод\n{line}\n" for k, line in enumerate(lines, 1))
    assert S.without_headings(text) == "".join(f"{line}\n" for line in lines)
    assert S.without_headings("1.2.3.1 One title\nx\n1.2.3.2 Two title\ny") == "x\ny"
