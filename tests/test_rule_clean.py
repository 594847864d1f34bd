"""The rule-based cleaner against a scalar version that scans characters, and on runs that recursive patterns don't survive."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.plans.queries import QUERIES, RULE_CLEAN_PAIRS


def while_(text, at, good):
    while at < len(text) and good(text[at]):
        at += 1
    return at


def is_digit(c):
    return c in "0123456789"


def is_word(c):
    return c == "_" or c.isalpha() or unicodedata.category(c)[0] == "N"


def is_upper(c):
    return unicodedata.category(c) == "Lu"


def decimal(text, at):
    """The end of a decimal number at a place, or None."""
    end = while_(text, at, is_digit)
    if end == at or end >= len(text) or text[end] not in ".,":
        return None
    last = while_(text, end + 1, is_digit)
    return last if last > end + 1 else None


def removed(text, found):
    """text without the spans that found(text, place) ends, left to right."""
    out, at = [], 0
    while at < len(text):
        end = found(text, at)
        if end is None:
            out.append(text[at])
            at += 1
        else:
            at = end
    return "".join(out)


def after_space(found):
    """A span that takes a space before it along."""
    return lambda t, k: found(t, k + 1) if t[k] == " " and k + 1 < len(t) and found(t, k + 1) is not None else found(t, k)


def lines(text, bad):
    parts = text.split("\n")
    return "".join(line + ("\n" if k < len(parts) - 1 else "") for k, line in enumerate(parts) if not bad(line.strip(" \t")))


def stars(t, k):
    n, end = 0, k
    while end < len(t) and t[end] == "*":
        n, end = n + 1, while_(t, end + 1, " \t".__contains__)
    return end if n >= 3 else None


def joined_breaks(text):
    out, at = [], 0
    while at < len(text):
        end = while_(text, at, is_word)
        out.append(text[at:end])
        if 0 < end < len(text) and is_word(text[end - 1]) and text[end] == "-":
            tail = while_(text, end + 1, " \t".__contains__)
            if tail < len(text) and text[tail] == "\n":
                tail = while_(text, tail + 1, " \t".__contains__)
                if tail < len(text) and is_word(text[tail]):
                    last = while_(text, tail, is_word)
                    out.append(text[tail:last])
                    if last < len(text):  # what follows a joined word isn't joined to it once more
                        out.append(text[last])
                    at = last + 1
                    continue
        if end < len(text):
            out.append(text[end])
        at = end + 1
    return "".join(out)


def joined_lines(text):
    out, at = [], 0
    while at < len(text):
        if at + 2 < len(text) and text[at] not in ".!?\n" and text[at + 1] == "\n" and unicodedata.category(text[at + 2]) == "Ll":
            out += [text[at], " ", text[at + 2]]
            at += 3
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def bracketed(t, k):
    if t[k] != "[":
        return None
    end = while_(t, k + 1, is_digit)
    while end > k + 1 and end < len(t) and t[end] in ";,":
        start = end + 1 + (t[end + 1 : end + 2] == " ")
        last = while_(t, start, is_digit)
        if last == start:
            return None
        end = last
    return end + 1 if end > k + 1 and t[end : end + 1] == "]" else None


def numbered(t, k):
    end = while_(t, k + 1, is_digit)
    return end + 1 if t[k] == "(" and end > k + 1 and t[end : end + 1] == ")" else None


def caption(t, k):
    if not t.startswith("Рис.", k):
        return None
    start = k + 4 + (t[k + 4 : k + 5] == " ")
    end = while_(t, start, is_digit)
    if end == start:
        return None
    ends = [end]
    while len(ends) <= 10 and t[end : end + 1] == ".":
        start = end + 1 + (t[end + 1 : end + 2] == " ")
        last = while_(t, start, is_digit)
        if last == start:
            break
        ends.append(end := last)
    for end in reversed(ends):  # the longest number after which a sentence still ends; digits may be left to the sentence
        stops = [end + 1, end] if t[end : end + 1] == "." else [end]
        for stop in stops:
            dot = t.find(".", stop)
            if dot >= 0:
                return dot + 1
    return None


def reference(t, k):
    for name in ("(рис.", "(табл.", "(гл."):
        if t.startswith(name, k):
            start = k + len(name)
            end = while_(t, start, "0123456789. ".__contains__)
            inside = t[start:end]
            if t[end : end + 1] == ")" and len(inside) >= 1:
                return end + 1
    return None


def citation(t, k):
    if t[k] != "(" or k + 1 >= len(t) or not is_upper(t[k + 1]):
        return None
    end = while_(t, k + 2, str.isalpha)
    start = end + 1 + (t[end + 1 : end + 2] == " ")
    if end == k + 2 or t[end : end + 1] != "," or not (len(t[start : start + 4]) == 4 and all(map(is_digit, t[start : start + 4]))):
        return None
    return start + 5 if t[start + 4 : start + 5] == ")" else None


def capitals(t, k):
    if k and is_upper(t[k - 1]):
        return None
    end, n = while_(t, k, is_upper), 0
    if end - k < 2:
        return None
    while True:
        start = while_(t, end, " ".__eq__)
        last = while_(t, start, is_upper)
        if start == end or last - start < 2:
            return end if n >= 3 else None
        end, n = last, n + 1


def decimals(t, k):
    if k and is_digit(t[k - 1]):
        return None
    end, n = decimal(t, k), 1
    while end is not None:
        start = while_(t, end, " ".__eq__)
        last = decimal(t, start) if start > end else None
        if last is None:
            return start if n >= 5 else None
        end, n = last, n + 1
    return None


def letters(text):
    out, at = [], 0
    while at < len(text):
        ends, k = [at + 1], at + 1
        while text[k : k + 1] == " " and k + 1 < len(text) and text[k + 1].isalpha() and not (k + 2 < len(text) and (text[k + 2].isalpha() or unicodedata.category(text[k + 2])[0] == "N")):
            k += 2
            ends.append(k)
        inside = at and (text[at - 1].isalpha() or unicodedata.category(text[at - 1])[0] == "N")
        if text[at].isalpha() and not inside and len(ends) >= 4:
            out.append(text[at:k].replace(" ", ""))
            at = k
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def scalar(text):
    text = unicodedata.normalize("NFKC", text)
    for old, new in (("“", '"'), ("”", '"'), ("„", '"'), ("‘", "'"), ("’", "'"), ("‚", "'"), (" ", " ")):
        text = text.replace(old, new)
    text = lines(text, lambda x: x != "" and all(map(is_digit, x)))
    text = lines(text, lambda x: len(x) >= 3 and set(x) <= set("-_=*"))
    text = joined_lines(joined_breaks(removed(text, stars)))
    for found in (after_space(bracketed), after_space(numbered), caption, after_space(reference), after_space(citation), capitals, decimals):
        text = removed(text, found)
    return " ".join(x for x in letters(text).split(" ") if x)


def test_rule_clean_equals_scalar(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in rows:
        text = r.text
        for old, new in RULE_CLEAN_PAIRS:
            text = text.replace(old, new)
        expected[r.doc_id] = scalar(text)
    got = {r.doc_id: r.text for r in QUERIES["rule_clean"](spark, sf_dir).collect()}
    assert got == expected


PIECES = ["1,2 ", "33.4 ", "5.6,7 ", "АБ ", "ВГД ", "я ", "б", " ", "* ", "*", "[1", "; 2", "]", "(3)", "(рис. 1. ", "2)", "Рис. 4", ". 5", ". ", ".", "Текст", "(Иванова, ", "1999)", "-\n", "\n", "---\n", " 17\n", "a", "-", "x y z w"]


def test_rules_on_random_pieces(spark):
    import random

    random.seed(5)
    texts = ["".join(random.choices(PIECES, k=random.randrange(1, 40))) for _ in range(3000)]
    # a long text's cleaning is one expression, so each is its own row
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.rule_clean(F.col("t")).alias("t")).collect()
    wrong = [(texts[r.i], r.t, scalar(texts[r.i])) for r in got if r.t != scalar(texts[r.i])]
    assert not wrong, wrong[:3]


RUNS = {
    "numbers": ("", "0,071 ", ""), "capitals": ("", "ДАННЫХ ", ""), "stars": ("", "* ", ""), "brackets": ("[1", "; 2", "]"), "open bracket": ("[1", "; 2", ""), "caption": ("Рис. 1", ". 1", ""), "letters": ("", "a ", ""),
    "digits": ("", "1", ""), "word": ("", "а", ""), "hyphens": ("", "a-", ""), "breaks": ("", "a-\n", ""), "spaces": ("x", " ", ""), "newlines": ("", "\n", ""), "rulers": ("", "---\n", ""), "page numbers": ("", "12\n", ""),
    "parentheses": ("", "(", ""), "reference": ("(рис. 1", " 1", ""), "upper": ("", "Я", ""), "decimals": ("", "1.2", ""), "short runs": ("", "1.2 1.2 1.2 1.2 x ", ""), "citation": ("(А", "б", ""), "dollars": ("", "$x", ""), "formulas": ("", r"\(", ""),
}


@pytest.mark.parametrize("kind", RUNS)
def test_a_run_of_a_million(spark, kind):
    before, unit, after = RUNS[kind]
    began = time.monotonic()
    text = F.concat(F.lit(before), F.repeat(F.lit(unit), 1_000_000), F.lit(after))
    assert spark.range(1).select(F.length(R.rule_clean(text))).first()[0] is not None
    assert time.monotonic() - began < 60


def test_short_runs_are_linear(spark):
    began = time.monotonic()
    text = F.repeat(F.lit("1.2 1.2 1.2 1.2 x "), 1_000_000)
    assert spark.range(1).select(F.length(R.rule_clean(text))).first()[0] == 18_000_000 - 1
    assert time.monotonic() - began < 20


def test_the_cleaner_is_one_stage(spark, sf_dir):
    """What comes before the cleaner is computed once for a row: nothing of it stands above the Python stage."""
    df = QUERIES["rule_clean"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "replace(" not in plan.split("ArrowEvalPython")[0]


def test_arrow_patterns_equal_the_rules(spark):
    import random

    import pyarrow as pa
    import pyarrow.compute as pc

    random.seed(6)
    texts = ["".join(random.choices([*PIECES, "Ⅷ ", "́", "日", "Рис. 1. 2 ", "__", "АБВ  ", "0,5", "x"], k=random.randrange(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(R.rule(name)(F.col("t")).alias(name) for name, _, _ in R.RULES))
    got = sorted(df.collect())
    for (name, _, _), (pattern, replacement) in zip(R.RULES, R._LINEAR, strict=True):
        assert [r[name] for r in got] == pc.replace_substring_regex(pa.array(texts), pattern, replacement).to_pylist(), name


def test_spaced_letters_beside_numbers():
    for text, expected in (("a b ⅷ c d e f ⅷ", "a b ⅷ cdef ⅷ"), ("ⅷ a b c", "ⅷ a b c"), ("a b c d ef g h i j", "abcd ef ghij"), ("x1 b c d e", "x1 bcde"), ("1 a b c d 2", "1 abcd 2"), ("a b c d,e f g h", "abcd,efgh")):
        assert R.spaced_letters_joined(text) == letters(text) == expected


def test_formulas_of_all_planes_stay(spark):
    text = "[1] $𝐀\U0010ffff￿\U000f0041 1 2,5 [2]$ \U000f0041[3]"
    assert spark.createDataFrame([(text,)], "t string").select(R.rule_clean(F.col("t")).alias("x")).first().x == "$𝐀\U0010ffff￿\U000f0041 1 2,5 [2]$ \U000f0041"
