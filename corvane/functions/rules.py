"""A rule-based cleaner of scanned text: the network-free default for the model-based one.

Line rules come first, as later ones remove line structure. Each rule is a Column -> Column function. As NFKC takes every text to Python, the whole cleaner
stays there: one stage of chained functions, whose patterns Arrow runs over a batch (RE2).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions.text import nfkc

_LETTER = r"[\p{L}\p{N}_]"
_NUMBER = r"[0-9]++[.,][0-9]++"
#: (name, pattern, replacement) in order. A repeated group of the JVM's patterns takes a stack frame for each repetition unless it is possessive (``++``), and a
#: class that a match may start within is read again from each of its characters; so groups are possessive and runs are entered at their start only.
RULES: tuple[tuple[str, str, str], ...] = (
    ("page_numbers", r"(?md)^[ \t]*+[0-9]++[ \t]*+$\n?", ""),
    ("rulers", r"(?md)^[ \t]*+[-_=*]{3,}+[ \t]*+$\n?", ""),
    ("asterisks", r"(?:\*[ \t]*+){3,}+", ""),
    ("hyphen_breaks", rf"(?<!{_LETTER})({_LETTER}++)-[ \t]*+\n[ \t]*+({_LETTER}++)", "$1$2"),
    ("mid_sentence_newlines", r"([^.!?\n])\n(\p{Ll})", "$1 $2"),
    ("bracketed_numbers", r" ?\[[0-9]++(?:[;,] ?[0-9]++)*+\]", ""),
    ("numbers_in_brackets", r" ?\([0-9]++\)", ""),
    # the caption's number has ten levels at most, so a deeper one ends the caption
    ("figure_captions", r"Рис\. ?[0-9]+(?:\. ?[0-9]+){0,9}\.?[^.\x{fdd2}]*\.", ""),
    ("references", r" ?\((?:рис|табл|гл)\. ?[0-9. ]++\)", ""),
    ("author_citations", r" ?\(\p{Lu}\p{L}++, ?[0-9]{4}\)", ""),
    ("capital_runs", r"(?<!\p{Lu})\p{Lu}{2,}+(?: ++\p{Lu}{2,}+){3,}+", ""),
    ("number_runs", rf"(?<![0-9]){_NUMBER}(?: ++{_NUMBER}){{4,}}+ *+", ""),
)


def rule(name: str) -> Callable[[Column], Column]:
    pattern, replacement = next((p, r) for n, p, r in RULES if n == name)
    return lambda c: F.regexp_replace(c, pattern, replacement)


def linear(pattern: str) -> str:
    """A rule's pattern as RE2 reads it. That is linear without possessive groups, and a run's leftmost match starts at the run's start anyway."""
    return re.sub(r"(\+|\*|\{[0-9,]+\})\+|\(\?<![^)]*\)", r"\1", pattern).replace("(?md)", "(?m)")


_LINEAR = [(linear(pattern), replacement.replace("$", "\\")) for _, pattern, replacement in RULES]
# Typographic characters and their plain forms.
PLAIN = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "\u00a0": " ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def plain_characters(text: str) -> str:
    """Typographic quotes, ligatures and no-break spaces as plain characters."""
    for character, plain in PLAIN.items():
        text = text.replace(character, plain)
    return text


#: From the first space of a run on. The class has a few numbers, too, which are told apart below.
_SPACED = re.compile(r" [^\W\d_](?= )(?<=[^\W\d_]..)(?<![^\W_]...)(?: [^\W\d_](?![^\W_])){2,}+")


def _without_spaces(m: re.Match[str]) -> str:
    singles = m.string[m.start() - 1 : m.end() : 2]
    if singles.isalpha():
        return singles[1:]
    runs = [(alpha, list(run)) for alpha, run in groupby(singles, str.isalpha)]
    return " ".join(("" if alpha and len(run) > 3 else " ").join(run) for alpha, run in runs)[1:]


def spaced_letters_joined(text: str) -> str:
    return _SPACED.sub(_without_spaces, text.replace("\ufdd0", "").replace("\ufdd1", ""))


@F.pandas_udf(StringType())
def _joined(s: pd.Series) -> pd.Series:
    return s.map(spaced_letters_joined, na_action="ignore")


def join_spaced_letters(c: Column) -> Column:
    """Four or more single letters with spaces between them become one word. The noncharacters U+FDD0 and U+FDD1, which no text should hold, go."""
    return _joined(c)


#: What is a formula: between $ or $$ (exactly), \\( and \\), \\[ and \\]. An opening mark reaches to the next one at most, so a text is read once.
FORMULA = (
    r"(?<!\$)\$\$(?=[^$\s])[^$]++(?<=\S)\$\$(?!\$)|(?<![$\\])\$(?=[^$\s])[^$\n]++(?<=[^\s\\])\$(?![$0-9])"
    r"|\\\((?:[^\\]++|\\(?![()\[\]]))*+\\\)|\\\[(?:[^\\]++|\\(?![()\[\]]))*+\\\]"
)
#: Noncharacters around a formula, whose UTF-16 units are private characters of plane 15 while the rules run, as no rule and no NFKC knows these. A text's own
#: noncharacters from U+FDD2 to U+FDDD go.
_BEGIN, _END, _OWN = "\ufdd2", "\ufdd3", [chr(k) for k in range(0xFDD2, 0xFDDE)]
_PLANE = 0xF0000
_FORMULA, _MARK, _GONE = re.compile(FORMULA, re.ASCII), re.compile(f"{_BEGIN}([^{_END}]*+){_END}"), dict.fromkeys(map(ord, _OWN))


def _masked(m: re.Match[str]) -> str:
    units = np.frombuffer(m[0].encode("utf-16-le"), "<u2").astype("<u4") + np.uint32(_PLANE)
    return _BEGIN + units.tobytes().decode("utf-32-le") + _END


def _restored(m: re.Match[str]) -> str:
    units = np.frombuffer(m[1].encode("utf-32-le"), "<u4") - np.uint32(_PLANE)
    return units.astype("<u2").tobytes().decode("utf-16-le")


def formulas_masked(text: str) -> str:
    own = text.translate(_GONE) if any(map(text.__contains__, _OWN)) else text
    return _FORMULA.sub(_masked, own) if "$" in own or "\\" in own else own


@F.pandas_udf(StringType())
def _mask(s: pd.Series) -> pd.Series:
    return s.map(formulas_masked, na_action="ignore")


@F.pandas_udf(StringType())
def _restore(s: pd.Series) -> pd.Series:
    return s.map(lambda text: _MARK.sub(_restored, text) if _BEGIN in text else text, na_action="ignore")


def with_formulas_kept(rules: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """rules on all but a text's formulas, which stay as they are, character by character, wherever the rules leave their marks."""
    return lambda c: _restore(rules(_mask(c)))


@F.pandas_udf(StringType())
def _cleaned(s: pd.Series) -> pd.Series:
    texts = pa.array(s.map(plain_characters, na_action="ignore"), pa.string(), from_pandas=True)
    for pattern, replacement in _LINEAR:
        texts = pc.replace_substring_regex(texts, pattern, replacement)
    cleaned = [None if x is None else re.sub(" {2,}", " ", spaced_letters_joined(x)).strip(" ") for x in texts.to_pylist()]
    return pd.Series(cleaned, s.index, dtype=object)


def rule_clean(c: Column) -> Column:
    """All rules in order, then one space for runs of spaces. Formulas stay as they are."""
    return with_formulas_kept(lambda masked: _cleaned(nfkc(masked)))(c)
