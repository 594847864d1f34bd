"""Structure of running text: section headings that stand in it, and lists and tables as Markdown."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- headings -------------------------------------------------------------------------------------------------

#: Characters of a heading's title at most.
TITLE = 160
# a number of up to five levels at the start of a line or sentence; the title goes on to the end of the line, or to the next word in upper case that begins a sentence
_NUMBER = re.compile(r"(?:(?<=\n)|(?<=^)|(?<=[.!?:»)] ))[ \t]{0,8}([0-9]{1,6}(?:\. ?[0-9]{1,6}){0,4})(?:\.[ \t]{1,8}|[ \t]{1,8})(?=[^\W\d_])")
_WORD = re.compile(r"\S+")


class Heading(NamedTuple):
    start: int
    end: int
    number: tuple[int, ...]


def title_end(text: str, start: int) -> int:
    """Where a title that begins at a place ends: at the line's end, or before the next word that is capitalised after one that isn't an abbreviation; -1 if a sentence ends first or no title is there."""
    if not text[start].isupper():
        return -1
    stop = text.find("\n", start, start + TITLE + 1)
    line = text[start : stop if stop >= 0 else start + TITLE]
    last = 0
    for k, m in enumerate(_WORD.finditer(line)):
        word = m[0]
        if k and word[0].isupper() and word[1:2].islower():
            return start + last
        last = m.end()
        if word[-1] in ".!?":
            return -1  # a sentence, or the item of a list
    return start + last if stop >= 0 or start + len(line) == len(text) else -1


def candidates(text: str) -> list[Heading]:
    """Numbers with a title.

    One of more than three digits may be a year, so it counts only after the number before it (999, 1000, 1000. 1). Four levels written as 28.68.191.238 may be
    an address, and count only if the text has the section before, after or above them.
    """
    found, addresses, seen = [], set(), set()
    for m in _NUMBER.finditer(text):
        end = title_end(text, m.end())
        if end >= 0:
            number = tuple(int(x) for x in re.split(r"\. ?", m[1]))
            if max(number) < 1000 or (*number[:-1], number[-1] - 1) in seen or number[-1] < 1000 and number[:-1] in seen:
                seen.add(number)
                found.append(Heading(m.start(), end, number))
                if len(number) == 4 and max(number) < 256 and " " not in m[1]:
                    addresses.add(m.start())
    near = lambda n: seen & {(*n[:-1], n[-1] - 1), (*n[:-1], n[-1] + 1), n[:-1]}
    return [h for h in found if h.start not in addresses or near(h.number)]


def rising(found: list[Heading]) -> list[Heading]:
    """The longest sequence in which section numbers rise (1. 4. 2 < 1. 4. 3 < 2); of equally long ones the one that ends lowest."""
    tails: list[tuple[int, ...]] = []
    last: list[int] = []
    back: list[int] = []
    for k, h in enumerate(found):
        at = bisect_left(tails, h.number)
        back.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [h.number], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(found[k])
        k = back[k]
    return chain[::-1]


def without_headings(text: str, least: int = 2) -> str:
    """text without its numbered headings, if there are at least so many; what numbers else stand in it (figures, tables, years) stays."""
    chain = rising(candidates(text))
    if len(chain) < least:
        return text
    out, at = [], 0
    for h in chain:
        out.append(text[at : h.start])
        # the line's end goes with a heading that has a line of its own
        own = (h.start == 0 or text[h.start - 1] == "\n") and text[h.end : h.end + 1] == "\n"
        at = h.end + 1 if own or text[h.end : h.end + 1] in ("\n", " ") else h.end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def drop_headings(texts: pd.Series) -> pd.Series:
    """Section headings within running text taken out: numbers that rise through a document, each followed by a title. Null stays null."""
    return texts.map(lambda t: None if t is None else without_headings(t))


# -- lists and tables -----------------------------------------------------------------------------------------

_BULLET = re.compile(r"([ \t]*)(?:[•▪‣◦●○■□·∙–—*+]|-)[ \t]+(?=\S)")
_ITEM = re.compile(r"([ \t]*)(?:\(([0-9]{1,3}|[a-zа-я])\)|([0-9]{1,3}|[a-zа-я])[.)])[ \t]+(?=\S)")
_GAP = re.compile(r"\t[ \t]*|[ ]{2,}")
_RULE = re.compile(r"[ \t]*[-=+|_][-=+|_ \t]*")


def cells_of(lines: list[str]) -> list[list[str]] | None:
    """The cells of neighbouring lines whose columns are parted by gaps that all of them share, or None."""
    wide = [line.expandtabs(8).rstrip() for line in lines]
    width = max(map(len, wide))
    blank = [all(k >= len(x) or x[k] == " " for x in wide) for k in range(width)]
    gaps, k = [], 0
    while k < width:
        if blank[k]:
            end = k
            while end < width and blank[end]:
                end += 1
            if end - k >= 2 and k > 0:
                gaps.append((k, end))
            k = end
        k += 1
    bounds = [0, *(e for _, e in gaps)], [*(s for s, _ in gaps), width]
    rows = [[x[s:e].strip() for s, e in zip(*bounds, strict=True)] for x in wide]
    return rows if len(bounds[0]) >= 2 and all(sum(c != "" for c in row) >= 2 for row in rows) else None


def pipe_table(rows: list[list[str]]) -> list[str]:
    """A Markdown table; the first row is its head."""
    line = lambda cells: "| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|") for c in cells) + " |"
    return [line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])]


def parsed_table(lines: list[str]) -> list[list[str]]:
    """The cells of a Markdown table: what pipe_table() made it of."""
    rows = []
    for k, line in enumerate(lines):
        if k != 1:
            cells = re.findall(r"(?:[^|\\]|\\.)*", line[1:-1])
            rows.append([re.sub(r"\\(.)", r"\1", c.strip()) for c in cells if c][: line[1:-1].replace("\\\\", "").replace("\\|", "").count("|") + 1])
    return rows


def markdown_structure(text: str) -> str:
    """Lists as Markdown lists, tables as pipe tables, all else as it is.

    A list item's level is the place of its indent among those of the items before it; a blank line or a text line further out ends the list. A number keeps its value, letters are
    counted from a. Two or more neighbouring lines form a table where gaps of two blanks or a tab part all of them at the same places.
    """
    lines = text.split("\n")
    out: list[str] = []
    levels: list[int] = []  # indents of the open items
    k = 0
    while k < len(lines):
        line = lines[k]
        end = k
        while end < len(lines) and _GAP.search(lines[end].strip()) and not _BULLET.match(lines[end]) and not _ITEM.match(lines[end]):
            end += 1
            while end < len(lines) and _RULE.fullmatch(lines[end]) and len(lines[end].strip()) > 2:
                end += 1
        table = None
        if end - k >= 2:
            own = [x for x in lines[k:end] if not _RULE.fullmatch(x)]
            table = cells_of(own) if len(own) >= 2 else None
        if table:
            out += pipe_table(table)
            levels, k = [], end
            continue
        bullet, item = _BULLET.match(line), _ITEM.match(line)
        found = bullet or item
        if found:
            indent = len(found[1].expandtabs(4))
            while levels and levels[-1] > indent:
                levels.pop()
            if not levels or levels[-1] < indent:
                levels.append(indent)
            mark = "-"
            if item and not bullet:
                name = item[2] or item[3]
                mark = f"{name if name.isdigit() else letter_number(name)}."
            out.append("  " * (len(levels) - 1) + f"{mark} {line[found.end():].rstrip()}")
        else:
            if not line.strip() or levels and len(line) - len(line.lstrip()) <= levels[0]:
                levels = []
            out.append(line)
        k += 1
    return "\n".join(out)


def letter_number(letter: str) -> int:
    return ord(letter) - ord("a" if letter.isascii() else "а") + 1


@F.pandas_udf(StringType())
def to_markdown_structure(texts: pd.Series) -> pd.Series:
    """markdown_structure() of each text. Null stays null."""
    return texts.map(lambda t: None if t is None else markdown_structure(t))
