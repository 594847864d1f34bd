"""Whether a cleaned text holds its source's content: nothing added, and what was taken away.

Both texts are compared by their letters and digits, after NFKC and with plain characters, so repaired line breaks, ligatures and
quotes are no change. The differences are those of a longest common subsequence: found exactly, by bit vectors, where both texts or what lies between two
anchors are short, and between anchors (stretches that each text holds once, in the same order) in long ones, so the work grows with the texts' length.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.rules import plain_characters

#: Product of two lengths up to which a difference is exact at once, and up to which it is where no anchor is found; beyond, the stretch counts as replaced.
EXACT, MOST = 1 << 18, 1 << 26
#: Values (4 bytes each) of the rows that few_insertions() may fill: characters of the second text times insertions.
FEW = 1 << 24
#: Lengths of anchors, tried in turn.
ANCHORS = (32, 16, 8)
Pair = tuple[int, int, int, int]


@cache
def _kept() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(k).isalnum() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(text: str | None) -> str:
    """Letters and digits in order."""
    plain = plain_characters(unicodedata.normalize("NFKC", plain_characters(text or "")))
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4")
    return codes[_kept()[codes]].tobytes().decode("utf-32-le", "surrogatepass")


def is_subsequence(short: str, long: str) -> bool:
    at = 0
    for c in short:
        at = long.find(c, at) + 1
        if not at:
            return False
    return True


def common_start(a: str, b: str) -> int:
    """How many characters two strings have in common at their start: blocks that double, then halves."""
    n, step = 0, 64
    most = min(len(a), len(b))
    while n < most and a[n : n + step] == b[n : n + step]:
        n, step = min(most, n + step), 2 * step
    while step > 1 and n < most:
        step //= 2
        if a[n : n + step] == b[n : n + step] and n + step <= most:
            n += step
    return n


def embedded(a: str, b: str) -> list[Pair] | None:
    """exact_changes() where only a has letters of its own, or None: each letter of b is met by the first that is left in a, as the bit vectors do."""
    if len(b) > len(a):
        return None
    found, x, y = [], 0, 0
    while y < len(b):
        at = a.find(b[y], x)
        if at < 0:
            return None
        if at > x:
            found.append((x, at, y, y))
        x, y = at + 1, y + 1
        if a[x : x + 8] == b[y : y + 8]:
            n = common_start(a[x : x + 512], b[y : y + 512])
            x, y = x + n, y + n
    return [*found, (x, len(a), y, y)] if x < len(a) else found


def exact_changes(a: str, b: str) -> list[Pair]:
    """(start, end) in a and in b of what a longest common subsequence leaves out, in order."""
    if (whole := embedded(a, b)) is not None:
        return whole
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    rows, state = [], every
    for c in b:
        same = state & masks.get(c, 0)
        state = ((state + same) | (state - same)) & every
        rows.append(state)
    matched = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                matched.append((i, j))
    return unmatched(reversed(matched), len(a), len(b))


def _grams(text: str, k: int) -> np.ndarray:
    """Hashes of all stretches of k characters, k a power of 2: those of a stretch's halves give its own."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    factor, step = 0x9E3779B97F4A7C15, 1
    while step < k:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    # mixed, so that the high bits, which _once() keeps, tell what the low ones do
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(29)


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixed hashes that occur once, rising, without the low bits that hold their places meanwhile; and the places."""
    bits = np.uint64(len(h).bit_length())
    packed = np.sort(h >> bits << bits | np.arange(len(h), dtype=np.uint64))
    keys = packed >> bits
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    single = new[1:] & new[:-1]
    return keys[single], (packed[single] & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def anchors(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of stretches of k characters that both hold once, rising in both; every k-th place of b is looked at."""
    if min(len(a), len(b)) < k:
        return []
    of_a, of_b = _grams(a, k), _grams(b, k)
    keys, first = _once(of_a)
    _, place = _once(of_b)
    once = np.sort(place[place % k == 0])
    if not len(keys):
        return []
    sought = of_b[once] >> np.uint64(len(of_a).bit_length())
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    known = keys[at] == sought
    pairs = list(zip(first[at[known]].tolist(), once[known].tolist(), strict=True))
    pairs = [(i, j) for i, j in pairs if a[i : i + k] == b[j : j + k]]
    # the longest rising subsequence
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for x, (i, _) in enumerate(pairs):
        at_ = bisect_left(tails, i)
        back[x] = last[at_ - 1] if at_ else -1
        tails[at_ : at_ + 1], last[at_ : at_ + 1] = [i], [x]
    chain, x = [], last[-1] if last else -1
    while x >= 0:
        chain.append(pairs[x])
        x = back[x]
    return chain[::-1]


def changes(a: str, b: str) -> list[Pair]:
    """(start, end) in a and in b of what differs, in order.

    Anchors may mislead in repeating texts, and long stretches have none. So where more is inserted than letters that a lacks, it is tried with fewer.
    """
    found = list(anchored_changes(a, b))
    inserted = sum(j - y for *_, y, j in found)
    if inserted and inserted > (Counter(b) - Counter(a)).total():
        found = few_insertions(a, b, inserted) or found
    return found


def few_insertions(a: str, b: str, below: int) -> list[Pair] | None:
    """The changes with the fewest characters of b inserted, or None if these aren't fewer than below, or than FEW allows.

    Row k has, for each start of b, the end of the shortest start of a that holds all of it but k characters.
    """
    none, n = len(a) + 1, len(b)
    rows: list[array[int]] = []
    while True:
        k = len(rows)
        if k >= below or (k + 1) * (n + 1) > FEW:
            return None
        row, at = array("i", [0]), 0
        for j, c in enumerate(b):
            if at < none:
                at = a.find(c, at) + 1 or none
            if k:
                at = min(at, rows[-1][j])
            row.append(at)
        rows.append(row)
        if at < none:
            break
    matched, j = [], n
    while j:
        if k and rows[k - 1][j - 1] == rows[k][j]:
            k -= 1
        else:
            matched.append((rows[k][j] - 1, j - 1))
        j -= 1
    return unmatched(reversed(matched), len(a), n)


def unmatched(matched: Iterable[tuple[int, int]], a: int, b: int) -> list[Pair]:
    """What lies between matched places of texts of two lengths."""
    found, x, y = [], 0, 0
    for i, j in [*matched, (a, b)]:
        if i > x or j > y:
            found.append((x, i, y, j))
        x, y = i + 1, j + 1
    return found


def anchored_changes(a: str, b: str) -> Iterator[Pair]:
    """changes() by anchors, in linear time; not always the least."""
    # what is left to do, last first: bounds, and the anchors' length to try
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        x, i, y, j, level = todo.pop()
        n = common_start(a[x:i], b[y:j])
        x, y = x + n, y + n
        n = common_start(a[x:i][::-1], b[y:j][::-1])
        i, j = i - n, j - n
        if x == i and y == j:
            continue
        if x == i or y == j:
            yield x, i, y, j
            continue
        size = (i - x) * (j - y)
        found = anchors(a[x:i], b[y:j], ANCHORS[level]) if size > EXACT and level < len(ANCHORS) else []
        if found:
            k, parts = ANCHORS[level], []
            s, t = x, y
            for p, q in found:
                if x + p >= s and y + q >= t:  # an anchor may reach into the next
                    parts.append((s, x + p, t, y + q, level))
                    s, t = x + p + k, y + q + k
            todo += reversed([*parts, (s, i, t, j, level + 1 if not parts else level)])
        elif size > EXACT and level < len(ANCHORS):
            todo.append((x, i, y, j, level + 1))
        elif size > MOST:
            yield x, i, y, j
        else:
            yield from ((x + p, x + q, y + r, y + s) for p, q, r, s in exact_changes(a[x:i], b[y:j]))


def compared(before: str | None, after: str | None) -> dict[str, object]:
    a, b = letters(before), letters(after)
    spans = []
    for x, i, y, j in changes(a, b):
        if i > x:
            spans.append({"kind": "removed", "at": x, "text": a[x:i]})
        if j > y:
            spans.append({"kind": "inserted", "at": x, "text": b[y:j]})
    total = {kind: sum(len(s["text"]) for s in spans if s["kind"] == kind) for kind in ("removed", "inserted")}
    return {"faithful": not total["inserted"] or is_subsequence(b, a), "letters": len(a), **total, "spans": spans}


_KIND = "struct<faithful:boolean,letters:long,removed:long,inserted:long,spans:array<struct<kind:string,at:long,text:string>>>"


def content_contract(df: DataFrame, before: str, after: str) -> DataFrame:
    """df with content: faithful (after's letters are a subsequence of before's), letters of before, letters removed and inserted, and their spans (at: place in before's letters).

    Null texts count as empty ones. removed and inserted are the least possible, but in texts so long and so unlike that neither anchors nor few insertions explain them. Other columns
    pass through; repeated rows get equal values.
    """

    @F.arrow_udf(_KIND)
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        rows = [compared(x, y) for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True)]
        span = pa.struct([("kind", pa.string()), ("at", pa.int64()), ("text", pa.string())])
        return pa.array(rows, pa.struct([("faithful", pa.bool_()), ("letters", pa.int64()), ("removed", pa.int64()), ("inserted", pa.int64()), ("spans", pa.list_(span))]))

    return df.withColumn("content", run(F.col(before), F.col(after)))
