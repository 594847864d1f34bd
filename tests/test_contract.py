"""What a cleaner takes away or adds, against brute force; running heads."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import contract, heads


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def check(a, b, exact=True):
    found = list(contract.changes(a, b))
    out, at = [], 0
    for x, i, y, j in found:
        out += [a[at:x], b[y:j]]
        at = i
    assert "".join([*out, a[at:]]) == b
    if exact:
        n = lcs(a, b)
        assert sum(i - x for x, i, _, _ in found) == len(a) - n and sum(j - y for *_, y, j in found) == len(b) - n


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
@settings(max_examples=300, deadline=None)
def test_short_texts_have_the_least_difference(a, b):
    check(a, b)
    assert contract.is_subsequence(b, a) == (lcs(a, b) == len(b))
    assert contract.common_start(a, b) == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def edited(rnd, a, n):
    for _ in range(n):
        k, m = rnd.randrange(len(a) + 1), rnd.randrange(1, 30)
        a = a[:k] + ("" if rnd.random() < 0.5 else "".join(rnd.choices("abcdefgh", k=m))) + a[k + m * (rnd.random() < 0.7) :]
    return a


def test_anchors_give_the_least_difference_too():
    rnd = random.Random(3)
    for _ in range(6):
        a = "".join(rnd.choices("abcdefgh", k=1500))
        check(a, edited(rnd, a, 12))


def test_long_texts_are_linear():
    rnd = random.Random(4)

    def took(n):
        a = "".join(rnd.choices("abcdefghijklmnop", k=n))
        b = "".join(a[k : k + 900] for k in range(0, n, 1000)) + "zz"
        began = time.perf_counter()
        check(a, b, exact=False)
        assert sum(i - x for x, i, _, _ in contract.changes(a, b)) == n // 10
        return time.perf_counter() - began

    small = took(500_000)
    assert took(5_000_000) < 30 * max(small, 0.3)
    check("ab" * 1_000_000, "ba" * 900_000, exact=False)  # nothing that occurs once


def test_compared():
    got = contract.compared("A ﬁne “day”, [12] done\n", 'A fine "day", done!')
    assert got == {"faithful": True, "letters": 14, "removed": 2, "inserted": 0, "spans": [{"kind": "removed", "at": 8, "text": "12"}]}
    assert contract.compared("abc", "axc")["faithful"] is False and contract.compared(None, None) == {"faithful": True, "letters": 0, "removed": 0, "inserted": 0, "spans": []}


def test_content_contract_edges(spark):
    rows = [(1, None, "x"), (2, "x", None), (2, "x", None), (3, "", ""), (4, "a b", "ab")]
    df = spark.createDataFrame(rows, "i int, content_before string, after string")
    got = sorted((r.i, r.content.faithful, r.content.removed, r.content.inserted) for r in contract.content_contract(df, "content_before", "after").collect())
    assert got == [(1, False, 0, 1), (2, True, 1, 0), (2, True, 1, 0), (3, True, 0, 0), (4, True, 0, 0)]
    assert contract.content_contract(df.limit(0), "content_before", "after").collect() == []


def test_running_heads(spark):
    def page(doc, n, body):
        return doc, n, f"{'The Book of Rocks' if n % 2 else f'Chapter {n // 4}'}   {n}\n\n{body}\nThe book of rocks 7\nx\ny\nz\n{n}\n"

    rows = [page("a", n, f"body {'of' * n}\nmore {'so' * n}") for n in range(1, 9)] + [page("b", 1, "short"), page("b", 2, "short"), ("c", 1, None), ("c", 2, ""), ("c", None, "\n\n"), (None, 1, "t"), (None, 3, "t"), (None, 5, "t"), (None, 5, "t")]
    df = spark.createDataFrame(rows, "doc string, page int, text string").withColumns({"key": F.lit(1), "odd": F.lit(2), "lines": F.lit(3)})
    out = heads.drop_running_heads(df, "doc", "page")
    assert out.columns == df.columns
    got = {(r.doc, r.page): r.text for r in out.collect()}
    assert len(out.collect()) == len(rows)
    for n in range(1, 9):
        assert got["a", n] == f"\nbody {'of' * n}\nmore {'so' * n}\nThe book of rocks 7\nx\n"  # y and z stand at the edge of every page, too
    assert got["b", 1] == page("b", 1, "short")[2] and got["c", 1] is None and got["c", 2] == "" and got["c", None] == "\n\n"
    assert got[None, 1] == got[None, 5] == ""  # a line of three pages
    assert heads.drop_running_heads(df.limit(0), "doc", "page").collect() == []


def test_long_repeating_texts_have_the_least_difference():
    rnd = random.Random(9)
    lines = ["".join(rnd.choices("abcdefgh", k=40)) for _ in range(12)]
    a = "".join(rnd.choice(lines) + "12" * rnd.randrange(40) for _ in range(3000))
    b = a.replace("12", "")
    assert len(a) * len(b) > contract.MOST
    for after, inserted in ((b, 0), (b[:5000] + "zzzz" + b[5000:], 4), (b + "2", 0), (b[:70_000] + "zz" + b[70_000:] + "h" * 3, 5)):
        found = contract.changes(a, after)
        check(a, after, exact=False)
        assert sum(j - y for *_, y, j in found) <= inserted
        assert sum(i - x for x, i, _, _ in found) <= len(a) - len(after) + inserted
    assert contract.compared(a, b)["inserted"] == 0 and contract.compared(a, b)["faithful"]


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
@settings(max_examples=300, deadline=None)
def test_few_insertions_are_the_least(a, b):
    found = contract.few_insertions(a, b, len(b) + 1)
    n = lcs(a, b)
    assert sum(j - y for *_, y, j in found) == len(b) - n and sum(i - x for x, i, *_ in found) == len(a) - n
    assert contract.few_insertions(a, b, len(b) - n) is None


@given(st.text("abc", max_size=40), st.lists(st.integers(0, 39), max_size=40))
@settings(max_examples=300, deadline=None)
def test_what_is_only_taken_away_is_found_as_the_bit_vectors_do(a, gone):
    b = "".join(c for k, c in enumerate(a) if k not in gone)
    found = contract.embedded(a, b)
    assert found is not None
    longer = contract.exact_changes(a, b + "z")  # z, which a lacks, leaves these to the bit vectors
    assert [(x, i) for x, i, *_ in found] == [(x, i) for x, i, *_ in longer if i > x]
    assert contract.embedded(a, b + "z") is None


def test_what_is_only_taken_away_needs_no_table():
    import tracemalloc

    a = "abcdefghij" * 6_000
    tracemalloc.start()
    found = contract.exact_changes(a, a.replace("j", ""))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(i - x for x, i, *_ in found) == 6_000 and peak < 20 << 20


def test_letters_take_little_time():
    contract.letters("")
    text = "Состав (вод), 12 “x” ﬁ² _ 𝐀 " * 150_000
    began = time.perf_counter()
    assert contract.letters(text) == "Составвод12xfi2A" * 150_000
    assert time.perf_counter() - began < 2


def test_stretches_that_occur_once():
    rnd = random.Random(2)
    for k in (8, 16, 32):
        a = "".join(rnd.choices("ab", k=3000))
        b = a[:900] + a[1000:2000] + "c" * 9 + a[2000:]
        once = lambda s, k=k: {s[i : i + k]: i for i in range(len(s) - k + 1) if s.count(s[i : i + k]) == 1 and s.find(s[i : i + k], s.find(s[i : i + k]) + 1) < 0}
        of_a, of_b = once(a), once(b)
        expected = {(of_a[t], j) for t, j in of_b.items() if t in of_a and j % k == 0}
        got = contract.anchors(a, b, k)
        assert set(got) <= expected and got == sorted(got) and (k == 8 or set(got) == expected)
    assert contract.anchors("ab" * 100, "ab" * 90, 8) == []
