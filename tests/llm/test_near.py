import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lm_scoring, minhash
from corvane.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op10_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(QUERIES["op10_minhash_near_dedup"](spark, sf_dir)) == brute_force(rows, 2)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_around_the_threshold(spark, k):
    """One base with copies of many mutation rates: pairs lie on both sides of the threshold, so the residual stage runs."""
    rnd = random.Random(k)
    base = [f"w{rnd.randrange(3000)}" for _ in range(240)]
    rows = []
    for i in range(220):
        own = list(base)
        for j in rnd.sample(range(240), rnd.randint(0, 40 // k)):
            own[j] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own).upper() if i % 3 else "\t".join(own)))
    rows += [(1000 + i, " ".join(f"y{rnd.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    expected = brute_force(rows, k)
    assert len({c for _, c in expected.values()}) > 60
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k)) == expected


def test_near_duplicate_edges(spark):
    rows = [(1, "one"), (2, "ONE"), (3, None), (4, ""), (5, " \n"), (6, "one one"), (7, "é ünï"), (8, "É ünï"), (9, "word " * 50_000), (10, "word " * 40_000), (11, "x" * 500_000), (12, "x" * 500_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    assert found(minhash.near_duplicates(docs, 2)) == brute_force(rows, 2)
    more = docs.union(spark.createDataFrame([(None, "one", ""), (1, "one", "")], docs.schema))
    out = minhash.near_duplicates(more, 2).collect()
    assert len(out) == len(rows) + 2 and all(r.kept for r in out if r.doc_id in (None, 1))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.drop_near_copies(docs, 2)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 11]


def test_drop_near_copies_of_one_id(spark):
    """Rows that share an id go or stay by their own texts."""
    rows = [(1, "a b c d"), (2, "A b c d"), (2, "q r s t"), (2, "q r s t"), (None, "a b c d"), (3, None), (3, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "digest": F.lit("d"), "__id": F.lit(2), "row": F.lit("r"), "sum": F.lit(0)})
    left = minhash.drop_near_copies(docs, 2)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in left.collect()))
    assert got == [(0, "a b c d"), (1, "a b c d"), (2, "q r s t"), (2, "q r s t"), (3, "")], got


def test_word_hashes_tell_words_apart():
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(20_000)} | {"A" * n + "b" for n in range(300)}
    _, hashes = minhash.word_hashes(" ".join(words).encode())
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len({w.lower() for w in words})


def test_similar():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert minhash.similar(a, b, 90) and not minhash.similar(a, b, 91) and not minhash.similar(a[:0], b[:0], 0)


def test_tensored_recall():
    """Pairs at the threshold meet in some table as often as the formula says."""
    rnd = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        common, x, y = rnd.integers(0, 2**63, 160, np.uint64), rnd.integers(0, 2**63, 20, np.uint64), rnd.integers(0, 2**63, 20, np.uint64)
        flat, offsets = np.concatenate([np.sort(np.append(common, x)), np.sort(np.append(common, y))]), np.array([0, 180, 360])
        _, _, bands = minhash.signatures(flat, offsets)
        same = bands[0] == bands[1]
        met += bool(same[: minhash.SIDE].any() and same[minhash.SIDE :].any())
    assert met >= 297


def test_lm_scoring(spark):
    rnd = random.Random(2)
    science, other = [f"s{k}" for k in range(50)], [f"o{k}" for k in range(50)]
    text = lambda words: " ".join(rnd.choice(words) for _ in range(60))
    rows = [(i, text(science), True) for i in range(40)] + [(100 + i, text(other), False) for i in range(80)] + [(300 + i, text(science), False) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(3)
    models = lm_scoring.fit(docs)
    scores = {r.doc_id: r.score for r in lm_scoring.score(docs, models).collect()}
    assert max(s for i, s in scores.items() if i >= 300) < min(s for i, s in scores.items() if 100 <= i < 300)
    assert abs(unigrams(models)[0].sum() - unigrams(models)[1].sum()) < 1
    # counts against brute force
    counted = sum(len(t.split()) for _, t, w in rows if w)
    assert unigrams(models)[1].sum() == counted == bigrams(models)[1].sum()
    other_split = lm_scoring.fit(docs.coalesce(1))
    assert np.array_equal(bigrams(models), bigrams(other_split))


def test_lm_scoring_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "c"), (2, "", True, "c"), (3, "a b", True, "c"), (3, "a b", True, "c"), (None, "long " * 100_000, False, "c")], "doc_id long, text string, is_target boolean, score string")
    models = lm_scoring.fit(docs)
    rows = lm_scoring.score(docs, models).collect()
    assert [r.n_tokens for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id))] == [0, 0, 2, 2, 100_000]
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)
    assert lm_scoring.score(docs.limit(0), lm_scoring.fit(docs.limit(0))).count() == 0


def test_op4_equals_brute_force(spark):
    # more distinct pairs and words than 2 ** 20 and 2 ** 17: every n-gram has a count of its own
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rnd.expovariate(1 / 60_000)), 400_000)}" for _ in range(3_000)), i % 3 == 0) for i in range(400)] + [(400, None, True), (401, "W1 w1\tw1 ", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(4)
    models = lm_scoring.fit(docs)
    words, pairs, texts = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    split = {i: WORDS.findall((t or "").translate(LOWER)) for i, t, _ in rows}
    for i, _, wanted in rows:
        for m in range(1 + wanted):
            words[m].update(split[i])
            pairs[m].update(zip([None, *split[i]], split[i]))
            texts[m] += bool(split[i])
    mass = [c.total() for c in words]
    assert models.mass == tuple(mass) and models.words == len(words[0]) > 1 << 17 and bigrams(models).shape[1] == len(pairs[0]) > 1 << 20
    scale, v = [mass[1] / mass[0], 1.0], len(words[0]) + 1
    for r in lm_scoring.score(docs, models).collect():
        own = split[r.doc_id]
        if not own:
            assert r.score is None
            continue
        mean = []
        for m in range(2):
            p1 = {w: (words[m][w] * scale[m] + 0.5) / (mass[1] + 0.5 * v) for w in own}
            before = lambda w: (texts[m] if w is None else words[m][w]) * scale[m]  # noqa: B023, E731
            mean.append(sum(-np.log((pairs[m][a, b] * scale[m] + 4 * p1[b]) / (before(a) + 4)) for a, b in zip([None, *own], own)) / len(own))
        assert np.allclose([r.background_loss, r.target_loss, r.score], [*mean, mean[1] - mean[0]], rtol=1e-9)


def whole(models):
    """The scaled counts of both models (2, keys), and which keys are pairs and words."""
    rows = [[lm_scoring.unpacked(bytes(r[c]), c == "keys") for c in ("keys", "background", "target")] for r in models.table.orderBy("part").collect()]
    keys, *counts = (np.concatenate([np.zeros(0, np.uint64), *(r[k] for r in rows)]) for k in range(3))
    pair = (keys & np.uint64(1)).astype(bool)
    return np.stack([c * s for c, s in zip(counts, models.scale, strict=True)]), pair, ~pair & (keys != lm_scoring.start_key(models.bits[0]))


def unigrams(models):
    counts, _, word = whole(models)
    return counts[:, word]


def bigrams(models):
    counts, pair, _ = whole(models)
    return counts[:, pair]


def test_op4_query_equals_brute_force(spark, sf_dir):
    """Losses of every document from plain counts of words and pairs."""
    import math
    import re
    from collections import Counter

    from corvane.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    words = {k: re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for k, t in docs.items()}
    models = []
    for own in (words, {k: w for k, w in words.items() if k in wanted}):
        models.append((Counter(x for w in own.values() for x in w), Counter(p for w in own.values() for p in zip([None, *w], w, strict=False)), sum(1 for w in own.values() if w)))
    mass = [sum(one.values()) for one, _, _ in models]
    scale, kinds = (mass[1] / mass[0], 1.0), len(models[0][0]) + 1
    rows = QUERIES["op4_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = words[r.doc_id]
        assert r.n_tokens == len(own)
        means = []
        for (one, two, texts), s, m in zip(models, scale, mass, strict=True):
            loss = 0.0
            for before, x in zip([None, *own], own, strict=False):
                p = (one[x] * s + lm_scoring.FLOOR) / (m * s + lm_scoring.FLOOR * kinds)
                loss -= math.log((two[before, x] * s + lm_scoring.BACKOFF * p) / ((texts if before is None else one[before]) * s + lm_scoring.BACKOFF))
            means.append(loss / len(own))
        assert abs(r.background_loss - means[0]) < 1e-9 and abs(r.target_loss - means[1]) < 1e-9 and abs(r.score - (means[1] - means[0])) < 1e-9
