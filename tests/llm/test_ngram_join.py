"""The Jaccard join against all pairs in Python, on copies, near copies, ties and odd rows."""

import random
import re

import pytest

from obsynth.llm import ngram_join as N


def brute(rows, words, percent):
    def grams(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + rng.choice("cdefg") + rng.choice("hijkl") + rng.choice(["", "ß", "x"])
    line = [word() for _ in range(14)]
    bases = [[word() for _ in range(rng.randint(1, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = line + w
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(900, ""), (901, None), (902, " \n"), (903, "one TWO"), (904, "ONE two"), (905, rows[3][1]), (None, rows[4][1]), (None, "alone here"), (7, rows[9][1]), (7, rows[9][1])]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 3, 70)])
def test_equals_all_pairs(spark, seed, words, percent, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(N, "SALT_ROWS", 8)  # frequent n-grams are dealt out in several parts
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, node int, component_id string")
    got = N.near_duplicates(docs.repartition(4), N.Similarity(words, percent))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, words, percent)


def test_chain_of_near_copies(spark):
    """Each document is near the next alone; the component is the whole chain."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(docs, N.Similarity(4, 85)).collect()), key=repr)
    assert got == brute(rows, 4, 85) and {r[2] for r in got} == {0}


def test_pairs_across_salts(spark, monkeypatch):
    """A passage and the passage with one more word share n-grams that longer documents make frequent;
    each of the two may be alone in its salt, the first one included."""
    monkeypatch.setattr(N, "SALT_ROWS", 1)
    rows = []
    for g in range(24):
        passage = " ".join(f"p{g}x{i}" for i in range(9))
        rows += [(100 * g, passage), (100 * g + 1, f"{passage} more{g}")]
        rows += [(100 * g + k, f"{passage} " + " ".join(f"q{g}y{k}z{i}" for i in range(40))) for k in range(2, 10)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), N.Similarity(4, 85))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 4, 85)


def test_common_passage_and_very_long_texts(spark):
    """Documents of different lengths made of stretches of one passage, and texts of 60,000 words."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(150):
        a = rng.randrange(250)
        rows.append((i, " ".join(passage[a : a + rng.randint(10, 50)] + [f"o{i}x{k}" for k in range(rng.choice([0, 0, 3, 40]))])))
    long = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:-2000])), (502, " ".join(long[:30_000]))]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), N.Similarity(4, 85))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 4, 85)


def test_no_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = N.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2)]
