"""Spelling variants against all pairs in Python, on the given texts and on made-up words."""

import os
import random
import re
import zlib
from collections import Counter

import pytest

from obsynth.llm import queries
from obsynth.llm import spelling as S
from obsynth.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, factor=5):
    by_part, near = {}, {w: set() for w in n}
    for w in n:  # words one edit apart share a word made by leaving out one letter at most
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_part.setdefault(v, []).append(w)
    for group in by_part.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query(spark):
    n = Counter()
    for r in table(spark, DATA, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    got = found(queries.op11_gram_spelling(spark, DATA))
    assert len(got) > 100 and got == brute(n)


@pytest.mark.parametrize("tile", [1024, 7])
def test_made_up_words(spark, tile, monkeypatch):
    monkeypatch.setattr(S, "TILE_WORDS", tile)
    rng = random.Random(tile)
    words = {"a", "b", "ab", "ß", "x" * 3000, "x" * 3001, "x" * 2999 + "y", "日本語", "日本誤", "𝔘nicode", "Unicode", "abcdef", "bacdef"}
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    for w in base:
        words.add(w)
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("abcdéz")
            words |= {w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]} - {""}
    n = {w: rng.choice([1, 2, 3, 10, 10, 50, 300, 2000]) for w in words}
    rows = [(w, k, 1) for w, k in n.items()] + [(None, 3, 1), ("", 9, 1), ("nothing", None, 1)]
    got = found(S.spelling_variants(spark.createDataFrame(rows, "word string, n long, form int").repartition(5)))
    assert got == brute(n)


def test_runs(spark):
    docs = spark.createDataFrame([(1, "Été, ÀLPHA×beta don't", 5), (None, "abcdefg", 1), (2, None, 1), (3, "", 1), (4, "a" * 200_000, 1)], "doc_id long, text string, run int")
    got = [(r["doc_id"], r["run"]) for r in S.letter_runs(docs, 3).collect()]
    assert sorted(got, key=repr) == sorted([(1, "Été"), (1, "Àlpha×beta"), (1, "don"), (None, "abcdefg"), (4, "a" * 200_000)], key=repr)
    one = S.misspelt(spark.createDataFrame([(None, "abcdefg"), (7, "ab")], "doc_id long, run string"), 1).collect()
    h, g = zlib.crc32(b":abcdefg") % 7, zlib.crc32(b"7:ab") % 2
    assert [r["run"] for r in one] == ["abcdefg"[:h] + "abcdefg"[h + 1 :], "ab"[:g] + "ab"[g + 1 :]]


def test_no_words(spark):
    assert S.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert found(S.spelling_variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == [("alone", None, "alone", 3, 0, None)]
