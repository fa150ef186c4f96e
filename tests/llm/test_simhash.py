"""Fingerprints by definition, and links against all pairs."""

import os
import random
import re

import pytest
import xxhash

from obsynth.llm import queries
from obsynth.llm import simhash as S
from obsynth.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def by_definition(text, words=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius):
    """Root of each of the distinct fingerprints."""
    values = sorted(set(prints))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    return {v: root(v) for v in values}


def brute(rows, radius=4):
    prints = [by_definition(t) for _, t in rows]
    root = groups(prints, radius)
    names = {}
    for (d, _), f in zip(rows, prints, strict=True):
        if d is not None:
            names[root[f]] = min(d, names.get(root[f], d))
    return sorted(((d, f"{f:016x}", names.get(root[f])) for (d, _), f in zip(rows, prints, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    assert found(queries.op13_tiled_simhash(spark, DATA)) == brute(rows)


@pytest.mark.parametrize("tile", [2048, 5])
def test_dense_and_odd_rows(spark, tile, monkeypatch):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "WORDS_AT_ONCE", 50)
    rng = random.Random(3)
    base = [f"word{rng.randint(0, 9999)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 60)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows.append((1000 - i, rng.choice([" ", "\n", "\t\r"]).join(w)))
    rows += [(5, None), (6, ""), (7, " \x0b\n"), (8, "One TWO"), (9, "one two"), (None, rows[0][1]), (None, "nobody else says this at all"), (3, rows[1][1]), (3, rows[1][1]), (10, "é ü"), (11, "a b")]
    rows += [(20, "many " * 20_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, bits string, component_id int").repartition(4)
    assert found(S.simhash_groups(docs)) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_links(spark, radius, monkeypatch):
    monkeypatch.setattr(S, "TILE", 64)
    monkeypatch.setattr(S, "ROWS_AT_ONCE", 16)
    rng = random.Random(radius)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = S.near_fingerprints(spark.createDataFrame(signed, "bits long").repartition(3), radius).collect()
    joined = groups(values, radius)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in ((r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges):
        up[root(a)] = root(b)
    parts = lambda of: sorted(sorted(v for v in values if of(v) == k) for k in {of(v) for v in values})
    assert parts(root) == parts(joined.get)


def test_no_rows(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
