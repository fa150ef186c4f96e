"""Repair against a plain search over all edits, and the report of the given conversations."""

import functools
import hashlib
import os
import random
import re
import zlib

import pytest

from obsynth.llm import dialogue as D
from obsynth.llm import queries
from obsynth.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """rows: (role, fault) with fault 0, 1 (has to go) or 2 (breaks off)."""
    done = re.compile("(s?(ua)+)?")
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "", ("p", "u"): "u"}  # p: pairs complete

    def move(state, kind):
        return "p" if (state, kind) == ("u", "a") else step.get((state, kind))

    @functools.cache
    def best(i, state, inserts):
        out = [(0, "")] if i == len(rows) and state in ("", "p") else []
        if inserts < 3:
            out += [(3 + c, "I" + a) for k in "ua" if (s := move(state, k)) is not None for c, a in [best(i, s, inserts + 1)] if c < 1e8]
        if i < len(rows):
            role, fault = rows[i]
            out += [(4 + c, "D" + a) for c, a in [best(i + 1, state, 0)]]
            if fault != 1:
                more = 3 * (fault == 2)
                if (s := move(state, role[:1])) is not None:
                    out += [(more + c, "K" + a) for c, a in [best(i + 1, s, 0)]]
                for k in "ua":
                    if (s := move(state, k)) is not None:
                        out += [(3 + more + c, "R" + a) for c, a in [best(i + 1, s, 0)]]
        return min(out, default=(1e9, ""))

    assert done.fullmatch("suaua")
    return best(0, "", 0)


def brute(conversations, ids):
    """conversations: (conv_id, turn, role, text), not yet in order."""
    out = []
    for conv in ids:
        rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations if c == conv]
        digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
        rows.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), digest(z[1], z[2])))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            inked = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0
            if not inked:
                counts[0] += 1
                fault = 1
            elif (role, text) in seen:
                counts[1] += 1
                fault = 1
            elif inked[-1] not in ".!?":
                counts[2] += 1
                fault = 2
            seen.add((role, text))
            faults.append((role, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = cheapest(tuple(faults))
        made, i = [], 0
        for e in audit:
            want = "assistant" if made and made[-1][0][0] == "u" else "user"
            if e == "I":
                made.append((want, ""))
                continue
            _, role, text = rows[i]
            i += 1
            if e != "D":
                made.append((role if e == "K" else want, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = found(queries.op12_grammar_repair(spark, DATA))
    assert len(got) > 5 and got == brute(hurt(rows), {r[0] for r in rows})


ROLES = ["user", "assistant", "system", "tool", "", None, "ulf"]
TEXTS = ["Yes.", "No!", "Why?", "broken off", "", " \n", None, "Ends. \t", "x" * 5000 + ".", "Ünï. é"]


@pytest.mark.parametrize("seed", range(3))
def test_odd_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(conv, rng.choice([None, *range(9)]), rng.choice(ROLES[: rng.choice([2, 3, 7])]), rng.choice(TEXTS)) for conv in [None, *range(120)] for _ in range(rng.randint(0, 9))]
    rows += [(500, t, "user", f"{t}.") for t in range(30)] + [(501, 2**40, "assistant", "A.")]
    rows = rng.sample(rows, len(rows))
    ids = [(i,) for i in [None, *range(120), 500, 501, 777, 777]]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, tag int, audit string").repartition(4)
    got = found(D.conversation_report(frame, spark.createDataFrame(ids, "conv_id long")))
    assert got == brute(rows, {i for i, in ids})


def test_long_conversation():
    """Costs and audits do not depend on the grammar, nor on the length."""
    rng = random.Random(1)
    for n in (1, 17, 400):
        symbols = bytes(rng.choice([3, 6, 3, 6, 3, 6, 0, 9, 4, 5, 8]) for _ in range(n))
        plain = D.Grammar()
        rules = D.Grammar((bytes([3, 6]), bytes([12, 12]), bytes([6, 3]), bytes([13, 13])))
        a, b = (D.cheapest(symbols, g, g.matrices()) for g in (plain, rules))
        rows = tuple(("suax"[s // 3], s % 3) for s in symbols)
        assert a == b and (n > 100 or a == cheapest(rows))


def test_very_long_conversation():
    symbols = bytes([3, 6, 4, 8]) * 20_000
    cost, audit = D.cheapest(symbols, D.Grammar(), D.Grammar().matrices())
    assert cost > 0 and sum(c != "I" for c in audit) == len(symbols)


def test_grammar_is_learned(spark):
    frame = spark.createDataFrame([(bytes([3, 6, 3, 6, 3, 6, 3, 6]), 5), (bytes([0, 3, 6]), 2), (b"", 9)], "symbols binary, weight long")
    g = D.learn_grammar(frame)
    assert g.rules and len(g.rules) <= 256 - D.TERMINALS and len(g.compress(bytes([3, 6] * 4))) == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.conversation_report(none).count() == 0
    got = found(D.conversation_report(none, spark.createDataFrame([(1,)], "conv_id long")))
    assert got == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
