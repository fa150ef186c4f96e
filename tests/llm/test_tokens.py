"""Byte-pair codec against the tokenizers library, packing against its limits, both whole."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsynth.llm.bpe import BytePairCodec, default_vocabulary, encode_decode
from obsynth.llm.packing import Limits, pack_documents, pack_stream, turn_loss_start

ODD = ["", None, "aaaaaaaaaaa", " a\n\n b\t\t c   d", "it's don't we'll<|endoftext|>x <|endoftext|>\n", "日本語 １２３ ²½ é́ 🙂🙂", "\x1c x\x85y\xa0", "  \n ", "x" * 5000, "the end " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_codec_equals_library(library):
    codec, rng = BytePairCodec(default_vocabulary()), random.Random(1)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("abcdest 'lrv\n\t.!é１2²<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    made = codec.encode_batch(texts)
    for text, ids in zip(texts, made, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_codec_on_words_that_overflow_the_cache(library, monkeypatch):
    monkeypatch.setattr("obsynth.llm.bpe.CACHE_WORDS", 3)
    codec = BytePairCodec(default_vocabulary())
    for text in ("one two three four five", "six one seven", "five four"):
        assert np.frombuffer(codec.encode_batch([text])[0], "<u4").tolist() == library.encode(text).ids


def docs_of(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, offset long")


def test_codec_rows(spark, library):
    got = {r["doc_id"]: r for r in encode_decode(docs_of(spark, ODD + ODD[:1])).collect()}
    for i, text in enumerate(ODD):
        r, ids = got[i if i != 3 else None], library.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_decode(docs_of(spark, ODD).limit(0)).count() == 0


def test_packing_rows(spark, library):
    rows = pack_documents(docs_of(spark, ODD + ["the same text"] * 40).repartition(3)).collect()
    want = {i if i != 3 else None: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ODD + ["the same text"] * 40)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for key, ids in want.items():
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert pack_documents(docs_of(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [Limits(64, 3, 20), Limits(64, 64, 64), Limits(16, 1, 5)])
def test_packing_keeps_all_limits(limits):
    rng = random.Random(2)
    examples = [(i, n := rng.randint(1, 150), rng.randint(0, n)) for i in range(300)]
    held = defaultdict(int)
    for seq in pack_stream(examples, limits, window=16):
        assert 0 < sum(p.length for p in seq) <= limits.tokens
        assert len(seq) <= limits.segments
        assert sum(p.loss() for p in seq) <= limits.loss_tokens
        for p in seq:
            held[p.key] += p.length
    assert held == {k: n for k, n, _ in examples}


def test_loss_start_binds_in_spark(spark):
    rows = [(i, role, f"turn {i} has some words " * (1 + i % 7)) for i, role in enumerate(["user", "assistant"] * 60)] + [(900, "user", None)]
    turns = spark.createDataFrame(rows, "doc_id long, role string, text string").withColumn("from", turn_loss_start(F.col("role"), F.col("text")))
    limits = Limits(256, 64, 64)
    got = pack_documents(turns.coalesce(1), limits=limits, loss_col="from").collect()
    role = {d: r for d, r, _ in rows}
    sums = {}
    for p in got:
        assert p["loss_tokens"] == (p["length"] if role[p["doc_id"]] == "assistant" else 0)
        n, loss = sums.get(p["sequence_id"], (0, 0))
        sums[p["sequence_id"]] = n + p["length"], loss + p["loss_tokens"]
    assert all(loss <= 64 for _, loss in sums.values()) and any(loss == 64 and n > 64 for n, loss in sums.values())
    one = pack_documents(spark.createDataFrame([(1, "ask me answer", 6)], "doc_id long, text string, k int"), loss_col="k", with_ids=True).collect()
    assert 1 < sum(p["loss_tokens"] for p in one) < sum(p["length"] for p in one)


def test_short_sequences_need_no_padding():
    """Many short documents end sequences at the segment limit."""
    made = list(pack_stream(((i, 5, 0) for i in range(2000))))
    sizes = [sum(p.length for p in seq) for seq in made]
    assert sum(sizes) == 10_000 and all(n & (n - 1) == 0 for n in sizes) and max(len(seq) for seq in made) <= 64
