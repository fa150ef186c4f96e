"""PNG columns: exact round trip, checksums, all row filters, equal hashes for equal texts."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from obsynth.llm import media as M

TEXTS = ["", None, "abc", "é" * 96, "x" * 192, "word " * 5000, "same text", "same text"]


def test_every_filter_is_undone():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (40, 30), np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    filtered = rows.copy()
    for y in range(40):
        for x in range(30):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            filtered[y, x] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
    assert (M.unfilter_rows(kinds, filtered, 3) == rows).all()


def test_round_trip_and_checksums():
    payload = np.random.default_rng(1).integers(0, 256, 192 * 7, np.uint8).tobytes()
    png = M.write_png(payload)
    assert M.read_png(png).tobytes() == payload
    for at in range(8, len(png), 37):
        with pytest.raises(M.BadPng):
            M.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    for cut in (3, 20, len(png) - 3):
        with pytest.raises(M.BadPng):
            M.read_png(png[:cut])
    grey = M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + M._chunk(b"tEXt", b"note") + M._chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + M._chunk(b"IEND", b"")
    assert M.read_png(grey).tobytes() == b"abcd"


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, b"m", "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary, feature string")
    got = {r["doc_id"]: r for r in M.png_features(M.texts_to_png(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        assert r["error"] is None and r["hash"].hex() == r["feature"] and len(r["hash"]) == 8
    same = [tuple(got[i])[1:] for i in (6, 7)]
    assert same[0] == same[1]
    assert M.texts_to_png(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, b"no png", 5), (2, None, 6)], "doc_id long, media binary, payload_bytes long")
    assert [(r["doc_id"], r["payload_bytes"], bool(r["error"])) for r in M.png_features(bad).orderBy("doc_id").collect()] == [(1, None, True), (2, None, True)]
