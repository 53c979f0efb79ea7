import zlib
from collections import Counter

import numpy as np

from palimpsest.llm.sharding import jump, shard_documents


def one(key, shards):
    """The published loop, for one key."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 24, 1000):
        assert jump(keys, n).tolist() == [one(int(k), n) for k in keys]


def test_shards(spark):
    rows = [(i, f"tëxt {i}", 1) for i in range(3000)] + [(7, None, 2), (7, None, 2), (None, "", 3), (-5, "z" * 100_000, 4)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 24).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = {}
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    moved = Counter(r.grown_shard == 24 for r in got)[True] / len(got)
    assert 0.02 < moved < 0.06


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
