import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from palimpsest.llm.importance import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, runs):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, runs, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(d, *grams(t, runs)) for d, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in found for g in gs), Counter(bucket(g) for x in target for g in grams(x, runs)[1])
    s_all, t_all, out = s.total(), t.total(), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    for d, n, gs in found:
        weight = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    rank = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        rank.setdefault(id(r), k + 1)
    return sorted(((d, f, w, s, rank.get(id(r))) for r in out for d, _, f, w, s in [r]), key=str)


def docs():
    rows = [(d, " ".join(f"W{(d * k) % 97} été,x" for k in range(5 + d % 40))) for d in range(300)]
    rows += [(None, None), (None, "a " * 30), (301, ""), (302, "?!"), (7, "same id, other text " * 9), (303, "x" * 5000 + " " + "the end " * 20_000), (304, "中文 字 " * 15)]
    return rows + [(5, "copy of a row " * 20)] * 60


TARGET = ["w1 w2 w3 the end of a target", None, "", "x été w7 w7 w7 " * 50]


@pytest.mark.parametrize("runs, chunk, part", [(1, 2_000_000, 1 << 20), (1, 50, 64), (3, 400, 100)])
def test_as_brute_force(spark, runs, chunk, part):
    rows = docs()
    frame = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, rank int, word string").repartition(3)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = resample(frame, target, runs=runs, percent=37, chunk_words=chunk, part_bytes=part)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, TARGET, runs, percent=37)


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(docs(), "doc_id long, text string")
    assert resample(none, some).count() == 0
    assert sorted(map(tuple, resample(some, none, percent=100).collect()), key=str) == brute(docs(), [], 1, percent=100)
    assert resample(some, none, percent=0).where("rank is not null").count() == 0


def test_equal_scores_rank_by_id(spark):
    """Rows alike, and rows of one doc_id: ranks are gapless and without repeats."""
    rows = [(1, "a b c d e " * 10)] * 50 + [(1, "a b c d e " * 11)] * 50 + [(2, "a b c d e " * 10)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resample(frame, frame, percent=50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 52))
