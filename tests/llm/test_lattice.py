import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm.lattice import Lattice, likelihoods, vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def cuts(word, pieces):
    """Every way to cut a word into pieces."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in cuts(word[n:], pieces):
                yield [word[:n], *rest]


def marginal(word, p):
    """The same sum as all cuts have, by the plainest recursion."""
    upto = [1.0] + [0.0] * len(word)
    longest = max(map(len, p))
    for e in range(1, len(word) + 1):
        upto[e] = math.fsum(upto[s] * p.get(word[s:e], 0.0) for s in range(max(0, e - longest), e))
    return upto[-1]


def test_all_cuts():
    pieces = sorted({b"a", b"b", b"c", b" ", b" a", b"ab", b"abc", b"bc", b"ca", b" ab"})
    p = dict(zip(pieces, np.random.default_rng(1).dirichlet(np.ones(len(pieces)))))
    words, counts = [b"abc", b"a", b"cabcab", b"bcaabcbc"], np.array([3, 1, 2, 5])
    logp = np.log([p[x] for x in pieces])
    want, usage = [], Counter()
    for w, c in zip(words, counts):
        found = [(cut, math.prod(p[x] for x in cut)) for cut in cuts(b" " + w, p)]
        total = sum(x for _, x in found)
        want.append(math.log(total))
        for cut, x in found:
            for piece in cut:
                usage[piece] += c * x / total
    lattice = Lattice(pieces)
    assert np.allclose(lattice.likelihood(words, logp), want)
    assert np.allclose(lattice.expected(words, counts, logp), [usage[x] for x in pieces])


def test_vocabulary():
    pieces, weights = vocabulary(PATH)
    assert len(set(pieces)) == len(pieces) > 30_000 and (weights > 0).all()
    assert all(bytes([b]) in pieces for b in range(256)) and b" the" in pieces and not any(b" " in p[1:] for p in pieces)


def brute(docs, rounds):
    pieces, weights = vocabulary(PATH)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = [WORD.findall(lower(t)) for _, t in docs]
    c = Counter(w for (d, _), ws in zip(docs, words) if not held(d) for w in ws)
    ends = sum(not held(d) for d, _ in docs)
    n, v = c.total() + ends, len(c) + (ends > 0)
    p, lattice, end = weights / weights.sum(), Lattice(pieces), 0.0
    for _ in range(rounds):
        usage = lattice.expected([w.encode() for w in c], np.array(list(c.values())), np.log(p)) + 1 if c else np.ones(len(pieces))
        whole = usage.sum() + ends + 1
        p, end = usage / whole, math.log10((ends + 1) / whole)
    by_piece = dict(zip(pieces, p))
    one = {w: math.log10(marginal(b" " + w.encode(), by_piece)) for ws in words for w in ws if len(w) < 60}
    out = []
    for (d, t), ws in zip(docs, words):
        base = math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        score = math.fsum(one[w] for w in ws) + end if all(w in one for w in ws) else None
        out.append((d, held(d), len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return out


DOCS = [(k, f"The quick fox {k} saw {k % 3} übergroße Füchse und 狐狸 am  Fluss\n\tagain {'x' * (k % 9)}") for k in range(40)]
DOCS += [(None, None), (None, "Null id"), (41, ""), (42, " \n"), (3, "same id, other text"), (3, "same id, other text"), (43, "quick " * 3000), (44, "unheardof wörds 𝄞 "), (45, "z" * 3000)]


@pytest.mark.parametrize("chunk, part", [(2_000_000, 1 << 20), (20, 50)])
def test_as_brute_force(spark, chunk, part):
    frame = spark.createDataFrame([(d, t, "x", 1.0) for d, t in DOCS], "doc_id long, text string, word string, score double").repartition(3)
    got = likelihoods(frame, rounds=2, chunk_words=chunk, part_bytes=part).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(DOCS, 2), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g[6]) and (w[6] is None or g[6] == pytest.approx(w[6], rel=1e-9))


def test_empty_and_unlearnt(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert likelihoods(none).count() == 0
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2]
    got = likelihoods(spark.createDataFrame([(d, "some text") for d in held], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in got)


def test_held_out(spark):
    """More rounds explain held-out texts better, and text like the corpus better than letters at random."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, three = (likelihoods(docs, rounds=n).where("held_out").agg({"score": "sum", "n_tokens": "sum"}).first() for n in (1, 3))
    assert three["sum(score)"] > one["sum(score)"]
    rng = np.random.default_rng(3)
    noise = [(-1 - k, " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(200))) for k in range(50)]
    mixed = likelihoods(docs.select("doc_id", "text").union(spark.createDataFrame(noise, "doc_id long, text string"))).where("held_out")
    rate = {r["noise"]: r["rate"] for r in mixed.selectExpr("doc_id < 0 as noise", "score / n_tokens as rate").groupBy("noise").agg({"rate": "avg"}).withColumnRenamed("avg(rate)", "rate").collect()}
    assert rate[False] > rate[True] + 1
