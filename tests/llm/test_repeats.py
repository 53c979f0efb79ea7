import hashlib
import random

import numpy as np

from palimpsest.llm.common import Workspace
from palimpsest.llm.repeats import doubled_ranks, leftmost_least, parts, remove_repeats, runs


def brute(rows):
    rows = sorted(rows)
    seen, out = {}, []
    for k, (_, b) in enumerate(rows):
        for j in range(len(b) - 99):
            seen.setdefault(b[j : j + 100], (k, j))
    for k, (d, b) in enumerate(rows):
        gone = np.zeros(len(b) + 2, dtype=bool)
        for j in range(len(b) - 99):
            if seen[b[j : j + 100]] < (k, j):
                gone[j + 1 : j + 101] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(60)
    texts = [base, base, "", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "z" * 450, "ab" * 300, "0123456789" * 30 + "!" + "0123456789" * 30, base[7:], base[:-7]]
    for k in range(40):
        words = base.split()
        for _ in range(k % 6):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [prose(rnd.randint(0, 80)) + passage[: rnd.randint(90, len(passage))] + prose(rnd.randint(0, 80)) for _ in range(40)]
    texts += [passage[k : k + 100 + k % 3] + "#" + passage[k : k + 140] for k in range(0, 120, 7)]
    rnd.shuffle(texts)
    return [(i * 3 - 50, t.encode()) for i, t in enumerate(texts)]


def test_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t.decode(), 1) for d, t in rows], "doc_id long, text string, n_spans int").repartition(5)
    assert sorted(map(tuple, remove_repeats(df).collect())) == brute(rows)


def test_runs():
    """Runs are a partition of the windows, and none holds one window twice."""
    for text in (b"a" * 300, b"abc" * 90, bytes(range(256)), b"q" * 100, b"q" * 99):
        key, whole, j, size, at = runs(text)
        assert sum(size) == max(0, len(text) - 99) and all(j[1:] == (j + size)[:-1]) and all((at >= size - 1) & (at <= 52))
        for a, n, p in zip(j.tolist(), size.tolist(), at.tolist()):
            own = text[a : a + n + 99]
            got = parts(own, a, n, p)
            assert sum(g[3] for g in got) == n and all(g[3] <= 13 and len(g[4]) == g[3] + 99 for g in got)
            assert len({own[w : w + 100] for w in range(n)}) == n
    x = np.array([3, 1, 1, 2, 0, 0, 5], dtype=np.uint64) << np.uint64(40)
    assert leftmost_least(x, 3).tolist() == [1, 1, 4, 4, 4]


def test_parts_of_a_long_text(monkeypatch):
    """Texts longer than the places have bits for are done in parts with the same result."""
    x = np.random.default_rng(2).integers(0, 30, 500).astype(np.uint64) << np.uint64(50)
    whole = leftmost_least(x, 53)
    monkeypatch.setattr("palimpsest.llm.repeats._PLACE_BITS", 7)
    assert (leftmost_least(x, 53) == whole).all() and len(whole) == 448


def test_edges(spark):
    long = "0" * 150_000
    rows = [(1, None), (None, "k" * 120), (2, "k" * 120), (3, "m" * 100), (3, "m" * 100), (4, "n" * 50 + "p" * 60), (4, "p" * 60 + "n" * 50), (5, long)]
    got = {}
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert got == {1: [(0, 0, 0)], None: [(120, 119, 1)], 2: [(120, 120, 1)], 3: [(100, 0, 0)] * 2, 4: [(110, 0, 0)] * 2, 5: [(150_000, 149_999, 1)]}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_doc_id(spark):
    """Many texts without a doc_id are each their own document, whatever their hashes."""
    rnd = random.Random(3)
    rows = [(None, "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(100, 160)))) for _ in range(300)]
    rows += [(5, rows[7][1] + "#" + rows[200][1]), (5, "another text of five"), (6, "x" * 40)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    five = len(rows[7][1]) + len(rows[200][1])
    assert got == sorted([("None", len(t), 0) for d, t in rows if d is None] + [("5", five + 1, five), ("5", 20, 0), ("6", 40, 0)])


def test_doubled_ranks(spark):
    """Prefix doubling as such finds the same positions as comparing all windows."""
    rows = corpus()[:40]
    seen, want = {}, set()
    for d, b in sorted(rows):
        for j in range(len(b) - 99):
            first = seen.setdefault(b[j : j + 100], (d, j))
            if first != (d, j):
                want.add((d, j, *first))
    df = spark.createDataFrame([(d, b.decode()) for d, b in rows], "doc_id long, text string")
    assert set(map(tuple, doubled_ranks(Workspace(spark), df).collect())) == want
