import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.packing import SumIndex, cut, make_plan, pack, place, placements


def check(counts, room, slack=None):
    plan = make_plan(counts, room)
    used = Counter()
    for kind, n in plan.kinds:
        assert n > 0 and sum(kind) <= room
        for x in kind:
            used[x] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    length = np.array([x for x, n in counts.items() for _ in range(n)], dtype=np.int64)
    rank = np.array([r for n in counts.values() for r in range(n)], dtype=np.int64)
    if len(length):
        tiled(zip(*place(placements(plan), length, rank), length), room)
    if slack is not None:
        assert plan.sequences() <= -(-sum(k * n for k, n in counts.items()) // room) + slack


def tiled(rows, room):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 40).flatmap(lambda room: st.tuples(st.just(room), st.dictionaries(st.integers(1, room), st.integers(1, 30), max_size=20))))
def test_any_histogram(case):
    check(case[1], case[0])


def test_index_as_all_combinations():
    """What the index finds is available and sums up; where it finds nothing, no one, two or three lengths do."""
    rnd = random.Random(4)
    for _ in range(60):
        left = [0] + [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(30)]
        index = SumIndex(left)
        for _ in range(40):
            gap = rnd.randint(1, 30)
            have = [x for x in range(1, 31) for _ in range(min(3, left[x]))]
            sums = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(have, k)}
            found = index.exact(gap)
            assert (found is not None) == (gap in sums)
            if found:
                assert sum(found) == gap and all(left[x] >= n for x, n in Counter(found).items())
                for x in found:
                    left[x] -= 1


def test_nearly_full():
    rnd = random.Random(1)
    check(Counter(n for _ in range(20_000) for _, n in cut(rnd.randint(1, 5000), 2048)), 2048, slack=6)
    check({10: 5, 20: 5, 34: 5}, 64, slack=0)
    check({}, 64, slack=0)


def test_cut():
    for n in (1, 5, 6, 7, 11, 12, 13):
        parts = cut(n, 6)
        assert parts[0][0] == 0 and sum(p[1] for p in parts) == n and all(p[1] == 6 for p in parts[1:]) and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))


def test_documents(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["Über", "naïve", "word", "12", "漢字", "\n"]) for _ in range(rnd.randrange(400))), "c") for i in range(80)]
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    rows += [(94 + i, x, "c") for i, x in enumerate(["<|endoftext|>", "x<|endoftext|><|endoftext|>" * 50, "<|endoftext|", "é <|endoftext|>\n"])]
    rows += [(90, None, "c"), (91, "", "c"), (91, "", "c"), (None, "a <|endoftext|> b", "c"), (92, "ab " * 20_000, "c"), (93, " " * 9000 + "x" * 9000, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), room=128).collect()
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x, _ in rows]
    want = Counter((d, p, s, n, zlib.crc32(np.array(i[s : s + n], dtype="<u4").tobytes())) for d, i in ids for p, (s, n) in enumerate(cut(len(i), 128)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    tiled(((r.sequence_id, r.offset, r.length) for r in got), 128)
    assert len({r.sequence_id for r in got}) <= -(-sum(len(i) for _, i in ids) // 128) + 3


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
