import random

import pytest

from palimpsest.llm import nearcopies
from palimpsest.llm.nearcopies import Plan, near_copies, one_of_similar
from palimpsest.llm.simhash import one_of_each

SCHEMA = "doc_id long, text string, sketch string, node int"


def brute(rows, words=5, similarity=0.8):
    """By the definition: every pair of texts by their sets of shingles, then the smallest doc_id reachable."""

    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in rows]
    kinds = sorted(set(s for _, s in sets), key=lambda s: (len(s), sorted(s)))
    comp, changed = {s: i for i, s in enumerate(kinds)}, True
    holders = {}
    for s in kinds:
        for x in s:
            holders.setdefault(x, []).append(s)
    near = {(a, b) for a in kinds for b in {t for x in a for t in holders[x]} if a != b and 10 * len(a & b) >= 10 * similarity * len(a | b)}
    while changed:
        changed = False
        for a, b in near:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    least = {}
    for d, s in sets:
        least[comp[s]] = min(least.get(comp[s], d), d)
    return sorted((d, least[comp[s]]) for d, s in sets)


def corpus():
    """Families of a hundred copies with 0 to 12 words changed, unrelated texts, short and wordless ones, and a very long one."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "two words"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "A b\tc d e  f G")]
    for family in range(4):
        base = [word() for _ in range((40, 150, 300, 600)[family])]
        for i in range(100):
            words = list(base)
            for _ in range(i % 13):
                words[rnd.randrange(len(words))] = word()
            rows.append((1000 * (family + 1) - i, " ".join(words)))
    rows += [(9000 + i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(100)]
    return rows + [(9999, "Long " * 50_000)]


@pytest.mark.parametrize("pairwise", [64, 2])
def test_as_brute_force(spark, pairwise):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, near_copies(df, pairwise=pairwise).collect()))
    assert got == brute(rows)
    kept = one_of_similar(df, pairwise=pairwise)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})


def test_pairs_at_the_threshold(spark):
    """Each pair stands alone, so that no third text helps: of pairs of 0.8 to 0.85 at most one in 25 is missed, and none below links."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    rows = []
    for i in range(600):
        base = [word() for _ in range(rnd.randrange(60, 400))]
        other = list(base)
        # a word changed costs five shingles of either text
        for k in rnd.sample(range(len(base) // 8), round(len(base) * rnd.uniform(0.012, 0.03))):
            other[8 * k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = dict(brute(rows))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [d for d in want if want[d] != d]
    missed = [d for d in linked if got[d] != want[d]]
    assert len(linked) > 150 and len(missed) * 25 <= len(linked), (len(linked), len(missed))
    assert all(got[d] == d for d in want if want[d] == d)


def test_empty_and_rows_of_one_doc_id(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies(empty).count() == 0 and one_of_similar(empty).count() == 0
    text = "some words that stand in more than one row of the table"
    rows = [(None, text, "x", 1), (7, text, "x", 1), (7, text, "x", 2), (7, "another text of the same number as the first", "x", 1), (None, "and one more without any", "x", 1)]
    for one in (one_of_similar, one_of_each):
        kept = sorted((str(r.doc_id), r.text[:4]) for r in one(spark.createDataFrame(rows, SCHEMA)).collect())
        assert kept == [("7", "anot"), ("7", "some"), ("None", "and ")]


def test_plan():
    """Segments grow with the logarithm of the rows, and the chance of a hit stays."""
    small, large = Plan.of(1_000, 0.8, 0.98), Plan.of(1_000_000_000, 0.8, 0.98)
    assert (small.bits, large.bits) == (12, 31) and small.tables < large.tables < 40
    assert Plan.of(0, 0.8, 0.98).tables >= 1


def test_compared_pairs_follow_the_members(spark, monkeypatch):
    """A family of copies that all link costs a few comparisons a member, and is one group."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"new{i}", *base[i % 150 + 1 :]])) for i in range(300)]
    compared, alike = [], nearcopies._alike

    def counted(*args):
        compared.append(next(a for a in args if getattr(a, "columns", [])[:2] == ["u", "v"]).count())
        return alike(*args)

    monkeypatch.setattr(nearcopies, "_alike", counted)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == len(rows)
    assert sum(compared) <= 4 * len(rows), compared
