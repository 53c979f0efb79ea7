import random

import pytest
import xxhash

from palimpsest.llm.common import Workspace
from palimpsest.llm.simhash import links, near_duplicates
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    """By the definition: every pair, then the smallest doc_id reachable."""

    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words, word = [], ""
        for c in low + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [word] * bool(word)
                word = ""
            else:
                word += c
        if not words:
            return 0
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [(r[0], fp(r[1])) for r in rows]
    comp = list(range(len(fps)))
    near = [(i, j) for i, (_, a) in enumerate(fps) for j, (_, b) in enumerate(fps[:i]) if (a ^ b).bit_count() <= 2]
    before = None
    while comp != before:
        before = list(comp)
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for (d, _), c in zip(fps, comp):
        least[c] = min(least.get(c, d), d)
    return sorted((d, f"{f:016x}", least[c]) for (d, f), c in zip(fps, comp))


def corpus():
    rnd = random.Random(5)
    base = [rnd.choice(["alpha", "beta", "gamma", "Élan", "über", "x"]) + str(rnd.randrange(60)) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "two words"), (6, "a a a a a a"), (6, "a a a a a a")]
    for i in range(40):
        words = list(base)
        for _ in range(i % 5):
            words[rnd.randrange(300)] = f"edit{rnd.randrange(9)}"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, " ".join(rnd.choice("abcdefgh") for _ in range(30))) for i in range(20)]
    return rows + [(999, "long " * 50_000)]


@pytest.mark.parametrize("pairwise", [64, 1])
def test_as_brute_force(spark, pairwise):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(df, pairwise=pairwise).collect())) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exploded_tables_are_not_broadcast(spark):
    """A table of 34 rows a fingerprint has the size of its source for Spark: it must not be broadcast for it."""
    plans = []

    class Kept(Workspace):
        def save(self, df, name, rows=None):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name, rows)

    ws = Kept(spark)
    fps = ws.save(spark.range(300).select((F.col("id") * 7).alias("fp")), "fps")
    plans.append(links(ws, fps, 2)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans)
