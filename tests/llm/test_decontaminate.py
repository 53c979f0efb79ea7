import hashlib
import re

import pytest

from palimpsest.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    known = {}
    for item, text in items:
        b = words(text)
        n = min(13, len(b))
        for j in range(len(b) - n + 1 if n else 0):
            known.setdefault(tuple(b[j : j + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short Item, three"), (10, "one"), (None, "Éa éb ÉC " * 6), (3, None), (4, "..."), (2, "another  text of id two"), (5, " ".join(["x"] * 20))]
DOCS = [
    (1, None), (2, ""), (3, "?!"), (4, "pre " + LONG.upper() + " post"), (5, " ".join(f"w{i}" for i in range(12))), (6, " ".join(f"w{i}" for i in range(13))),
    (7, "a short item three b"), (7, "a short item three b"), (7, "other text, same id, one"), (8, "Éa éb ÉC " * 6), (9, "éa éb éc " * 6), (None, "x " * 40 + "y " * 30),
    (11, "filler " * 50_000 + LONG), (12, "one " * 3 + "z " * 70), (13, "another text of id two"), (14, "short itemthree"),
]


@pytest.mark.parametrize("most", [500_000, 20])
def test_as_brute_force(spark, most):
    docs = spark.createDataFrame([(d, t, "c") for d, t in DOCS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, items, broadcast_windows=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).where("n_hit = 0 and not contaminated").count() == len(DOCS)
    assert contamination(docs.limit(0), none).count() == 0
