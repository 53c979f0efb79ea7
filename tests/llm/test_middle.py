import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.middle import TOKENS, Automaton, Rule, Scan, fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, cut=50, spm=80):
    text = text or ""
    u = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut:
        return doc_id, len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(1)
    out = [(k, "".join(rng.choice(["a", "é", "字", "𝄞", " ", "\t", "\n", "\x0b", " ", "<", "P"]) for _ in range(rng.randrange(0, 1500)))) for k in range(200)]
    out += [(None, None), (None, "null id here"), (201, ""), (202, " "), (203, "x"), (204, "has <S> in it"), (205, "\n\n a"), (206, "a \n\n"), (7, "same id"), (7, "same id")]
    return out + [(207, "word " * 40_000), (208, "z" * 100_000), (209, " " * 70_000), (210, "é " * 50_000 + "<M>"), (9, "字 " * 30_000)]


@pytest.mark.parametrize("chunk", [1 << 16, 700])
def test_as_brute_force(spark, chunk):
    docs = spark.createDataFrame([(d, t, 3, "c") for d, t in rows()], "doc_id long, text string, n int, form string").repartition(3)
    got = fill_in_middle(docs, chunk=chunk).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted((brute(d, t) for d, t in rows()), key=str)
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=str) == sorted(((d, t or "") for d, t in rows()), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rule(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = fill_in_middle(docs, Rule(7, 100, 0)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(d, t, 7, 100, 0) for d, t in rows()), key=str)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_functions_compose():
    """Any automaton: a run through a text is the composition of the functions of its blocks, from every state."""
    rng = np.random.default_rng(2)
    step = np.vstack([rng.integers(0, 5, (4, 5)), np.arange(5)]).astype(np.uint8)
    any_one = Automaton(rng.integers(0, 4, 256).astype(np.uint8), step, np.vstack([rng.integers(0, 2, (4, 5)), np.zeros(5)]).astype(np.uint8))
    for automaton in (any_one, TOKENS):
        bodies = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 15, 16, 17, 500)]
        scan = Scan(bodies, automaton, block=16)
        for k, body in enumerate(bodies):
            for entry in range(automaton.states):
                state, at = entry, []
                for i, c in enumerate(body):
                    at += [i] * int(automaton.emit[automaton.classes[c], state])
                    state = int(automaton.step[automaton.classes[c], state])
                assert (scan.exits[k, entry], scan.counts[k, entry]) == (state, len(at))
                if at:
                    units = np.arange(len(at))
                    assert scan.places(np.full(len(at), k), np.full(len(at), entry), units).tolist() == at
