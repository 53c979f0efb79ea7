"""Quality rules as a short-circuit cascade.

Every text is put to two base rules, whose statistics are results of their own. What the other rules cost and how much they
reject is measured on a bounded sample of what passes these; they then run by rejection per cost, and a text that one has
rejected is not shown to the next. The order decides what is spent, never what is kept.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_key, texts

#: Rows of the sample on which the order of the rules is decided.
SAMPLE_ROWS = 1000
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_word = re.compile(r"[^\x20\x09-\x0D]+")
_run = re.compile(r"(.)\1{29}", re.S)


def repeated_words(words: Sequence[str]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    at = np.zeros(n, dtype=bool)
    hit = times[which] > 1
    for k in range(3):
        at[k : n - 2 + k] |= hit
    return int(at.sum())


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _word.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


class Seen:
    """A text as the rules see it: its base statistics, and what several rules need, made when the first of them asks."""

    def __init__(self, text: str, base: tuple):
        self.text, self.base = text, base

    @cached_property
    def times(self) -> Counter:
        return Counter(_word.findall(self.text))


@dataclass(frozen=True)
class Rule:
    """rejects(seen): true if the text has to go."""

    name: str
    rejects: Callable[[Seen], bool]


def _shouting(x: Seen) -> bool:
    upper = sum(map(str.isupper, x.text))
    return upper > 20 and 2 * upper > sum(map(str.isalpha, x.text))


#: The method's own verdict: faults that no clean prose has. Each is kept far from what prose reaches.
RULES = (
    Rule("symbols", lambda x: 4 * x.base[2] > x.base[0] > 0),
    Rule("word_length", lambda x: x.base[0] > 0 and not 2 * x.base[0] <= x.base[1] <= 25 * x.base[0]),
    Rule("dup_lines", lambda x: x.base[3] > 3 and 2 * x.base[3] > x.text.count("\n") + 1),
    Rule("shouting", _shouting),
    Rule("one_word", lambda x: x.base[0] >= 20 and 3 * max(x.times.values()) > x.base[0]),
    Rule("few_words", lambda x: x.base[0] >= 100 and 10 * len(x.times) < x.base[0]),
    Rule("marks", lambda x: x.base[0] > 0 and 3 * (x.text.count("!!") + x.text.count("??")) > x.base[0]),
    Rule("one_character", lambda x: _run.search(x.text) is not None),
)


def base_failed(base: tuple) -> bool:
    """The base rules, which every text is put to: too few words, or too many in repeated windows."""
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


def sample_rows(docs: DataFrame, rows: int) -> DataFrame:
    """The rows with the smallest hashes; no more than ``rows`` keys, so that they can be broadcast."""
    keyed = texts(docs).select("doc_id", "text", *row_key())
    chosen = keyed.select("t1", "t2").orderBy(F.xxhash64("t1", "t2"), "t1", "t2").limit(rows).distinct()
    return keyed.join(F.broadcast(chosen), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).select("doc_id", "text")


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per second on a sample of at most ``rows`` texts; only sums reach the driver.

    The cascade only ever sees what the base rules let through, so they are measured on that part of the sample. What a rule
    shares with others counts in the cost of each, as if it were the first to ask. Rules that reject nothing come last,
    cheapest first.
    """

    def measure(batches):
        spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                base = base_statistics(text or "")
                if not base_failed(base):
                    for k, rule in enumerate(rules):
                        began = time.perf_counter()
                        rejected[k] += bool(rule.rejects(Seen(text, base)))
                        spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(rules)), "spent": spent, "rejected": rejected})

    sums = sample_rows(docs, rows).mapInArrow(measure, "k long, spent double, rejected long").groupBy("k").agg(F.sum("spent"), F.sum("rejected")).collect()
    measured = {k: (n / max(s, 1e-9), s) for k, s, n in sums}
    gain = lambda k: measured.get(k, (0.0, 0.0))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain(k)[0], gain(k)[1], k))]


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the five base statistics, base_failed and kept.

    A null text counts as empty: no words, so it fails the base rules. A text of any length is judged whole. Rows that repeat
    a doc_id are judged each by its own text, rows alike in all alike. Other columns are passed over, whatever their names. An
    empty table gives an empty result. kept is the same whatever the order of the rules, ties in it included.
    """
    order = cascade_order(docs, rules, sample)

    def run(batches):
        for b in batches:
            stats, failed, kept = [], [], []
            for text in b.column("text").to_pylist():
                base = base_statistics(text or "")
                stats.append(base)
                failed.append(base_failed(base))
                if failed[-1]:
                    kept.append(False)
                else:
                    seen = Seen(text, base)
                    kept.append(not any(r.rejects(seen) for r in order))  # any() stops at the first that rejects
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)] if stats else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *(c.split()[0] for c in BASE.split(", ")), "base_failed", "kept"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {BASE}, base_failed boolean, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
