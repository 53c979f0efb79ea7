"""Best-fit packing by exact-complement hashing.

What is packed are lengths, so the plan is made on the histogram of lengths alone: at most ``room`` numbers, whatever the
input. For each length, longest first, an index by sum of the single lengths, pairs and triples still available gives what
fills its gap exactly, and as many sequences are made of that combination as the counts allow. What then remains is packed
best-fit, longest first, also by counts. The plan lists, for each length, how many of its pieces go into which kind of
sequence; a piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ranked, read_table, row_key, texts

ROOM = 2048
END = 0
#: Ranks within a length are counted in parts of about this many pieces, and 64 parts at least.
PART_ROWS = 50_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@cache
def _encoders(tokenizer: str, ranks: str, pattern: str):
    """The tokenizer, a faster encoder with the same vocabulary, and a pattern of the tokens that the tokenizer adds to it."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    return slow, tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), re.compile("|".join(map(re.escape, added)) or r"(?!)")


def token_ids(text: str, tokenizer: str, ranks: str, pattern: str) -> np.ndarray:
    """The tokenizer's ids as unsigned 32-bit numbers.

    A text that spells one of the tokenizer's added tokens, such as ``<|endoftext|>``, goes to the tokenizer itself.
    """
    slow, fast, added = _encoders(tokenizer, ranks, pattern)
    if not added.search(text):
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except BaseException as e:  # noqa: BLE001  the fast encoder gives up on some extreme texts by a panic, which is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
    return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids. Of longer documents only the first piece is shorter than a sequence."""
    if n <= room:
        return [(0, n)]
    first = n % room
    return [(0, first)] * bool(first) + [(s, room) for s in range(first, n, room)]


@dataclass
class Plan:
    """Sequences by kind: how many there are of each, and the lengths in one."""

    room: int
    kinds: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)


class SumIndex:
    """Sums of one, two and three of the lengths still available.

    ``left`` holds how many there are of each length; the caller only ever takes from it. So a combination that the counts no
    longer allow never comes back, and the index keeps, for every sum, the first combination that may still be there: the one
    of the longest lengths. Looking one up costs nothing but the passing over of those used up, each once.
    """

    def __init__(self, left: list[int]):
        self.left, top = left, len(left) - 1
        self._pair = list(range(top + 1))  # by sum: the longer length of the first pair that may be left
        self._triple = list(range(top + 1))  # by sum: the longest length of the first triple that may be left

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        left, a = self.left, min(self._pair[total], total - 1)
        while 2 * a >= total and a > 0 and not (left[a] and left[total - a] > (2 * a == total)):
            a -= 1
        self._pair[total] = a
        return (a, total - a) if a > 0 and 2 * a >= total else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        left, a = self.left, min(self._triple[total], total - 2)
        while 3 * a >= total:
            two = self.pair(total - a) if left[a] else None
            if two and a in two:  # the same length twice: are there so many?
                left[a] -= 1
                two = next(((b, total - a - b) for b in range(min(a, total - a - 1), (total - a - 1) // 2, -1) if left[b] and left[total - a - b] > (2 * b == total - a)), None)
                left[a] += 1
            if two:
                self._triple[total] = a
                return a, *two
            a -= 1
        self._triple[total] = a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``, the longest first."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def make_plan(counts: dict[int, int], room: int = ROOM) -> Plan:
    """Kinds of sequences for the counts of lengths. Each kind uses up a length, so kinds are few."""
    left = [0] * (room + 1)
    for length, n in counts.items():
        if not 0 < length <= room:
            raise ValueError(f"a length of {length} does not fit")
        left[length] += n
    plan = Plan(room)
    if left[room]:
        plan.kinds.append(((room,), int(left[room])))
        left[room] = 0
    rest: dict[int, int] = {}
    index = SumIndex(left)
    for top in range(room - 1, 0, -1):
        while left[top]:
            left[top] -= 1
            found = index.exact(room - top)
            left[top] += 1
            if found is None:
                rest[top] = int(left[top])
                left[top] = 0
                break
            kind = (top, *found)
            times = min(int(left[x]) // kind.count(x) for x in set(kind))
            for x in kind:
                left[x] -= times
            plan.kinds.append((kind, times))
    # best fit of the residuals: open sequences by gap, those alike together
    open_gaps: list[int] = []
    by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(kind: tuple[int, ...], n: int) -> None:
        gap = room - sum(kind)
        if not gap:
            plan.kinds.append((kind, n))
            return
        if not by_gap[gap]:
            open_gaps.insert(bisect_left(open_gaps, gap), gap)
        by_gap[gap][kind] = by_gap[gap].get(kind, 0) + n

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            k = bisect_left(open_gaps, length)
            if k == len(open_gaps):
                fit = room // length
                if n // fit:
                    put((length,) * fit, n // fit)
                if n % fit:
                    put((length,) * (n % fit), 1)
                n = 0
                continue
            kinds = by_gap[open_gaps[k]]
            kind, have = kinds.popitem()
            gap = open_gaps[k]
            if not kinds:
                open_gaps.pop(k)
            each = min(gap // length, n)
            times = min(have, n // each)
            if have > times:
                put(kind, have - times)
            put((*kind, *(length,) * each), times)
            n -= times * each
    plan.kinds += [(kind, n) for kinds in by_gap.values() for kind, n in kinds.items()]
    return plan


def placements(plan: Plan) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on which kind takes pieces, how many a sequence, its first sequence and offset."""
    taken, base, rows = defaultdict(int), 0, []
    for kind, times in plan.kinds:
        offset = 0
        for length in sorted(set(kind), reverse=True):
            each = kind.count(length)
            rows.append((length, taken[length], each, base, offset))
            taken[length] += each * times
            offset += each * length
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "base", "offset"), table.T))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of pieces."""
    wide = np.int64(1) << 45
    k = np.searchsorted(table["length"] * wide + table["rank"], length * wide + rank, side="right") - 1
    past = rank - table["rank"][k]
    return table["base"][k] + past // table["each"][k], table["offset"][k] + past % table["each"][k] * length


def tokenized(docs: DataFrame, room: int = ROOM, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, t1, t2, piece, start, length, ids_crc32) of every piece: no ids are kept."""
    import public_tokenizers as P

    args = tokenizer or P.path(TOKENIZER), ranks or P.path(RANKS), pattern or P.PATTERN

    def run(batches):
        for b in batches:
            rows = []
            keys = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "t2"))))
            for key, text in zip(keys, b.column("text")):
                ids = np.append(token_ids(text.as_py(), *args), np.uint32(END)).astype("<u4")
                rows += [(*key, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), room))]
            columns = list(zip(*rows)) or [()] * 7
            kinds = b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "t1", "t2", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs).select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, room: int = ROOM, **tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document is its ids and then id 0, so that a null or empty text is one piece of length 1. Only longer documents than a
    sequence are cut, however long. Rows that repeat a doc_id, or are alike in all, are packed each; pieces of one length are
    interchangeable, so that ties need no rule. Other columns are passed over, whatever their names. An empty table gives an
    empty result.
    """
    ws = Workspace(docs.sparkSession)
    pieces = ws.save(tokenized(docs, room, **tokenizer), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``room`` rows
    table = placements(make_plan(counts, room))
    order = [F.col(c) for c in ("doc_id", "piece", "t1", "t2")]
    salts = max(64, max(counts.values(), default=0) // PART_ROWS)
    placed = ranked(pieces, "length", order, salts, ["doc_id", "piece", "t1", "t2"], "rank")

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = place(table, b.column("length").to_numpy(), b.column("rank").to_numpy())
                kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return placed.mapInArrow(run, f"doc_id {placed.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
