"""Texts as integers, by a dictionary for each chunk of texts.

A chunk is a run of texts of at most about ``CHUNK_WORDS`` words that one task reads. Its words are numbered as they come, and
its texts become arrays of these numbers. What is global (counts, scores) is then worked out on the chunks' dictionaries, which
hold a word once however often the chunk repeats it: a word that makes up a third of all text has one row a chunk like any
other, so that no key is hot. Results come back to the chunk, and only there to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a chunk, about. The texts of a chunk and its dictionary meet in one task again.
CHUNK_WORDS = 2_000_000
#: Bytes of a text that are numbered at a time: longer texts become several parts, cut between words.
PART_BYTES = 1 << 20
_UPPER = {c: c + 32 for c in range(65, 91)} | dict.fromkeys(range(9, 14), 32)
#: A-Z in lower case, tab to carriage return as spaces, all else as it is: words are what lies between spaces.
LOWER = bytes(_UPPER.get(c, c) for c in range(256))
#: The same, with a space for each ASCII character that is no letter or digit.
LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER)


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def parts(body: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that are cut at spaces, so that no word is."""
    at = 0
    while len(body) - at > size:
        end = body.find(b" ", at + size)
        if end < 0:
            break
        yield body[at:end]
        at = end
    yield body[at:]


class Chunk:
    """The words of some texts and the features, runs of 1 to ``runs`` words, that they make.

    A feature is kept as the feature of all its words but the last, and the last word: the id tuple of a run of n words is
    that of a run of n - 1 and one more.
    """

    def __init__(self, runs: int):
        self.runs, self.words, self.features, self.coded, self.sides = runs, Numbers(), Numbers(), [], []

    def add(self, words: list[bytes], carried: list[bytes], side: int) -> np.ndarray:
        """Feature numbers of all runs that end in ``words``; ``carried`` are the words before them in the same text."""
        ids = np.fromiter(map(self.words.__getitem__, carried + words), np.int64, len(carried) + len(words))
        if self.runs == 1:
            out = ids.astype(np.int32)
        else:
            found, run = [], np.full(len(ids), -1, np.int64)  # run: the feature of the words before, -1 for none
            for n in range(min(self.runs, len(ids))):
                keys = ((run[: len(ids) - n] + 1) << 32) | ids[n:]
                run = np.fromiter(map(self.features.__getitem__, keys.tolist()), np.int64, len(keys))
                found.append(run[max(0, len(carried) - n) :])
            out = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        self.coded.append(out)
        self.sides.append(side)
        return out

    def counts(self, side: int) -> np.ndarray:
        own = [c for c, s in zip(self.coded, self.sides) if s == side]
        n = len(self.words) if self.runs == 1 else len(self.features)
        return np.bincount(np.concatenate(own) if own else np.zeros(0, np.int32), minlength=n).astype(np.int64)

    def tuples(self) -> list[list[int]]:
        """Word numbers of each feature."""
        out: list[list[int]] = []
        for key in self.features:
            before = (key >> 32) - 1
            out.append((out[before] if before >= 0 else []) + [key & 0xFFFFFFFF])
        return out


def code(rows: DataFrame, table: bytes, runs: int = 1, chunk_words: int = CHUNK_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Code the texts of ``rows`` (doc_id, text binary, side 0 or 1); null texts have no words.

    Rows of three kinds come back, to be written before they are used (numbers of rows and chunks stand only then):
    texts (kind ``d``: chunk, row, doc_id, side, n words, ids as compressed 32-bit numbers of features), a text of several parts as several
    rows with one ``row`` number; words (``w``: chunk, id, word); features (``f``: chunk, id, tuple of word ids, and how often it
    occurs on each side, n0 and n1). With runs of one word only, words are the features and have these counts.
    """
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, chunk long, row long, doc_id {doc_type}, side int, n long, ids binary, id int, word binary, tuple array<int>, n0 long, n1 long"
    kinds = [pa.string(), pa.int64(), pa.int64(), None, pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
    names = ["kind", "chunk", "row", "doc_id", "side", "n", "ids", "id", "word", "tuple", "n0", "n1"]

    def run(batches):
        import zstandard

        packed = zstandard.ZstdCompressor()
        base, row, number = TaskContext.get().partitionId() << 32, 0, 0
        own, texts, size, id_type = Chunk(runs), [], 0, None

        def batch(**columns):
            n = len(next(iter(columns.values())))
            types = {**dict(zip(names, kinds)), "doc_id": id_type}
            return pa.RecordBatch.from_arrays([columns[c].cast(types[c]) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names)

        def closed():
            chunk = base + number
            if texts:
                row_ids, doc_ids, sides, ns, ids = zip(*texts)
                yield batch(kind=["d"] * len(texts), chunk=[chunk] * len(texts), row=list(row_ids), doc_id=pa.array(doc_ids, id_type), side=list(sides), n=list(ns), ids=list(ids))
            n0, n1 = own.counts(0), own.counts(1)
            for at in range(0, len(own.words), 50_000):
                some = list(own.words)[at : at + 50_000]
                counted = {"n0": n0[at : at + len(some)], "n1": n1[at : at + len(some)]} if runs == 1 else {}
                yield batch(kind=["w"] * len(some), chunk=[chunk] * len(some), id=np.arange(at, at + len(some)), word=some, **counted)
            if runs > 1:
                tuples = own.tuples()
                for at in range(0, len(tuples), 50_000):
                    some = tuples[at : at + 50_000]
                    yield batch(kind=["f"] * len(some), chunk=[chunk] * len(some), id=np.arange(at, at + len(some)), tuple=some, n0=n0[at : at + len(some)], n1=n1[at : at + len(some)])

        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc_id, text, side in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("side").to_pylist()):
                body, carried = (text.as_py() or b"").translate(table), []
                row += 1
                for part in parts(body, part_bytes):
                    words = part.split()
                    texts.append((base + row, doc_id, side, len(words), packed.compress(own.add(words, carried, side).tobytes())))
                    carried = (carried + words)[len(carried) + len(words) - runs + 1 :] if runs > 1 else []
                    size += len(words) + 1
                    if size >= chunk_words:
                        yield from closed()
                        own, texts, size, number = Chunk(runs), [], 0, number + 1
        if texts:
            yield from closed()

    return rows.select("doc_id", "text", F.col("side").cast("int").alias("side")).mapInArrow(run, schema)


def sums(coded: DataFrame, values: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(row, doc_id, side, n words, n_features, and the sum of each value over the features of the text), one row a text.

    ``values`` has, for each chunk and id of a feature, the columns of ``kinds`` (long or double). A chunk's texts meet its
    values in one task; both are bounded by the size of a chunk.
    """
    docs = coded.where("kind = 'd'").select("chunk", "row", "doc_id", "side", "n", "ids")
    types = {"long": np.int64, "double": np.float64}

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        lists = list(map(zstandard.ZstdDecompressor().decompress, texts["ids"].to_pylist()))
        ids = np.frombuffer(b"".join(lists), np.int32)
        lengths = np.array([len(x) // 4 for x in lists], np.int64)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        where, out = found["of_id"].to_numpy(), [texts["row"], texts["doc_id"], texts["side"], texts["n"], pa.array(lengths)]
        for name, kind in kinds.items():
            value, total = np.zeros(where.max() + 1 if len(where) else 0, types[kind]), np.zeros(len(lists), types[kind])
            value[where] = found[name].to_numpy()
            if len(full):
                total[full] = np.add.reduceat(value[ids], starts)
            out.append(pa.array(total))
        return pa.table(out, names=["row", "doc_id", "side", "n", "n_features", *kinds])

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, side int, n long, n_features long, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    parted = docs.groupBy("chunk").cogroup(values.select(F.col("chunk").alias("of_chunk"), F.col("id").alias("of_id"), *kinds).groupBy("of_chunk")).applyInArrow(run, schema)
    return parted.groupBy("row", "doc_id", "side").agg(*(F.sum(c).alias(c) for c in ("n", "n_features", *kinds)))
