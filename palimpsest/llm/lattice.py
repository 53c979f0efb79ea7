"""Language-model scores by the lattice of subwords.

The model is a unigram distribution over the pieces of an existing subword vocabulary and an end of text. A text's probability
is marginal: it adds up all ways to cut the text's words into pieces, by a forward recursion over the lattice in log space. The
vocabulary's own scores, ranks, are the first weights (by Zipf's law); rounds of expectation and maximisation over the words of
the learning texts then fit the weights, each word once with its count, every cut with its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .coding import CHUNK_WORDS, LOWER, PART_BYTES, code, sums
from .common import Workspace, read_table, texts

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Bytes of words whose lattices are worked out together.
TOGETHER = 1 << 18


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces as bytes, a space for the mark of a word's start, and their weights.

    Scores are ranks with a minus; a piece without a rank comes last. Pieces with a space elsewhere are left out, since no
    word has one. Every byte is a piece, so that every word can be cut; pieces of the same bytes are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    last, rank = model.get_piece_size(), {}
    for i in range(last):
        if model.is_control(i) or model.is_unknown(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        if b" " in piece[1:]:
            continue
        own = -model.get_score(i) if not model.is_byte(i) and -model.get_score(i) <= last else last
        rank[piece] = min(rank.get(piece, last), own)
    for b in range(256):
        rank.setdefault(bytes([b]), last)
    pieces = sorted(rank)
    return pieces, np.array([1.0 / (1.0 + rank[p]) for p in pieces])


class Lattice:
    """The pieces in a word, found by an automaton of all pieces; positions of many words are worked out together."""

    def __init__(self, pieces: list[bytes]):
        import ahocorasick

        self.pieces, self.length = pieces, np.array([len(p) for p in pieces], np.int64)
        self._find = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self._find.add_word(p.decode("latin-1"), i)  # a character for each byte
        self._find.make_automaton()

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(start, end, piece) by byte of the words, each behind a space, one after another; first byte of each word; word of each byte."""
        text = b" " + b" ".join(words)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        found = np.fromiter(self._find.iter(text.decode("latin-1")), dtype=[("end", np.int64), ("piece", np.int64)])
        end, piece = found["end"], found["piece"]
        return end - self.length[piece] + 1, end, piece, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)

    @staticmethod
    def _levels(place: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges by ``place``, ascending, those of one ``group`` side by side, and where each group starts among them."""
        order = np.lexsort((group, place))
        cuts = np.flatnonzero(np.diff(place[order])) + 1
        for some in np.split(order, cuts):
            yield some, np.concatenate([[0], np.flatnonzero(np.diff(group[some])) + 1])

    @staticmethod
    def _log_sums(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(value, starts)
        sizes = np.diff(np.append(starts, len(value)))
        return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes)), starts))

    def _forward(self, lattice: tuple[np.ndarray, ...], logp: np.ndarray) -> np.ndarray:
        """By byte: log of the probability of the word up to this byte, over all cuts."""
        start, end, piece, first, word = lattice
        origin = first[word]
        upto = np.full(len(word), -np.inf)
        for some, starts in self._levels(end - origin[end], end):
            s = start[some]
            before = np.where(s == origin[s], 0.0, upto[s - 1])
            upto[end[some[starts]]] = self._log_sums(before + logp[piece[some]], starts)
        return upto

    def likelihood(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        if not words:
            return np.zeros(0)
        lattice = self.edges(words)
        last = np.append(lattice[3][1:], len(lattice[4])) - 1
        return self._forward(lattice, logp)[last]

    def expected(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each piece is expected in all cuts of the words, each counted ``counts`` times."""
        if not words:
            return np.zeros(len(self.pieces))
        start, end, piece, first, word = lattice = self.edges(words)
        upto, origin = self._forward(lattice, logp), first[word]
        last = np.append(first[1:], len(word)) - 1
        after = np.where(np.arange(len(word)) == last[word], 0.0, -np.inf)  # by byte: of the word behind it
        for some, starts in self._levels(origin[start] - start, start):
            inner = start[some[starts]]
            value = self._log_sums(logp[piece[some]] + after[end[some]], starts)
            keep = inner > origin[inner]
            after[inner[keep] - 1] = value[keep]
        before = np.where(start == origin[start], 0.0, upto[start - 1])
        share = np.exp(before + logp[piece] + after[end] - upto[last][word[end]])
        return np.bincount(piece, share * counts[word[end]], minlength=len(self.pieces))


@lru_cache(2)
def _lattice(path: str) -> Lattice:
    return Lattice(vocabulary(path)[0])


def together(words: list[bytes]) -> Iterator[slice]:
    """Slices of about ``TOGETHER`` bytes."""
    size, at = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= TOGETHER:
            yield slice(at, k + 1)
            size, at = 0, k + 1
    if at < len(words):
        yield slice(at, len(words))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def fit(dictionary: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural logs of the pieces' probabilities, and of the end's, from (word, c) of all learning texts.

    A round reads every word once and sums up by piece before and behind the shuffle; the driver gets a row for each piece of
    the vocabulary. Each piece and the end count once more than expected, so that none is impossible.
    """
    pieces, weights = vocabulary(path)
    learnt = dictionary.where("c > 0").select("word", "c")
    logp, end = np.log(weights / weights.sum()), 0.0
    for _ in range(rounds):

        def run(batches, logp=logp):
            lattice, total = _lattice(path), np.zeros(len(logp))
            for b in batches:
                words, counts = b.column("word").to_pylist(), b.column("c").to_numpy()
                for some in together(words):
                    total += lattice.expected(words[some], counts[some], logp)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["piece", "n"])

        rows = learnt.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row a piece at most
        counts = np.ones(len(pieces))
        for r in rows:
            counts[r["piece"]] += r["n"]
        whole = counts.sum() + ends + 1
        logp, end = np.log(counts / whole), math.log((ends + 1) / whole)
    return logp, end


def likelihoods(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, chunk_words: int = CHUNK_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    score is the lattice model's: the sum of its words' marginal probabilities and the end's. base_score is that of a unigram
    model over whole words with one added to each count, for comparison. Both learn from the rows that are not held out, each as
    often as it is there, and know words in lower case (A-Z). A null or empty text has no words and one token, its end. With
    nothing to learn from, every piece is equally likely. Rows that repeat a doc_id are scored each by its own text; a null doc_id
    counts as the empty string. Texts of any length are scored whole, in parts. Columns other than doc_id and text are
    passed over, whatever their names. An empty table gives an empty result.
    """
    import public_tokenizers as P

    path, ws = path or P.path(VOCABULARY), Workspace(docs.sparkSession)
    rows = texts(docs, binary=True).select("doc_id", "text", held_out(F.col("doc_id")).cast("int").alias("side"))
    coded = ws.save(code(rows, LOWER, 1, chunk_words, part_bytes), "coded")
    words = coded.where("kind = 'w'").select("chunk", "id", "word", "n0")
    dictionary = ws.save(words.groupBy("word").agg(F.sum("n0").alias("c")), "dictionary")
    ends = coded.where("kind = 'd' and side = 0").select(F.count_distinct("row")).first()[0]
    n, v = dictionary.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    logp, end = fit(dictionary, ends, path, max(1, rounds))

    def run(batches):
        lattice = _lattice(path)
        for b in batches:
            w = b.column("word").to_pylist()
            found = [lattice.likelihood(w[some], logp) for some in together(w)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(np.concatenate(found) / math.log(10) if found else np.zeros(0))], ["word", "c", "score"])

    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    rated = dictionary.mapInArrow(run, "word binary, c long, score double").select("word", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"), "score")
    values = words.join(ws.save(rated, "rated"), "word").select("chunk", "id", "known", "base", "score")
    found = sums(coded, values, {"known": "long", "base": "double", "score": "double"})
    return found.select(
        "doc_id",
        (F.col("side") == 1).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10((ends + 1) / (n + v + 1))).alias("base_score"),
        (F.col("score") + end / math.log(10)).alias("score"),
    )


def op13_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihoods(read_table(spark, sf_dir, "documents"))
