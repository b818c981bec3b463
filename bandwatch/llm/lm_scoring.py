"""Language-model scores: word pairs by deleted interpolation, weights by context frequency from held-out counts.

P(w | h) = l[b] * c(h w) / c(h) + (1 - l[b]) * P1(w),  P1(w) = m * c(w) / N + (1 - m) / (V + 1),
b: the power of two of c(h). The weights maximise the probability of a held-out part of the training texts under
counts of the rest (expectation-maximisation); the scores use the counts of both.

Texts are coded once into chunks (a task's rows, by its own vocabulary). Each chunk asks for the counts of its
distinct words and pairs, once each, in arrays by hash range; a range's task adds up what all chunks bring and
answers each. So the most frequent word is one entry per chunk, and nothing is held whole by one task.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, remainder, staged

FOLDS, HELD_OUT, TUNING = 7, 2, 5  # crc32 of the id: 2 is never learned from, 5 is held out for the weights
FLUSH_TOKENS = 3_000_000  # of a chunk, at least where there are as many
RANGE_KEYS = 3_000_000  # keys that a hash range is asked for, about
ROWS = 512
STEP = 16  # histogram bins per octave
ROUNDS = 60
BUCKETS = 64
PRIOR = 10.0  # held-out tokens that a weight of 1/2 counts for
NEVER = 1 << 20  # bin of pairs that the counts do not know
SUMS, HISTOGRAM = 0, 1  # kinds of sums over words
END = b" "  # no word: words hold no space
START_HASH = np.uint64(0x5851F42D4C957F2D)


class Ids(dict[bytes, int]):
    """Numbers for words in order of their first appearance; the end of a text is 0."""

    def __init__(self) -> None:
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def pack_counts(x: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow."""
    large = x[x >= 255].astype("<i8")
    return struct.pack("<q", len(large)) + large.tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<q", data)[0]
    out = np.frombuffer(data, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", n, 8)
    return out


def pack_tokens(ids: np.ndarray) -> bytes:
    """Token numbers, frequent ones small, as compressed planes of bytes."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


CHUNK = "chunk long, tuning boolean, n_tokens long, doc_ids array<long>, kinds binary, lens binary, tokens binary, vocabulary binary"


class Chunk:
    """Texts being coded."""

    def __init__(self) -> None:
        self.known, self.size = Ids(), 0
        self.docs: list[int | None] = []
        self.kinds: list[int] = []
        self.lens: list[int] = []
        self.parts: list[np.ndarray] = []

    def add(self, docs: list[int | None], kinds: list[int], texts: list[list[bytes]]) -> None:
        flat = [w for words in texts for w in (*words, END)]
        self.parts.append(np.fromiter(map(self.known.__getitem__, flat), np.int32, len(flat)))
        self.docs += docs
        self.kinds += kinds
        self.lens += [len(x) + 1 for x in texts]
        self.size += len(flat)

    def row(self, name: int, tuning: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        order = np.argsort(-np.bincount(ids, minlength=len(self.known)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))[order]
        values = [name, tuning, self.size, self.docs, bytes(self.kinds), np.array(self.lens, "<i4").tobytes(), pack_tokens(rank[ids]), hashes.tobytes()]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        names = [x.split(" ")[0] for x in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, kind, text); kind is the id's remainder, and texts for tuning have chunks of their own."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = TaskContext.get().partitionId(), 0
        chunks = {False: Chunk(), True: Chunk()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, kinds, texts = (c.to_pylist() for c in part.columns)
                words = [ascii_words(x) for x in texts]
                for tuning in chunks:
                    some = [k for k, kind in enumerate(kinds) if (kind == TUNING) == tuning]
                    if some:
                        chunks[tuning].add([ids[k] for k in some], [kinds[k] for k in some], [words[k] for k in some])
                    if chunks[tuning].size >= FLUSH_TOKENS:
                        yield chunks[tuning].row((at << 24) + made, tuning)
                        made += 1
                        chunks[tuning] = Chunk()
        for tuning, chunk in chunks.items():
            if chunk.size:
                yield chunk.row((at << 24) + made, tuning)
                made += 1

    return docs.mapInArrow(rows, CHUNK)


class Read:
    """A chunk read back: tokens, their contexts, and the distinct keys in the order of asking."""

    def __init__(self, row: dict, words: int, pairs: int):
        self.kinds = np.frombuffer(row["kinds"], np.uint8)
        self.lens = np.frombuffer(row["lens"], "<i4")
        self.ids = unpack_tokens(row["tokens"])
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        self.before = np.concatenate((self.ids[:1], self.ids[:-1]))
        #: the start of a text is as frequent a context as its end is a token
        end = np.flatnonzero(vocabulary == np.uint64(xxhash.xxh3_64_intdigest(END)))[0]
        self.before[self.starts] = end
        left = vocabulary[self.before]
        left[self.starts] = START_HASH
        with np.errstate(over="ignore"):
            both = (left ^ (left >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + vocabulary[self.ids]
            both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            both ^= both >> np.uint64(32)
        distinct, self.pair = np.unique(both, return_inverse=True)
        self.n_words = len(vocabulary)
        keys = np.concatenate((vocabulary, distinct))
        high = (keys >> np.uint64(48)).astype(np.int64)
        # ranges: words in the first, pairs in those after them
        ranges = np.where(np.arange(len(keys)) < self.n_words, high % words, words + high % pairs)
        self.order = np.argsort(ranges, kind="stable")
        self.edges = np.searchsorted(ranges[self.order], np.arange(words + pairs + 1))
        self.keys = keys[self.order]

    def trained(self) -> np.ndarray:
        """How often the texts to learn from have each key, in the order of asking."""
        learn = np.repeat((self.kinds != HELD_OUT).astype(np.int64), self.lens)
        words = np.bincount(self.ids, learn, self.n_words)
        pairs = np.bincount(self.pair, learn, len(self.keys) - self.n_words)
        return np.concatenate((words, pairs)).astype(np.int64)[self.order]

    def resolve(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts by word number and by pair from the answers of all ranges."""
        got = np.concatenate([unpack_counts(answers[r]) for r in sorted(answers)])
        out = np.empty_like(got)
        out[self.order] = got
        return out[: self.n_words], out[self.n_words :]


def _bins(x: np.ndarray) -> np.ndarray:
    return np.round(np.log2(x) * STEP).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Power of two of a context's count; 0 for 0 and 1."""
    return np.minimum(np.frexp(np.maximum(count, 1).astype(float))[1] - 1, BUCKETS - 1)


ANSWER = "chunk long, range int, total binary, tuning binary"


def counts(chunks: DataFrame, words: int, pairs: int) -> DataFrame:
    """Answers (chunk, range, total, tuning) in the order in which the chunk asked; chunk -1 holds sums of word ranges.

    Keys are 48 bits within a range of about RANGE_KEYS: two of its keys are alike with probability 1e-8 each.
    """

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = Read(row, words, pairs)
                trained = got.trained()
                for r, lo, hi in zip(range(words + pairs), got.edges[:-1], got.edges[1:], strict=True):
                    if lo < hi:
                        key = got.keys[lo:hi]
                        values = [r, row["chunk"], row["tuning"], key.astype("<u4").tobytes(), (key >> np.uint64(32)).astype("<u2").tobytes(), pack_counts(trained[lo:hi])]
                        types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["range", "chunk", "tuning", "low", "high", "counts"])

    def answer(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        keys = [np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.frombuffer(r["high"], "<u2").astype(np.uint64) << np.uint64(32)) for r in rows]
        brought = [unpack_counts(r["counts"]) for r in rows]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        tuned = np.repeat([float(r["tuning"]) for r in rows], [len(k) for k in keys])
        flat = np.concatenate(brought)
        total = np.bincount(of, flat).astype(np.int64)
        tuning = np.bincount(of, flat * tuned).astype(np.int64)
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            mine = of[at : at + len(k)]
            at += len(k)
            out.append((r["chunk"], r["range"], pack_counts(total[mine]), pack_counts(tuning[mine]) if r["tuning"] else b""))
        if rows[0]["range"] < words:
            rest = total - tuning
            bins, which = np.unique(_bins(np.maximum(rest, 1)) + (rest == 0) * -NEVER, return_inverse=True)
            sums = np.array([total.sum(), (total > 0).sum(), rest.sum(), (rest > 0).sum()], "<i8")
            held = np.stack((bins, np.bincount(which, tuning).astype(np.int64))).astype("<i8")
            out.append((-1, rows[0]["range"], sums.tobytes(), held.tobytes()))
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "range", "total", "tuning"])

    asked = chunks.mapInArrow(ask, "range int, chunk long, tuning boolean, low binary, high binary, counts binary")
    return asked.groupBy("range").applyInArrow(answer, ANSWER)


def em(ratios: np.ndarray, held: np.ndarray, known: np.ndarray) -> float:
    """The weight of the finer of two estimates: ratios are coarse / fine, held the held-out tokens of each;
    where not known, the fine estimate is 0."""
    weight = 0.5
    for _ in range(ROUNDS):
        posterior = np.where(known, weight / (weight + (1 - weight) * ratios), 0)
        weight = float((np.sum(held * posterior) + PRIOR / 2) / (np.sum(held) + PRIOR))
    return weight


def word_sums(answers: DataFrame) -> DataFrame:
    """kind, bin, n summed over all word ranges: four sums (SUMS), and held-out tokens by bin of a word's rate (HISTOGRAM)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums, (bins, n) = np.frombuffer(sums, "<i8"), np.frombuffer(held, "<i8").reshape(2, -1)
                kind = np.repeat(np.array([SUMS, HISTOGRAM], np.int32), [len(sums), len(bins)])
                columns = [kind, np.concatenate((np.arange(len(sums)), bins)), np.concatenate((sums, n))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "bin", "n"])

    told = answers.where("chunk = -1").select("total", "tuning").mapInArrow(rows, "kind int, bin long, n long")
    return told.groupBy("kind", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Sums over the words of the training texts, and the weights."""

    def __init__(self, sums: list[tuple[int, int, int]]):
        """sums: rows of word_sums()."""
        table = np.array(sums, np.int64).reshape(-1, 3)
        parts = dict(table[table[:, 0] == SUMS, 1:].tolist())
        self.tokens, self.types, tokens_rest, types_rest = (parts.get(i, 0) for i in range(4))
        self.rest = (tokens_rest, types_rest)
        bins, held = table[table[:, 0] == HISTOGRAM, 1:].T
        known = bins > -NEVER // 2
        fine = np.exp2(np.where(known, bins, 0) / STEP) / max(1, tokens_rest)
        self.word_weight = em(1 / (types_rest + 1) / fine, held, known)
        self.weights = np.full(BUCKETS, 0.5)

    def words(self, count: np.ndarray, rest: bool = False) -> np.ndarray:
        """P1 of words by their count: in all training texts, or in those without the tuning part."""
        tokens, types = self.rest if rest else (self.tokens, self.types)
        return self.word_weight * count / max(1, tokens) + (1 - self.word_weight * (tokens > 0)) / (types + 1)

    def learn(self, held: list[tuple[int, int, int]]) -> None:
        """Weights of the contexts from (bucket, bin of P1 / pair estimate, held-out tokens)."""
        table = np.array(held, np.int64).reshape(-1, 3)
        for b in np.unique(table[:, 0]):
            _, bins, n = table[table[:, 0] == b].T
            known = bins != NEVER
            self.weights[b] = em(np.exp2(np.where(known, bins, 0) / STEP), n, known)


def _answers(part: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(part.column("range").to_pylist(), part.column(column).to_pylist(), strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null text: only the end token. Null id: learned from, not held out. Repeated rows: each is scored and counts.
    Without training texts the model knows nothing and gives each token probability 1 / (0 + 1). Empty table: empty.
    """
    kind: Column = F.coalesce(remainder(F.col(id_col), FOLDS), F.lit(0)).cast("int")
    chunks = staged(coded(docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.alias("kind"), F.col(text_col).alias("text"))))
    total = chunks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    words, pairs = max(1, math.ceil(0.2 * total / RANGE_KEYS)), max(1, math.ceil(0.8 * total / RANGE_KEYS))
    answers = staged(counts(chunks, words, pairs))
    model = Model([tuple(r) for r in word_sums(answers).collect()])  # four sums, and at most the bins of a double's range

    def held(mine: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[tuple[int, int], int] = {}
        for row in mine.to_pylist():
            got = Read(row, words, pairs)
            (w, p), (tw, tp) = got.resolve(_answers(told, "total")), got.resolve(_answers(told, "tuning"))
            w, p = w - tw, p - tp
            context, pair, first = w[got.before], p[got.pair], model.words(w, rest=True)[got.ids]
            seen = context > 0  # without a context there is nothing to weigh
            known = pair > 0
            bins = np.where(known, _bins(np.where(known, first * np.maximum(context, 1) / np.maximum(pair, 1), 1.0)), NEVER)
            keys, n = np.unique(np.stack((context_bucket(context), bins))[:, seen], axis=1, return_counts=True)
            for b, x, k in zip(*keys.tolist(), n.tolist(), strict=True):
                out[b, x] = out.get((b, x), 0) + k
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "bin": pa.array([x for _, x in out], pa.int64()), "n": pa.array(list(out.values()), pa.int64())})

    tuning = chunks.where("tuning").groupBy("chunk").cogroup(answers.where("length(tuning) > 0 AND chunk >= 0").groupBy("chunk"))
    seen = tuning.applyInArrow(held, "bucket int, bin long, n long").groupBy("bucket", "bin").agg(F.sum("n").alias("n"))
    model.learn([(r["bucket"], r["bin"], r["n"]) for r in seen.collect()])  # at most BUCKETS x the bins of a double's range

    def scored(mine: pa.Table, told: pa.Table) -> pa.Table:
        tables = []
        for row in mine.to_pylist():
            got = Read(row, words, pairs)
            w, p = got.resolve(_answers(told, "total"))
            context, pair, first = w[got.before], p[got.pair], model.words(w)[got.ids]
            weight = np.where(context > 0, model.weights[context_bucket(context)], 0.0)
            logs = np.log10(weight * pair / np.maximum(context, 1) + (1 - weight) * first)
            base = np.log10((w + 1) / (model.tokens + model.types + 1))[got.ids]
            sums = lambda x: np.add.reduceat(x, got.starts)
            tables.append(
                pa.table(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(got.kinds == HELD_OUT),
                        pa.array(got.lens.astype(np.int64)),
                        pa.array(sums((w > 0).astype(np.int64)[got.ids])),
                        pa.array(np.full(len(got.lens), model.tokens, np.int64)),
                        pa.array(sums(base)),
                        pa.array(sums(logs)),
                    ],
                    names=[x.split(" ")[0] for x in SCORED.split(", ")],
                )
            )
        return pa.concat_tables(tables) if tables else _nothing()

    joined = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
    return joined.applyInArrow(scored, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _nothing() -> pa.Table:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.table({name: pa.array([], types[kind]) for name, kind in (x.split(" ") for x in SCORED.split(", "))})
