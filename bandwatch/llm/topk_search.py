"""Exact BM25 top-k by an inverted index in shards with block-max WAND, merged under global statistics.

A shard is some thousand documents of one task: their inverted lists, ordered by term. Its documents lie in parts of
like vocabulary and length, and in each part a list is long or short. Queries come in blocks of bounded size, broadcast
one after the other over all shards. For a query, what is short of its lists is scored in full; for the long ones the
maxima per block of BLOCK documents bound what they can add. Each query first visits the few blocks of highest bound,
which gives it a threshold already in its first shard; of the others only blocks whose bound passes that threshold are
scored (the pivot test of WAND, for arrays of documents). A few blocks meet just the queries that need them, as one
product of two small matrices. What passes in single precision is scored in double precision.
A task takes its shards one after the other and keeps each query's k best, which
raises the threshold as it goes; so what it sends does not grow with its shards. The tasks' k best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, staged

K = 10
K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_ENTRIES = 8192, 4_000_000  # a document's number takes bits off what its entries give: no more than 2**16
BLOCK = 64
COMMON_SHARE = 1 / 16  # of a shard's documents: terms in more of them part it
PART_DOCS, PART_DEPTH = 1024, 3  # parts of fewer documents are not cut again; cuts one after the other
LONG_SHARE = 1 / 24  # of a part's documents: lists longer than that are long there
QUERY_TERMS = 2_000_000  # of a block of queries, about: a broadcast of some 40 MB at most
BATCH, GROUP = 256, 4  # queries, and blocks, scored at once
SEEDS = (4, 16)  # so many blocks raise a query's threshold before the others are looked at
PIECE = 2**16  # entries added at once
TASKS_PER_CORE = 2  # that a block of queries is spread over
ROUNDING, LEAST = 2.0**-23, 1e-9  # by term: single precision finds candidates, double precision scores them
DIGITS = 9  # scores are compared to so many decimals, so that equal texts tie


def _press(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


SHARD = "shard long, n_docs long, n_words long, doc_ids array<long>, lens binary, terms binary, df binary, parts binary, docs binary, tf binary"


def _pack(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return _press(x.astype("<u1" if most < 2**8 else "<u2" if most < 2**16 else "<u4"))


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    planes = np.frombuffer(raw, np.uint8).reshape(len(raw) // max(1, n) or 1, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several stretches, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _parts(doc: np.ndarray, term: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """The part of each document: cut in two, again and again, along the main direction of its commoner terms."""
    common = np.flatnonzero(df > COMMON_SHARE * n)
    column = np.full(len(df), -1, np.int32)
    column[common] = np.arange(len(common))
    at = column[term]
    x = np.zeros((n, len(common)), np.float32)
    x[doc[at >= 0], at[at >= 0]] = 1
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    part = np.zeros(n, np.int64)
    todo, made = [(np.arange(n), 0)], 0
    while todo:
        rows, depth = todo.pop()
        least = max(BLOCK, len(rows) // 16)
        if len(rows) >= PART_DOCS and depth < PART_DEPTH and len(common) > 1:
            y = x[rows]
            mean = y.mean(axis=0)
            along = np.random.default_rng(0).standard_normal(y.shape[1]).astype(np.float32)
            for _ in range(8):
                ahead = y @ along - mean @ along
                along = ahead @ y - ahead.sum() * mean
                along /= max(float(np.linalg.norm(along)), 1e-30)
            place = (y @ along - mean @ along).astype(float)
            order = np.argsort(place, kind="stable")
            left, size = np.cumsum(place[order])[:-1], np.arange(1, len(rows))
            apart = (left / size - (left[-1] + place[order[-1]] - left) / (len(rows) - size)) ** 2 * size * (len(rows) - size)
            cut = least + int(np.argmax(apart[least - 1 : len(rows) - least]))
            if apart[cut - 1] > 0:
                todo += [(rows[order[cut:]], depth + 1), (rows[order[:cut]], depth + 1)]
                continue
        part[rows] = made
        made += 1
    return part


class Builder:
    """Documents of a shard being gathered."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lens: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.entries = 0

    def add(self, doc: int, words: list[bytes]) -> None:
        terms, tf = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), return_counts=True)
        self.ids.append(doc)
        self.lens.append(len(words))
        self.terms.append(terms)
        self.tf.append(np.minimum(tf, 2**32 - 1).astype(np.uint32))
        self.entries += len(terms)

    def row(self, name: int) -> pa.RecordBatch:
        n, ids, lens = len(self.ids), np.array(self.ids, np.int64), np.array(self.lens, np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in self.terms])
        hashes, tf = np.concatenate(self.terms), np.concatenate(self.tf)
        self.terms, self.tf = [], []
        by_hash = np.argsort(hashes)
        hashes, tf, doc = hashes[by_hash], tf[by_hash], doc[by_hash]
        del by_hash
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        term = np.cumsum(new, dtype=np.int32) - 1
        hashes, df = hashes[new], np.bincount(term)
        # documents of one vocabulary and length come together
        part = _parts(doc, term, df, n)
        order = np.lexsort((ids, lens, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        bits = n.bit_length(), int(tf.max()).bit_length()
        if len(hashes).bit_length() + sum(bits) < 64:  # one number per entry sorts faster than an order of entries
            key = term.astype(np.int64) << bits[0]
            key |= place[doc]
            key <<= bits[1]
            key |= tf
            key.sort()
            doc, tf = (key >> bits[1]) & ((1 << bits[0]) - 1), key & ((1 << bits[1]) - 1)
        else:
            by_term = np.lexsort((place[doc], term))
            doc, tf = place[doc][by_term], tf[by_term]
        values = [
            name, n, int(lens.sum()), ids[order], _press(lens[order].astype("<u4")), _press(hashes), _press(df.astype("<u4")),
            _press(np.bincount(part).astype("<u4")), _pack(doc), _pack(tf),
        ]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split(" ")[0] for x in SHARD.split(", ")])


def build(docs: DataFrame) -> DataFrame:
    """Shards of (doc_id, text); documents without words are in none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, shard = TaskContext.get().partitionId(), 0, Builder()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := ascii_words(text):
                    shard.add(doc, words)
                if len(shard.ids) >= SHARD_DOCS or shard.entries >= SHARD_ENTRIES:
                    yield shard.row((at << 24) + made)
                    made, shard = made + 1, Builder()
        if shard.ids:
            yield shard.row((at << 24) + made)

    return docs.mapInArrow(rows, SHARD)


def document_counts(shards: DataFrame) -> DataFrame:
    """term, df over all shards."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpress(terms, "<u8").view(np.int64)), pa.array(_unpress(df, "<u4").astype(np.int64))], ["term", "df"])

    return shards.select("terms", "df").mapInArrow(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct words of each query as hashes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.array([xxhash.xxh3_64_intdigest(w) for w in sorted(set(ascii_words(text)))], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), q, np.int64)), pa.array(got.view(np.int64))], ["query_id", "term"])

    return queries.mapInArrow(rows, "query_id long, term long")


class Queries:
    """A block of queries: distinct terms (sorted hashes) with weights, and each query's places in them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, df: np.ndarray, n_docs: int):
        self.ids = ids
        self.terms, first, at = np.unique(terms.view(np.uint64), return_index=True, return_inverse=True)
        self.at = at.astype(np.int32)
        df = df[first]
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        self.edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    @property
    def weights(self) -> np.ndarray:
        """By place: a term weighs the same in all queries."""
        return self.idf[self.at]

    @classmethod
    def of(cls, rows: pa.Table, n_docs: int) -> Queries:
        """From rows of (query_id, terms, df), without an object per term."""
        ids, terms, df = (c.combine_chunks() for c in rows.columns)
        return cls(ids.to_numpy(), pc.list_value_length(terms).to_numpy(), terms.flatten().to_numpy(), df.flatten().to_numpy(), n_docs)


class Shard:
    """An index ready for queries.

    Of the terms that are asked for, lists that are long in a part are columns of its matrix there. What is left of all
    lists are entries of 4 bytes: what a document gives as a single, with the document's number in the last bits. Both
    hold the terms' weights, so that a query is a set of lists. Longer lists come first.
    """

    def __init__(self, row: dict, average: float):
        self.ids = np.array(row["doc_ids"], np.int64)
        self.n = len(self.ids)
        self.terms = _unpress(row["terms"], "<u8")
        self.df = _unpress(row["df"], "<u4").astype(np.int64)
        self.begin = np.cumsum(self.df) - self.df
        n_entries = int(self.df.sum())
        self.docs = _unpack(row["docs"], n_entries)
        self.tf = _unpack(row["tf"], n_entries)
        self.k_doc = K1 * (1 - B + B * _unpress(row["lens"], "<u4") / average)
        self.part_docs = _unpress(row["parts"], "<u4").astype(np.int64)
        self.part_start = np.cumsum(self.part_docs) - self.part_docs
        self.part_edges = [np.arange(0, n, BLOCK) for n in self.part_docs]
        self.edges = np.concatenate([lo + x for lo, x in zip(self.part_start, self.part_edges, strict=True)])
        self.bits = (self.n - 1).bit_length()

    def weigh(self, idf: np.ndarray) -> None:
        """Readies the lists of the terms that have a weight for queries."""
        n_parts = len(self.part_docs)
        asked = np.flatnonzero(idf)
        asked = asked[np.argsort(-self.df[asked], kind="stable")]
        self.list_of = np.zeros(len(self.terms), np.int32)
        self.list_of[asked] = np.arange(len(asked))
        df = self.df[asked]
        places = _spans(self.begin[asked], df)
        self.asked_idf, self.asked_df = idf[asked], df.copy()
        self.asked_docs, self.asked_tf = docs, tf = self.docs.take(places), self.tf.take(places)
        gives = tf.astype(np.float32)
        gives /= gives + self.k_doc.astype(np.float32).take(docs)
        gives *= np.repeat((self.asked_idf * (K1 + 1)).astype(np.float32), df)
        # lists that could be long in some part, and where their entries lie
        could = int(np.searchsorted(-df, -max(8, LONG_SHARE * self.part_docs.min())))
        held = slice(int(df[:could].sum()))
        cell = np.repeat(np.arange(could, dtype=np.int32) * n_parts, df[:could])
        cell += np.repeat(np.arange(n_parts, dtype=np.int32), self.part_docs).take(docs[held])
        sizes = np.bincount(cell, minlength=could * n_parts).reshape(-1, n_parts)
        long = sizes > np.maximum(8, LONG_SHARE * self.part_docs)
        column_of = np.where(long, np.cumsum(long, axis=0) - 1, -1)
        self.column_of = np.ascontiguousarray(column_of.T).astype(np.int32)
        width = np.count_nonzero(long, axis=0)
        base = np.cumsum(self.part_docs * width) - self.part_docs * width
        far = np.flatnonzero(long.ravel().take(cell))
        start = np.concatenate([lo + np.arange(n) * w for lo, n, w in zip(base, self.part_docs, width, strict=True)])
        at = column_of.ravel().take(cell[far])
        at += start.take(docs[far])
        flat = np.zeros(int((self.part_docs * width).sum()), np.float32)
        flat[at] = gives[far]
        del cell, at
        self.matrices = [flat[lo : lo + n * w].reshape(n, w) for lo, n, w in zip(base, self.part_docs, width, strict=True)]
        self.maxima = [np.maximum.reduceat(m, edges, axis=0) for m, edges in zip(self.matrices, self.part_edges, strict=True)]
        short = np.ones(len(docs), bool)
        short[far] = False
        df[:could] -= np.where(long, sizes, 0).sum(axis=1)
        self.start = np.concatenate(([0], np.cumsum(df))).astype(np.int32)
        self.entries = ((gives.view(np.uint32) >> self.bits << self.bits) | docs)[short]

    def by_doc(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these documents (ascending): where each begins, its lists, and what they give in double precision."""
        wanted = np.zeros(self.n, bool)
        wanted[docs] = True
        places = np.flatnonzero(wanted.take(self.asked_docs))
        places = places[np.argsort(self.asked_docs.take(places), kind="stable")]  # by counting, numbers being short
        doc = self.asked_docs.take(places)
        lists = np.repeat(np.arange(len(self.asked_df), dtype=np.int32), self.asked_df).take(places)
        tf = self.asked_tf.take(places).astype(float)
        gives = self.asked_idf.take(lists) * (tf * (K1 + 1) / (tf + self.k_doc.take(doc)))
        return np.searchsorted(doc, np.append(docs, self.n)), lists, gives


def _ranked(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the k best of their group, group by group, and their ranks from 0."""
    order = np.lexsort((ids, -scores, groups))
    at = groups[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return order[rank < k], rank[rank < k]


class Best:
    """The k best documents of each query of a block so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found = np.zeros(queries, np.int64)
        self.docs = np.zeros((queries, k), np.int64)
        self.scores = np.zeros((queries, k))

    @property
    def ids(self) -> list[np.ndarray]:
        return [x[:n] for x, n in zip(self.docs, self.found, strict=True)]

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        names, at = np.unique(queries, return_inverse=True)
        old = np.arange(self.k) < self.found[names, None]
        at = np.concatenate((np.nonzero(old)[0], at))
        ids, scores = np.concatenate((self.docs[names][old], ids)), np.concatenate((self.scores[names][old], scores))
        keep, rank = _ranked(at, scores, ids, self.k)
        self.docs[names[at[keep]], rank] = ids[keep]
        self.scores[names[at[keep]], rank] = scores[keep]
        self.found[names] = np.minimum(self.k, np.bincount(at, minlength=len(names)))


class Rough:
    """What a shard's documents score at least, for each query, in single precision; candidates among them."""

    def __init__(self, scores: np.ndarray, slack: np.ndarray):
        self.k = scores.shape[1]
        self.low, self.slack = scores.copy(), slack  # the k highest scores so far, as found or less than they are
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def least(self, queries: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a document must reach in single precision; equal scores may still win by their id."""
        return np.maximum(self.low[queries, -1] * (1 - self.slack[queries]) - LEAST, LEAST)

    def add(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        scores = scores.astype(float)
        names, at = np.unique(queries, return_inverse=True)
        groups = np.concatenate((np.repeat(np.arange(len(names)), self.k), at))
        low = np.concatenate((self.low[names].ravel(), scores * (1 - self.slack[queries])))
        keep, rank = _ranked(groups, low, np.zeros(len(low), bool), self.k)
        self.low[names[groups[keep]], rank] = low[keep]
        keep = scores >= self.least(queries)
        self.found.append((queries[keep], docs[keep], scores[keep]))

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and documents (ascending) that must be scored exactly."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        queries, docs, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = np.flatnonzero(scores >= self.least(queries))
        keep = keep[np.argsort(docs[keep], kind="stable")]
        return queries[keep], docs[keep]


def score_batch(shard: Shard, terms: list[np.ndarray], weights: list[np.ndarray], numbers: list[int], best: Best) -> int:
    """Adds to best what the shard has for some queries (numbers; places of their terms in the shard's lists, and weights)."""
    flat, idf = np.concatenate(terms), np.zeros(len(shard.terms))
    idf[flat] = np.concatenate(weights)
    shard.weigh(idf)
    return score_all(shard, flat, np.array([len(t) for t in terms], np.int64), np.asarray(numbers), best)


def score_all(shard: Shard, terms: np.ndarray, sizes: np.ndarray, names: np.ndarray, best: Best) -> int:
    """Adds to best what the shard has for some queries (names), given by their terms one after the other.

    Scores in single precision raise the thresholds, less what they can be wrong by; what passes in the end is scored
    exactly. Returns how many blocks were scored, by query.
    """
    names, sizes = names[sizes > 0], sizes[sizes > 0]  # queries of no term here find nothing
    if not len(sizes):
        return 0
    lists = shard.list_of.take(terms)
    starts = np.cumsum(sizes) - sizes
    rough = Rough(best.scores[names], (sizes + 8 + 2.0**shard.bits) * ROUNDING)
    # queries of one vocabulary, and of like length, come together, since they share blocks
    far = np.flatnonzero(lists < shard.column_of.shape[1])
    query = np.repeat(np.arange(len(sizes)), sizes)[far]
    shares = np.stack([np.bincount(query, column.take(lists[far]) >= 0, len(sizes)) / max(1, m.shape[1]) ** 0.5 for column, m in zip(shard.column_of, shard.matrices, strict=True)])
    order = np.lexsort((sizes, np.argmax(shares, axis=0)))
    scored = 0
    for lo in range(0, len(order), BATCH):
        q = order[lo : lo + BATCH]
        scored += score_some(shard, lists.take(_spans(starts[q], sizes[q])), sizes[q], q, rough)
    queries, docs = rough.left()
    if len(queries):
        best.add(names[queries], shard.ids[docs], exact(shard, lists, starts, sizes, queries, docs))
    return scored


def score_some(shard: Shard, lists: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, rough: Rough) -> int:
    """Finds candidates for a batch of queries, given by their lists one after the other.

    Short lists are added in full, long ones bound what they can add to a block. Queries without a threshold first
    visit some SEEDS blocks of highest bound. A block meets only the queries whose bound passes their threshold.
    """
    query = np.repeat(np.arange(len(sizes)), sizes)
    far = np.flatnonzero(lists < shard.column_of.shape[1])
    long, asking = lists[far], query[far]
    sparse = np.zeros((len(sizes), shard.n), np.float32)
    add_short(shard, sparse, query, lists)
    bound = np.maximum.reduceat(sparse, shard.edges, axis=1)
    wides, block_of, block = [], [], 0
    for column_of, matrix, maxima in zip(shard.column_of, shard.matrices, shard.maxima, strict=True):
        column = column_of.take(long)
        here = np.flatnonzero(column >= 0)
        wide = np.zeros((len(sizes), matrix.shape[1]), np.float32)
        wide[asking[here], column[here]] = 1
        block_of.append((block, block + len(maxima)))
        bound[:, slice(*block_of[-1])] += wide @ maxima.T
        block += len(maxima)
        wides.append(wide)
    rank = np.full(bound.shape, bound.shape[1])
    if len(cold := np.flatnonzero(rough.least(numbers) <= LEAST)):
        ranked = np.empty((len(cold), bound.shape[1]), np.int64)
        np.put_along_axis(ranked, np.argsort(-bound[cold], axis=1), np.arange(bound.shape[1])[None], axis=1)
        rank[cold] = ranked
    done = scored = 0
    for upto in (*SEEDS, bound.shape[1] + 1) if len(cold) else (bound.shape[1] + 1,):
        seeds = 1 if upto == SEEDS[0] else 0
        least = rough.least(numbers).astype(np.float32)
        wanted = ((rank >= done) & (rank < upto) & (bound >= least[:, None])).T
        done = upto
        scored += int(np.count_nonzero(wanted))
        queries, docs, scores = [], [], []
        for wide, matrix, first, blocks in zip(wides, shard.matrices, shard.part_start, block_of, strict=True):
            for block in range(*blocks, seeds or GROUP):
                mine = wanted[block : min(block + (seeds or GROUP), blocks[1])]
                some, lo = np.flatnonzero(mine.any(axis=0)), shard.edges[block]
                if not len(some):
                    continue
                hi = min(lo + len(mine) * BLOCK, first + len(matrix))
                if len(some) == len(sizes):
                    near = wide @ matrix[lo - first : hi - first].T
                    near += sparse[:, lo:hi]
                else:
                    near = wide[some] @ matrix[lo - first : hi - first].T
                    near += sparse[some, lo:hi]
                limit = least[some]
                if seeds and near.shape[1] > rough.k:  # no threshold yet but among themselves
                    limit = np.maximum(limit, np.partition(near, -rough.k, axis=1)[:, -rough.k] * (1 - 2 * rough.slack[numbers[some]]).astype(np.float32))
                hit = np.flatnonzero(near >= limit[:, None])
                if len(hit):
                    q, d = np.divmod(hit, near.shape[1])
                    asking = mine[d // BLOCK, some[q]]
                    queries.append(some[q[asking]])
                    docs.append(d[asking] + lo)
                    scores.append(near.ravel()[hit[asking]])
        if queries:
            rough.add(numbers[np.concatenate(queries)], np.concatenate(docs), np.concatenate(scores))
    return scored


def add_short(shard: Shard, sums: np.ndarray, query: np.ndarray, lists: np.ndarray) -> None:
    """Adds to sums (queries x documents) what is short of these lists gives."""
    start = shard.start.take(lists)
    sizes = shard.start.take(lists + 1) - start
    some = np.flatnonzero(sizes)
    start, sizes, base = start[some], sizes[some], (query[some] * shard.n).astype(np.int32)
    flat, ends = sums.reshape(-1), np.cumsum(sizes, dtype=np.int64)
    number = np.uint32((1 << shard.bits) - 1)
    lo = 0
    while lo < len(sizes):  # in pieces that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
        size = sizes[lo:hi]
        got = shard.entries.take(_spans(start[lo:hi], size))
        at = np.repeat(base[lo:hi], size)
        at += (got & number).view(np.int32)
        np.add.at(flat, at.astype(np.int64), got.view(np.float32))
        lo = hi


def exact(shard: Shard, lists: np.ndarray, starts: np.ndarray, sizes: np.ndarray, queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The scores in double precision of pairs of a query (its lists begin at starts) and a document (ascending)."""
    names, at = np.unique(docs, return_inverse=True)
    first, has, gives = shard.by_doc(names)
    row = np.zeros(len(shard.start))
    out = np.empty(len(docs))
    last, lo, hi = -1, 0, 0
    lows = starts[queries]
    for i, (d, begin, end) in enumerate(zip(at.tolist(), lows.tolist(), (lows + sizes[queries]).tolist(), strict=True)):
        if d != last:
            row[has[lo:hi]] = 0
            last, lo, hi = d, first[d], first[d + 1]
            row[has[lo:hi]] = gives[lo:hi]
        out[i] = row.take(lists[begin:end]).sum()
    return np.round(out, DIGITS)


def answer(shards: Iterator[dict], block: Queries, average: float, k: int) -> pa.RecordBatch:
    """The k best of all these shards for each query of a block."""
    best = Best(len(block.ids), k)
    numbers = np.arange(len(block.ids))
    for row in shards:
        shard = Shard(row, average)
        at = np.minimum(np.searchsorted(shard.terms, block.terms), len(shard.terms) - 1).astype(np.int32)
        at[shard.terms[at] != block.terms] = -1
        idf = np.zeros(len(shard.terms))
        idf[at[at >= 0]] = block.idf[at >= 0]
        shard.weigh(idf)
        flat = at[block.at]
        here = flat >= 0
        if here.any():
            sizes = np.diff(np.concatenate(([0], np.cumsum(here)))[block.edges])
            score_all(shard, flat[here], sizes, numbers, best)
        del shard, row  # before the next one is made
    columns = [np.repeat(block.ids, best.found), *(x[np.arange(k) < best.found[:, None]] for x in (best.docs, best.scores))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score of the k best documents of each query, by score, then doc_id.

    A query is the set of its words (id and text columns as in docs); a word counts once. Queries and documents
    without words, and documents that share none, give no rows. Rows with a null id are left out; a query_id that
    occurs twice is searched as one query of the words of both.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    shards = staged(build(pick(docs)))
    sums = shards.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    n_docs, average = sums["d"] or 0, (sums["w"] or 0) / max(1, sums["d"] or 0)
    asked = query_terms(pick(queries)).distinct().join(document_counts(shards), "term")
    asked = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t"))
    asked = staged(asked.select("query_id", F.col("t.term").alias("terms"), F.col("t.df").alias("df")))
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / QUERY_TERMS))
    spark, parts = docs.sparkSession, []
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()  # QUERY_TERMS terms, about
        shared = spark.sparkContext.broadcast(Queries.of(rows, n_docs))
        del rows

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield answer((row for batch in batches for row in batch.to_pylist()), shared.value, average, k)

        parts.append(staged(shards.coalesce(tasks).mapInArrow(run, "query_id long, doc_id long, score double")))
        shared.unpersist()
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # k rows of each shard
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
