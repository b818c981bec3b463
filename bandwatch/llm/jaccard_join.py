"""Self-join on the Jaccard similarity of word shingles by T-occurrence search, and its classes.

1. Each text becomes a set of 64-bit shingle hashes; equal sets are one class from here on.
2. A shingle that no other text holds cannot be shared. Tasks send each hash once, in arrays by hash range, and
   learn how many of a text's shingles are shared. Two sets at similarity t share at least t of the larger one,
   so texts with fewer shared shingles link with nothing: most of a corpus ends here.
3. The others' shingles are ordered from rare to frequent. Linked sets meet in the first s - T + 1 of the s shared
   ones (T: required overlap), so components over these are blocks that no link leaves.
4. Blocks are searched for T occurrences: the short inverted lists of a query are merged on a heap, the long ones
   probed by bisection (DivideSkip). Lists hold classes of texts already linked, so a group of thousands of near
   copies costs one entry per list. In a block beyond a task's size each text is first held against the block's
   most central one; then only the texts that do not link with it are searched, part by part, against all parts.
   So a group of near copies of one text costs a pass over it, however large it is.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, staged
from .graph import components

WORDS = 5
NUM, DEN = 3, 4  # similarity 0.75
FLUSH_KEYS = 1_000_000  # shingles that a task gathers before it sends them
BUCKET_KEYS = 3_000_000  # shingles of a hash range, about
TASK_KEYS = 400_000  # shingles that one task searches, about
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes: a broadcast of at most 8 MB, else a shuffle join
LONG_LISTS = 0.0085  # fixed value: weight of the length of the longest list in the number of long lists
ROWS = 512
CACHED = 200_000  # words whose hashes a worker remembers; beyond that it starts afresh


class WordHashes(dict[bytes, int]):
    """64-bit hashes of words, remembered by a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = WordHashes()


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than WORDS words: one hash of all; none: empty."""
    split = [ascii_words(x) for x in texts]
    flat = [w for words in split for w in words]
    codes = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
    with np.errstate(over="ignore"):
        rolled = np.full(max(0, len(codes) - WORDS + 1), WORDS, np.uint64)
        for k in range(WORDS):
            rolled = _mix(rolled, codes[k : k + len(rolled)])
        out, start = [], 0
        for words in split:
            n = len(words)
            if n >= WORDS:
                out.append(np.unique(rolled[start : start + n - WORDS + 1]))
            elif n:
                h = np.full(1, n, np.uint64)
                for k in range(n):
                    h = _mix(h, codes[start + k : start + k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
    return out


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), shingle_sets(part.column(1).to_pylist())


def _signature(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (128 bits of the whole set)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array([_signature(x) for x in sets], pa.binary())], ["doc_id", "n_shingles", "sig"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, sig binary")


def shared_counts(docs: DataFrame, total: int) -> DataFrame:
    """doc_id and how many of its shingles occur in another row, or slightly more: hashes are cut to a range and 32 bits.

    A shingle that occurs twice among the rows a task gathers is counted there, and sent once to tell the others;
    so the most frequent shingle is no more than one entry per task and gathering.
    """
    buckets = max(1, math.ceil(total / BUCKET_KEYS))

    def packed(ids: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, key = np.concatenate(ids), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        doc, key = doc[order], key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        last = np.concatenate((first[1:], [True]))
        single = first & last
        own, counts = np.unique(doc[~single], return_counts=True)
        rows = [(-1, own.tobytes(), counts.astype(np.int32).tobytes(), b"")]
        # a shared one is sent without a document, last and with a negative number: nobody waits for its answer
        doc, key, single = np.where(single, doc, 0)[first], key[first], single[first]
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, ~single, bucket))
        doc, key, bucket, single = doc[order], key[order], bucket[order], single[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, lo, hi in zip(range(buckets), edges[:-1], edges[1:], strict=True):
            if lo < hi:
                mid = lo + int(np.count_nonzero(single[lo:hi]))
                owners, lens = np.unique(doc[lo:mid], return_counts=True)
                if mid < hi:
                    owners, lens = np.append(owners, 0), np.append(lens, mid - hi)
                rows.append((b, owners.tobytes(), lens.astype(np.int32).tobytes(), key[lo:hi].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
            ["bucket", "owners", "lens", "keys"],
        )

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        size = 0
        for doc_ids, sets in _sets(batches):
            for i, s in zip(doc_ids.to_pylist(), sets, strict=True):
                ids.append(np.full(len(s), i, np.int64))
                keys.append(s)
                size += len(s)
            if size >= FLUSH_KEYS:
                yield from packed(ids, keys)
                ids, keys, size = [], [], 0
        if size:
            yield from packed(ids, keys)

    def told(part: pa.Table) -> pa.Table:
        owners = np.frombuffer(b"".join(part.column("owners").to_pylist()), np.int64)
        lens = np.frombuffer(b"".join(part.column("lens").to_pylist()), np.int32)
        if part.column("bucket")[0].as_py() < 0:
            doc, counts = owners, lens
        else:
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint32)
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            shared = np.zeros(len(keys), bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            waits = np.repeat(lens > 0, np.abs(lens))
            doc, counts = np.unique(np.repeat(owners, np.abs(lens))[shared & waits], return_counts=True)
        # one row for each range of ids, not for each document: a hash range knows something of most documents
        ranges = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(ranges, kind="stable")
        doc, counts = doc[order], counts[order]
        which, first = np.unique(ranges[order], return_index=True)
        parts = list(zip(np.split(doc, first[1:]), np.split(counts, first[1:]), strict=True)) if len(which) else []
        return pa.table(
            [
                pa.array(which.astype(np.int64), pa.int64()),
                pa.array([d.astype("<i8").tobytes() for d, _ in parts], pa.binary()),
                pa.array([n.astype("<i4").tobytes() for _, n in parts], pa.binary()),
            ],
            names=["of", "docs", "counts"],
        )

    def summed(part: pa.Table) -> pa.Table:
        docs, of = np.unique(np.frombuffer(b"".join(part.column("docs").to_pylist()), "<i8"), return_inverse=True)
        counts = np.bincount(of, np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i4"), len(docs))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "shared": pa.array(counts.astype(np.int64))})

    sent = docs.mapInArrow(gather, "bucket int, owners binary, lens binary, keys binary")
    # local counts (-1) are rows of their own already: spread them over tasks
    split = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("owners"), F.lit(buckets))).otherwise(0)
    answers = sent.withColumn("split", split).groupBy("bucket", "split").applyInArrow(told, "of long, docs binary, counts binary")
    return answers.groupBy("of").applyInArrow(summed, "doc_id long, shared long")


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, sig, keys (array of longs)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            for at in range(0, len(sets), 64):
                some = sets[at : at + 64]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 64), pa.array([_signature(x) for x in some], pa.binary()), keys], ["doc_id", "sig", "keys"])

    return docs.mapInArrow(rows, "doc_id long, sig binary, keys array<long>")


class Index:
    """Inverted lists over classes of linked sets, searched for T occurrences."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.members: list[list[int]] = []  # of each class: places in sets
        self.sets: list[frozenset[int]] = []
        self.sizes: list[int] = []
        self.known = -1  # the class of sets known to be connected
        self.parent: list[int] = []

    def root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def candidates(self, keys: list[int], least: int) -> list[int]:
        """Classes whose lists hold at least `least` of the keys (a bound for each member of the class)."""
        lists = sorted((x for k in keys if (x := self.lists.get(k))), key=len)
        if len(lists) < least:
            return []
        long = min(least - 1, int(least / (LONG_LISTS * math.log2(len(lists[-1]) + 1) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        found = []
        count, last = 0, -1
        for c in [*heapq.merge(*short), -1]:
            if c != last:
                if last >= 0 and count >= least - long:
                    for left, x in zip(range(len(probed), 0, -1), probed, strict=True):
                        if count >= least or count + left < least:
                            break
                        at = bisect.bisect_left(x, last)
                        count += at < len(x) and x[at] == last
                    if count >= least:
                        found.append(last)
                count, last = 0, c
            count += 1
        return found

    def add(self, keys: list[int], size: int, known: bool = False) -> list[int]:
        """Adds a set (keys: those that others may share; size: its whole size); places of sets that it links with,
        one for each class not yet connected to it. Sets must come in order of size. Those marked as known are
        connected with each other already."""
        mine, links = frozenset(keys), []
        own = self.known if known else -1
        for c in self.candidates(keys, -(-NUM * size // DEN)):
            if own >= 0 and self.root(c) == self.root(own):
                continue
            for place in reversed(self.members[c]):
                other = self.sizes[place]
                if DEN * other < NUM * size:
                    break  # members are in order of size: the rest is smaller still
                if (NUM + DEN) * len(mine & self.sets[place]) >= NUM * (size + other):
                    links.append(place)
                    if own < 0:
                        own = c
                    else:
                        self.parent[self.root(c)] = self.root(own)
                    break
        if own < 0:
            own = len(self.members)
            self.members.append([])
            self.parent.append(own)
            if known:
                self.known = own
        elif known and self.known < 0:
            self.known = own
        self.members[own].append(len(self.sets))
        self.sets.append(mine)
        self.sizes.append(size)
        for k in keys:
            x = self.lists.setdefault(k, [])
            if not x or x[-1] < own:
                x.append(own)
            else:
                at = bisect.bisect_left(x, own)
                if x[at] != own:
                    x.insert(at, own)
        return links


def search(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect what is connected among the rows (node, n_shingles, keys, known)."""
    rows = rows.sort_values(["n_shingles", "node"], kind="stable")
    nodes, index = rows["node"].tolist(), Index()
    a, b = [], []
    for node, size, keys, known in zip(nodes, rows["n_shingles"].tolist(), rows["keys"], rows["known"].tolist(), strict=True):
        for place in index.add([int(k) for k in keys], size, known):
            a.append(node)
            b.append(nodes[place])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def ordered_lists(sets: DataFrame) -> DataFrame:
    """node, n_shingles, keys that another set holds, from rare to frequent, and centre (sum of how often they are
    held); without sets that have too few of them."""
    each = sets.select(F.col("doc_id").alias("node"), F.size("keys").alias("n_shingles"), F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = each.join(often, "key").groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("k"))
    return lists.where(DEN * F.size("k") >= NUM * F.col("n_shingles")).select(
        "node", "n_shingles", F.col("k.key").alias("keys"), F.aggregate("k.df", F.lit(0).cast("long"), lambda a, x: a + x).alias("centre")
    )


def blocks(lists: DataFrame) -> DataFrame:
    """node, block: sets that may link, directly or through others, are in one block; lone sets have none."""
    least = F.ceil(NUM * F.col("n_shingles") / DEN).cast("int")
    prefix = lists.select("node", F.explode(F.slice("keys", F.lit(1), F.size("keys") - least + 1)).alias("key"))
    first = prefix.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = prefix.join(first, "key").select(F.col("node").alias("a"), "b").distinct()
    return components(edges).select("node", F.col("component").alias("block"))


def links(sets: DataFrame, task_keys: int = TASK_KEYS) -> DataFrame:
    """Links (a, b) between sets (doc_id, keys): not all, but enough to connect what is connected."""
    lists = staged(ordered_lists(sets))
    rows = staged(lists.join(blocks(lists), "node").withColumn("weight", F.size("keys").cast("long")))
    sizes = staged(rows.groupBy("block").agg(F.sum("weight").alias("block_keys")))
    total = sizes.agg(F.sum("block_keys").alias("n")).first()["n"] or 0
    bins = max(1, math.ceil(total / task_keys))
    task = ["node", "n_shingles", "keys", "known", "block", "i", "j"]
    # small blocks share tasks
    small = rows.join(sizes.where(F.col("block_keys") <= task_keys), "block")
    small = small.withColumns({"known": F.lit(False), "i": F.lit(-1), "j": F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int")})
    small = small.withColumn("block", F.lit(0).cast("long")).select(task)

    large = rows.join(sizes.where(F.col("block_keys") > task_keys), "block")
    central = F.max_by(F.struct("node", "n_shingles", "keys"), F.struct("centre", -F.col("node")))
    judged = large.join(large.groupBy("block").agg(central.alias("first")), "block")
    shared = F.size(F.array_intersect("keys", "first.keys"))
    known = (NUM + DEN) * shared >= NUM * (F.col("n_shingles") + F.col("first.n_shingles"))
    judged = staged(judged.withColumn("known", known).withColumn("first", F.col("first.node")))
    star = judged.where("known AND node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    parts = lambda keys: F.ceil(2 * F.col(keys) / task_keys).cast("int")
    open_keys = judged.where("NOT known").groupBy("block").agg(F.sum("weight").alias("open_keys"))
    cut = judged.join(open_keys, "block").withColumns({"n_i": parts("open_keys"), "n_j": parts("block_keys")})
    cut = cut.withColumns({"own_i": F.pmod(F.xxhash64("node"), "n_i").cast("int"), "own_j": F.pmod(F.xxhash64("node", "block"), "n_j").cast("int")})
    asked = cut.where("NOT known").withColumn("i", F.col("own_i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    told = cut.withColumn("j", F.col("own_j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))
    told = told.where("known OR i <> own_i")
    tasks = small.unionByName(asked.select(task)).unionByName(told.select(task)).groupBy("block", "i", "j")
    found = tasks.applyInPandas(lambda part: search(part[["node", "n_shingles", "keys", "known"]]), "a long, b long")
    return found.unionByName(star)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of each row.

    Without words: empty set, linked with nothing. Texts of equal sets are linked. Rows that repeat a doc_id are one
    document as far as links go. A null doc_id has a null component. Empty table: empty result.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(signatures(picked))
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    total = rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    shared = shared_counts(picked.where("doc_id IS NOT NULL"), total)
    left = shared.join(classes, shared["doc_id"] == classes["rep"]).where(DEN * F.col("shared") >= NUM * F.col("n")).select("doc_id", "sig")
    left = staged(left)
    ids = left.select("doc_id").distinct()
    if left.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sets = sets_of(picked.join(ids, "doc_id", "left_semi"))
    sets = staged(sets.join(left, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"]))
    reached = components(links(sets))
    named = classes.join(reached, classes["rep"] == reached["node"], "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    joined = rows.join(named, (rows["sig"] == named["sig"]) & (rows["n_shingles"] > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))
