"""Packing documents into sequences of fixed length by a grouping genetic algorithm on islands.

Pieces of full length are sequences by themselves. The others are dealt to shards of about SHARD_TOKENS tokens and
SHARD_PIECES pieces at most. Pieces of one length are alike, so a shard is evolved from its counts by length: several
islands start from best-fit orders, cross whole well-filled sequences into each other, and send their best to the next
island between epochs. In a crossover, pieces that lost their sequence first take the places of shorter ones, then go
where they fit best. An island stops once it has as few sequences as a lower bound allows, or gains nothing more. At
last the shard's pieces take the places of the best plan. No task sees more than a shard.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 1024
END_ID = 2
SHARD_TOKENS = 1 << 24
SHARD_PIECES = 1 << 18  # what a shard of short texts is bounded by
ISLANDS, EPOCHS = 2, 2
POPULATION, GENERATIONS = 6, 16
PATIENCE = 5  # generations without a gain
INJECTED = 0.3  # share of the other parent's sequences that a crossover takes
ROWS = 512

#: Text of these characters is split alike by both libraries; other text takes the slower one.
PLAIN = re.compile("[\t-\r -~¡-¬®-ɏ]*")


class Tokens:
    """Ids of whole texts by the published byte-level vocabulary, equal to the tokenizers library's, as little-endian bytes."""

    def __init__(self, path: str):
        self.path = path
        import base64

        import public_tokenizers
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self.full = None

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and END_ID, cut only beyond the capacity.

    The first piece of a long document is the shorter one. Null text: END_ID alone.
    """
    path = path or default_path()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                owner, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = (tokens(path).encode(text) if text else b"") + end
                    n = len(ids) // 4
                    begin, stop = 0, (n - 1) % capacity + 1
                    while begin < n:
                        owner.append(k)
                        piece.append(0 if begin == 0 else piece[-1] + 1)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(ids[4 * begin : 4 * stop]))
                        begin, stop = stop, stop + capacity
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(rows, f"doc_id {dict(picked.dtypes)['doc_id']}, {PIECE}")


class Bins:
    """Sequences being filled: which one each item is in, and open sequences by free space for best fit."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.of = [-1] * len(lengths)
        self.free: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit f: some sequence has f free

    def add_bin(self, items: Iterable[int]) -> None:
        """A sequence with these items."""
        k, room = len(self.free), self.capacity
        for i in items:
            self.of[i] = k
            room -= int(self.lengths[i])
        self.free.append(room)
        self._file(k, room)

    def _file(self, k: int, room: int) -> None:
        if room:
            self.open[room].append(k)
            self.mask |= 1 << room

    def best_fit(self, items: Iterable[int]) -> None:
        """Each item, in order, into the fullest sequence that has room, else a new one."""
        sizes, of, free, stacks = self.lengths.tolist(), self.of, self.free, self.open
        for i in items:
            size = sizes[i]
            rest = self.mask >> size
            if rest:
                room = size + ((rest & -rest).bit_length() - 1)
                k = stacks[room].pop()
                if not stacks[room]:
                    self.mask ^= 1 << room
            else:
                k, room = len(free), self.capacity
                free.append(room)
            of[i] = k
            free[k] = room - size
            self._file(k, room - size)


def fitness(of: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; then the fuller the full ones, the better (negative mean square of the filling)."""
    fill = np.bincount(of, lengths)
    return len(fill), -float(np.mean((fill / capacity) ** 2))


def least_sequences(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of sequences: for any short length, what is longer than half shares its sequence
    with nothing else of that kind, and what is at least that short fills the room left there first."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for short in range(1, half + 1):
        alone = int(number[-1] - number[capacity - short])
        large = int(number[capacity - short] - number[half])
        room = large * capacity - int(total[capacity - short] - total[half])
        rest = int(total[half] - total[short - 1]) - room
        best = max(best, alone + large + max(0, -(-rest // capacity)))
    return best


def start_from(lengths: np.ndarray, capacity: int, rng: random.Random, noise: float) -> np.ndarray:
    """Best fit in decreasing order, with some noise in the order."""
    bins = Bins(lengths, capacity)
    key = lengths + np.array([rng.uniform(0, noise) for _ in range(len(lengths))]) if noise else lengths
    bins.best_fit(np.argsort(-key, kind="stable").tolist())
    return np.array(bins.of)


def swap_in(groups: list[list[int]], left: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Fill sequences better by a displaced item in place of one or two shorter ones; the displaced then, long ones first.

    Of each sequence with room that swap is made which fills it most.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0  # bit n: a displaced item has length n
    for i in left:
        stacks.setdefault(sizes[i], []).append(i)
        mask |= 1 << sizes[i]
    for group in groups:
        room = capacity - sum(sizes[i] for i in group)
        if not room or not mask:
            continue
        held: dict[int, list[int]] = {}
        for i in group:
            held.setdefault(sizes[i], []).append(i)
        lengths, gain, choice, size = sorted(held), 0, [], 0
        for k, x in enumerate(lengths):
            outs = [held[x][:1]] + ([held[x][:2]] if len(held[x]) > 1 else []) + [[held[x][0], held[y][0]] for y in lengths[k + 1 :]]
            for out in outs:
                gone = sum(sizes[i] for i in out)
                longest = (mask & ((2 << (gone + room)) - 1)).bit_length() - 1
                if longest - gone > gain:
                    gain, choice, size = longest - gone, out, longest
        if choice:
            group[:] = [*(i for i in group if i not in choice), stacks[size].pop()]
            if not stacks[size]:
                mask ^= 1 << size
            for i in choice:
                stacks.setdefault(sizes[i], []).append(i)
                mask |= 1 << sizes[i]
    return [i for size in sorted(stacks, reverse=True) for i in stacks[size]]


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Whole well-filled sequences of b, then those of a that share no item with them; what is left is swapped in or best fitted."""
    fill = np.bincount(b, lengths)
    well = np.flatnonzero(fill >= np.median(fill))
    injected = np.array(rng.sample(well.tolist(), max(1, int(len(well) * INJECTED))))
    taken = np.isin(b, injected)
    broken = np.zeros(a.max() + 1, bool)
    broken[a[taken]] = True
    kept = ~taken & ~broken[a]
    groups: list[list[int]] = []
    for parent, chosen in ((b, taken), (a, kept)):
        items = np.flatnonzero(chosen)
        items = items[np.argsort(parent[items], kind="stable")]
        groups += [x.tolist() for x in np.split(items, np.flatnonzero(np.diff(parent[items])) + 1) if len(x)]
    left = swap_in(groups, np.flatnonzero(~taken & ~kept).tolist(), lengths.tolist(), capacity)
    child = Bins(lengths, capacity)
    for group in groups:
        child.add_bin(group)
    child.best_fit(left)
    return np.array(child.of)


def evolve(counts: dict[int, int], elites: list[bytes], seed: int, capacity: int = CAPACITY) -> bytes:
    """The best plan of an island after an epoch: for each item, by length, its sequence (as little-endian int32)."""
    lengths = np.repeat(np.array(sorted(counts)), [counts[x] for x in sorted(counts)])
    least = least_sequences(lengths, capacity)
    rng = random.Random(seed)
    score = lambda x: fitness(x, lengths, capacity)
    people = [np.frombuffer(x, "<i4").astype(int) for x in elites]
    if not people:
        people = [start_from(lengths, capacity, rng, 0)]
    best = min(people, key=score)
    if score(best)[0] > least:
        people += [start_from(lengths, capacity, rng, capacity / 16) for _ in range(POPULATION - len(people))]
        since = 0
        for _ in range(GENERATIONS):
            people.sort(key=score)
            since = 0 if score(people[0]) < score(best) else since + 1
            best = min(best, people[0], key=score)
            if score(best)[0] <= least or since > PATIENCE:
                break
            a, b = people[0], people[rng.randrange(1, len(people))]
            people[-2:] = [cross(a, b, lengths, capacity, rng), cross(b, a, lengths, capacity, rng)]
        best = min([best, *people], key=score)
    return best.astype("<i4").tobytes()


PLAN = "shard long, island int, plan binary, bins long, fit double"


def _epoch(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows["shard"][0]), int(rows["island"][0])
        counts = {int(k): int(v) for k, v in zip(rows["sizes"][0], rows["counts"][0], strict=True)}
        elites = sorted(bytes(x) for x in rows["plan"] if x is not None)
        plan = evolve(counts, elites, 1000 * len(elites) + island, capacity)
        lengths = np.repeat(np.array(sorted(counts)), [counts[x] for x in sorted(counts)])
        bins, fit = fitness(np.frombuffer(plan, "<i4"), lengths, capacity)
        return pd.DataFrame({"shard": [shard], "island": [island], "plan": [plan], "bins": [bins], "fit": [fit]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most `capacity` tokens, gapless from 0.

    pieces has doc_id, piece, start, length (1 to capacity), ids_crc32. Repeated rows are packed each. Empty: empty.
    """
    rows = staged(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row")))
    total, pieces_left = rows.where(F.col("length") < capacity).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil(total / shard_tokens), math.ceil(pieces_left / shard_pieces))
    full = rows.where(F.col("length") >= capacity).select(
        *rows.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = rows.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    sizes = short.groupBy("shard", "length").count().groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "count"))).alias("h"))
    sizes = staged(sizes.select("shard", F.col("h.length").alias("sizes"), F.col("h.count").alias("counts")))
    on_islands = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    plans = None
    for _ in range(epochs):
        if plans is None:
            given = on_islands.withColumn("plan", F.lit(None).cast("binary"))
        else:
            guests = plans.withColumn("island", (F.col("island") + 1) % islands)
            given = on_islands.join(plans.unionByName(guests).select("shard", "island", "plan"), ["shard", "island"])
        # little data, much work: a partition for each island, which AQE does not merge
        given = given.repartition(shards * islands, "shard", "island")
        plans = staged(given.groupBy("shard", "island").applyInPandas(_epoch(capacity), PLAN))
    best = plans.groupBy("shard").agg(F.min_by("plan", F.struct("bins", "fit", "island")).alias("plan"))

    def place(mine: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=[*mine.columns.drop("shard"), "sequence_id", "offset"])
        mine = mine.sort_values(["length", "row"], kind="stable")
        mine["sequence_id"] = np.frombuffer(plan["plan"][0], "<i4").astype(np.int64) + (mine["shard"].to_numpy() << 32)
        mine = mine.sort_values(["sequence_id", "row"], kind="stable")
        before = mine.groupby("sequence_id")["length"].cumsum() - mine["length"]
        return mine.assign(offset=before).drop(columns="shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    placed = short.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, schema)
    return placed.unionByName(full).drop("row")
