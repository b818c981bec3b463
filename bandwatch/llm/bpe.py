"""BPE encoding and decoding with a published vocabulary of words with word ends; a contiguous rank array per word.

A word is held as its parts' ids beside the ranks of the merges of neighbouring parts. The minimum rank is found
by a scan, its boundary is deleted (what follows moves up by one place) and the two neighbouring ranks are looked
up anew. All new words of a batch are merged together, one row of a matrix each. Words of over LONG bytes would
make the scans quadratic; they use a heap over a linked list instead, with the same merges in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 64  # bytes of the longest word that is scanned
NONE = np.int32(2**31 - 1)  # rank of parts that do not merge
CACHED_BYTES = 150_000_000  # that a worker remembers of runs and their ids, about; beyond that it starts afresh
REMEMBERED = 64  # characters of the longest run that is remembered: text without spaces has runs that never return
ENTRY_BYTES = 350  # of a remembered run besides its characters, about
ROWS = 512  # texts at once
END = "</w>"
#: Fixed value: the pattern that splits text into words before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")  # white space for str.split, ordinary characters for the vocabulary


def default_path() -> str:
    """Where this machine keeps the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next above 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in seen}
    names |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids: dict[str, int] = told["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.names = {i: name for name, i in ids.items()} | {i: name for name, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.names}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        names = byte_names()
        self.inner = np.array([ids[x] for x in names], np.int32)
        self.last = np.array([ids[x + END] for x in names], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.size = max(self.names) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a and b; NONE where there is no such merge or a part is missing (-1)."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted((k for k, w in enumerate(words) if len(w) <= LONG), key=lambda k: len(words[k]))
        for k, word in enumerate(words):
            if len(word) > LONG:
                out[k] = self._merge_long(word)
        start = 0
        while start < len(order):  # words of like length share a matrix
            width = len(words[order[start]])
            width = max(width + width // 4, 4)
            stop = start
            while stop < len(order) and stop - start < 20_000 and len(words[order[stop]]) <= width:
                stop += 1
            for k, got in zip(order[start:stop], self._merge_short([words[k] for k in order[start:stop]]), strict=True):
                out[k] = got
            start = stop
        return out

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        length = np.array([len(w) for w in words])
        width = int(length.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        place = np.arange(width)
        parts = np.where(place < length[:, None], self.inner[raw], -1).astype(np.int32)
        rows = np.arange(len(words))
        parts[rows, length - 1] = self.last[raw[rows, length - 1]]
        ranks = np.full(parts.shape, NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        result = parts.copy()
        live = rows
        while True:
            at = np.argmin(ranks, axis=1)
            best = ranks[np.arange(len(live)), at]
            going = best != NONE
            if not going.all():
                result[live[~going]] = parts[~going]
                live, parts, ranks, at, best = live[going], parts[going], ranks[going], at[going], best[going]
            if not len(live):
                break
            own = np.arange(len(live))
            gone = place > at[:, None]  # these places take what stands right of them
            end = np.full((len(live), 1), -1, np.int32)
            parts = np.where(gone, np.concatenate([parts[:, 1:], end], axis=1), parts)
            parts[own, at] = self.made[best]
            none = np.full((len(live), 1), NONE, np.int32)
            ranks = np.where(gone, np.concatenate([ranks[:, 1:], none], axis=1), ranks)
            after = np.where(at + 1 < width, parts[own, np.minimum(at + 1, width - 1)], -1)
            ranks[own, at] = self.rank(parts[own, at], after)
            left = at > 0
            ranks[own[left], at[left] - 1] = self.rank(parts[own[left], at[left] - 1], parts[own[left], at[left]])
        return [row[row >= 0].tolist() for row in result]

    def _merge_long(self, word: bytes) -> list[int]:
        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw].tolist()
        parts[-1] = int(self.last[raw[-1]])
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        rank = lambda i: self.rank_of.get(parts[i] * self.size + parts[after[i]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(len(parts)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or rank(i) != r:
                continue  # a part has gone or changed since
            j = after[i]
            parts[i], parts[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (again := rank(k)) is not None:
                    heapq.heappush(heap, (again, k))
        return [x for x in parts if x >= 0]


class Encoder:
    """Encodes texts; remembers short runs between spaces and their ids, within a bound of bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[str, str, int]] = {}
        self.bytes = 0

    def _chunks(self, text: str) -> list[str]:
        """Lower-cased runs of non-space, special tokens as themselves after a space."""
        special = self.vocabulary.special_pattern
        parts = special.split(text) if special and "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if part in self.vocabulary.special:
                out.append(" " + part)
                continue
            # final sigma: characters are lowered one by one
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += [x for x in SPACES.split(low) if x] if ODD_SPACES.search(low) else low.split()
        return out

    def _learn(self, chunks: set[str]) -> dict[str, tuple[str, str, int]]:
        """Ids as text, tokens as text and their number for each new chunk; short ones are remembered.

        So are their words: a word is split alike by itself and within a chunk.
        """
        vocabulary, known = self.vocabulary, self.known
        names, numbers = vocabulary.names, vocabulary.numbers
        pieces = {c: WORDS.findall(c) for c in chunks if c[0] != " "}
        distinct = sorted({w for ws in pieces.values() for w in ws if w not in known})
        learnt = {}
        for w, got in zip(distinct, vocabulary.merge([w.encode() for w in distinct]), strict=True):
            learnt[w] = " ".join([numbers[i] for i in got]), " ".join([names[i] for i in got]), len(got)
        for c in chunks:
            if c[0] == " ":
                i = vocabulary.special[c[1:]]
                learnt[c] = numbers[i], names[i], 1
            elif c not in learnt:
                parts = [known.get(w) or learnt[w] for w in pieces[c]]
                learnt[c] = " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts])
        for c, told in learnt.items():
            if len(c) <= REMEMBERED:
                known[c] = told
                self.bytes += ENTRY_BYTES + len(c) + len(told[0]) + len(told[1])
        return learnt

    def encode(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """(ids joined by a space, decoded text, number of ids) of each text."""
        split = [self._chunks(x) if x else [] for x in texts]
        if self.bytes > CACHED_BYTES:
            self.known.clear()
            self.bytes = 0
        learnt = self._learn(set().union(*split) - self.known.keys())
        known, out = self.known, []
        for chunks in split:
            got = list(map(known.get, chunks))
            if None in got:
                got = [x or learnt[c] for c, x in zip(chunks, got, strict=True)]
            ids, decoded, sizes = zip(*got, strict=True) if got else ((), (), ())
            out.append((" ".join(ids), " ".join(decoded), sum(sizes)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (text, joined by a space), decoded, n_tokens of each row. Null text: no ids.

    Decoding joins the vocabulary's tokens by a space: the file has no decoder of its own.
    """
    return _encoded(docs, path, id_col, text_col, False)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of the decoded text; the texts stay in the task."""
    return _encoded(docs, path, id_col, text_col, True)


def _encoded(docs: DataFrame, path: str | None, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    path = path or default_path()
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if hashed else ["ids", "decoded"])]
    told = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if hashed else str

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                got = encoder(path).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x[2] for x in got], pa.int64()),
                        pa.array([told(x[0]) for x in got], pa.string()),
                        pa.array([told(x[1]) for x in got], pa.string()),
                    ],
                    names,
                )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(rows, f"doc_id {dict(picked.dtypes)['doc_id']}, n_tokens long, {names[2]} string, {names[3]} string")
