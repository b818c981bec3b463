"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A text beyond STEP characters is cut at fixed places, and each chunk reaches OVERLAP characters into the next. All are
encoded by themselves, with offsets. The vocabulary's splitter reads from left to right and remembers nothing but where
it stands, so two things are sure:

* a place where the left chunk begins a word is one in the whole text too, once its own words are right from some place
  on and it sees MARGIN more characters (the longest special string, and what the splitter looks ahead);
* if the right chunk begins a word at the same place, all its words after that are right.

Such a common place is where the counts are spliced. Where the overlap holds none (one word or one run of blanks fills
it), the left chunk starts again at its last sure place and both reach further, four times as far each time, up to the
end of the text. So the count is that of the whole text, and memory is bounded by a few chunks or the longest word.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing

STEP = 1 << 15
OVERLAP = 256
LIMIT = 1024
ROWS = 256
BATCH_CHARS = 1 << 20  # short texts encoded in one call
AHEAD = 8  # chunks encoded in one call
GROWTH = 4
LOOK_AHEAD = 3  # characters the splitter looks at beyond a word's end


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """A chunk's words: where each begins in the text, and how many tokens lie before it within the chunk."""

    def __init__(self, encoding, start: int, end: int):
        word = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-2)) if len(word) else np.zeros(0, np.int64)
        offsets = encoding.offsets
        self.start, self.end, self.tokens = start, end, len(word)
        self.at = np.array([offsets[i][0] for i in first], np.int64) + start
        self.before = first

    def tokens_before(self, place: int) -> int:
        """Tokens before a place where a word begins, or before the end."""
        k = int(np.searchsorted(self.at, place))
        return int(self.before[k]) if k < len(self.at) else self.tokens


class Counter:
    """Counts tokens as the tokenizers library does on whole texts."""

    def __init__(self, path: str, step: int = STEP, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps all cores busy
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.step, self.overlap = step, min(overlap, step)
        special = [len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max(special, default=0) + LOOK_AHEAD
        self.fast = packing.tokens(path) if path == packing.default_path() else None
        self.widened = 0  # how often an overlap did not align

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; none for null."""
        found = [0] * len(texts)
        pending: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.step + self.overlap:
                found[i] = self.count_long(text)
                continue
            if self.fast and packing.PLAIN.fullmatch(text):
                found[i] = len(self.fast.encode(text)) // 4
                continue
            pending.append(i)
            size += len(text)
            if size >= BATCH_CHARS:
                self._short(texts, pending, found)
                pending, size = [], 0
        self._short(texts, pending, found)
        return found

    def _short(self, texts: list[str | None], which: list[int], found: list[int]) -> None:
        encoded = self.tokenizer.encode_batch_fast([texts[i] for i in which], add_special_tokens=False)
        for i, e in zip(which, encoded, strict=True):
            found[i] = len(e)

    def _words(self, text: str, start: int, end: int) -> Words:
        return Words(self.tokenizer.encode(text[start:end], add_special_tokens=False), start, end)

    def _chunks(self, text: str) -> Callable[[int], Words]:
        """The chunk from a multiple of the step; a few are encoded in one call and kept until passed."""
        ready: dict[int, Words] = {}

        def chunk(start: int) -> Words:
            if start not in ready:
                ready.clear()
                spans = [(a, min(len(text), a + self.step + self.overlap)) for a in range(start, min(len(text), start + AHEAD * self.step), self.step)]
                encoded = self.tokenizer.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
                ready.update({a: Words(e, a, b) for e, (a, b) in zip(encoded, spans, strict=True)})
            return ready.pop(start)

        return chunk

    def count_long(self, text: str) -> int:
        """Tokens of a text, spliced from overlapping chunks."""
        n, chunk = len(text), self._chunks(text)
        left, sure, total = chunk(0), 0, 0  # left's words are right from `sure` on
        while left.end < n:
            # the right chunk begins at a multiple of the step that the left one reaches beyond by the overlap
            begin = (left.end - self.overlap) // self.step * self.step
            right, reach = chunk(begin), left.end - begin
            while (place := self._common(left, right, sure)) is None:
                self.widened += 1
                kept = self._last_sure(left, sure)
                total += left.tokens_before(kept) - left.tokens_before(sure)
                sure, reach = kept, reach * GROWTH
                left = self._words(text, sure, min(n, begin + reach))
                if left.end == n:
                    break
                if left.end > right.end:
                    right = self._words(text, begin, min(n, left.end + self.step))
            else:
                total += left.tokens_before(place) - left.tokens_before(sure)
                left, sure = right, place
        return total + left.tokens - left.tokens_before(sure)

    def _common(self, left: Words, right: Words, sure: int) -> int | None:
        """The first place that is surely the begin of a word, and is one in both chunks."""
        mine = left.at[(left.at >= max(sure, right.start)) & (left.at <= left.end - self.margin)]
        both = np.intersect1d(mine, right.at, assume_unique=True)
        return int(both[0]) if len(both) else None

    def _last_sure(self, left: Words, sure: int) -> int:
        k = int(np.searchsorted(left.at, left.end - self.margin, "right")) - 1
        return max(sure, int(left.at[k])) if k >= 0 else sure


_counters: dict[tuple, Counter] = {}


def counter(path: str, step: int, overlap: int) -> Counter:
    """The worker's counter, loaded once."""
    key = path, step, overlap
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def count(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, step: int = STEP, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of each row; null text: as an empty one.

    One pass without a shuffle: repeated rows are counted each, rows without an id too, an empty table gives none.
    """
    path = path or default_path()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = np.array(counter(path, step, overlap).counts(part.column(2).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return picked.mapInArrow(rows, f"doc_id {dict(picked.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
