"""Language ID: nearest of several centroids per language in a space of TF-IDF letter n-grams, by cosine.

The model is fitted on a bounded sample of labelled rows (SAMPLE per language); everything is predicted on
whole texts. Counting n-grams is array work over batches of bounded size inside the tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

UNKNOWN = "und"
BUCKETS = 1 << 13
SAMPLE = 300  # labelled rows per language at most, about; the bound of the fit
CENTROIDS = 4  # per language
ROUNDS = 12
HELD_OUT, FOLDS = 2, 4
SLACK = 1.25  # a text is rejected beyond this times the largest distance in training ...
NEAREST, FARTHEST = 0.8, 0.98  # ... but never within the first of these, and beyond the second in any case
BLOCK = 1_000_000  # characters worked on at once
ROWS = 256  # texts at once


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit vectors
    idf: np.ndarray
    limits: np.ndarray  # largest accepted distance of each centroid


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK characters that end at a space, so that no n-gram of a word is lost."""
    start = 0
    while len(text) - start > 2 * BLOCK:
        cut = text.find(" ", start + BLOCK)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _add(counts: np.ndarray, owners: list[int], texts: list[str]) -> None:
    """Adds the n-grams of the texts to their owners' rows: letter pairs and triples, word borders as 0."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.array(owners), [len(x) + 1 for x in texts])
    letter = _letters()[code]
    keep = letter | np.concatenate(([True], letter[:-1]))  # of other characters the first of a run
    code, owner = np.where(letter, code, 0)[keep].astype(np.uint64), owner[keep]
    a, b = code[:-1], code[1:]
    pair = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2)) >> np.uint64(40)
    inside = owner[:-1] == owner[1:]
    slots = [(owner[:-1] * BUCKETS + (pair % BUCKETS).astype(np.int64))[inside]]
    a, b, c = code[:-2], code[1:-1], code[2:]
    triple = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) >> np.uint64(41)
    inside = (b != 0) & (owner[:-2] == owner[2:])
    slots.append((owner[:-2] * BUCKETS + (triple % BUCKETS).astype(np.int64))[inside])
    counts += np.bincount(np.concatenate(slots), minlength=counts.size).reshape(counts.shape)


def counted(texts: list[str | None]) -> np.ndarray:
    """n-gram counts of each text, over its whole length."""
    counts = np.zeros((len(texts), BUCKETS))
    owners: list[int] = []
    block: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            owners.append(k)
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                _add(counts, owners, block)
                owners, block, size = [], [], 0
    if block:
        _add(counts, owners, block)
    return counts


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = (counts * idf).astype(np.float32)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-12)


def cluster(vectors: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Unit centroids by spherical k-means; the start is farthest-first, so the result depends on the rows only."""
    mean = vectors.mean(axis=0)
    picked = [int(np.argmax(vectors @ mean))]
    while len(picked) < min(k, len(vectors)):
        near = (vectors @ vectors[picked].T).max(axis=1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break  # only repeated rows are left
        picked.append(far)
    centres = vectors[picked]
    for _ in range(ROUNDS):
        of = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([vectors[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The model of labelled rows; rows without language, text or letters teach nothing.

    The sample is the rows whose hashed id falls below a rate per language: deterministic, about `sample` each.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("at"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    chosen = rows.where(F.pmod("at", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = counted(part.column(1).to_pylist())
                packed = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x.astype(np.int32).tobytes() for x in packed], pa.binary()),
                        pa.array([row[x].astype(np.int32).tobytes() for row, x in zip(counts, packed, strict=True)], pa.binary()),
                    ],
                    ["lang", "slots", "counts"],
                )

    got = sorted((r["lang"], bytes(r["slots"]), bytes(r["counts"])) for r in chosen.mapInArrow(features, "lang string, slots binary, counts binary").collect())
    got = [x for x in got if x[1]]
    if not got:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.zeros(0))
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for row, (_, slots, values) in zip(counts, got, strict=True):
        row[np.frombuffer(slots, np.int32)] = np.frombuffer(values, np.int32)
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(counts, idf)
    names = np.array([x[0] for x in got], object)
    of, centres, limits = [], [], []
    for lang in sorted(set(names)):
        own = vectors[names == lang]
        found = cluster(own)
        far = 1 - (own @ found.T).max(axis=1)
        of += [lang] * len(found)
        centres.append(found)
        limits += [min(FARTHEST, max(NEAREST, SLACK * float(far.max())))] * len(found)
    return Model(of, np.concatenate(centres), idf, np.array(limits))


def _judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejected of each text."""
    counts = counted(texts)
    known = (counts.sum(axis=1) > 0) & bool(model.languages)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    cosines = unit(counts, model.idf) @ model.centroids.T
    near = np.argmax(cosines, axis=1)
    score = np.where(known, np.clip(cosines[np.arange(len(counts)), near], 0, 1), 0).astype(float)
    names = [model.languages[j] if k else UNKNOWN for j, k in zip(near, known, strict=True)]
    return names, score, ~known | (1 - score > model.limits[near])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected of each row.

    Null text, a text without letters, or a model without languages: und, score 0, rejected. rejected also marks
    texts farther from the nearest centroid than training texts of its language are. Ties: the first language.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, score, out = _judged(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(rows, f"doc_id {dict(picked.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that predict() does not reject, with all their columns; lang becomes the predicted one."""
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, _, out = _judged(part.column(text_at).to_pylist(), model)
                columns = [pa.array(names, pa.string()) if i == lang_at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(~out))

    return docs.mapInArrow(rows, docs.schema)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id, modulo 4, is not 2."""
    return docs.where(remainder(F.col(id_col), FOLDS) != HELD_OUT)
