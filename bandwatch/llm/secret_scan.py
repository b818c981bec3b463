"""Secrets in text: fixed patterns, and formats learned from labelled credentials by grammar inference.

Each kind of credential gives a prefix tree of its examples; states whose next symbols and endings agree within
a Hoeffding bound are merged (red and blue states, in order of the tree), which leaves a small probabilistic
automaton with loops for the random parts. A stretch is scored by the log likelihood of its format against a
background of letters and digits, from any start within a run of such characters to where the format ends; runs have no
greatest length. The examples are made by rule, so the model is a bounded constant.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import os
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

#: The base patterns and the least length of what they must find.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]+"), 0, 16),
)
#: The same hits with fewer tries: a shorter run can never become a hit.
BASE_FAST = {"access": re.compile(r"AKIA[A-Z0-9]{14,}"), "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")}

#: Public shapes of credentials (kind, literal start, alphabet of the rest, its length).
UPPER, LOWER, DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
SHAPES = (
    ("access_id", "AKIA", UPPER + DIGIT, 16),
    ("session_id", "ASIA", UPPER + DIGIT, 16),
    ("code_host", "ghp_", UPPER + LOWER + DIGIT, 36),
    ("code_app", "gho_", UPPER + LOWER + DIGIT, 36),
    ("code_lab", "glpat-", UPPER + LOWER + DIGIT + "-_", 20),
    ("maps_key", "AIza", UPPER + LOWER + DIGIT + "-_", 35),
    ("pay_live", "sk_live_", UPPER + LOWER + DIGIT, 24),
    ("pay_test", "sk_test_", UPPER + LOWER + DIGIT, 24),
    ("chat_bot", "xoxb-", DIGIT + "-" + UPPER + LOWER, 40),
    ("chat_user", "xoxp-", DIGIT + "-" + UPPER + LOWER, 40),
    ("web_token", "eyJ", UPPER + LOWER + DIGIT + "-_.", 90),
    ("mail_key", "SG.", UPPER + LOWER + DIGIT + "-_.", 66),
    ("package_key", "npm_", UPPER + LOWER + DIGIT, 36),
    ("digest", "", DIGIT + "abcdef", 40),
)
#: Least and greatest length of the rest in the examples of formats whose length varies.
LENGTHS = {"code_lab": (20, 60), "pay_live": (24, 100), "pay_test": (24, 100), "chat_bot": (40, 80), "chat_user": (40, 80), "web_token": (60, 1500)}
EXAMPLES = 120  # of each shape
ALPHA = 0.05  # of the compatibility test
FLOOR = 1e-4  # probability of a symbol that a state has never seen
ALPHABET = len(UPPER + LOWER + DIGIT + "+/_.=-")
MIN_LENGTH = 16
MIN_BITS = 12.0  # by which a stretch must be likelier than background
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")


def labelled(count: int = EXAMPLES) -> dict[str, list[str]]:
    """The labelled table: credentials of each kind, made from SHAPES and LENGTHS by a seeded generator."""
    rng = random.Random(7)
    out: dict[str, list[str]] = {}
    for kind, start, rest, n in SHAPES:
        low, high = LENGTHS.get(kind, (n, n))
        sizes = [round(low * (high / low) ** (k / max(1, count - 1))) for k in range(count)]
        out[kind] = [start + "".join(rng.choices(rest, k=size)) for size in sizes]
    return out


class Automaton:
    """A probabilistic automaton grown from examples: state 0 starts, next[s][symbol] is a state."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.count: list[int] = [0]  # arrivals
        self.end: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        for example in examples:
            at = 0
            self.count[0] += 1
            for x in example:
                self.seen[at][x] = self.seen[at].get(x, 0) + 1
                if x not in self.next[at]:
                    self.next[at][x] = len(self.count)
                    self.count.append(0)
                    self.end.append(0)
                    self.next.append({})
                    self.seen.append({})
                at = self.next[at][x]
                self.count[at] += 1
            self.end[at] += 1
        self._merge_all()

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(a / n - b / m) <= bound

    def compatible(self, p: int, q: int) -> bool:
        """Whether endings and next symbols of both states, and of what follows, agree within the bound."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.count[p], self.count[q]
            if not self._near(self.end[p], n, self.end[q], m):
                return False
            for x in self.seen[p].keys() | self.seen[q].keys():
                if not self._near(self.seen[p].get(x, 0), n, self.seen[q].get(x, 0), m):
                    return False
            # few arrivals agree with anything: below them the test has no power
            if min(n, m) > 2:
                stack += [(self.next[p][x], self.next[q][x]) for x in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.count[p] += self.count[q]
            self.end[p] += self.end[q]
            for x, n in self.seen[q].items():
                self.seen[p][x] = self.seen[p].get(x, 0) + n
                if x in self.next[p]:
                    stack.append((self.next[p][x], self.next[q][x]))
                else:
                    self.next[p][x] = self.next[q][x]

    def _merge_all(self) -> None:
        red = [0]
        blue = [(0, x) for x in sorted(self.next[0])]
        while blue:
            parent, x = blue.pop(0)
            state = self.next[parent][x]
            if state in red:
                continue
            # the newest first: a rare state agrees with any, and belongs to the part that it follows
            into = next((r for r in reversed(red) if self.compatible(r, state)), None)
            if into is None:
                red.append(state)
            else:
                self.next[parent][x] = into
                self._fold(into, state)
            known = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in known]
        index = {r: k for k, r in enumerate(red)}
        self.next = [{x: index[t] for x, t in self.next[r].items()} for r in red]
        self.seen = [self.seen[r] for r in red]
        self.end = [self.end[r] for r in red]

    def table(self) -> tuple[list[dict[str, tuple[float, int]]], list[float]]:
        """For each state: symbol -> (log2 likelihood ratio to background, next state); and of an unseen symbol."""
        steps, unseen = [], []
        for seen, nxt, end in zip(self.seen, self.next, self.end, strict=True):
            total = sum(seen.values()) + end
            # additive smoothing over the symbols of the alphabet that the state has seen
            steps.append({x: (math.log2((1 - FLOOR * ALPHABET) * n / total * ALPHABET), nxt[x]) for x, n in seen.items()})
            unseen.append(math.log2(FLOOR * ALPHABET))
        return steps, unseen


@functools.cache
def model() -> dict[str, tuple[list[dict[str, tuple[float, int]]], list[float], str, float]]:
    """The automaton of each kind, what all its examples begin with, and the least length, grown once per process."""
    return {kind: (*Automaton(x).table(), os.path.commonprefix(x), max(MIN_LENGTH, 0.8 * min(map(len, x)))) for kind, x in labelled().items()}


def stretches(run: str, kind: str) -> list[tuple[float, int, int]]:
    """(bits by which the kind's automaton finds it likelier than background, start, end) of stretches of a run.

    Each start that the examples have is tried and followed while the score is positive. Symbols that the format
    knows all belong to the stretch; foreign ones only if what follows makes up for them. One that is long enough
    is taken, and the search goes on behind it.
    """
    steps, unseen, prefix, least = model()[kind]
    out, start, n = [], 0, len(run)
    while n - start >= least:
        if prefix:
            start = run.find(prefix, start)
            if start < 0:
                break
        elif run[start] not in steps[0]:
            start += 1
            continue
        state, total, peak, end, gap = 0, 0.0, 0.0, start, False
        for at in range(start, n):
            step = steps[state].get(run[at])
            if step is None:
                total += unseen[state]
                gap = True
                if total <= 0:
                    break
            else:
                total += step[0]
                state = step[1]
                if not gap or total > peak:
                    peak, end, gap = total, at + 1, False
        if end - start >= least:
            out.append((peak, start, end))
            start = end
        else:
            start += 1
    return out


def best(candidate: str) -> tuple[str, float]:
    """The kind with the likeliest stretch in the candidate, and its score; ties go to the first name."""
    found = [(-bits, kind) for kind in model() for bits, _, _ in stretches(candidate, kind)]
    if not found:
        return "", -math.inf
    worst, kind = min(found)
    return kind, -worst


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind, by start and kind as listed."""
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in BASE_FAST.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((m.start(), rank, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(spans)]


def learned_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of stretches that a learned format accepts and that touch no base span, by start.

    Where stretches overlap, the likeliest is kept.
    """
    spans = []
    order = sorted(taken)
    nearest = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".=-":  # a sentence's full stop is no part of a credential
            end -= 1
        # the parts of the run between base spans
        parts = []
        while nearest < len(order) and order[nearest][1] <= start:
            nearest += 1
        at, k = start, nearest
        while k < len(order) and order[k][0] < end:
            parts.append((at, order[k][0]))
            at = max(at, order[k][1])
            k += 1
        parts.append((at, end))
        for a, b in parts:
            if b - a < MIN_LENGTH:
                continue
            run = text[a:b]
            found = [(-bits, x, kind, y) for kind in model() for bits, x, y in stretches(run, kind) if bits >= MIN_BITS]
            kept: list[tuple[int, int, str, float]] = []  # by start; none overlap, so only the neighbours matter
            for minus, x, kind, y in sorted(found):
                place = bisect.bisect(kept, (a + x,))
                if (not place or kept[place - 1][1] <= a + x) and (place == len(kept) or a + y <= kept[place][0]):
                    kept.insert(place, (a + x, a + y, kind, -minus))
            spans += kept
    return spans


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find_in(text: str | None) -> list[dict]:
    """All spans of a text, base and learned; the base ones are scored too."""
    if not text:
        return []
    base = base_spans(text)
    rows = [(a, k, {"kind": kind, "start": a, "end": b, "score": best(text[a:b])[1], "base": True}) for k, (a, b, kind) in enumerate(base)]
    rows += [(a, len(base), {"kind": kind, "start": a, "end": b, "score": bits, "base": False}) for a, b, kind, bits in learned_spans(text, base)]
    return [x for _, _, x in sorted(rows, key=lambda r: r[:2])]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end in code points, score, base), a row for a row.

    Null or empty text: no spans. Long texts are scanned whole. Repeated rows give repeated results.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_in(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], ["doc_id", "spans"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(by_batch(rows), SPANS)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by its kind in brackets; all columns and rows stay."""
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(text: str | None) -> str | None:
        done, out = 0, []
        for span in find_in(text):
            if span["end"] > done:
                out += [text[done : max(done, span["start"])], f"[{span['kind']}]"]
                done = span["end"]
        return text if not out else "".join(out) + text[done:]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([clean(x) for x in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else x for i, x in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(by_batch(rows), schema)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""

    def told(spans: list[dict]) -> str:
        return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = batch.column(1).to_pylist()
            base = [[x for x in spans if x["base"]] for spans in all_spans]
            counts = [pa.array([sum(x["kind"] == kind for x in spans) for spans in base], pa.int64()) for kind, *_ in BASE]
            hashes = pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base])
            texts = pa.array([told(x) for x in all_spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, texts], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(rows, DIGEST)
