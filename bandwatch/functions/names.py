"""Which known names a formula text has in it, found by an automaton over all names.

The automaton (Aho-Corasick) reads a text once and reports every name in it, however many names there
are; a text of n names costs its length and n hits. Texts and names are dealt to a grid of blocks, so
that neither side has to fit into one task: a task builds the automaton of one block of names and
reads one block of texts. At usual sizes the grid has one cell, and only *distinct* texts are read.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bandwatch.functions.formula import INSIDE, NUMBER

NAMES_PER_TASK = 200_000
TEXTS_PER_TASK = 50_000

QUOTES = "\"'"
# Names of other characters stand in formulas as they are; these need quotes around them.
_BARE = re.compile(rf"(?!{NUMBER}$)(?!Math\.)(?![\s,-])[^()*/+{QUOTES}]+(?<![\s,-])", re.ASCII)
_INSIDE = re.compile(INSIDE)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether the name at [start, end) may be a name there: quoted, or bare and not part of a word."""
    before, after = text[start - 1:start], text[end:end + 1]
    if before and before == after and before in QUOTES:
        return True
    name = text[start:end]
    return (_BARE.fullmatch(name) is not None
            and not (_INSIDE.match(before) and _INSIDE.match(name[0]))
            and not (_INSIDE.match(after) and _INSIDE.match(name[-1])))


class NameFinder:
    """The automaton of some names."""

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                self.automaton.add_word(name, len(name))
        if len(self.automaton):
            self.automaton.make_automaton()

    def names_in(self, text: str) -> list[str]:
        """The distinct names that stand in a text, in order."""
        if not len(self.automaton):
            return []
        hits = ((last + 1 - size, last + 1) for last, size in self.automaton.iter(text))
        return sorted({text[a:b] for a, b in hits if stands_alone(text, a, b)})


def _find(texts: pa.Table, names: pa.Table) -> pa.Table:
    finder = NameFinder(names.column("key").to_pylist())
    found = [finder.names_in(t) for t in texts.column("raw_value").to_pylist()]
    return pa.table({"raw_value": texts.column("raw_value"),
                     "keys": pa.array(found, pa.list_(pa.string()))})


def names_in_texts(
    texts: DataFrame, names: DataFrame, names_per_task: int = NAMES_PER_TASK,
    texts_per_task: int = TEXTS_PER_TASK,
) -> DataFrame:
    """Per distinct `raw_value` of `texts` the sorted `keys` among `names` (key) that stand in it.

    Reads both sides twice (once to count); hand over tables, not long plans. Repeated texts and
    names count once, null ones are left out.
    """
    spark = texts.sparkSession
    texts = texts.select("raw_value").where("raw_value is not null").distinct()
    names = names.select("key").where("key is not null").distinct()
    sizes = texts.agg(F.count("*").alias("n")).crossJoin(names.agg(F.count("*").alias("m"))).first()
    rows, columns = (max(1, math.ceil(n / per)) for n, per in
                     ((sizes["n"], texts_per_task), (sizes["m"], names_per_task)))
    if not sizes["n"]:
        return spark.createDataFrame([], "raw_value string, keys array<string>")

    def block(key: str, of: int):
        return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")

    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    text_blocks = texts.select("raw_value", block("raw_value", rows).alias("i"),
                               every(columns).alias("j"))
    name_blocks = names.select("key", every(rows).alias("i"), block("key", columns).alias("j"))
    found = text_blocks.groupBy("i", "j").cogroup(name_blocks.groupBy("i", "j")).applyInArrow(
        _find, "raw_value string, keys array<string>")
    if columns == 1:
        return found
    parts = found.groupBy("raw_value").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    return parts.withColumn("keys", F.sort_array("keys"))
