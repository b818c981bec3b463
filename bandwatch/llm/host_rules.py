"""Quality rules by host: failure rates of each host, shrunk by an empirical beta prior, decide for its documents.

Native: only DataFrame functions. Everything about one text is computed inside its row (no explode, no shuffle
of words); only counts by host are shuffled, after a partial sum in each task, so a hot host is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
REJECT_RATE = 0.5
TRUST_RATE = 0.02
BROADCAST_HOSTS = 100_000  # verdicts that are broadcast; more are joined by a shuffle
PRIOR_STRENGTH = (1.0, 10_000.0)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list. Windows are compared by 64-bit hash."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        same = lambda other, x: F.coalesce(other["h"] == x["h"], F.lit(False))
        places = lambda s: F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
        found = let(F.array_sort(windows), places)
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    hashes = lambda: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    # most texts repeat nothing: they are told by a hash set, without the sort
    judged = let(
        hashes(),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            covered(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        ),
    )
    return F.when(n < 3, 0).otherwise(judged)


def counts_of(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text as a struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    per_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r"))
    return let(
        let(_words(text), per_words),
        lambda w: F.struct(
            w["n"].alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            w["r"].alias("n_repeat_words"),
        ),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text; a row in, a row out."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), counts_of(F.col(text_col)).alias("c"))
    return counted.select("doc_id", "host", "c.*")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def symbols_failed(n_words: Column, n_symbols: Column) -> Column:
    return 100 * n_symbols > MAX_SYMBOL_PERCENT * n_words


def prior(hosts: int, n: int, k: int, q: float, n2: float) -> tuple[float, float]:
    """Mean and strength of the prior from the number of hosts and, over them, the sums of n, k, k^2/n and n^2.

    With correlation c = 1/(s+1) within a host, the sum of n*(r-m)^2 over hosts is expected to be
    m*(1-m)*((hosts-1)*(1-c) + c*(N-sum(n^2)/N)).
    """
    low, high = PRIOR_STRENGTH
    m = k / n if n else 0.0
    room = n - n2 / n - (hosts - 1) if n else 0.0
    if not 0 < m < 1 or room <= 1e-9 * n:
        return m, high
    within = ((q - m * m * n) / (m * (1 - m)) - (hosts - 1)) / room
    return m, min(max(1 / within - 1, low), high) if within > 1e-9 else high


def host_verdicts(flags: DataFrame) -> DataFrame:
    """host, docs, failures, shrunk_rate, host_verdict from rows with host and failed (a boolean).

    The prior Beta(m*s, (1-m)*s) is fitted to the hosts by the moments of the beta-binomial: m is the overall rate, s
    follows from the spread of the hosts' rates beyond what chance gives hosts of their sizes. Where sizes or rates
    show no difference between hosts (single documents, one host), s is at its upper limit and all keep close to m.
    A host with few documents keeps close to m. The null host is a host.
    """
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    n, k = F.col("docs").cast("double"), F.col("failures").cast("double")
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("n"), F.sum("failures").alias("k"), F.sum(k * k / n).alias("q"), F.sum(n * n).alias("n2")).first()
    m, strength = prior(total["hosts"], total["n"] or 0, total["k"] or 0, total["q"] or 0.0, total["n2"] or 0.0)
    shrunk = (F.col("failures") + m * strength) / (F.col("docs") + strength)
    verdict = F.when(F.col("shrunk_rate") >= REJECT_RATE, "reject").when(F.col("shrunk_rate") <= TRUST_RATE, "trust").otherwise("strict")
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_verdict", verdict)


def _verdicts(rows: DataFrame) -> DataFrame:
    found = host_verdicts(rows.select("host", (F.col("base_failed") | F.col("symbols_failed")).alias("failed")))
    return found.select(F.col("host").alias("of_host"), "shrunk_rate", "host_verdict")


def _kept(base: Column, symbols: Column, verdict: Column) -> Column:
    return ~base & ((verdict == "trust") | ((verdict == "strict") & ~symbols))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Each document with its counts, base_failed, its host's shrunk rate and verdict, and kept.

    Documents of a rejected host go; a strict host loses those with many symbols, a trusted one keeps them.
    Null text: counted as empty, fails. Repeated rows: each is judged and counts for its host. Empty table:
    empty result. Other columns of docs are not read, so their names cannot clash.
    """
    rows = staged(measure(docs, id_col, text_col, host_col))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words")), symbols_failed(F.col("n_words"), F.col("n_symbols"))
    rows = rows.withColumns({"base_failed": failed[0], "symbols_failed": failed[1]})
    verdicts = _verdicts(rows)
    joined = rows.join(verdicts, rows["host"].eqNullSafe(verdicts["of_host"]), "left")
    return joined.drop("of_host").withColumn("kept", _kept(F.col("base_failed"), F.col("symbols_failed"), F.col("host_verdict")))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    They are written once with their state: counting a text costs more than writing it, and texts are not shuffled.
    """
    state = let(
        counts_of(F.col(text_col)),
        lambda c: F.when(base_failed(c["n_words"], c["n_repeat_words"]), 2).when(symbols_failed(c["n_words"], c["n_symbols"]), 1).otherwise(0),
    )
    name = "_".join(["state", *docs.columns])  # clashes with no column
    rows = staged(docs.withColumn(name, state))
    found = staged(host_verdicts(rows.select(F.col(host_col).alias("host"), (F.col(f"`{name}`") > 0).alias("failed"))))
    allowed = F.when(F.col("host_verdict") == "trust", 2).when(F.col("host_verdict") == "strict", 1).otherwise(0)
    verdicts = found.select(F.col("host").alias(name + "_host"), allowed.alias(name + "_below"))
    if found.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, rows[host_col].eqNullSafe(verdicts[name + "_host"]))
    return joined.where(F.col(f"`{name}`") < F.col(f"`{name}_below`")).select(*(f"`{c}`" for c in docs.columns))


ORACLE = f"""
WITH words AS (
  SELECT rowid AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 2)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), counted AS (
  SELECT r, doc_id, source, len(w) AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM words
), base AS (
  SELECT c.r, doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * coalesce(n, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words AS symbols_failed
  FROM counted c LEFT JOIN repeated USING (r)
), hosts AS (
  SELECT source, count(*) AS n, sum((base_failed OR symbols_failed)::INT) AS k FROM base GROUP BY source
), sums AS (
  SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(k) / sum(n) AS m, sum(k * k / n) AS q, sum(n::DOUBLE * n) AS n2 FROM hosts
), evidence AS (
  SELECT m, n, n - n2 / n - (h - 1) AS room, CASE WHEN m > 0 AND m < 1 THEN (q - m * m * n) / (m * (1 - m)) - (h - 1) END AS excess FROM sums
), prior AS (
  SELECT m, CASE WHEN excess IS NULL OR room <= 1e-9 * n THEN {PRIOR_STRENGTH[1]} WHEN excess / room <= 1e-9 THEN {PRIOR_STRENGTH[1]}
                 ELSE least(greatest(room / excess - 1, {PRIOR_STRENGTH[0]}), {PRIOR_STRENGTH[1]}) END AS s FROM evidence
), verdicts AS (
  SELECT source, (k + (SELECT m * s FROM prior)) / (n + (SELECT s FROM prior)) AS rate FROM hosts
)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (rate <= {TRUST_RATE} OR (rate < {REJECT_RATE} AND NOT symbols_failed)) AS kept
FROM base b JOIN verdicts v ON b.source IS NOT DISTINCT FROM v.source
"""
