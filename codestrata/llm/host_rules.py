"""Quality rules by host: failure rates shrunk by an empirical beta prior, verdicts joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.llm.shared import join_counted
from codestrata.session import stage

#: Words of a window that counts as repeated.
WINDOW = 8
#: A window is ranked by doubling: pairs of ranks of 1, 2 and 4 words.
_DOUBLINGS = (1, 2, 4)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
FACTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

#: Conditions on the facts of a document; a document that meets one fails that rule.
BASE_RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
}
#: Rules that count against a host only.
HOST_RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class HostOptions:
    """``limit``: share of failing documents a host may have. ``sureness``: standard
    deviations of the posterior by which it must be exceeded. ``strength``: prior
    strength where hosts don't tell one (fewer than two hosts, or no spread to measure)."""

    base: dict[str, str] = field(default_factory=lambda: dict(BASE_RULES))
    rules: dict[str, str] = field(default_factory=lambda: dict(HOST_RULES))
    limit: float = 0.5
    sureness: float = 2.0
    strength: float = 2.0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more, exact for any length."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    for step in _DOUBLINGS:
        # ranks stay below n, so the pair fits in 64 bits
        rank = np.unique(rank[:-step] * np.int64(n) + rank[step:], return_inverse=True)[1].astype(np.int64)
    often = np.bincount(rank)[rank] > 1
    if not often.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def text_facts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0, 0
    # code points are the bytes that do not continue one
    units = np.frombuffer(text, np.uint8)
    chars = int(((units & 0xC0) != 0x80).sum()) - (len(text) - len(text.translate(None, _SPACES)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def document_facts(documents: DataFrame, host: Column) -> DataFrame:
    """(doc_id, host, facts), one row per document; texts do not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_facts(t.as_py() or b"") for t in b.column("_text")]
            facts = np.array(made, np.int64).reshape(-1, 6)
            names = [f.split()[0] for f in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_host"), *[pa.array(facts[:, i]) for i in range(6)]], ["doc_id", "host", *names]
            )

    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("_host"),
        F.col("text").cast("string").cast("binary").alias("_text"),
    )
    return narrow.mapInArrow(run, f"doc_id long, host string, {FACTS}")


def priors(counted: DataFrame, rules: list[str], strength: float) -> dict[str, tuple[float, float]]:
    """Beta parameters of each rule, by moments over hosts weighted by their documents.

    ``counted`` has a row per host: _rows and a column per rule with its
    failures. With w = n / N, E[sum w (p - mu)^2] = mu (1 - mu) ((1 - rho)(k - 1) / N
    + rho (1 - sum w^2)); it is solved for rho, and alpha + beta = 1 / rho - 1.
    """
    sums = [F.count(F.lit(1)).alias("k"), F.sum("_rows").cast("double").alias("n"), F.sum(F.col("_rows").cast("double") ** 2).alias("n2")]
    for i, r in enumerate(rules):
        x = F.col(r).cast("double")
        sums += [F.sum(x).alias(f"x{i}"), F.sum(x * x / F.col("_rows")).alias(f"s{i}")]
    got = counted.agg(*sums).first()
    out: dict[str, tuple[float, float]] = {}
    for i, r in enumerate(rules):
        total, size = got["n"] or 0.0, strength
        mean = (got[f"x{i}"] or 0.0) / total if total else 0.0
        chance, spread = mean * (1 - mean), 0.0
        if total and got["k"] > 1:
            spread = 1 - got["n2"] / total**2 - (got["k"] - 1) / total
        if chance > 0 and spread > 0:
            seen = got[f"s{i}"] / total - mean * mean - chance * (got["k"] - 1) / total
            rho = min(max(seen / (chance * spread), 1e-6), 0.999)
            size = 1 / rho - 1
        out[r] = (mean * size, (1 - mean) * size)
    return out


def host_verdicts(facts: DataFrame, options: HostOptions = HostOptions()) -> DataFrame:
    """(host, _rows, rate_<rule>..., host_failed) of every host.

    Rates are posterior means. A host fails if, for some rule, the posterior lies
    above the limit by the asked number of standard deviations. Rows without host
    make one row that never fails and does not count for the priors.
    """
    rules = list(options.rules)
    counted = stage(
        facts.groupBy("host").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(F.when(F.expr(options.rules[r]), 1).otherwise(0)).alias(r) for r in rules],
        )
    )
    failed, rates = F.lit(False), []
    for r, (alpha, beta) in priors(counted.filter("host is not null"), rules, options.strength).items():
        a = F.lit(alpha) + F.col(r)
        size = F.lit(alpha + beta) + F.col("_rows")
        rate = a / size
        deviation = F.sqrt(rate * (1 - rate) / (size + 1))
        rates.append(rate.alias(f"rate_{r}"))
        failed = failed | (rate - F.lit(options.sureness) * deviation > F.lit(options.limit))
    return counted.select("host", "_rows", *rates, (failed & F.col("host").isNotNull()).alias("host_failed"))


def host_rules(documents: DataFrame, options: HostOptions = HostOptions(), host: Column | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_failed), one row per row.

    ``host`` defaults to ``source``. A null or empty text has no words and fails.
    A row without host is judged by its own text alone (host_failed is false);
    rows without doc_id and repeated rows are rows like others. An empty table
    gives an empty result; further columns are not read.
    """
    facts = stage(document_facts(documents, F.col("source") if host is None else host))
    verdicts = stage(host_verdicts(facts, options).select("host", "_rows", "host_failed"))
    base = F.lit(False)
    for rule in options.base.values():
        base = base | F.expr(rule)
    joined = join_counted(facts, verdicts, "host", ["host_failed"])
    return joined.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed",
    )
