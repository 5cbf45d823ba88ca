"""Divergence of sources from each other and from their language, with duplicate texts collapsed first."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.llm.shared import join_counted
from codestrata.session import stage

#: Parts per thousand million of a group's terms.
_FINE, _COARSE = 31_250, 32_000
UNIT = _FINE * _COARSE
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Counts of texts a task holds before it passes them on.
HELD = 300_000
#: Occurrences of terms, once for each source of their text, that a task holds before it passes sums on; rows of a batch of sums.
ENTRIES, SENT = 1 << 20, 1 << 16
#: Pairs of sources evaluated at once.
STEP = 1 << 19
#: Slices that pairs of sources of one language are dealt into.
SLICES = 16


class Numbers(dict):
    """Numbers things in the order in which they are first met."""

    def __missing__(self, thing: object) -> int:
        n = self[thing] = len(self)
        return n


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), exact while totals stay below 2.9e14."""
    whole = F.call_function("div", count * F.lit(_FINE), total)
    rest = count * F.lit(_FINE) - whole * total
    return F.lit(1) + whole * F.lit(_COARSE) + F.call_function("div", rest * F.lit(_COARSE), total)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def collapsed(documents: DataFrame) -> DataFrame:
    """(lang, digest, source, n, text): multiplicities of texts, and each text once per task that holds it.

    Rows of a text come in two kinds: n rows of a source without the text, and
    the deflated text with n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "digest", "source", "n", "text"]
        counts: Counter = Counter()
        seen: set[tuple[str, bytes]] = set()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            made = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays([*made, pa.array(counts.values(), pa.int64()), pa.nulls(len(keys), pa.binary())], names)

        for b in batches:
            lang, source, texts = b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")
            fresh, digests = [], []
            for i in range(b.num_rows):
                digest = hashlib.blake2b(texts[i].as_buffer(), digest_size=16).digest()
                digests.append(digest)
                counts[lang[i], digest, source[i]] += 1
                if (lang[i], digest) not in seen:
                    seen.add((lang[i], digest))
                    fresh.append(i)
            at = pa.array(fresh, pa.int64())
            bodies = pa.array([zlib.compress(texts[i].as_buffer(), 1) for i in fresh], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").take(at), pa.array([digests[i] for i in fresh], pa.binary()), pa.array([""] * len(fresh)),
                 pa.array(np.zeros(len(fresh), np.int64)), bodies], names)
            if len(counts) > HELD:
                yield flush()
                counts.clear()
                seen.clear()
        yield flush()

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    narrow = documents.select(filled("lang"), filled("source"), filled("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "lang string, digest binary, source string, n long, text binary")


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) sums; term null with the number of rows of every group.

    Copies of a text meet in one task after one exchange; the text is cut into
    terms once, and its counts are added with the multiplicity of each source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, named = Numbers(), Numbers()
        cut: list[np.ndarray] = []  # the terms of each text, by number
        met: list[int] = []  # how many sources each text has
        held: list[tuple[int, int]] = []  # each text's sources, by number, with their rows
        key: tuple[str, bytes] | None = None
        text: bytes | None = None
        sources: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            sizes, own = np.array([len(c) for c in cut], np.int64), np.array(met, np.int64)
            group, n = np.array(held, np.int64).reshape(-1, 2).T
            found, times = np.unique(np.repeat(np.arange(len(cut)), sizes) << 32 | np.concatenate(cut), return_counts=True)
            text, term = found >> 32, found & 0xFFFFFFFF
            # the terms of a text, once for each of its sources
            often = own[text]
            at = np.arange(often.sum()) + np.repeat((np.cumsum(own) - own)[text] - np.cumsum(often) + often, often)
            sums = group[at] << 32 | np.repeat(term, often)
            order = np.argsort(sums)
            sums = sums[order]
            heads = np.flatnonzero(np.r_[True, sums[1:] != sums[:-1]][: len(sums)])
            count = np.add.reduceat((np.repeat(times, often) * n[at])[order], heads)
            docs = np.add.reduceat(n[at][order], heads)
            rows = np.zeros(len(named), np.int64)
            np.add.at(rows, group, n)
            group = np.r_[sums[heads] >> 32, np.arange(len(named))]
            count, docs = np.r_[count, np.zeros(len(named), np.int64)], np.r_[docs, rows]
            term = pa.array(np.r_[sums[heads] & 0xFFFFFFFF, rows], mask=np.arange(len(group)) >= len(heads))
            words = pa.array(list(terms), pa.binary())
            lang, source = (pa.array([k[i] for k in named], pa.string()) for i in (0, 1))
            for a in range(0, len(group), SENT):
                which = pa.array(group[a : a + SENT])
                yield pa.RecordBatch.from_arrays(
                    [lang.take(which), source.take(which), words.take(term[a : a + SENT]), pa.array(count[a : a + SENT]), pa.array(docs[a : a + SENT])],
                    ["lang", "source", "term", "count", "docs"])

        def add() -> int:
            """Entries that the text adds, one at least."""
            if key is None:
                return 0
            got = TERM.findall(zlib.decompress(text).lower()) if text else ()
            cut.append(np.fromiter(map(terms.__getitem__, got), np.int64, len(got)))
            met.append(len(sources))
            held.extend((named[key[0], source], n) for source, n in sources.items())
            return max(1, len(got)) * len(sources)

        entries = 0
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("lang", "digest", "source", "n", "text")))
            for lang, digest, source, n, body in rows:
                if (lang, digest) != key:
                    entries += add()
                    if entries > ENTRIES:
                        yield from flush()
                        for x in (terms, named, cut, met, held):
                            x.clear()
                        entries = 0
                    key, text, sources = (lang, digest), None, Counter()
                if n:
                    sources[source] += n
                elif text is None:
                    text = body
        if entries + add():
            yield from flush()

    met = collapsed(documents).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    made = met.mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    # a task has summed its rows already: they are exchanged as they are, and summed after that
    return made.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, count, all): terms in ``least`` or more documents of their language.

    A term brings one row per source at most, so its group is no larger than the
    number of sources.
    """
    by_term = Window.partitionBy("lang", "term")
    return (
        counts.filter("term is not null")
        .select("*", F.sum("docs").over(by_term).alias("df"), F.sum("count").over(by_term).alias("all"))
        .filter(F.col("df") >= least).select("lang", "term", "source", "count", "all")
    )


def shared_terms(rows: DataFrame) -> DataFrame:
    """(g, h, value): what terms that both groups hold change against terms that one of them holds.

    ``rows`` (first, g, p, p0) come term by term within each partition, ``first``
    marking where one starts: group, its share of the term, and its share of a
    term it lacks. Sums per pair are taken in the task before they are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(first: np.ndarray, g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(first)
            sizes = np.diff(np.r_[cuts, len(g)])
            start, size = np.repeat(cuts, sizes), np.repeat(sizes, sizes)
            ends = np.cumsum(size)
            at = 0
            while at < len(g):
                # rows whose partners fit in one step, one row at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + STEP, side="right")))
                n = size[at:to]
                a = np.repeat(np.arange(at, to), n)
                b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
                a, b = a[a != b], b[a != b]
                value = divergence(p[a], p[b]) - divergence(p[a], p0[b]) - divergence(p0[a], p[b]) + divergence(p0[a], p0[b])
                order = np.lexsort((g[b], g[a]))
                x, y, value = g[a][order], g[b][order], value[order]
                if len(x):
                    heads = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                    sums = np.add.reduceat(value, heads)
                    yield pa.RecordBatch.from_arrays([pa.array(x[heads]), pa.array(y[heads]), pa.array(sums)], ["g", "h", "value"])
                at = to

        rest: list[np.ndarray] | None = None
        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in ("first", "g", "p", "p0")]
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            if not len(got[0]):
                continue
            # the last term may go on in the next batch
            cut = int(np.flatnonzero(got[0])[-1])
            if cut:
                yield from pairs(*[x[:cut] for x in got])
            rest = [x[cut:] for x in got]
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    return rows.mapInArrow(run, "g long, h long, value long")


def audit(documents: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language, and each source's ``top`` terms.

    Nulls in text, lang and source are read as ''. Texts are whole; repeated rows
    count each. A source whose texts have no kept term still has its rows of part
    ``pair``; a language without kept terms has values of 0. Ties in value are
    ranked by the UTF-8 bytes of the item. An empty table gives an empty result;
    further columns are not read. A pair's value is summed over all kept terms:
    terms of one side from that side's histogram of counts, terms of both sides
    by what they change, the rest at once.
    """
    counts = stage(term_counts(documents))
    kept = stage(kept_terms(counts, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("n_lang"), F.count_distinct("term").alias("v"))
    groups = stage(
        counts.filter("term is null").select("lang", "source")
        .join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        .select("*", F.monotonically_increasing_id().alias("g"), F.struct("lang", "source").alias("name"))
    )
    none = F.lit(1)
    facts = groups.filter("terms > 0").select(
        "name", F.col("terms").alias("_rows"), "g", "n", "v", "n_lang", share(none, F.col("n") + F.col("v")).alias("p0")
    )
    named = kept.select("*", F.struct("lang", "source").alias("name"))
    shares = stage(
        join_counted(named, facts, "name", ["g", "n", "v", "n_lang", "p0"]).select(
            "lang", "source", "term", "g", "p0", "count",
            share(F.col("count") + 1, F.col("n") + F.col("v")).alias("p"),
            share(F.col("all") + 1, F.col("n_lang") + F.col("v")).alias("q"),
        )
    )
    return pair_rows(shares, groups).unionByName(term_rows(shares, top))


def term_rows(shares: DataFrame, top: int) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    over = shares.filter(p > q).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        F.call_function("div", (p - q) * (p - q), q).alias("value"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def pair_rows(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language with its value.

    An entry of a group is a share p with the number of terms that have it, and a
    partner y has the share p0 of a term it lacks: entry x against partner y counts
    for the pair (x, y) and, the other way round, for (y, x). The terms a group
    lacks are one more entry, with the numbers that make both sums whole.
    """
    lacking = F.when(F.col("v") > 0, share(F.lit(1), F.col("n") + F.col("v"))).otherwise(F.lit(1))
    partners = groups.select("lang", F.col("g").alias("y"), lacking.alias("y0"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    entries = shares.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("own")).withColumn("other", F.col("own")).unionByName(
        groups.select("lang", "g", lacking.alias("p"), (F.col("v") - F.col("terms")).alias("own"), (-F.col("terms")).alias("other"))
    ).withColumn("slice", F.pmod(F.hash("g", "p"), F.lit(SLICES)))
    against = entries.join(partners, ["lang", "slice"]).filter("g != y").select(F.explode(F.array(
        F.struct("g", F.col("y").alias("h"), F.expr("own * (((p - y0) * (p - y0)) div y0)").alias("value")),
        F.struct(F.col("y").alias("g"), F.col("g").alias("h"), F.expr("other * (((y0 - p) * (y0 - p)) div p)").alias("value")),
    )).alias("e")).select("e.*")
    by_term = Window.partitionBy("lang", "term").orderBy("g")
    # each term's rows follow one another within their partition
    met = shares.select((F.row_number().over(by_term) == 1).alias("first"), "g", "p", "p0")
    values = against.unionByName(shared_terms(met)).groupBy("g", "h").agg(F.sum("value").alias("value"))
    named = groups.select("g", "lang", "source")
    other = groups.select(F.col("g").alias("h"), F.col("source").alias("item"))
    largest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.join(named, "g").join(other, "h").select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(largest).alias("rank")
    )
