"""Katz backoff language model: Good-Turing discounts, exact backoff weights.

Vocabulary: every word that the training texts hold twice or more, at any size of
the corpus. Words seen once stand for those never seen: they are one class, inside
which a word has (c + 1) / (tokens of the class + its types + 1). Bigrams of classes
back off to unigrams:

    P(w | h) = d[n(h, w)] n(h, w) / n(h)      where the bigram was seen
             = a(h) P(w)                      elsewhere

with a(h) such that the probabilities after every h sum to one.

Ids are given by falling count, so the count of a word is a step function of its
id: tasks get one row per distinct count, never one per word. Bigrams meet in
buckets by their history, whose weight is found there. Only histories with
VOCABULARY_SHARE of the training tokens, at most 1 / VOCABULARY_SHARE of them, are
spread over all buckets; their weights are sent to every task.

Texts are read once, in blocks of word numbers. A block sends its distinct words
and then its distinct bigrams to buckets by hash, as packed arrays, and gets ids
and log probabilities back in the same order, so what is exchanged is distinct
words and bigrams per block, and the word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.quality import held_out
from codestrata.llm.shared import groups
from codestrata.session import drop_scratch, scratch_path

#: Histories with this share of the training tokens are spread over the buckets.
VOCABULARY_SHARE = 1e-6
#: Tokens of a block, tokens per bucket, bytes of text per bucket of words, largest count that is discounted.
BLOCK_TOKENS, BUCKET_TOKENS, WORD_BYTES, DISCOUNTED = 3_000_000, 2_000_000, 32 << 20, 5
#: Class ids: words of no own, end of text, begin of text (as history only).
OTHER, END, BEGIN, FIRST_WORD = 0, 1, 2, 3
#: What a block is told of a word that was seen once: it is of no own, but known.
ONCE = 0xFFFFFFFF
_ID_BITS = 32
_ID_MASK = (1 << _ID_BITS) - 1


class _Index(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Block:
    """Texts as arrays: word numbers with their hashes, sizes of the documents."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    hashes: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Documents of a task in runs of about BLOCK_TOKENS words; a text is never cut."""
    index, ids, held, found, total = _Index(), [], [], [], 0

    def done() -> Block:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        sizes = np.array([len(f) for f in found], np.int64)
        return Block(ids, np.array(held, bool), sizes, np.concatenate(found), hashes)

    for b in batches:
        for doc, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            found.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            held.append(out)
            total += len(words) + 1
            if total >= BLOCK_TOKENS:
                yield done()
                index, ids, held, found, total = _Index(), [], [], [], 0
    if found:
        yield done()


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted or small integers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences of the upper halves, and of the lower ones under one upper half."""
    high, low = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(_ID_MASK)).astype(np.uint32)
    up = np.diff(high, prepend=np.uint32(0))
    return _squeeze(np.concatenate([up, np.where(up == 0, np.diff(low, prepend=np.uint32(0)), low)]))


def _unsqueeze_keys(data: bytes) -> np.ndarray:
    up, step = _unsqueeze(data, "<u4").reshape(2, -1).astype(np.uint64)
    sums = np.cumsum(step, dtype=np.uint64)
    first = np.flatnonzero(up)
    first = first if len(up) and up[0] else np.append(0, first)
    low = sums - np.repeat(sums[first] - step[first], np.diff(np.append(first, len(up)))) if len(up) else sums
    return (np.cumsum(up, dtype=np.uint64) << np.uint64(32)) | low


_SCHEMA = (
    "kind int, block long, bucket long, keys binary, counts binary, places binary, sizes binary, held binary, ids array<long>"
)
_COLUMNS = {
    "keys": pa.binary(), "counts": pa.binary(), "places": pa.binary(), "sizes": pa.binary(), "held": pa.binary(), "ids": pa.list_(pa.int64()),
}


def _rows(kind: int, block: list, bucket: list, **given) -> pa.RecordBatch:
    n = len(block)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(block, pa.int64()), pa.array(bucket, pa.int64())]
    columns += [pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _COLUMNS.items()]
    return pa.RecordBatch.from_arrays(columns, ["kind", "block", "bucket", *_COLUMNS])


def _dealt(block: int, keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
    """Order of ``keys`` by bucket and value, and rows of kind 1 that hold them so: a bucket's keys with their counts."""
    order = np.lexsort((keys, bucket))
    keys, n, bucket = keys[order], n[order].astype(np.uint32), bucket[order].astype(np.int64)
    cuts = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)] if len(bucket) else [0]
    parts = list(zip(cuts, cuts[1:]))
    return order, _rows(1, [block] * len(parts), [int(bucket[a]) for a, _ in parts],
                        keys=[_squeeze_keys(keys[a:b]) for a, b in parts],
                        counts=[_squeeze(n[a:b]) for a, b in parts])


def _hash_bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _merged(g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a bucket, their counts, and per block row where its keys are."""
    keys = [_unsqueeze_keys(k) for k in g.column("keys").to_pylist()]
    n = np.concatenate([_unsqueeze(c, "<u4") for c in g.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64), at, [len(k) for k in keys]


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.select("block", "bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket", "block")


def read_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """The texts as blocks, in two kinds of rows.

    0: a block's documents with the word numbers of their tokens and, per word, its
    place among the words by bucket. 1: hashes of a block's words in a bucket with
    their training counts; ends of text are not in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches)):
            number = (task << 20) + k
            train = np.repeat(~block.held, block.sizes)
            n = np.bincount(block.words[train], minlength=len(block.hashes))
            order, rows = _dealt(number, block.hashes, n, _hash_bucket(block.hashes, buckets))
            yield _rows(0, [number], [-1], keys=[_squeeze(block.words.astype(np.uint32))], places=[_squeeze(order.astype(np.uint32))],
                        sizes=[_squeeze(block.sizes)], ids=[block.ids], held=[block.held.tobytes()])
            yield rows

    return texts.mapInArrow(run, _SCHEMA)


def counts_of_counts(words: DataFrame) -> DataFrame:
    """(bucket, n, types): how many words of a bucket have a training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket"]):
            n, types = np.unique(_merged(g)[1], return_counts=True)
            n, types = n[n > 0], types[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g.column("bucket")[0].as_py())), pa.array(n), pa.array(types)], ["bucket", "n", "types"])

    return _by_bucket(words).mapInArrow(run, "bucket long, n long, types long")


@dataclass
class Vocabulary:
    """Counts by class id, as steps, and the first id of each (bucket, count)."""

    starts: np.ndarray
    steps: np.ndarray
    classes: int
    tokens: int
    types: int
    spread: int
    bucket: np.ndarray
    count: np.ndarray
    first: np.ndarray

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.steps[np.searchsorted(self.starts, ids, side="right") - 1]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Add-one probability of each class; the begin is never predicted."""
        return np.where(ids == BEGIN, 0.0, (self.counts(ids) + 1.0) / (self.tokens + self.classes - 1))

    def ids(self, bucket: int, n: np.ndarray) -> np.ndarray:
        """What blocks are told of the words of a bucket with counts ``n``: ONCE, an id, or OTHER if never seen."""
        a, b = np.searchsorted(self.bucket, [bucket, bucket + 1])
        out = np.where(n == 1, ONCE, OTHER).astype(np.uint32)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 1]
        counts = n[order]
        new = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]]) if len(counts) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(counts)))
        within = np.arange(len(counts)) - np.repeat(new, sizes)
        out[order] = self.first[a:b][np.searchsorted(self.count[a:b], counts)] + within
        return out


def vocabulary(words: DataFrame, ends: int) -> Vocabulary:
    """``ends`` is the number of training texts. A row per bucket and distinct count reaches the driver, never one per word."""
    got = counts_of_counts(words).toArrow()
    bucket, n, types = (got.column(c).to_numpy() for c in ("bucket", "n", "types"))
    tokens, all_types, once = int((n * types).sum()) + ends, int(types.sum()) + (ends > 0), int(types[n == 1].sum())
    own = n > 1
    bucket, n, types = bucket[own], n[own], types[own]
    order = np.lexsort((bucket, -n))
    first = np.empty(len(n), np.int64)
    first[order] = FIRST_WORD + np.cumsum(types[order]) - types[order]
    falling = n[order]
    new = np.flatnonzero(np.r_[True, falling[1:] != falling[:-1]]) if len(falling) else np.zeros(0, np.int64)
    starts = np.concatenate([[OTHER, END, BEGIN], first[order][new]])
    steps = np.concatenate([[once, ends, 0], falling[new]])
    spread = FIRST_WORD + int(types[n >= VOCABULARY_SHARE * tokens].sum())
    classes = FIRST_WORD + int(types.sum())
    if classes >= ONCE:
        raise ValueError("more words than ids")
    place = np.lexsort((n, bucket))
    return Vocabulary(starts, steps, classes, tokens, all_types, spread, bucket[place], n[place], first[place])


def resolve(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(block, bucket, keys): ids of a block's words, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket"]):
            _, n, at, sizes = _merged(g)
            ids = vocab.ids(g.column("bucket")[0].as_py(), n)[at]
            ends = np.cumsum([0, *sizes])
            yield pa.RecordBatch.from_arrays(
                [g.column("block").combine_chunks(), g.column("bucket").combine_chunks(), pa.array([_squeeze(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())],
                ["block", "bucket", "keys"],
            )

    return _by_bucket(words).mapInArrow(run, "block long, bucket long, keys binary")


def encode(read: DataFrame, resolved: DataFrame, vocab: Vocabulary, buckets: int) -> DataFrame:
    """The blocks by class, as two kinds of rows.

    0: a block's documents with their sums over words and, per token, the number of
    its bigram in the block. 1: bigrams of a block in a bucket with their training
    counts; taken by ascending bucket they stand in the order of those numbers.
    """
    both = read.select("block", "bucket", "keys", "places", "sizes", "held", "ids").unionByName(resolved, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            number, ids = g.column("block")[0].as_py(), g.column("ids")[0].as_py()
            data = g.column("keys").to_pylist()
            sizes, held = _unsqueeze(g.column("sizes")[0].as_py(), "<i8"), np.frombuffer(g.column("held")[0].as_py(), bool)
            place = _unsqueeze(g.column("places")[0].as_py(), "<u4")
            told = np.empty(len(place), np.uint32)
            if len(place):
                told[place] = np.concatenate([_unsqueeze(x, "<u4") for x in data[1:]])
            words, docs = _unsqueeze(data[0], "<u4"), len(sizes)
            class_of = np.where(told == ONCE, OTHER, told).astype(np.uint32)
            n = np.where(told == ONCE, 1, np.where(told == OTHER, 0, vocab.counts(class_of)))
            logs, other = np.log10(n + 1.0), class_of == OTHER
            doc_of = np.repeat(np.arange(docs, dtype=np.int32), sizes)

            def per_doc(x: np.ndarray) -> np.ndarray:
                return np.bincount(doc_of, weights=x[words], minlength=docs)

            sums = np.column_stack([per_doc(n > 0), per_doc(logs), per_doc(other), per_doc(np.where(other, logs, 0))]).astype(np.float64)
            del doc_of
            # each text: its words, then the end; histories begin with BEGIN
            ends = np.cumsum(sizes + 1) - 1
            keys = np.full(len(words) + docs, END, np.uint64)
            inside = np.ones(len(keys), bool)
            inside[ends] = False
            keys[inside] = class_of[words]
            last = np.concatenate((np.array([BEGIN], np.uint64), keys[:-1]))
            last[np.concatenate(([0], ends[:-1] + 1))] = BEGIN
            keys |= last << np.uint64(_ID_BITS)
            del last, inside, words
            distinct, at = np.unique(keys, return_inverse=True)
            del keys
            n = np.bincount(at[np.repeat(~held, sizes + 1)], minlength=len(distinct))
            history = distinct >> np.uint64(_ID_BITS)
            bucket = _hash_bucket(np.where(history < vocab.spread, distinct, history), buckets)
            order, rows = _dealt(number, distinct, n, bucket)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield _rows(0, [number], [-1], keys=[_squeeze(place[at])], sizes=[_squeeze(sizes)], ids=[ids], counts=[sums.tobytes()], held=[held.tobytes()])
            yield rows

    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, _SCHEMA)


#: Per history: seen bigrams by count up to DISCOUNTED + 1, the sum of counts above DISCOUNTED, unigram mass.
_SEEN = [f"c{r}" for r in range(1, DISCOUNTED + 2)]
_EVERY = -1


def bigram_sums(bigrams: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Sums over the training bigrams, of histories that are spread and (history _EVERY) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket"]):
            distinct, n, _, _ = _merged(g)
            distinct, n = distinct[n > 0], n[n > 0]
            every = [np.array([np.count_nonzero(n == r)], np.int64) for r in range(1, DISCOUNTED + 2)]
            h = (distinct >> np.uint64(_ID_BITS)).astype(np.int64)
            size = int(np.searchsorted(h, vocab.spread))
            h, w, n = h[:size], (distinct[:size] & np.uint64(_ID_MASK)).astype(np.int64), n[:size]
            history, at = np.unique(h, return_inverse=True)

            def sums(x: np.ndarray) -> np.ndarray:
                return np.bincount(at, weights=x, minlength=len(history))

            own = [sums(n == r).astype(np.int64) for r in range(1, DISCOUNTED + 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(history, _EVERY)), *(pa.array(np.append(a, b)) for a, b in zip(own, every)),
                    pa.array(np.append(sums(np.where(n > DISCOUNTED, n, 0)), 0.0)), pa.array(np.append(sums(vocab.unigram(w)), 0.0)),
                ],
                ["history", *_SEEN, "large", "lower"],
            )

    made = _by_bucket(bigrams).mapInArrow(run, "history long, " + ", ".join(f"{c} long" for c in _SEEN) + ", large double, lower double")
    return made.groupBy("history").agg(*(F.sum(c).alias(c) for c in (*_SEEN, "large", "lower")))


def discounts(seen: dict[int, int]) -> np.ndarray:
    """Share of a count that stays, by count up to DISCOUNTED, from counts of counts.

    Katz's form of Good-Turing; where it leaves (0, 1), as with few or odd data,
    half a count is taken off.
    """
    d = np.ones(DISCOUNTED + 1)
    top = (DISCOUNTED + 1) * seen.get(DISCOUNTED + 1, 0) / max(seen.get(1, 0), 1)
    for r in range(1, DISCOUNTED + 1):
        ratio = (r + 1) * seen.get(r + 1, 0) / max(seen.get(r, 0), 1) / r
        d[r] = (ratio - top) / (1 - top) if top != 1 else 0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


def _weights(kept: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and backoff weight of histories with these sums over the bigrams seen."""
    left = 1 - lower
    # a history that was followed by everything gives its seen words all the mass;
    # one with large counts only, of which nothing is taken off, counts one more
    full = left < 1e-12
    total = np.where(full, kept, np.where(kept > n - 1e-9, n + 1, n))
    return total, np.where(full, 0.0, (1 - kept / total) / np.where(full, 1, left))


@dataclass
class Katz:
    """Discounts, and count and backoff weight of the histories that are spread."""

    vocab: Vocabulary
    discount: np.ndarray
    history: np.ndarray
    backoff: np.ndarray

    def probability(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of distinct, sorted bigrams of a bucket, which holds all of a history that is not spread."""
        h, w = (keys >> np.uint64(_ID_BITS)).astype(np.int64), (keys & np.uint64(_ID_MASK)).astype(np.int64)
        kept, lower = np.where(n <= DISCOUNTED, self.discount[np.minimum(n, DISCOUNTED)], 1.0) * n, self.vocab.unigram(w)
        size = int(np.searchsorted(h, self.vocab.spread))
        total, backoff = np.empty(len(h)), np.empty(len(h))
        total[:size], backoff[:size] = self.history[h[:size]], self.backoff[h[:size]]
        if size < len(h):
            first = size + np.flatnonzero(np.r_[True, h[size + 1 :] != h[size:-1]])
            sums = (np.add.reduceat(x, first) for x in (kept, n.astype(float), np.where(n > 0, lower, 0.0)))
            times = np.diff(np.append(first, len(h)))
            total[size:], backoff[size:] = (np.repeat(x, times) for x in _weights(*sums))
        return np.where(n > 0, kept / np.maximum(total, 1e-300), backoff * lower)


def fit(bigrams: DataFrame, vocab: Vocabulary) -> Katz:
    """Discounts and exactly normalised backoff weights.

    Per history the mass that its discounted bigrams keep and the unigram mass of
    the words seen after it are summed; a row per history that is spread reaches
    the driver. Other histories are summed where their bigrams are scored.
    """
    got = bigram_sums(bigrams, vocab).toArrow()
    h = got.column("history").to_numpy()
    seen = np.column_stack([got.column(c).to_numpy() for c in _SEEN])
    every = seen[h == _EVERY].sum(0)
    d = discounts({r: int(c) for r, c in enumerate(every, 1)})
    large, lower = (got.column(c).to_numpy() for c in ("large", "lower"))
    small = seen[:, :DISCOUNTED] * np.arange(1, DISCOUNTED + 1)
    own = h != _EVERY
    history, backoff = np.zeros(vocab.spread), np.ones(vocab.spread)
    history[h[own]], backoff[h[own]] = _weights((small @ d[1:] + large)[own], (small.sum(1) + large)[own], lower[own])
    return Katz(vocab, d, history, backoff)


def score_bigrams(bigrams: DataFrame, model: Katz) -> DataFrame:
    """(block, bucket, logs): log10 probabilities of a block's bigrams, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["bucket"]):
            distinct, n, at, sizes = _merged(g)
            with np.errstate(divide="ignore"):
                logs = np.log10(model.probability(distinct, n)).astype("<f4")[at]
            ends = np.cumsum([0, *sizes])
            yield pa.RecordBatch.from_arrays(
                [g.column("block").combine_chunks(), g.column("bucket").combine_chunks(), pa.array([_squeeze(logs[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())],
                ["block", "bucket", "logs"],
            )

    return _by_bucket(bigrams).mapInArrow(run, "block long, bucket long, logs binary")


def sum_documents(encoded: DataFrame, scored: DataFrame) -> DataFrame:
    """Per document: id, tokens, known words, log counts, words of no own with their log counts, bigram log sum."""
    both = encoded.select("block", "bucket", "keys", "counts", "sizes", "held", "ids").unionByName(
        scored.select("block", "bucket", F.col("logs").alias("keys")), allowMissingColumns=True
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            data = g.column("keys").to_pylist()
            logs = np.concatenate([_unsqueeze(x, "<f4") for x in data[1:]]).astype(np.float64)
            at, sizes = _unsqueeze(data[0], "<u4"), _unsqueeze(g.column("sizes")[0].as_py(), "<i8")
            held = np.frombuffer(g.column("held")[0].as_py(), bool)
            sums = np.frombuffer(g.column("counts")[0].as_py(), "<f8").reshape(-1, 4)
            total = np.add.reduceat(logs[at], np.cumsum(sizes + 1) - sizes - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    g.column("ids")[0].values, pa.array(held), pa.array(sizes + 1), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]),
                    pa.array(sums[:, 2].astype(np.int64)), pa.array(sums[:, 3]), pa.array(total),
                ],
                ["doc_id", "held_out", "n_tokens", "n_words_known", "word_log", "n_other", "other_log", "bigram_log"],
            )

    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_words_known long, word_log double, n_other long, other_log double, bigram_log double"
    )


def language_model_scores(documents: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``documents``.

    Counts are learnt from the whole texts of all rows whose crc32(doc_id) leaves
    another remainder. Null and empty texts are the end alone; null ids are not
    held out; repeated rows count as often as they stand there. Without training
    rows every probability is that of unseen words. Only doc_id and text are read.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    )
    size = texts.agg(F.count_if(~F.col("held_out")).alias("ends"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()

    def written(rows: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
        rows.write.partitionBy("kind").option("compression", "zstd").parquet(place)
        got = spark.read.schema(_SCHEMA).parquet(place)
        return got.filter("kind = 0"), got.filter("kind = 1")

    by_word, by_class = scratch_path(spark, "katz-words"), scratch_path(spark, "katz-classes")
    read, words = written(read_texts(texts, 1 + size["bytes"] // WORD_BYTES), by_word)
    vocab = vocabulary(words, size["ends"])
    encoded, bigrams = written(encode(read, resolve(words, vocab), vocab, max(1, -(-vocab.tokens // BUCKET_TOKENS))), by_class)
    drop_scratch(spark, by_word)  # the blocks by class hold all that is asked from here on
    model = fit(bigrams, vocab)
    sums = sum_documents(encoded, score_bigrams(bigrams, model))
    tokens, types, once = vocab.tokens, vocab.types, int(vocab.steps[OTHER])
    end_known, end_log = int(size["ends"] > 0), float(np.log10(size["ends"] + 1))
    inside = float(np.log10(2 * once + 1))
    return sums.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_words_known") + end_known).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("word_log") + end_log - F.col("n_tokens") * float(np.log10(tokens + types + 1))).alias("base_score"),
        (F.col("bigram_log") + F.col("other_log") - F.col("n_other") * inside).alias("score"),
    )
