"""SimHash near-duplicates by the generalised pigeonhole principle, and near copies by exact similarity of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.shared import components, groups, split_large, split_marked
from codestrata.session import stage

BITS = 64
SEED = 42
#: Cost of a row that is exchanged, against a pair that a task compares.
ROW_COST, PAIR_COST = 1.0, 0.01
#: Rows compared with all others of a group at once.
STEP = 64
#: Sets of similarity NEAR / OF or more are near copies.
NEAR, OF = 4, 5
#: Candidates agree in one of BANDS groups of MINIMA minima: of pairs at 0.8 all but
#: (1 - 0.8 ** 6) ** 40, five in a million, whatever their size.
BANDS, MINIMA = 40, 6
#: Texts whose sets of shingles a task holds before it sends them on.
SLICE = 512
#: Shingles that count as one more row where groups are cut to size.
ROW_SHINGLES = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * MINIMA, np.uint64, endpoint=False) | np.uint64(1)
_SHORT_FACTORS = _FACTORS.astype(np.uint32)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 hashes of the word shingles of a text, repeats included.

    Upper-case A-Z are lowered, words end at ASCII white space. Fewer words than
    ``shingle`` give one shingle of all of them; no word gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the shingle hashes, as an unsigned integer; zero without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each of MINIMA least values under functions of its own."""
    least, short = np.full(BANDS * MINIMA, np.iinfo(np.uint32).max, np.uint32), (distinct >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256] * _SHORT_FACTORS[:, None]).min(1), out=least)
    keys = ((least + np.uint64(1)) * _FACTORS).reshape(BANDS, MINIMA).sum(1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(32))


def fingerprints(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            f = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(f, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                both += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
            n += len(x)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    # 64 x 64 + 1 rows whatever the input
    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Groups of nearly equal size that keep strongly correlated bits together."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        # start with the bit that carries least information among those left
        group = [min(left, key=lambda b: (-abs(p[b] - 0.5), b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def agreement(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of ``group``, t = 0..most."""
    p = both.diagonal() / max(n, 1)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per part, of the given sum and the least summed cost.

    ``costs[i][t + 1]`` is the cost of threshold t in part i; t = -1 skips it.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                now = spent + cost[t + 1]
                if used + t not in step or now < step[used + t][0]:
                    step[used + t] = (now, [*chosen, t])
        best = step
    return best[total]


def plan_parts(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Bit groups with thresholds: fingerprints within ``distance`` agree on some group.

    With m groups and thresholds that sum to distance - m + 1, two fingerprints
    that differ by more than its threshold in every group differ by more than
    ``distance`` in all. Costs are rows to exchange plus estimated candidates,
    from bit frequencies and the measured number of equal group values.
    """
    n, both = bit_counts(distinct)
    n = max(n, 2)  # a probe is never free, so that few rows take the plan with fewest probes
    pairs = n * n / 2
    cuts = {m: bit_groups(n, both, m) for m in range(2, distance + 2)}
    # all cuts are measured in one job, of one row per fingerprint and group
    masks = F.array(*[F.lit(_signed(_mask(g))) for parts in cuts.values() for g in parts])
    values = distinct.select("fp", F.posexplode(masks).alias("part", "mask")).groupBy("part", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    sums = values.agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.sum(F.pow(F.col("n").cast("double"), 2)).alias("s"))
    found = {r["part"]: r["s"] for r in sums.collect()}
    options = []
    for m, parts in cuts.items():
        before = sum(len(cuts[k]) for k in range(2, m))
        measured = {i: found[before + i] for i in range(m) if before + i in found}
        costs = []
        for i, g in enumerate(parts):
            share = agreement(n, both, g, distance)
            factor = max(1.0, measured.get(i, 0.0) / 2 / max(share[0] * pairs, 1.0))
            probes = [sum(comb(len(g), d) for d in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0] + [ROW_COST * n * r + PAIR_COST * min(pairs, s * pairs * factor) * 2 for r, s in zip(probes, share)])
        spent, chosen = allocate(costs, distance - m + 1)
        options.append((spent, [(g, t) for g, t in zip(parts, chosen) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probes(bits: list[int], threshold: int) -> list[int]:
    """Bit patterns to flip, none first, that reach all values within ``threshold``."""
    return [_mask(list(c)) for d in range(threshold + 1) for c in combinations(bits, d)]


def forest(
    fp: np.ndarray, home: np.ndarray, side: np.ndarray | None, distance: int,
) -> list[tuple[int, int]]:
    """Index pairs that connect what is linked in one group, fewer than its rows.

    A pair counts if it is within ``distance``, one of the two is at home in the
    group and, given sides, the sides differ.
    """
    out: list[tuple[int, int]] = []

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= distance
        i, j = np.nonzero(hit)
        if not len(i):
            return hit
        x, y = a[i], b[j]
        good = (home[x] | home[y]) & (x != y)
        if side is not None:
            good &= side[x] != side[y]
        hit[i[~good], j[~good]] = False
        return hit

    everyone, linked = np.arange(len(fp)), np.zeros(len(fp), bool)
    rows = everyone if side is None else np.flatnonzero(side == side[0])
    others = everyone if side is None else np.flatnonzero(side != side[0])
    for k in range(0, len(rows), STEP):
        some, rest = rows[k : k + STEP], others[k:] if side is None else others
        hit = near(some, rest)
        linked[some] |= hit.any(1)
        linked[rest] |= hit.any(0)
    left = np.flatnonzero(linked)
    while len(left) > 1:
        reached, left = [left[:1]], left[1:]
        while reached and len(left):
            at = reached.pop()
            for k in range(0, len(at), STEP):
                some = at[k : k + STEP]
                hit = near(some, left)
                got = hit.any(0)
                if got.any():
                    by = some[hit[:, got].argmax(0)]
                    out.extend(zip(by.tolist(), left[got].tolist()))
                    reached.append(left[got])
                    left = left[~got]
                if not len(left):
                    break
    return out


def links(distinct: DataFrame, distance: int, bucket_rows: int = 2048) -> DataFrame:
    """Edges (a, b) between nodes that connect all fingerprints within ``distance``.

    ``distinct`` has unique ``fp`` with a ``node``. Fingerprints meet in the
    buckets of the planned groups, at home and at the probed values. A bucket
    above ``bucket_rows`` is first refined: what it holds agrees on its group, so
    at most ``distance`` of the other bits differ and one of distance + 1 exact
    sub-groups of them must be equal. What stays large is dealt out in pairs of
    chunks. In a bucket only the edges of a spanning forest are returned.
    """
    places, rest = [], []
    for i, (bits, t) in enumerate(plan_parts(distinct, distance)):
        mask = F.lit(_signed(_mask(bits)))
        for k, flip in enumerate(_probes(bits, t)):
            places.append(F.struct(
                F.lit(i).cast("long").alias("part"),
                F.col("fp").bitwiseXOR(F.lit(_signed(flip))).bitwiseAND(mask).alias("value"),
                F.lit(k == 0).alias("home"),
            ))
        others = [b for b in range(BITS) if b not in bits]
        rest.append(F.array(*[F.lit(_signed(_mask(others[j :: distance + 1]))) for j in range(distance + 1)]))
    rows = stage(
        distinct.select("fp", "node", F.explode(F.array(*places)).alias("p"))
        .select("fp", "node", "p.*", F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("sub_value"))
    )
    keys = ["part", "value", "sub", "sub_value"]
    crowded = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows)
    marked = rows.join(crowded, ["part", "value"], "left")
    refined = (
        marked.filter("_n is not null").drop("_n", "sub", "sub_value")
        .select("*", F.posexplode(F.element_at(F.array(*rest), F.col("part").cast("int") + 1)).alias("sub", "_mask"))
        .select("fp", "node", "part", "value", "home", F.col("sub").cast("long"), F.col("fp").bitwiseAND(F.col("_mask")).alias("sub_value"))
    )
    dealt = split_large(marked.filter("_n is null").drop("_n").unionByName(refined), keys, bucket_rows, F.col("fp"))
    keys = [*keys, "chunk_a", "chunk_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            fp = g.column("fp").to_numpy().view(np.uint64)
            home = g.column("home").to_numpy()
            across = g.column("chunk_a")[0].as_py() != g.column("chunk_b")[0].as_py()
            found = forest(fp, home, g.column("chunk").to_numpy() if across else None, distance)
            if found:
                node = g.column("node").to_numpy()
                x, y = np.array(found).T
                a.append(node[x])
                b.append(node[y])
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``documents``.

    Fingerprints are linked at ``distance`` or fewer differing bits, whether they
    differ or not; ``component_id`` is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero. Rows without doc_id keep their row; they
    join the component of their fingerprint, or get null if that has no doc_id
    at all. Repeated rows are kept. An empty table gives an empty result.
    """
    found = stage(fingerprints(documents, shingle))
    distinct = stage(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    labels = components(links(distinct, distance))
    by_fp = distinct.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(by_fp, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_sets(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect all sets of similarity NEAR / OF or more, fewer than the sets.

    ``sets`` hold distinct hashes; the similarity is exact. Given sides, only
    pairs across them count.
    """
    size = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start, marked = np.cumsum(size) - size, np.zeros(len(values), bool)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            fits = np.minimum(size[left], size[at]) * OF >= NEAR * np.maximum(size[left], size[at])
            if side is not None:
                fits &= side[left] != side[at]
            some = left[fits]
            if not len(some):
                continue
            n = size[some]
            first = np.cumsum(n) - n
            own = ids[start[at] : start[at] + size[at]]
            marked[own] = True
            hits = np.append(marked[ids[np.arange(n.sum()) + np.repeat(start[some] - first, n)]], False)
            marked[own] = False
            shared = np.where(n > 0, np.add.reduceat(hits, first, dtype=np.int64), 0)
            got = some[shared * (NEAR + OF) >= NEAR * (n + size[at])]
            out.extend((at, int(x)) for x in got)
            reached.extend(got.tolist())
            left = np.setdiff1d(left, got, assume_unique=True)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that few sets are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def linked_prints(prints: DataFrame, distance: int) -> DataFrame:
    """(node, bucket) of the nodes in ``prints`` (node, fp) whose fingerprints are linked: what links connect is a bucket.

    Fingerprints are linked at ``distance`` or fewer differing bits, equal ones too.
    """
    distinct = stage(prints.groupBy("fp").agg(F.min("node").alias("_least"), F.max("node").alias("_most")).withColumn("node", F.col("fp")))
    labels = components(links(distinct.select("fp", "node"), distance)).withColumnRenamed("node", "fp")
    # a fingerprint of one node without links is no candidate
    told = distinct.join(labels, "fp", "left").filter("component is not null or _least != _most")
    buckets = told.select("fp", F.xxhash64(F.coalesce("component", "fp"), F.lit("fingerprints")).alias("bucket"))
    return prints.join(buckets, "fp").select("node", "bucket").distinct()


def similar_rows(rows: DataFrame, shingle: int = 5, group_rows: int = 4096, distance: int = 4) -> DataFrame:
    """(row, component) for ``rows`` (row, text): near copies have one component.

    Two texts are near copies if the sets of their word shingles have a similarity
    of NEAR / OF or more, which is computed exactly; a component is what such pairs
    connect. Texts with equal sets are one node, known by a 64-bit digest of the
    set; texts without words are one, too.

    Which sets are compared: nodes whose SimHash fingerprints are linked at
    ``distance`` or fewer differing bits are candidates, and for those copies whose
    fingerprints lie further apart, as they do towards NEAR / OF, nodes that agree in
    a band of minima. The components of the candidates, each bucket tied to its smallest node, are
    the groups; they hold every near copy of their members. A group above
    ``group_rows`` (where ROW_SHINGLES shingles count as one row more) is dealt
    out in pairs of chunks, as a whole or bucket by bucket, whichever copies fewer
    rows. Sets are made again from the texts of candidates only: texts that are
    certainly none are left out before the exchange, and a set is sent once for
    each group it is dealt to. From a group come only the edges of a spanning
    forest. ``row`` is of any type that has an order; ``rows`` must give the same
    rows each time it is read.
    """
    kind = rows.schema["row"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            prints, sets = np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(b.column("text")):
                hashes = shingle_hashes(t.as_py(), shingle)
                prints[i] = majority(hashes)
                sets.append(np.unique(hashes))
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            bands = np.concatenate([band_keys(x) for x in sets]) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64))),
                ],
                ["row", "node", "size", "fp", "bands"],
            )

    texts = rows.select("row", F.col("text").cast("string"))
    found = stage(texts.mapInArrow(describe, f"row {kind}, node long, size long, fp long, bands array<long>"))
    linked = linked_prints(found.select("node", "fp").distinct(), distance)
    listed = found.select("node", F.explode("bands").alias("bucket")).distinct().unionByName(linked)
    shared = listed.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "first")
    met = stage(listed.join(shared, "bucket"))
    nodes = found.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"))
    weight = (F.lit(1) + F.floor(F.col("size") / ROW_SHINGLES)).cast("long")
    members = stage(components(met.select(F.col("node").alias("a"), F.col("first").alias("b"))).join(nodes, "node").withColumn("weight", weight))

    # copies of rows that either way of dealing makes, by component
    chunks = F.ceil(F.col("w") / group_rows)
    whole = members.groupBy("component").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).select("component", (F.col("n") * chunks).alias("whole"), chunks.alias("c"))
    large = stage(members.join(whole.filter("c > 1"), "component").select("node", "row", "component", "weight", "whole"))
    placed = stage(met.join(large, "node").select("node", "row", "component", "weight", "whole", "bucket"))
    split = (
        placed.groupBy("bucket").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.first("component").alias("component"), F.first("whole").alias("whole"))
        .groupBy("component").agg(F.sum(F.col("n") * chunks).alias("parts"), F.first("whole").alias("whole")).filter("parts < whole").select("component")
    )
    split = stage(split)
    grouped = members.join(split, "component", "left_anti").select("node", "row", "weight", F.col("component").alias("group")).unionByName(
        placed.join(split, "component", "left_semi").select("node", "row", "weight", F.col("bucket").alias("group"))
    )
    dealt = stage(split_large(grouped, ["group"], group_rows, F.col("node"), F.col("weight")).drop("weight"))

    keys = ["group", "chunk_a", "chunk_b"]
    carried = [*keys, "chunk", "node"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed = None, b""
        for b in _slices(batches):
            sets = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text")):
                if node != last:  # the groups of a row follow each other
                    last, packed = node, np.unique(shingle_hashes(text.as_py(), shingle)).tobytes()
                sets.append(packed)
            yield pa.RecordBatch.from_arrays([*map(b.column, carried), pa.array(sets, pa.binary())], [*carried, "hashes"])

    candidates, _ = split_marked(texts, members.select("row"), "row")
    sets = candidates.join(dealt, "row").select(*carried, "text").mapInArrow(
        gather, "group long, chunk_a int, chunk_b int, chunk int, node long, hashes binary"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            across = g.column("chunk_a")[0].as_py() != g.column("chunk_b")[0].as_py()
            edges = near_sets([np.frombuffer(x, np.uint64) for x in g.column("hashes").to_pylist()], g.column("chunk").to_numpy() if across else None)
            node, at = g.column("node").to_numpy(), np.array(edges, int).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

    edges = sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")
    labels = components(edges)
    return found.select("row", "node").join(labels, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def similar_texts(documents: DataFrame, shingle: int = 5, group_rows: int = 4096) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id among the near copies of each text (see ``similar_rows``).

    Rows without doc_id have no component and connect nothing.
    """
    rows = stage(documents.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id()))
    labels = stage(similar_rows(rows.filter("doc_id is not null"), shingle, group_rows).join(rows.select("row", "doc_id"), "row"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labels.join(least, "component").select("doc_id", "component_id").unionByName(
        rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    )
