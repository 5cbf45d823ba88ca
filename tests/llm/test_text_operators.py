"""Quality, mixing, language model, packing, SimHash and token operators against brute force."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm import katz, mixing, packing, quality, simhash, token_counts, token_files
from codestrata.llm.shared import components, split_large
from codestrata.llm.tokens import Encoder
from codestrata.session import scratch_path, stage

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part string, block string, rank string"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three four five", "en", "a", 23),
    (4, "one two three four five", "en", "a", 23), (5, "one two three four five", None, "b", None), (None, "no id here at all", "en", "b", 3),
    (6, "long word " * 6000, "en", None, 60000), (7, "It's  I'LL\r\n\n é ß 12345 <|endoftext|>   x‍ 漢字", "fr", "b", 9),
    (8, "ONE Two three FOUR five", "en", "c", 23),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def reach(ids, linked):
    """Smallest id reachable, by brute force."""
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = reach({x for p in pairs for x in p}, pairs)
    assert got == {n: c for n, c in want.items() if n != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds_have_tasks_by_edges(spark):
    tracker = spark.sparkContext.statusTracker()
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    edges = stage(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("component-rounds", "")
        assert {r["component"] for r in components(edges).collect()} == {0}
        jobs = tracker.getJobIdsForGroup("component-rounds")
        stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
        tasks = [info.numTasks for s in sorted(stages) if (info := tracker.getStageInfo(s)) is not None]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    # only the distinct edges meet in as many tasks as there are shuffle partitions
    assert sum(n == 61 for n in tasks) <= 1 and len(tasks) > 10



def test_split_large_keeps_every_pair(spark):
    rows = spark.range(57).select(F.lit(1).alias("k"), "id").unionByName(spark.range(3).select(F.lit(2).alias("k"), "id"))
    met = defaultdict(set)
    for r in split_large(rows, ["k"], 10, F.col("id")).collect():
        met[r["k"], r["chunk_a"], r["chunk_b"]].add((r["id"], r["chunk"]))
    seen = Counter()
    for (k, a, b), members in met.items():
        for (x, cx), (y, cy) in combinations(sorted(members), 2):
            if (a == b) or cx != cy:
                seen[k, x, y] += 1
    assert max(map(len, met.values())) < 57
    assert seen == Counter([(1, x, y) for x, y in combinations(range(57), 2)] + [(2, x, y) for x, y in combinations(range(3), 2)])


# quality


def test_machine_equals_the_double_sum():
    rng = np.random.default_rng(3)
    model = quality.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), ())
    rows = [(rng.choice(50, n, replace=False), rng.normal(size=n)) for n in (1, 5, 20)]
    for got, (at, v) in zip(quality.scores(model, rows), rows):
        plain = 0.3 + sum(model.weight[i] * x for i, x in zip(at, v))
        for (i, x), (j, y) in combinations(zip(at, v), 2):
            plain += (model.factor[i] @ model.factor[j]) * x * y
        assert got == pytest.approx(plain)


def test_quality_is_learnt_from_rows_not_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(documents, labels)
    assert got.count() == documents.count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    # other labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(got.collect()) == sorted(quality.quality(documents, turned).collect())


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(none, labels).count() == 0
    unlearnt = quality.quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlearnt} == {0.5}


# mixing


def mixed(df, **how):
    return mixing.mix(df.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")), **how)


def test_mixing_meets_entropy_and_uses_every_document(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = Counter()
    for i, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())

    def entropy(a):
        w = np.array([(n / total) ** a for n in tokens.values()])
        w /= w.sum()
        return -(w * np.log(w)).sum()

    goal = 0.95 * math.log(len(tokens))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= goal else (low, mid)
    sources = mixing.source_tokens(df.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")))
    assert mixing.find_exponent(sources, entropy=0.95) == pytest.approx(low, abs=2e-6)
    got = mixed(df, entropy=0.95).collect()
    assert {r["doc_id"] for r in got} == set(range(3000))
    share = Counter()
    for r in got:
        share[r["source"]] += r["n_tokens"]
    want = {s: (n / total) ** low for s, n in tokens.items()}
    for s in tokens:
        assert share[s] / sum(share.values()) == pytest.approx(want[s] / sum(want.values()), rel=0.01)
    # every block holds the sources in these weights; a permutation has every document once
    first = Counter((r["source"], r["block"]) for r in got for _ in range(r["n_tokens"]))
    assert min(first["big", b] for b in range(64)) > 0.7 * max(first["big", b] for b in range(64))
    assert max(Counter((r["doc_id"], r["epoch"]) for r in got).values()) == 1


def test_mixing_repeats_and_budget(spark):
    rows = [(i, "w " * 10, "big" if i < 900 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r["doc_id"] for r in mixed(df, repeats=2.0).collect())
    assert {times[i] for i in range(900)} == {1} and {times[i] for i in range(900, 1000)} == {2}
    few = mixed(df, repeats=2.0, tokens=1000).collect()
    assert 1000 <= sum(r["n_tokens"] for r in few) <= 1020
    assert mixing.mix_rows(df, repeats=2.0).count() == 1100 and mixing.mix_rows(df, repeats=2.0).columns == df.columns


def test_mixing_edges(odd, none):
    got = mixed(odd, entropy=0.9).collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0) == Counter(r[0] for r in ODD)
    assert mixed(none, entropy=0.9).count() == 0
    kept = mixing.mix_rows(odd, repeats=1.25)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in ODD}


@pytest.mark.parametrize("broadcast_bytes", [mixing.BROADCAST_BYTES, 0])
def test_rows_of_the_mixture_are_those_of_its_streams(spark, broadcast_bytes):
    rows = [(i, "w " * (i % 9), ["big", "big", "big", "mid", None][i % 5] if i % 50 else f"s{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for how in ({"entropy": 0.97}, {"repeats": 1.5}, {"repeats": 1.25, "tokens": 3000}):
        want = Counter(r["doc_id"] for r in mixed(df, **how).collect())
        got = Counter(r["doc_id"] for r in mixing.mix_rows(df, **how, broadcast_bytes=broadcast_bytes).collect())
        assert got == want


def test_half_the_ids_null_and_a_source_of_one_token(spark):
    rows = [(None if i % 2 else i, f"text number {i} of all", "big") for i in range(2000)] + [(1, "alone", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(r["text"] for r in mixing.mix_rows(df, entropy=0.9).collect())
    assert set(got) == {r[1] for r in rows} and {got[t] for _, t, s in rows if s == "big"} == {1}
    # entropy 0.9 of two sources needs a share of 0.316 for the small one
    assert got["alone"] == pytest.approx(10000 * 0.316 / 0.684, rel=0.01)
    listed = mixed(df, entropy=0.9).filter("source = 'small'")
    assert listed.count() == got["alone"] and listed.select("epoch").distinct().count() == got["alone"]
    part = mixing.mix_rows(df, repeats=1.0, tokens=5001)
    assert sum(len(r["text"].split()) for r in part.collect() if r["source"] == "big") == pytest.approx(5000, abs=10)


def test_a_source_of_one_token_beside_a_large_one(spark):
    sources = spark.createDataFrame([("small", 1, 1), ("large", 10**10, 10**6)], "source string, tokens long, docs long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(sources, 1.0).collect()}
    assert got == {"small": 1, "large": 10**10}
    got = {r["source"]: r["budget"] for r in mixing.budgets(sources, 0.99).collect()}
    assert got["large"] == 10**10 and got["small"] == 2


# language model


def katz_by_hand(rows):
    held = {i for i, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 7 == 2}
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"] for _, t in rows]
    c = Counter(w for i, ws in enumerate(words) if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    own = {w for w, k in c.items() if k >= max(2, katz.VOCABULARY_SHARE * n)} | {b"\n"}
    uni, bi = Counter(), Counter()
    for i, ws in enumerate(words):
        if i not in held:
            h = "begin"
            for w in ws:
                k = w if w in own else "other"
                uni[k] += 1
                bi[h, k] += 1
                h = k
    size = len(own) + 1
    lower = lambda k: (uni[k] + 1) / (n + size)
    d = katz.discounts(Counter(bi.values()))
    total, kept, mass = Counter(), Counter(), Counter()
    for (h, k), m in bi.items():
        total[h] += m
        kept[h] += m * (d[m] if m <= katz.DISCOUNTED else 1)
        mass[h] += lower(k)
    for h in total:
        total[h] += kept[h] > total[h] - 1e-9
    inside = uni["other"] + sum(w not in own for w in c) + 1

    def p(h, k):
        m = bi.get((h, k), 0)
        if m:
            return (d[m] if m <= katz.DISCOUNTED else 1) * m / total[h]
        return lower(k) * ((1 - kept[h] / total[h]) / (1 - mass[h]) if h in total else 1)

    for h in ["begin", *list(uni)[:20]]:
        assert sum(p(h, k) for k in own | {"other"}) == pytest.approx(1)
    out = []
    for i, ws in enumerate(words):
        h, s = "begin", 0.0
        for w in ws:
            k = w if w in own else "other"
            s += math.log10(p(h, k)) + (math.log10((c[w] + 1) / inside) if k == "other" else 0)
            h = k
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((rows[i][0], i in held, len(ws), sum(c[w] > 0 for w in ws), n, base, s))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_katz_equals_the_plain_recursion(which, request):
    df = request.getfixturevalue(which)
    order = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    want = sorted(katz_by_hand([(r["doc_id"], r["text"]) for r in df.collect()]), key=order)
    got = sorted(map(tuple, katz.language_model_scores(df).collect()), key=order)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_katz_keeps_the_texts_once_on_disk(spark, documents, monkeypatch):
    made = []
    monkeypatch.setattr(katz, "scratch_path", lambda spark, label: (made.append(scratch_path(spark, label)), made[-1])[1])
    katz.language_model_scores(documents).count()
    assert [Path(p.removeprefix("file:")).is_dir() for p in made] == [False] * (len(made) - 1) + [True]


def test_katz_packs_bigrams_by_history():
    rng = np.random.default_rng(3)
    odd = [[], [0], [0, 1, 2**64 - 1], [2**32, 2**32 + 7, 2**33], [5, 2**40, 2**40 + 1]]
    keys = np.unique(rng.geometric(1e-4, 30_000).astype(np.uint64) << np.uint64(32) | rng.geometric(1e-4, 30_000).astype(np.uint64))
    for k in [*(np.array(o, np.uint64) for o in odd), rng.integers(0, 2**64, 1000, np.uint64), keys]:
        assert katz._unsqueeze_keys(katz._squeeze_keys(np.sort(k))).tolist() == np.sort(k).tolist()
    assert len(katz._squeeze_keys(keys)) < 0.9 * len(katz._squeeze(np.diff(keys, prepend=np.uint64(0))))


def test_katz_counts_bigrams_of_all_words_at_any_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(200)] + ["often"] * 200 + ["most"] * 300
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(katz_by_hand(rows))
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(katz, "WORD_BYTES", 1000)
    for share in (1e-6, 0.01, 1.0):  # as where a corpus is large: words of a small share, all words
        monkeypatch.setattr(katz, "VOCABULARY_SHARE", share)
        for a, b in zip(sorted(map(tuple, katz.language_model_scores(df).collect())), want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_katz_beats_the_base_on_held_out_text_and_takes_empty_tables(documents, none):
    got = katz.language_model_scores(documents).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]
    assert katz.language_model_scores(none).count() == 0


# tokens


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_remembered_words_give_the_ids_of_the_library(path, documents):
    library, own = Tokenizer.from_file(path), Encoder(path)
    texts = [r["text"] for r in documents.collect()] + [r[1] or "" for r in ODD] + [
        "a  b\t\tc", "x  ", "  x", "a \n b", "a\n \nb", "\n", " ", "<|startoftext|>a <|endoftext|>  b", "don'ts 'SS I'Ve'd", "1a2b&&'re",
        "ª µ º × ÷", "é", "A\x1cB", "x y",
    ]
    for t in texts * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_word_is_encoded_once_whatever_stands_beside_it(path, monkeypatch):
    asked, library, ask = [], Tokenizer.from_file(path), Encoder._piece
    monkeypatch.setattr(Encoder, "_piece", lambda self, piece: (asked.append(piece), ask(self, piece))[1])
    own, text = Encoder(path), " Reshsh Reshsh, Reshsh. (Reshsh Reshsh&&& Reshsh;"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum("resh" in a.lower() for a in asked) == 1 + ("Reshsh" in asked)  # with and without the space before it


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memory_of_pieces_is_bounded_in_bytes(path):
    rng, own = np.random.default_rng(5), Encoder(path)
    letters = rng.integers(97, 123, (300_000, 9), dtype=np.uint8)
    texts = [" ".join(bytes(w).decode() for w in letters[a : a + 1000]) for a in range(0, len(letters), 1000)]
    tracemalloc.start()
    try:
        for t in texts:
            own.encode(t)
        own.encode("".join(texts).replace(" ", ""))  # one word of 2.7 million letters
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 50 << 20


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_words_are_not_remembered(path):
    rng, own = np.random.default_rng(6), Encoder(path)
    texts = [bytes(w).decode() for w in rng.integers(97, 123, (300, 5000), dtype=np.uint8)]
    tracemalloc.start()
    try:
        for t in texts:
            own.encode(t)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1 << 20


def test_token_counts_encode_misses_only(spark, odd, none, documents, monkeypatch):
    cache, library = scratch_path(spark, "cache"), Tokenizer.from_file(WORD)
    how = dict(tokenizer=WORD, cache=cache, normalise=token_counts.single_spaces)
    got = sorted(map(tuple, token_counts.count_tokens(odd, **how).collect()), key=str)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 2048) for d, t, *_ in ODD), key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join(re.split("[ \t\n\r]+", t or "")) for _, t, *_ in ODD})
    token_counts.count_tokens(odd, **how).collect()
    assert spark.read.parquet(cache).count() == stored
    spark.read.parquet(cache).limit(3).write.mode("append").parquet(cache)  # as a repeated task might
    assert sorted(map(tuple, token_counts.count_tokens(odd, **how).collect()), key=str) == got
    assert token_counts.count_tokens(none, **how).count() == 0
    assert token_counts.count_tokens(documents, **how).count() == documents.count()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, encoding):
    library = Tokenizer.from_file(BYTE)
    layout = token_files.write_ids(odd, BYTE, scratch_path(spark, "ids"), encoding=encoding)
    want = sorted(((d, t or "") for d, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    at, rows = 0, []
    for d, t in want:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        rows.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.digests(spark, layout).collect()), key=lambda r: r[1]) == rows
    assert [r["doc_id"] for r in token_files.read_metadata(spark, layout).orderBy("start").collect()] == [d for d, _ in want]
    some = token_files.read_ids(spark, layout, 4, 5)
    assert sorted(r["doc_id"] for r in some.collect()) == [4, 4, 5]


def test_token_files_of_nothing(spark, none):
    layout = token_files.write_ids(none, BYTE, scratch_path(spark, "ids"))
    assert token_files.digests(spark, layout).count() == 0


# packing


def test_patterns_use_every_piece_and_fit():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5000):
        histogram = Counter(rng.integers(1, 2049, n).tolist())
        used = Counter()
        for pattern, count in packing.patterns(histogram, 2048):
            assert sum(pattern) <= 2048
            for length in pattern:
                used[length] += count
        assert used == histogram


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_packing_is_whole_and_tight(which, request):
    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(WORD)
    got = [r.asDict() for r in packing.pack(df, WORD).collect()]
    whole = [[*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in df.collect()]
    assert sum(r["length"] for r in got) == sum(map(len, whole))
    full = defaultdict(list)
    for r, ids in zip(df.collect(), whole):
        full[r["doc_id"]].append(np.array(ids, "<u4"))
    for r in got:
        assert any(zlib.crc32(f[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(f) == r["doc_tokens"] for f in full[r["doc_id"]])
    size, by = Counter(), defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, parts in by.items():
        for offset, length in sorted(parts):
            assert offset == size[s]
            size[s] += length
    assert max(size.values()) <= 2048
    if which == "documents":
        assert sum(size.values()) / (2048 * len(size)) > 0.95


def test_packing_of_nothing(none):
    assert packing.pack(none, WORD).count() == 0


# near duplicates


def brute_simhash(rows, shingle):
    out = []
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash_equals_all_pairs(which, request):
    rows = [(r["doc_id"], r["text"]) for r in request.getfixturevalue(which).collect()]
    prints = brute_simhash(rows, 4)
    ids = {d for d, _ in prints if d is not None}
    linked = [(a, b) for (a, x), (b, y) in combinations([p for p in prints if p[0] is not None], 2) if (x ^ y).bit_count() <= 4]
    label = reach(ids, linked)
    same = {x: label[d] for d, x in prints if d is not None}
    want = sorted(((d, f"{x:016x}", label[d] if d is not None else same.get(x)) for d, x in prints), key=str)
    got = sorted(map(tuple, simhash.near_duplicates(request.getfixturevalue(which), 4, 4).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("bucket_rows", [4, 2048])
def test_links_lose_nothing_in_crowded_buckets(spark, bucket_rows):
    rng = np.random.default_rng(bucket_rows)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    made = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(60)}
    made |= {int(x) for x in rng.integers(0, 2**63, 100, dtype=np.uint64)}
    prints = list(enumerate(sorted(made)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in prints], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df, 4, bucket_rows)).collect()}
    want = reach([i for i, _ in prints], [(a, b) for (a, x), (b, y) in combinations(prints, 2) if (x ^ y).bit_count() <= 4])
    assert {i: got.get(i, i) for i, _ in prints} == want


def test_thresholds_cover_the_distance():
    cost, chosen = simhash.allocate([[0, 5, 50, 500], [0, 1, 2, 3], [0, 5, 50, 500]], 2)
    assert sum(chosen) == 2 and cost == min(
        sum(c[t + 1] for c, t in zip([[0, 5, 50, 500], [0, 1, 2, 3], [0, 5, 50, 500]], ts))
        for ts in __import__("itertools").product(range(-1, 3), repeat=3) if sum(ts) == 2
    )


def test_similar_texts_and_clean_ones(spark):
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    rows, group = [], {}
    for k in range(30):
        base = words(int(rng.integers(150, 600)))
        for c in range(4):
            text = list(base)
            for at in rng.choice(len(text), c * len(text) // 200, replace=False):  # up to three words in 200
                text[at] = words(1)[0]
            group[len(rows)] = k
            rows.append((len(rows), " ".join(text)))
    for n in (1, 2, 3, 5, 8, 20, 40):
        for _ in range(20):
            group[len(rows)] = ("alone", len(rows))
            rows.append((len(rows), " ".join(words(n))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(df, group_rows=64).collect()}
    first = {}
    for d, k in sorted(group.items()):
        first.setdefault(k, d)
    right = sum(got[d] == first[k] for d, k in group.items())
    assert right >= 0.97 * len(rows)
    assert all(got[d] == d for d, k in group.items() if isinstance(k, tuple))


def test_similar_texts_edges(odd, none):
    got = simhash.similar_texts(odd).collect()
    assert len(got) == len(ODD) and sum(r["component_id"] is None for r in got) == 1
    label = {r["doc_id"]: r["component_id"] for r in got}
    assert label[1] == label[2] == label[3] == 1 and label[4] == label[5] == label[8] == 4
    assert simhash.similar_texts(none).count() == 0


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def families(rng, sizes, low, high):
    """Pairs of texts, shared in front, of a similarity from low to high: the second has other words at its end."""
    out = []
    for n in sizes:
        base = words_of(rng, n)
        for cut in range(n):
            other = base[: n - cut] + words_of(rng, cut)
            if low <= similarity(" ".join(base), " ".join(other)) < high:
                out.append((" ".join(base), " ".join(other)))
                break
    return out


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_similar_texts_finds_all_pairs_that_brute_force_finds(spark, group_rows):
    rng = np.random.default_rng(3)
    pairs = families(rng, [n for n in range(14, 41) for _ in range(8)], 0.8, 0.86) + families(rng, [100, 300, 900] * 20, 0.8, 0.86)
    assert len(pairs) > 150
    df = spark.createDataFrame([(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(df, group_rows=group_rows).collect()}
    assert got == {d: d - d % 2 for d in range(2 * len(pairs))}


def test_similar_texts_leaves_pairs_below_the_similarity(spark):
    rng = np.random.default_rng(4)
    pairs = families(rng, [100, 300, 900] * 20, 0.7, 0.79) + families(rng, [n for n in range(14, 41) for _ in range(4)], 0.6, 0.79)
    shared = words_of(rng, 150)
    rows = [t for p in pairs for t in p] + [" ".join(shared + words_of(rng, 45)) for _ in range(30)]  # one family, no two at 0.8
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in simhash.similar_texts(df).collect())


def test_quality_leaves_no_words_in_the_workers(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more of them", 10) for i in range(200)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == 200

    def held(batches):
        import pyarrow as pa

        from codestrata.llm import quality as loaded

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(loaded._BUCKETS)] * b.num_rows, pa.int64())], ["n"])

    assert {r["n"] for r in spark.range(64, numPartitions=16).mapInArrow(held, "n long").collect()} == {0}
