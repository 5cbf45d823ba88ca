"""Host rules, ball codes and the source audit: edge cases, method and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from codestrata.llm import ball_codes, host_rules, queries, source_audit
from codestrata.llm.shared import join_counted
from codestrata.session import stage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, term string, count string, kept string"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two\none two", "en", "a", 23),
    (4, "one two\none two", "en", "a", 23), (5, "one two\none two", None, "b", None), (None, "no id here at all", "en", "b", 3),
    (6, "long word " * 60000, "en", None, 600000), (7, "It's  I'LL\x0b\x1c é ß # 12345 <|x|>   漢字 İ", "fr", "b", 9),
    (8, "ONE Two", "en", "c", 23), (9, "one THREE", "en", "c", 1), (10, "", "de", "z", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_ball_codes", "op13_source_audit"])
def test_query_against_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


# ---- join of rows to facts of their keys

def test_join_counted_with_hot_rare_and_null_keys(spark):
    rows = stage(spark.range(5000).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3500, None).otherwise(F.col("id").cast("string")).alias("k")))
    facts = stage(rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"), F.sum("id").alias("s")))
    got = {r["id"]: r["s"] for r in join_counted(rows, facts, "k", ["s"]).collect()}
    sums = defaultdict(int)
    key = lambda i: "hot" if i < 3000 else None if i < 3500 else i
    for i in range(5000):
        sums[key(i)] += i
    assert got == {i: sums[key(i)] for i in range(5000)}


# ---- host rules

def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + o for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for o in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_facts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \x1c ", "a\x85b c é漢"]
    for _ in range(300):
        vocabulary = [rng.choice(["a", "bb", "é", "#x", "<|>"]) + str(rng.randint(0, 1)) for _ in range(rng.randint(1, 6))]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in host_rules.host_rules(docs).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_bad_host_takes_its_clean_documents_along(spark):
    good = " ".join(f"word{i} and" for i in range(30))
    rows = [(i, "spam" if i % 10 else good, "bad") for i in range(200)]
    rows += [(1000 + i, good if i % 10 else "short", f"host{i // 50}") for i in range(2000)]
    rows += [(5000, "short", "single"), (5001, good, None), (5002, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in host_rules.host_rules(docs).collect()}
    assert not any(got[i]["kept"] for i in range(200)) and all(got[i]["host_failed"] for i in range(200))
    assert all(got[1000 + i]["kept"] == bool(i % 10) for i in range(2000))
    # one failure tells little about a host: its rate is drawn to the others'
    assert not got[5000]["host_failed"] and got[5001]["kept"] and not got[5002]["kept"]
    facts = stage(host_rules.document_facts(docs, F.col("source")))
    rates = {r["host"]: r["rate_few_words"] for r in host_rules.host_verdicts(facts).collect()}
    assert 0.1 < rates["single"] < 0.75 and 0.85 < rates["bad"] < 0.9
    # without shrinking, hence with no prior, the single document would decide
    bare = host_rules.host_rules(docs.filter("source = 'single'"), host_rules.HostOptions(strength=0.0)).first()
    assert bare["host_failed"]


def test_prior_recovers_known_parameters(spark):
    rng = np.random.default_rng(3)
    hosts = [(f"h{i}", 400, int(rng.binomial(400, rng.beta(4, 12)))) for i in range(3000)]
    alpha, beta = host_rules.priors(spark.createDataFrame(hosts, "host string, _rows long, x long"), ["x"], 2.0)["x"]
    assert alpha == pytest.approx(4, rel=0.15) and beta == pytest.approx(12, rel=0.15)


def test_rules_of_odd_rows(odd, none):
    got = host_rules.host_rules(odd).collect()
    assert len(got) == len(ODD) and none.count() == 0 == host_rules.host_rules(none).count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[6]["n_repeat_words"] == by_id[6]["n_words"] == 120000
    assert by_id[7]["n_symbols"] == 5 and not by_id[1]["host_failed"]


# ---- ball codes

def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, _ in kept], dtype=object)
    size = x.shape[1] // parts
    codes, error, books = np.zeros((len(x), parts), int), np.zeros(len(x), object), []
    for p in range(parts):
        part = x[:, p * size : (p + 1) * size]
        book = [list(r) for r in part[:entries]]
        def assign():
            d = np.array([[sum((a - b) ** 2 for a, b in zip(r, e)) for e in book] for r in part], dtype=object)
            return [min(range(len(book)), key=lambda j: (row[j], j)) for row in d], d
        for _ in range(rounds):
            a, _d = assign()
            for e in range(len(book)):
                mine = [part[i] for i in range(len(part)) if a[i] == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        a, d = assign()
        codes[:, p] = a
        error += np.array([d[i][a[i]] for i in range(len(part))], dtype=object)
        books.append(book)
    sums = Counter()
    for (_, _, lab), e in zip(kept, error):
        sums[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        repr((kept[i][0], "".join(f"{c:02x}" for c in codes[i]), int(error[i]), int(sums[kept[i][2]]), digest)) for i in range(len(kept))
    )


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(420):
        v = rng.choice([-0.01, 0.0, 0.01, 0.25, -0.3], 8) if i % 3 else rng.normal(0, 0.3, 8)
        rows.append((i, [float(np.float32(c)) for c in v], [None, 1, 2][i % 3]))
    rows += [(7, rows[7][1], 1), (None, rows[9][1], None), (900, None, 1), (901, [0.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1),
             (903, [float("inf")] * 8, 1), (904, [0.0] * 8, 5), (905, [-0.0] * 8, 5)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    got = sorted(repr(tuple(r)) for r in ball_codes.ball_codes(df).collect())
    assert got == codes_by_hand(rows)


def test_ball_search_equals_full_search_and_skips_work(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (40, 6))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 6))).astype(float)
    book = np.concatenate([centres, centres[:5]]).astype(float)  # equal entries: the lower index wins
    want = ball_codes.full_search(x, book)
    assert (want < 40).all()
    for start in (want, rng.integers(0, len(book), len(x)), np.full(len(x), len(book) - 1)):
        assert (ball_codes.ball_search(x, book, start) == want).all()
    # with the right entries at hand and far clusters only equal entries are neighbours
    searched = []
    real = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": searched.append(len(a)) or real(a, v, side))
    ball_codes.ball_search(x, book, want)
    assert len(searched) > 2 and max(searched[1::2]) < 15


def test_codes_of_few_rows_other_lengths_and_nothing(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    assert ball_codes.ball_codes(make([])).count() == 0
    assert ball_codes.ball_codes(make([(1, None, 1), (2, [None] * 4, 1)])).count() == 0
    got = ball_codes.ball_codes(make([(1, [0.5] * 6, 1), (2, [0.25] * 6, 1), (3, [1.0], 1)])).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(1, "00000000", 0), (2, "01010100", 0)]  # the last part is filled up: all alike
    assert got[0]["codebooks_sha256"] == hashlib.sha256(",".join(["512", "512", "256", "256"] * 3).encode()).hexdigest()
    assert [tuple(r)[:3] for r in ball_codes.ball_codes(make([(5, [], None)])).collect()] == [(5, "00000000", 0)]
    with pytest.raises(Exception, match="scale"):
        ball_codes.ball_codes(make([(1, [3e38] * 4, 1)])).collect()


# ---- source audit

def audit_by_hand(rows, least=3, top=200):
    rows = [((t or ""), (lang or ""), (s or "")) for _, t, lang, s, *_ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, counts, sources = Counter(), defaultdict(Counter), sorted({r[2] for r in rows if r[1] == lang})
        for text, l, s in rows:
            if l == lang:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
                df.update(terms.keys())
                counts[s].update(terms)
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)
        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 1) // (n + v) for t in kept}
        p = {s: shares(counts[s]) for s in sources}
        q = shares(sum(counts.values(), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "The", "Öl", "öl", "naïve", "a", "b", "c", "d1e", "漢字", "zz"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 9]) for _ in range(rng.randint(0, 30))), rng.choice(["en", None, "fr"]), rng.choice(["a", "b", "c", None, "Ä"]))
            for i in range(150)]
    rows += [(i, "copied words the same everywhere", "en", rng.choice("abc")) for i in range(300)] + [(999, "", "only", "x"), (998, None, "only", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = audit_by_hand(rows)
    assert sorted(tuple(r) for r in source_audit.audit(docs).collect()) == want
    # the same with two terms a source, and where every step and every held sum is small
    assert sorted(tuple(r) for r in source_audit.audit(docs, top=2).collect()) == audit_by_hand(rows, top=2)
    monkeypatch.setattr(source_audit, "HELD", 5)
    monkeypatch.setattr(source_audit, "STEP", 7)
    assert sorted(tuple(r) for r in source_audit.audit(docs).collect()) == want


@pytest.mark.parametrize("entries, sent", [(1 << 20, 1 << 16), (0, 1), (40, 7)])
def test_terms_are_counted_whatever_a_task_holds(spark, monkeypatch, entries, sent):
    monkeypatch.setattr(source_audit, "ENTRIES", entries)
    monkeypatch.setattr(source_audit, "SENT", sent)
    rows = [("en", "a", "one Two two"), ("en", "b", "one Two two"), ("en", "b", "one Two two"), ("fr", "a", "two"), ("fr", "a", ""), ("en", "c", None), ("en", "a", "Öl one")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = {(r["lang"], r["source"], r["term"] and r["term"].decode()): (r["count"], r["docs"]) for r in source_audit.term_counts(docs).collect()}
    assert got == {
        ("en", "a", "one"): (2, 2), ("en", "a", "two"): (2, 1), ("en", "a", "Öl"): (1, 1), ("en", "b", "one"): (2, 2), ("en", "b", "two"): (4, 2),
        ("fr", "a", "two"): (1, 1), ("en", "a", None): (0, 2), ("en", "b", None): (0, 2), ("en", "c", None): (0, 1), ("fr", "a", None): (0, 2),
    }


def test_a_task_sends_a_term_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} every where {i}", "en", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, lang string, source string")
    plan = source_audit.term_counts(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    # no sums before the exchange, where the terms of a task have been summed already
    assert plan.index("partial_sum") < plan.index("REPARTITION_BY_COL") < plan.index("MapInArrow")


def test_copies_are_tokenized_once(spark):
    docs = spark.createDataFrame([(i, "same text here", "en", "ab"[i % 2]) for i in range(100)], "doc_id long, text string, lang string, source string")
    got = source_audit.collapsed(docs.coalesce(1)).collect()
    assert sum(r["text"] is not None for r in got) == 1 and sorted(r["n"] for r in got) == [0, 50, 50]


def test_audit_of_odd_rows(odd, none):
    assert sorted(tuple(r) for r in source_audit.audit(odd).collect()) == audit_by_hand(ODD)
    assert source_audit.audit(none).count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    rows = [(10**13 + 7, 10**14 + 9), (1, 3), (2 * 10**14, 2 * 10**14 + 1), (5, 10**14)]
    df = spark.createDataFrame(rows, "c long, n long").select("c", "n", source_audit.share(F.col("c"), F.col("n")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["n"] for r in df.collect())
