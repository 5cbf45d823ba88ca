"""The corpus pipeline stage by stage, and the registered queries with SQL."""

from collections import Counter

import numpy as np
import pytest
from compare import compare

import corpus_pipeline
from codestrata.llm import queries, simhash
from codestrata.llm.quality import quality
from codestrata.llm.shared import table
from codestrata.llm.simhash import fingerprint, similar_texts
from codestrata.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_stages_keep_what_they_should(spark):
    docs = table(spark, SF, "documents")
    given, columns = docs, tuple(docs.columns)
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test")
        stage(spark, given, SF).write.parquet(path)
        given = spark.read.parquet(path)
        kept.append(given)
    good, single, mixed, packed = kept
    assert tuple(good.columns) == tuple(single.columns) == tuple(mixed.columns) == columns
    accepted = {r["doc_id"] for r in quality(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    groups = {r["component_id"] for r in similar_texts(good, corpus_pipeline.SHINGLE).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(groups)
    assert {r["doc_id"] for r in mixed.collect()} == groups
    copies = Counter(r["doc_id"] for r in mixed.collect())
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
    size = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    assert tokens == Counter({d: copies[d] * size[d] for d in groups})


def test_near_copies_are_judged_by_row(spark):
    rows = [
        (None, "no id and these six words"), (None, "no id and these six words"), (None, "NO id and these six words"), (None, "a text of its own"),
        (5, "repeated row with one id and text"), (5, "repeated row with one id and text"),
        (1, "the text of the smallest id here"), (7, "the text of the smallest id here"), (7, "what only the seventh row has to say"),
        (9, "copy of a row without any id"), (None, "copy of a row without any id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect())
    assert got == Counter({
        (None, "no id and these six words"): 1, (None, "a text of its own"): 1, (5, "repeated row with one id and text"): 1,
        (1, "the text of the smallest id here"): 1, (7, "what only the seventh row has to say"): 1, (9, "copy of a row without any id"): 1,
    })


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bases = [["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)] for _ in range(20)]
    rows = [" ".join(t) for base in bases for t in (base, base[:-1] + ["x"])]
    near = [(fingerprint(a, corpus_pipeline.SHINGLE) ^ fingerprint(b, corpus_pipeline.SHINGLE)).bit_count() <= corpus_pipeline.DISTANCE
            for a, b in zip(rows[::2], rows[1::2])]
    assert any(near)
    # no two bands agree, so that fingerprints alone give the candidates
    monkeypatch.setattr(simhash, "band_keys", lambda distinct: np.random.default_rng().integers(0, 1 << 63, simhash.BANDS, np.uint64))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()}
    assert got == set(range(0, 40, 2)) | {2 * k + 1 for k, n in enumerate(near) if not n}


def test_stages_take_nulls_ties_empty_tables_and_any_column(spark):
    clash = ["row", "file", "at", "key", "tie", "doc", "copy", "_times", "_step", "_at", "_metadata"]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in clash)
    words = " ".join(f"word{i}" for i in range(3000))
    base = [
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (None, None, None, None),
        (2, "", "en", "b"), (None, "nothing like the rest of them here", "en", None), (3, words, "de", "b"), (4, words + " more", "de", "b"),
    ]
    docs = spark.createDataFrame([(i, t, l, s, len(t or ""), *clash) for i, t, l, s in base], schema)
    for _, step in corpus_pipeline.STAGES:
        got = step(spark, docs, SF)
        assert step(spark, docs.limit(0), SF).count() == 0
        if step is not corpus_pipeline.pack_sequences:
            assert got.columns == docs.columns
            assert {r["row"] for r in got.collect()} <= {"row"}
    single = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert Counter(r["doc_id"] for r in single.collect()) == Counter([1, 2, 3, None])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} == {(i, t) for i, t, _, _ in base}
    assert sum(r["doc_id"] == 1 for r in mixed.collect()) >= 2
