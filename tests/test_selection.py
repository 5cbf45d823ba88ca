"""Globs, ignore rules, limits, binary detection, memo and scans."""

import random
import re

import pytest

from codestrata.functions.globs import ignore_rule, path_glob, python_regex
from codestrata.operators import collect
from codestrata.operators.ordering import first_n, prefix
from codestrata.sources.memo import load_memo, save_memo
from codestrata.sources.scan import scan_files
from pyspark.sql import functions as F


@pytest.mark.parametrize("glob,path,expected", [
    ("*.go", "a.go", True), ("*.go", "d/a.go", False), ("**/*.go", "a.go", True), ("**/*.go", "x/y/a.go", True),
    ("src/**", "src/a/b", True), ("src/**/b", "src/b", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[a-c].x", "b.x", True), ("[^a-c].x", "b.x", False), ("*.{js,ts}", "a.ts", True), ("*.{js,ts}", "a.py", False),
    (r"\*.x", "*.x", True), (r"\*.x", "a.x", False), ("a.b", "axb", False),
])
def test_path_glob(glob, path, expected):
    assert bool(python_regex(path_glob(glob)).search(path)) is expected


@pytest.mark.parametrize("glob", ["[a", "{a", "a\\"])
def test_malformed_glob_matches_nothing(glob):
    assert path_glob(glob) is None


@pytest.mark.parametrize("pattern,path,is_dir,expected", [
    ("*.log", "a/b.log", False, True), ("*.log", "b.log/c", False, True), ("build/", "build", False, False),
    ("build/", "build", True, True), ("build/", "x/build/y", False, True), ("/a", "a", False, True), ("/a", "b/a", False, False),
    ("a/b", "a/b/c", False, True), ("a/b", "x/a/b", False, False), ("**/a/b", "x/a/b", False, True),
    ("**/a/b", "a/c/a/b", False, False), ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True),
    ("node_modules/**", "node_modules", True, True), ("**/*.pyc", "x/y.pyc", False, True), ("a/**b", "a/xb", False, False),
])
def test_ignore_rule(pattern, path, is_dir, expected):
    rule = ignore_rule(pattern)
    assert bool(python_regex(rule.on_dir if is_dir else rule.on_file).search(path)) is expected


def paths(df):
    return sorted(r.path for r in df.collect())


def test_negation_cannot_rescue_below_a_pruned_directory(files):
    df = files(("logs/keep.log", "x"), ("keep.log", "x"), ("b.log", "x"), ("logs2/keep.log", "x"))
    patterns = ["*.log", "logs/", "!keep.log"]
    assert paths(collect.exclude(df, patterns)) == ["keep.log", "logs/keep.log", "logs2/keep.log"]
    assert paths(collect.prune_dirs(collect.exclude(df, patterns), patterns)) == ["keep.log", "logs2/keep.log"]
    assert paths(collect.prune_dirs(df, ["*"])) == []


def test_repository_ignore_file_comes_last(files):
    df = files((".gitignore", "!a.pyc\n# c\n\n b.txt \n"), ("a.pyc", "x"), ("b.txt", "x"), ("c.txt", "x"))
    kept = paths(collect.exclude_by_repo(df, df, collect.default_excludes()))
    assert kept == [".gitignore", "a.pyc", "c.txt"]


_PATTERNS = [
    "a", "b/", "!a", "!b/", "*.go", "!*.go", "a*", "!a*/", "*", "!*", "/a", "/a/b", "a/b/", "!a/b", "//a//b", "/", "!", "!/", "**/b", "a/**/b",
    "?.go", "[ab]", "!a/*", "a/*.go", ".", ".*", "**", "a**b", "[", "[b-a]", r"\*", "*.tar.gz", "a.go", "!a.go", "x{a}", "*~", "b*a",
]
_PATHS = [
    "a", "b", "a.go", "a/b", "b/a", "a/b/a.go", "b/a/b/x.go", "x/a.go", "x/b/y", "aa/b", "x.tar.gz/a", "x/y.tar.gz", "*", "x{a}", "b~", "bxa/q", ".a/b",
    "axb/a", "x/y/z/b/a", "a/x/y/b/c",
]


def _hidden(patterns, common, path):
    """By the definition: every rule as a regular expression, the last one that fits decides."""

    def decision(rules_, text, on_dir):
        for r in reversed([ignore_rule(p) for p in rules_]):
            try:
                if python_regex(r.on_dir if on_dir else r.on_file).search(text):
                    return r.exclude
            except re.error:
                pass
        return None

    parts = path.split("/")
    places = [(".", True), (path, False), *(("/".join(parts[:n]), True) for n in range(1, len(parts)))]
    own = [decision(patterns, *place) for place in places]
    return any(decision(common, *place) if mine is None else mine for mine, place in zip(own, places))


def test_repository_rules_of_every_shape(spark):
    chance, common = random.Random(5), ["*.tar.gz", "y/", "!b~"]
    rules_ = {f"r{i}": chance.sample(_PATTERNS, chance.randint(1, 6)) for i in range(120)}
    rules_ |= {f"s{i}": [p] for i, p in enumerate(_PATTERNS)} | {"none": []}
    rows = [(repo, ".gitignore", "\n".join(own)) for repo, own in rules_.items() if own]
    ignore = spark.createDataFrame(rows, "repo string, path string, content string")
    places = spark.createDataFrame([(repo, path) for repo in rules_ for path in _PATHS], "repo string, path string")
    got = {(r.repo, r.path) for r in collect.exclude_by_repo(places, ignore, common).collect()}
    want = {(repo, path) for repo, own in rules_.items() for path in _PATHS if not _hidden(own, common, path)}
    assert got == want


def test_repository_rules_call_no_python_per_file(files):
    df = files((".gitignore", "a"), ("b", "x"))
    plan = collect.exclude_by_repo(df.select("repo", "path"), df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Join LeftOuter") < plan.index("ArrowEvalPython")


def test_prefix_matches_a_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("repo"),
        F.col("id").alias("path"), (F.col("id") * 7919 % 101).alias("size"),
    )
    got = {(r.repo, r.path): (r.rank, r.running) for r in prefix(df, ["repo"], ["size", "path"], F.col("size")).collect()}
    want, state = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.repo, r["size"], r.path)):
        n, total = state.get(r.repo, (0, 0))
        state[r.repo] = (n + 1, total + r["size"])
        want[(r.repo, r.path)] = state[r.repo]
    assert got == want


def test_first_n_beyond_the_window_limit(spark):
    df = spark.range(3000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"))
    got = first_n(df, ["repo"], [F.col("path")], 1500)
    assert got.count() == 1500
    assert [r.path for r in got.orderBy("rank").limit(3).collect()] == ["0", "1", "10"]


def test_budget(spark):
    rows = [("r", f"p{i}", s) for i, s in enumerate([50, 10, 30, 20, 40])] + [("q", "a", 60)]
    df = spark.createDataFrame(rows, "repo string, path string, size long")
    got = sorted((r.repo, r["size"]) for r in collect.fit_budget(df, 70).collect())
    assert got == [("q", 60), ("r", 10), ("r", 20), ("r", 30)]
    assert collect.fit_budget(df, 0).count() == 6


@pytest.mark.parametrize("budget", [1, 70, 5000, 123_456, 10**7])
def test_budget_by_brute_force(spark, budget):
    chance = random.Random(budget)
    kinds = {"small": 5, "same": 1, "wide": 10**6, "zero": 0, "huge": 10**12}
    rows = [(repo, f"d{i % 7}/f{i}", chance.randint(min(top, 1), top)) for repo, top in kinds.items() for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, path string, size long")
    want = []
    for repo in kinds:
        room = budget
        for size, path in sorted((r[2], r[1]) for r in rows if r[0] == repo):
            room -= size
            if room >= 0:
                want.append((repo, path, size))
    assert sorted(tuple(r) for r in collect.fit_budget(df, budget).collect()) == sorted(want)


def test_binary(files):
    df = files(
        ("a.bin", "text"), ("a.js", "\x00"), ("a.json", "{}"), ("b.json", "\x01"), ("c", ""), ("d", "<HTML >"), ("e", "<a>"),
        ("f", "<abbr>"), ("g", "plain"), ("h", "  <?xml"), ("i", "GIF89a"), ("j", "x" * 600 + "\x00"), ("k", "tab\tesc\x1b"),
    )
    got = {r.path: r.is_binary for r in collect.classify_binary(df).collect()}
    assert [p for p, b in sorted(got.items()) if b] == ["a.bin", "b.json", "c", "d", "e", "h", "i"]


def test_memo_is_used(files, tmp_path):
    df = files(("a", "plain"), ("b", "plain")).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    spark, where = df.sparkSession, str(tmp_path / "memo")
    assert load_memo(spark, where).count() == 0
    wrong = collect.classify_binary(df.filter("path = 'a'")).withColumn("is_binary", F.lit(True))
    save_memo(wrong, where)
    everything, fresh = collect.classify_incremental(df, load_memo(spark, where))
    assert {r.path: r.is_binary for r in everything.collect()} == {"a": True, "b": False}
    assert paths(fresh) == ["b"]
    save_memo(wrong, where)
    again, _ = collect.classify_incremental(df, load_memo(spark, where))
    assert again.count() == 2


@pytest.mark.parametrize("shuffle", [4, 200])
def test_memo_rows_are_not_moved(files, tmp_path, shuffle):
    df = files(*((f"f{i}", "plain") for i in range(200))).withColumn("mtime", F.timestamp_seconds(F.crc32("path")))
    spark, where = df.sparkSession, str(tmp_path / "it's a memo")
    save_memo(collect.classify_binary(df.filter("path < 'f5'")), where)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        memo = load_memo(spark, where)
        everything, fresh = collect.classify_incremental(df, memo)
        for found in (memo, fresh):
            plan = found._jdf.queryExecution().executedPlan().toString()
            moved = plan.count("Exchange hashpartitioning")
            assert moved == (found is fresh), plan
        kept = sorted(r.path for r in fresh.collect())
        save_memo(fresh, where)
        # a frame loaded before keeps its files
        assert sorted(r.path for r in fresh.collect()) == kept == sorted(f"f{i}" for i in range(200) if f"f{i}" >= "f5")
        assert load_memo(spark, where).count() == everything.count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text,size", [("0", 0), ("10MB", 10 * 2**20), ("1k", 1024), (" 2 GB ", 2 * 2**30), ("7", 7)])
def test_parse_size(text, size):
    assert collect.parse_size(text) == size


def test_parse_size_rejects_units():
    with pytest.raises(ValueError):
        collect.parse_size("5XB")


def test_scan_files(spark, tmp_path):
    for name, text in {"p1/src/a.go": "x\n", "p1/b": "y", "p2/c.txt": "é"}.items():
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    got = sorted((r.repo, r.path, r["size"], r.content) for r in scan_files(spark, str(tmp_path / "tree")).collect())
    assert got == [("p1", "b", 1, "y"), ("p1", "src/a.go", 2, "x\n"), ("p2", "c.txt", 2, "é")]
    hidden = ["p1/.gitignore", "p1/.env", "p1/.github/workflows/ci.yml", "p1/pkg/__init__.py", "p1/_x/empty", "p1/a b#1%.txt"]
    for name in hidden:
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("" if name.endswith("empty") else "z")
    (tmp_path / "tree" / "p1" / ".env").chmod(0o640)
    rows = {f"{r.repo}/{r.path}": r for r in scan_files(spark, str(tmp_path / "tree")).collect()}
    assert set(rows) == {*hidden, "p1/b", "p1/src/a.go", "p2/c.txt"} and rows["p1/_x/empty"].content == ""
    assert rows["p1/.env"].mode == 0o640 and all(r.error is None for r in rows.values())
    assert sorted(r.path for r in scan_files(spark, str(tmp_path / "tree"), repo="x").collect()) == sorted(
        [*hidden, "p1/b", "p1/src/a.go", "p2/c.txt"]
    )


@pytest.mark.parametrize("head,binary", [
    (b"\x20\x20\x20\x18ftypmp42\x20\x20\x20\x20mp41isom", False), (b"1234ftyp is only text", False), (b"ID3 tag", True),
    (b"FORM1234AIFF", True), (b"FORM1234ILBM", False), (b"RIFF1234WAVE", True),
])
def test_signatures(files, head, binary):
    rows = collect.classify_binary(files(("a.unknown", head.decode("latin-1")))).collect()
    assert rows[0].is_binary == (binary or any(c < 32 and c not in b"\t\n\r\x0c\x1b" for c in head))


def test_large_project_gate_at_its_limits(spark):
    """Each condition alone, just below and just above its limit."""
    cases = {
        "bytes": (1, 500 * 2**20 + 1, True), "bytes-": (1, 500 * 2**20, False),
        "files": (10_001, 1, True), "files-": (10_000, 1, False),
        "mean": (5_001, 50 * 2**10 + 1, True), "mean-": (5_001, 50 * 2**10, False), "mean+": (5_000, 50 * 2**10 + 1, False),
    }
    rows = spark.createDataFrame([(r, n, size) for r, (n, size, _) in cases.items()], "repo string, n int, size long")
    files = rows.select("repo", "size", F.explode(F.sequence(F.lit(1), "n")))
    got = {r.repo: r.is_large for r in collect.is_large_project(files).collect()}
    assert got == {r: large for r, (*_, large) in cases.items()}


def test_a_large_table_in_one_file_is_rendered_by_many_tasks(spark, tmp_path, monkeypatch):
    from codestrata.plans import corpora

    where = str(tmp_path / "orders.parquet")
    spark.range(1000).coalesce(1).write.parquet(where)
    table = spark.read.parquet(where)
    assert corpora.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(corpora, "TASK_ROWS", 100)
    assert corpora.spread(table).rdd.getNumPartitions() == 10 and corpora.spread(table).count() == 1000


def test_choices_by_halves_are_the_case(spark):
    from codestrata.plans import corpora

    keys = "cast(nullif(id - 2, 9) as bigint)"
    for default in (None, "'other'"):
        text = corpora._choice(f"({keys})", [f"'v{i}'" for i in range(7)], default)
        halved = corpora._HALVED.pop(text)
        assert spark.range(14).filter(f"not (({text}) <=> ({halved}))").count() == 0
