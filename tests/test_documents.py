"""Manifests, advisories, symbols, trees, reports, batches, chunks, changes."""

import json
import random
from functools import reduce

import numpy as np
import pytest

from codestrata.operators import advisories, batches, changes, dependencies, lint, report, symbols, technology, tree
from codestrata.streaming import chunks
from pyspark.sql import functions as F


def deps_of(df):
    return {(r.name, r.version, r.type, r.direct) for r in dependencies.dependencies(df).collect()}


def test_manifests(files):
    assert deps_of(files(
        ("package.json", '{"dependencies": {"a": "1", "b": 2}, "peerDependencies": {"p": "3"}}'),
        ("go.mod", "require (\n\tx v1 // indirect\n)\nrequire y v2\nz v3\n"),
        ("requirements.txt", "-r base.txt\nname[x]>=1 # c\n"),
        ("Cargo.toml", "[dependencies]\nq = \"1\"\n[dependencies.x]\nn = 1\n[build-dependencies]\nb = '2'\n"),
        ("Gemfile", "gem 'rails', '7', group: :test\ngem \"rack\"\n"),
        ("composer.json", '{"require": {"php": "8", "m": "1"}, "require-dev": {"php": "8"}}'),
        ("sub/go.mod", "require ignored v1"), 
    )) == {
        ("a", "1", "production", True), ("p", "3", "peer", True), ("x", "v1", "development", False),
        ("y", "v2", "production", True), ("-r", " base.txt", "production", True), ("name", "[x]>=1 # c", "production", True),
        ("q", "1", "production", True), ("b", "2", "development", True), ("rails", "7", "development", True),
        ("rack", "", "production", True), ("m", "1", "production", True), ("php", "8", "development", True),
    }


def test_broken_json_gives_nothing(files):
    assert deps_of(files(("package.json", '{"dependencies": {"a": "1"'))) == set()
    assert deps_of(files(("package.json", '{"dependencies": ["a"]}'))) == set()


def test_advisories(spark, files, tmp_path):
    df = files(("package.json", json.dumps({"dependencies": {
        "lodash": "^4.17.15", "axios": "0.19.0", "jquery": "2.1.4", "django": "==2.2.0", "request": "1-beta", "own": "9.1"}})))
    feed = tmp_path / "feed.json"
    feed.write_text(json.dumps({"own": [{"version": "9", "severity": "critical", "description": "bad"}]}, indent=1))
    deps = dependencies.dependencies(df)
    known = advisories.load_advisories(spark, str(feed))
    got = {(r.name, r.stage, r.severity) for r in advisories.check_dependencies(deps, known).collect()}
    assert got == {
        ("lodash", 1, "high"), ("own", 1, "critical"), ("axios", 2, "medium"), ("request", 3, "low"), ("request", 4, "medium"),
    }
    summary = advisories.vuln_summary(advisories.check_dependencies(deps, known), advisories.outdated(deps))
    top = [r.text for r in summary.filter("section = 'top'").orderBy("rank").collect()]
    assert top[0] == "own@9.1 [critical]\n    bad\n    Fix: " and top[1].startswith("lodash@^4.17.15 [high]\n") and "\n    CVE: CVE-" in top[1]
    strict = advisories.match_advisories(deps, known, strict=True)
    assert {r.name for r in strict.collect()} == {"lodash", "own", "django"}


def test_technologies(files):
    df = files(
        ("package.json", '{"dependencies": {"react": "^1", "express": "^4"}, "devDependencies": {"react": "2", "jest": 1}}'),
        ("Dockerfile", ""), (".dockerignore", ""), ("a_test.go", "github.com/labstack/echo"),
    )
    got = {r.name: (r.version, r.confidence) for r in technology.detect_all(df).collect()}
    assert got == {
        "React": ("2", 1.0), "Express": ("4", 0.9), "Echo": ("", 0.9), "Jest": ("", 1.0), "Go Testing": ("", 1.0),
        "Docker": ("", 1.0), "Go": ("", 0.25),
    }


GO = '''// Package p does things.
package p

import (
	"fmt"
	alias "os/exec"
)

import "single"

// Max is a limit.
const Max = 1

const (
	First, second = 1, 2
	Third         = 3
)

var hidden = 1
var Shown, Other int

// Shape is
// a shape.
type Shape struct {
	Name string
}

type Reader interface {
	Read() error
}

type (
	ID   int
	List []string
)

// Start runs.
func (s *Server) Start(a, b int, names []string) (string, error) {
	return "", nil
}

func Plain() {}
func small() {}
func Wait(c chan int, args ...string) map[string]int {
func Walk(f func(int) error) error {
'''


def test_go_symbols(files):
    df = files(("a.go", GO))
    got = [(r.kind, r.name, r.signature, r.doc) for r in symbols.go_symbols(df).orderBy("pos").collect()]
    assert got == [
        ("const", "Max", "const Max", "Max is a limit.\n"), ("const", "First", "const First", ""), ("const", "Third", "const Third", ""),
        ("var", "Shown", "var Shown", ""), ("var", "Other", "var Other", ""),
        ("type", "Shape", "type Shape struct", "Shape is\na shape.\n"), ("interface", "Reader", "type Reader interface", ""),
        ("type", "ID", "type ID", ""), ("type", "List", "type List", ""),
        ("function", "Start", "func s *Server Start(a int, b int, names []string) string, error", "Start runs.\n"),
        ("function", "Plain", "func Plain()", ""), ("function", "Wait", "func Wait(c ..., args ...) map[string]int", ""),
        ("function", "Walk", "func Walk(f func) error", ""),
    ]
    assert [r.target for r in symbols.imports(df).orderBy("pos").collect()] == ["fmt", "os/exec", "single"]
    assert symbols.summarize(df).first().doc == "Package p does things.\n"


GO_NESTED = """/*
Package q holds

   things.	

*/
package q

/* Stack is generic. */
//go:generate stringer
type Stack[K comparable, V map[K][]int] struct {
	Field []V
}

type (
	/*
	Lost = int
	*/
	Set[T any] interface {
		Has(T) bool
	}
	Pair [2]int
	Alias = interface{ M() }
)

//
// Push adds
//
//
// values.
//go:noinline
func (s *Stack[K, V]) Push(f func(a int, b ...string) (x, y int), m map[[2]string][]V, c chan<- func() error) (out []func(int) bool, err error) {
	return nil, nil
}

func Build[T any, L ~[]T](
	items L, // the list
	each func(T) func() error,
	opts ...Option[T],
) *Set[T] {
	return nil
}
/*
func Hidden() {}
*/

func Last(x interface{ M(int) string }, s struct{ A, B int }, any2 any, n [3]*pkg.T) func(int) chan int { return f(func() {}) }
func (Set[T]) Chan(<-chan chan int, map[string]chan struct{}) map[string]func(a []int) (int, error) {
func Deep(f func(g func(h func(i []map[string]Box[int]) [2]int) error) (func(), error)) []*Box[Box[int]] {
func External(a, _ int, b *(T)) (n int)
"""


def test_go_symbols_with_nested_types(files):
    df = files(("a.go", GO_NESTED))
    got = [(r.kind, r.name, r.signature, r.doc) for r in symbols.go_symbols(df).orderBy("pos").collect()]
    assert got == [
        ("type", "Stack", "type Stack struct", " Stack is generic.\n"),
        ("interface", "Set", "type Set interface", ""), ("type", "Pair", "type Pair", ""), ("interface", "Alias", "type Alias interface", ""),
        ("function", "Push", "func s *... Push(f func, m map[[]string][]V, c ...) out []func, err error", "Push adds\n\nvalues.\n"),
        ("function", "Build", "func Build(items L, each func, opts ...) *...", ""),
        ("function", "Last", "func Last(x interface{}, s ..., any2 any, n []*pkg.T) func", ""),
        ("function", "Chan", "func ... Chan(..., map[string]...) map[string]func", ""),
        ("function", "Deep", "func Deep(f func) []*...", ""),
        ("function", "External", "func External(a int, _ int, b *...) n int", ""),
    ]
    assert symbols.summarize(df).first().doc == "Package q holds\n\n   things.\n"


def test_c_functions(files):
    body = (
        "int\nmain (int argc) {\nif (x) {\nstatic char *name(void);\nfoo(1);\nvoid\nrun(int a);\n"
        "words and words\nmore words\nint f(a)\n  ;\nstruct node { struct node *next; };\n"
    )
    got = [(r.kind, r.name) for r in symbols.c_symbols(files(("a.c", body))).orderBy("pos").collect()]
    assert got == [("function", "main"), ("function", "run"), ("function", "f"), ("struct", "node"), ("struct", "node")]


def test_python_docstring_and_short_files(files):
    df = files(("a.py", '"""Doc text."""\nfrom a.b import c\nimport d\n  def no(): pass\ndef yes(a, b):\n'))
    assert symbols.summarize(df).first().doc == "Doc text."
    assert [r.signature for r in symbols.py_symbols(df).collect()] == ["def yes(a, b)"]
    assert [r.target for r in symbols.imports(df).collect()] == ["a.b"]


PATHS = ["b.txt", "a/x.go", "a/b/c.go", "a/b/d.go", "a-b/e.go", "z/q\"uote.md"]


def test_tree_text(files):
    df = files(*[(p, "x") for p in PATHS])
    lines = [r.text for r in tree.tree_text(tree.tree_nodes(df)).orderBy("line_no").collect()]
    assert lines == [
        "└── r/", "    ├── b.txt", "    ├── a/", "    │   ├── x.go", "    │   └── b/", "    │       ├── c.go", "    │       └── d.go",
        "    ├── a-b/", "    │   └── e.go", "    └── z/", "        └── q\"uote.md",
    ]


def test_tree_json_is_the_nested_document(files):
    df = files(*[(p, "x") for p in PATHS])
    text = "\n".join(r.text for r in tree.tree_json(tree.tree_nodes(df)).orderBy("line_no").collect())

    def leaf(name, files_, **dirs):
        return {"Name": name, "SubDirs": dirs, "Files": files_}

    assert json.loads(text) == {
        "Name": "r", "Files": ["b.txt"], "SubDirs": {
            "a": leaf("a", ["x.go"], b=leaf("b", ["c.go", "d.go"])), "a-b": leaf("a-b", ["e.go"]), "z": leaf("z", ['q"uote.md']),
        },
    }


def test_edges_are_nodes_minus_one(files):
    nodes = tree.tree_nodes(files(*[(p, "x") for p in PATHS]))
    edges = tree.tree_edges(nodes)
    assert edges.filter("parent_id is not null").count() == nodes.count() - 1
    assert tree.tree_counts(nodes).first().edge_count == nodes.count() - 1


def next_fit(sizes, budget, large=10**18):
    held, batch, out = 0, 0, []
    for s in sizes:
        if held + s > budget and held > 0:
            held, batch = 0, batch + 1
        if s <= large:
            held += s
        out.append(batch)
    return out


def next_fit_from(sizes, budget, large, held):
    flushes = 0
    for s in sizes:
        if held + s > budget and held > 0:
            held, flushes = 0, flushes + 1
        if s <= large:
            held += s
    return held, flushes


@pytest.mark.parametrize("seed", range(4))
def test_batch_pieces_compose(seed):
    """Pieces of any size give what one sequential pass gives."""
    rng = random.Random(seed)
    for _ in range(60):
        budget, large = rng.choice([1, 5, 20, 10**9]), rng.choice([None, 10, 10**8])
        sizes = [rng.choice([0, 1, 3, rng.randrange(30), 200 * 2**20]) for _ in range(rng.randrange(1, 40))]
        cuts = sorted(rng.sample(range(1, len(sizes)), min(len(sizes) - 1, rng.randrange(0, 6))))
        bounds = list(zip([0, *cuts], [*cuts, len(sizes)]))
        pieces = [np.array(sizes[a:b]) for a, b in bounds]
        maps = [batches.steps_of(p, budget, large) for p in pieces]
        # what lies in front of a piece is one map, however it was put together
        got = []
        for n, piece in enumerate(pieces):
            some = maps[:n]
            while len(some) > 1:
                k = rng.randrange(len(some) - 1)
                some[k : k + 2] = [some[k].then(some[k + 1])]
            (held,), (batch,) = some[0].apply(np.array([0])) if some else ((0,), (0,))
            got += batches.assign(piece, int(held), int(batch), budget, large)[0]
        # and a map holds for every received buffer
        whole = reduce(batches.Steps.then, maps)
        for held in {0, 1, 2, 7, budget, budget + 1, 10**9}:
            after, flushes = (int(x[0]) for x in whole.apply(np.array([held])))
            walked = next_fit_from(sizes, budget, large or 10**18, held)
            assert (after, flushes) == walked, (sizes, budget, large, held)
        assert got == next_fit(sizes, budget, large or 10**18), (sizes, budget, large, bounds)


def test_batches_run(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "cold", f"{i:04}", rng.randrange(100)) for i in range(2000)]
    got = batches.pack_batches(spark.createDataFrame(rows, "repo string, path string, size long"), 500).collect()
    for repo in ("hot", "cold"):
        mine = sorted((r.path, r["size"], r.batch_id) for r in got if r.repo == repo)
        assert [b for _, _, b in mine] == next_fit([s for _, s, _ in mine], 500)
    some = batches.pack_batches(spark.createDataFrame(rows, "repo string, path string, size long"), 500, large=50).collect()
    for repo in ("hot", "cold"):
        mine = sorted((r.path, r["size"], r.batch_id, r.direct) for r in some if r.repo == repo)
        assert [b for _, _, b, _ in mine] == next_fit([s for _, s, _, _ in mine], 500, 50)
        assert [d for *_, d in mine] == [s > 50 for _, s, *_ in mine] and any(d for *_, d in mine)


def test_feed_in_pieces_of_any_size(spark, tmp_path):
    """However small the ranges, the feed is what one parser reads."""
    feed = {
        "plain": [{"version": "1", "severity": "low", "description": "d"}],
        'quo"te\\\\': [{"version": "{[,", "description": 'a "b", {c} \\\\', "cve_id": "]}"}, {"version": "é漢"}],
        "none": [], "\\\\\\": [{"version": "\\\\\\\\", "recommendation": "\\\\n,"}],
    }
    path = tmp_path / "feed.json"
    names = ("version", "severity", "cve_id", "description", "recommendation")
    want = sorted((k, *[x.get(n, "") for n in names]) for k, items in feed.items() for x in items)
    for indent in (None, 1):
        path.write_text("  " + json.dumps(feed, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
        for split in (1, 3, 17, 10**6):
            got = advisories.feed_advisories(spark, str(path), split)
            assert sorted(tuple(r) for r in got.collect()) == want, (indent, split)
    # of a package listed twice the last list counts, as a map keeps one value
    path.write_text('{"a": [{"version": "1"}], "b": [], "a": [{"version": "2"}, {"version": "3"}]}')
    assert sorted(r.version for r in advisories.feed_advisories(spark, str(path), 5).collect()) == ["2", "3"]
    for text in ("{}", "", "[]", '{"a": [{"version": "1"}]', '{"a": [{"version": "1"}], "b": 5, }', '{"a": [{"version": "1"}], "b: []}', '[{"a": []}]'):
        path.write_text(text)
        assert advisories.feed_advisories(spark, str(path), 4).count() == 0, text


def test_batches_of_many_levels(spark, monkeypatch):
    """Pieces of four files, two at a time: the tree of maps has many levels."""
    monkeypatch.setattr(batches, "PIECE_BITS", 2)
    monkeypatch.setattr(batches, "FAN", 2)
    rng = random.Random(2)
    rows = [("hot" if i % 4 else "cold", f"{i:04}", rng.choice([0, 1, 30, 400, rng.randrange(90)])) for i in range(300)]
    got = batches.pack_batches(spark.createDataFrame(rows, "repo string, path string, size long"), 300, large=350).collect()
    for repo in ("hot", "cold"):
        mine = sorted((r.path, r["size"], r.batch_id) for r in got if r.repo == repo)
        assert [b for _, _, b in mine] == next_fit([s for _, s, _ in mine], 300, 350)
    assert batches.pack_batches(spark.createDataFrame([], "repo string, path string, size long"), 300).count() == 0


def test_prompt_document(files, tmp_path):
    df = files(("a.txt", "one\ntwo"), ("d/b.txt", "three"), ("e.txt", ""))
    rows = report.prompt_text(df).orderBy(*report.PROMPT_ORDER).collect()
    bar, rule = "=" * 48, "-" * 53
    assert "".join(r.text + "\n" for r in rows) == (
        f"\nPROJECT STRUCTURE:\n{rule}\n\n└── r/\n    ├── a.txt\n    ├── e.txt\n    └── d/\n        └── b.txt\n"
        f"\nFILE CONTENTS:\n{rule}\n\n{bar}\nFile: a.txt\n{bar}\none\ntwo\n\n{bar}\nFile: d/b.txt\n{bar}\nthree\n"
    )


def test_report_parts_hold_everything(files):
    rows = report.project_report(files(*[(f"f{i}.go", "x") for i in range(25)]))
    parts = report.render_report(rows, "json", part_rows=10).collect()
    docs = [json.loads(r.document) for r in parts]
    assert sum(len(d.get("files", [])) for d in docs) == 25 and len(parts) > 1
    assert "<report>" in report.render_report(rows, "xml").first().document


@pytest.mark.parametrize("size,expected", [(1, 3), (2, 2), (3, 1), (4, 1)])
def test_chunks_rebuild_the_file(files, size, expected):
    rows = chunks.chunk_files(files(("a", "abc"), ("empty", "")), size).orderBy("path", "chunk_no").collect()
    mine = [r for r in rows if r.path == "a"]
    assert len(mine) == expected and b"".join(bytes(r.data) for r in mine) == b"abc"
    assert [(r.offset, r.total, bytes(r.data)) for r in rows if r.path == "empty"] == [(0, 0, b"")]


def test_stream_picks_up_new_files(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "repo string, path string, content string"
    for i, text in enumerate(["abcd", "xy"]):
        spark.createDataFrame([("r", f"p{i}", text)], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        chunks.stream_chunks(stream, out, check, 3).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_changes(spark):
    status = spark.createDataFrame(
        [("r", "a", "added", "modified"), ("r", "b", "unmodified", "deleted"), ("r", "c", "untracked", "untracked"), ("r", "d", "renamed", "x")],
        "repo string, path string, staging string, worktree string",
    )
    assert {(r.path, r.change_type, r.is_staged) for r in changes.classify_changes(status).collect()} == {
        ("a", "added", True), ("b", "deleted", False), ("c", "added", False),
    }
    trees = spark.createDataFrame(
        [("r", 1, "a", "1"), ("r", 1, "b", "1"), ("r", 2, "a", "2"), ("r", 2, "b", "1"), ("r", 3, "a", "2"), ("r", 3, "c", "1")],
        "repo string, commit_seq long, path string, blob string",
    )
    commits = trees.select("repo", "commit_seq").distinct()

    def recent(n):
        return sorted(r.path for r in changes.recent_changes(commits, trees, n).collect())

    assert recent(1) == recent(0) == ["a", "c"]
    assert recent(2) == ["a", "b", "c"]
    assert recent(9) == ["a", "b", "c"]


def test_lint(files):
    df = files(("a.js", "console.log(1)\nvar x\n var y // no\n let var z\ndebugger\n"), ("a.jsx", "debugger"), ("b.go", "// if x\n//if\n"), ("c.py", " print(1)"))
    got = sorted((r.path, r.line, r.rule) for r in lint.lint(df).collect())
    assert got == [
        ("a.js", 1, "no-console"), ("a.js", 4, "no-var"), ("a.js", 5, "no-debugger"), ("b.go", 1, "no-commented-code"), ("c.py", 1, "use-logging"),
    ]


def test_repository_urls(spark):
    rows = ["https://github.com/a/b.git", "git@github.com:a/b", "github.com/a/b", "x", ""]
    got = [(r.owner, r.name, r.is_valid) for r in changes.parse_repo_urls(spark.createDataFrame([(u,) for u in rows], "url string")).collect()]
    assert got == [("a", "b", True), ("a", "b", True), ("a", "b", False), ("", "", False), ("", "", False)]


def test_tree_text_sends_no_table_of_paths_whole(spark, tmp_path):
    from codestrata.operators import tree

    files = spark.createDataFrame([("r", f"d{i % 3}/s{i % 5}/f{i}") for i in range(40)], "repo string, path string")
    plan = tree.tree_text(tree.tree_nodes(files))._jdf.queryExecution().sparkPlan().toString()
    # the offsets of a rank alone are small
    assert plan.count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in plan


def test_a_feed_is_written_and_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from codestrata.plans import dependency_plans
    from codestrata.sources.json_object import json_entries

    docs = [(i, f'text "{i}" ' * 50, "en", "s", 0) for i in range(40)] + [(39, "again", "en", "t", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(dependency_plans, "FEED_ENTRIES", 1000, raising=False)
    whole = sorted(map(str, dependency_plans._feed(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(dependency_plans, "FEED_ENTRIES", 10, raising=False)
    assert sorted(map(str, dependency_plans._feed(spark, str(tmp_path)).collect())) == whole and len(whole) == 41
    path = tmp_path / "feed.json"
    path.write_text("{" + ",".join(f'"p{i}": []' for i in range(500)) + "}")
    entries, _ = json_entries(spark, str(path), 64)
    assert entries.count() == 500 and entries.rdd.getNumPartitions() > 8


def test_go_signatures_are_computed_once():
    from codestrata.operators import symbols

    text = str(symbols._go_flat(F.col("signature")))
    assert text.count("signature") == 1
