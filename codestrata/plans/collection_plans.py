"""Collection queries."""

from codestrata.operators import collect
from codestrata.operators.collect import CollectOptions
from codestrata.plans.corpora import duck, load
from codestrata.session import scratch_path
from codestrata.sources.memo import load_memo, save_memo
from codestrata.sources.scan import scan_chunks, scan_files, walk_positions, write_tree
from pyspark.sql import functions as F

_INV = duck("inv")
_META = ["repo", "path", "size"]

INCLUDE = ["**/*.go", "d1/*.js", "**/s?/**/*.{c,cpp,h}", "README.md", "d[0-3]/f1*"]
EXCLUDE = ["*.log", "d3/", "/d4/s1", "!keep.log", "d5/**/f*.go", "vendor/", "*.r[bs]", "!f1*.rb", "!/d3/f3*"]
#: Limits of the large-project gate (bytes, files, some files, mean bytes) between the repositories of the corpus.
GATE = (65_000_000, 300, 200, 250_000)
OPTIONS = CollectOptions(
    include=("**/*.*",), exclude=("*.sql",), min_size=20_000, max_size=450_000,
    max_files=60, max_total_size=5_000_000,
)


def _meta(op, *args):
    return lambda s, d: op(load(s, d, "inv"), *args).select(*_META)


def _incremental(spark, sf):
    """Half of the files come from a memo saved beforehand, half are fresh."""
    files = load(spark, sf, "inv")
    location = scratch_path(spark, "memo")
    earlier = collect.classify_binary(files.filter(F.col("size") % 2 == 0))
    save_memo(earlier, location)
    everything, fresh = collect.classify_incremental(files, load_memo(spark, location))
    save_memo(fresh, location)
    return load_memo(spark, location).select("repo", "path", "size", "is_binary")


# hidden, underscore and empty files, folders and odd names
_TREE = {
    "repo": "source",
    "path": "concat(lang, case doc_id % 4 when 0 then '/.github/' when 1 then '/_private/' else '/a b#1%/' end, "
    "case doc_id % 5 when 0 then '.e' when 1 then '__' else 'f' end, doc_id, '.txt')",
    "content": "case doc_id % 7 when 0 then '' else text end",
}


def _tree(spark, sf):
    """A tree in the shared folder, written from the documents."""
    root = scratch_path(spark, "tree").removeprefix("file://").removeprefix("file:")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_tree(docs.selectExpr(*[f"{text} as {name}" for name, text in _TREE.items()]), root)
    return root


def _scan_tree(spark, sf):
    return scan_files(spark, _tree(spark, sf)).select("repo", "path", "size", F.md5(F.col("content").cast("binary")).alias("digest"), "error")


def _scan_tree_chunks(spark, sf):
    chunks = scan_chunks(spark, _tree(spark, sf), 4096)
    return chunks.select("repo", "path", "chunk_no", "offset", "total", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("digest"))


QUERIES = {
    "scan_tree": _scan_tree,
    "scan_tree_chunks": _scan_tree_chunks,
    "scan_walk_order": lambda s, d: walk_positions(load(s, d, "docs")).select("repo", "path", "size", "position"),
    "include": _meta(collect.include, INCLUDE),
    "exclude": _meta(collect.exclude, EXCLUDE),
    "prune_dirs": _meta(collect.prune_dirs, EXCLUDE),
    "default_excludes": lambda s, d: collect.prune_dirs(
        collect.exclude(load(s, d, "inv"), collect.default_excludes()), collect.default_excludes()
    ).select(*_META),
    "ignore_patterns": lambda s, d: collect.ignore_patterns(load(s, d, "inv")),
    "exclude_by_repo": lambda s, d: collect.exclude_by_repo(
        load(s, d, "inv"), load(s, d, "inv"), collect.default_excludes()
    ).select(*_META),
    "size_between": lambda s, d: collect.size_between(load(s, d, "docs"), 1024, 8000).select(*_META),
    "limit_files": _meta(collect.limit_files, 20),
    "fit_budget": _meta(collect.fit_budget, 40_000_000),
    "is_large_project": lambda s, d: collect.is_large_project(load(s, d, "inv")),
    "is_large_project_tight": lambda s, d: collect.is_large_project(load(s, d, "inv"), *GATE),
    "classify_binary": lambda s, d: collect.classify_binary(load(s, d, "inv")).select("repo", "path", "is_binary"),
    "classify_binary_web": lambda s, d: collect.classify_binary(load(s, d, "web")).select("repo", "path", "is_binary"),
    "classify_incremental": _incremental,
    "collect_files": lambda s, d: collect.collect(load(s, d, "inv"), OPTIONS),
}

# --- oracle: every rule written out by hand ------------------------------------


def _last_match(x: str, rules: list[tuple[str, bool]]) -> str:
    """Last matching (regex, exclude) wins."""
    arms = " ".join(
        f"when regexp_matches({x}, '{r}') then {str(e).lower()}" for r, e in reversed(rules)
    )
    return f"case {arms} end"


_EXCLUDE_FILE = [
    (r"(^|/)[^/]*\.log(/|$)", True), (r"(^|/)d3/", True), (r"^d4/s1(/|$)", True),
    (r"(^|/)keep\.log(/|$)", False), (r"^d5/([^/]+/)*f[^/]*\.go(/|$)", True), (r"(^|/)vendor/", True),
    (r"(^|/)[^/]*\.r[bs](/|$)", True), (r"(^|/)f1[^/]*\.rb(/|$)", False), (r"^d3/f3[^/]*(/|$)", False),
]
_EXCLUDE_DIR = [(r.replace("d3/", "d3(/|$)") if r == "(^|/)d3/" else r.replace("vendor/", "vendor(/|$)"), e) for r, e in _EXCLUDE_FILE]
_DEFAULT = [
    (r"^node_modules(/|$)|^vendor(/|$)|^\.git(/|$)|(^|/)\.git(/|$)|^\.svn(/|$)|(^|/)\.DS_Store(/|$)"
     r"|^\.idea(/|$)|^\.vscode(/|$)|^dist(/|$)|^build(/|$)|(^|/)__pycache__(/|$)"
     r"|(^|/)[^/]*\.(pyc|pyo|so|dll|exe|bin|obj|o|a|lib)(/|$)", True),
]
# directories above each file, one row each
_DIRS = (
    "select repo, path, array_to_string(parts[1:n], '/') as dir from (select repo, path, parts, "
    "unnest(generate_series(1, len(parts) - 1)) as n from (select repo, path, string_split(path, '/') as parts "
    f"from ({_INV})))"
)


def _pruned(rules) -> str:
    return f"select distinct repo, path from ({_DIRS}) where coalesce({_last_match('dir', rules)}, false)"


def _kept(file_rules, dir_rules, prune=True) -> str:
    sql = f"select repo, path, size from ({_INV}) f where true"
    if file_rules:
        sql += f" and not coalesce({_last_match('path', file_rules)}, false)"
    if prune:
        sql += f" and not exists (select 1 from ({_pruned(dir_rules)}) x where x.repo = f.repo and x.path = f.path)"
    return sql


_GITIGNORES = f"select repo, content, unnest(string_split(content, chr(10))) as line, unnest(generate_series(1, len(string_split(content, chr(10))))) as ord from ({_INV}) where path = '.gitignore'"
_PATTERNS = (
    "select repo, row_number() over (partition by repo order by ord) as seq, trim(line) as pattern "
    f"from ({_GITIGNORES}) where trim(line) <> '' and not starts_with(trim(line), '#')"
)


def _own(x: str, on_dir: bool) -> str:
    """The rendered ignore file, k = the directory number it names."""
    tail = "(/|$)" if on_dir else "/"
    return (
        f"case when regexp_matches({x}, '^d2/[^/]*\\.go(/|$)') then true "
        f"when regexp_matches({x}, '(^|/)dist(/|$)') then true "
        f"when regexp_matches({x}, '(^|/)keep\\.log(/|$)') then false "
        f"when regexp_matches({x}, '^d' || k || '/s1{tail}') then true "
        f"when regexp_matches({x}, '(^|/)[^/]*\\.log(/|$)') then true end"
    )


_K = f"select repo, regexp_extract(content, 'd([0-9]+)/s1', 1) as k from ({_INV}) where path = '.gitignore'"


def _by_repo(extra_exclude: str = "false") -> str:
    """Own rules come after the common ones, so they decide first."""
    common = _last_match("{x}", _DEFAULT)
    on_file = f"coalesce({_own('f.path', False)}, {common.replace('{x}', 'f.path')}, {extra_exclude}, false)"
    on_dir = f"coalesce({_own('dir', True)}, {common.replace('{x}', 'dir')}, false)"
    return (
        f"select f.repo, f.path, f.size, f.content from ({_INV}) f left join ({_K}) g on f.repo = g.repo "
        f"where not {on_file} and not exists (select 1 from ({_DIRS}) x where x.repo = f.repo and x.path = f.path and {on_dir})"
    )


_BINARY = (
    "case when regexp_matches(lower(path), '\\.(exe|dll|so|dylib|bin|obj|o|a|lib|pyc|pyo|pyd|class|jar|war|ear|png|jpg|jpeg|gif|bmp"
    "|ico|zip|tar|gz|rar|7z|pdf|avif|svg|wasm|webp)$') then true "
    "when regexp_matches(lower(path), '\\.(css|htm|html|js|mjs|xml)$') then false when content = '' then true "
    "else regexp_matches(content[1:512], '[\\x00-\\x08\\x0b\\x0e-\\x1a\\x1c-\\x1f]') "
    "or regexp_matches(content, '^(%PDF-|%!PS-Adobe-|GIF8[79]a|BM|OTTO|ttcf|wOFF|wOF2|PK\\x03\\x04|\\.snd)') "
    "or regexp_matches(content, '(?i)^[\\t\\n\\f\\r ]*<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--)[ >]') "
    "or regexp_matches(content, '^[\\t\\n\\f\\r ]*<\\?xml') end"
)
_WALK = "string_split(path, '/')"


def _budget(source: str, limit: int) -> str:
    return (
        f"select repo, path, size from (select *, sum(size) over (partition by repo) as total, "
        f"sum(size) over (partition by repo order by size, path rows unbounded preceding) as running from ({source})) "
        f"where total <= {limit} or running <= {limit}"
    )


_COLLECTED = (
    f"select repo, path, size from (select *, row_number() over (partition by repo order by {_WALK}) as rn from ("
    f"{_by_repo(chr(40) + 'case when ' + 'regexp_matches(f.path, ' + chr(39) + r'(^|/)[^/]*\.sql(/|$)' + chr(39) + ') then true end' + chr(41))}) "
    f"where regexp_matches(path, '(^|/)[^/]*\\.[^/]*$') and size between 20000 and 450000 and not {_BINARY}) where rn <= 60"
)

_TREE_SQL = "select " + ", ".join(f"{text} as {name}" for name, text in _TREE.items()) + " from documents"


def _gate(size, count, some, mean):
    return (
        f"select *, total_size > {size} or file_count > {count} or (file_count > {some} and total_size // file_count > {mean}) "
        f"as is_large from (select repo, count(*)::bigint as file_count, sum(size)::bigint as total_size from ({_INV}) group by repo)"
    )


ORACLES = {
    "scan_tree": f"select repo, path, strlen(content)::bigint as size, md5(content) as digest, null::varchar as error from ({_TREE_SQL})",
    "scan_tree_chunks": "select repo, path, chunk_no, chunk_no * 4096 as offset, total, octet_length(data)::bigint as bytes, md5(data) as digest from ("
    "select *, encode(content)[chunk_no * 4096 + 1 : chunk_no * 4096 + 4096] as data from ("
    "select repo, path, content, strlen(content)::bigint as total, "
    f"unnest(range(0, greatest(strlen(content) - 1, 0) // 4096 + 1))::bigint as chunk_no from ({_TREE_SQL})))",
    "scan_walk_order": "select repo, path, size, row_number() over (partition by repo order by string_split(path, '/')) as position "
    f"from ({duck('docs')})",
    "include": f"select repo, path, size from ({_INV}) where regexp_matches(path, '^(.*/)?[^/]*\\.go$') "
    "or regexp_matches(path, '^d1/[^/]*\\.js$') or regexp_matches(path, '^(.*/)?s[^/]/(.*/)?[^/]*\\.(c|cpp|h)$') "
    "or path = 'README.md' or regexp_matches(path, '^d[0-3]/f1[^/]*$')",
    "exclude": _kept(_EXCLUDE_FILE, [], prune=False),
    "prune_dirs": _kept([], _EXCLUDE_DIR),
    "default_excludes": _kept(_DEFAULT, _DEFAULT),
    "ignore_patterns": _PATTERNS,
    "exclude_by_repo": f"select repo, path, size from ({_by_repo()})",
    "size_between": f"select repo, path, size from ({duck('docs')}) where size between 1024 and 8000",
    "limit_files": f"select repo, path, size from (select *, row_number() over (partition by repo order by {_WALK}) as rn from ({_INV})) where rn <= 20",
    "fit_budget": _budget(_INV, 40_000_000),
    "is_large_project": _gate(524288000, 10000, 5000, 51200),
    "is_large_project_tight": _gate(*GATE),
    "classify_binary": f"select repo, path, {_BINARY} as is_binary from ({_INV})",
    "classify_binary_web": f"select repo, path, {_BINARY} as is_binary from ({duck('web')})",
    "classify_incremental": f"select repo, path, size, {_BINARY} as is_binary from ({_INV})",
    "collect_files": _budget(_COLLECTED, 5_000_000),
}
