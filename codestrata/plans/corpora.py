"""Source-like corpora rendered from the driver tables.

The tables hold business rows, prose and HTML but no source code. Each row of a
driver table is rendered to one file (a narrow projection: no shuffle, no
grouping, the corpus grows with the table). The same expression text serves
Spark SQL and the SQL oracle; ``@`` tokens cover the few dialect differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import stage

_SPARK = {
    "~/": " div ", "@bytes(": "octet_length(", "@str": "string",
    "@fn ": "", "@->": " -> ", "@map(": "transform(", "@keep(": "filter(",
    "@seq(": "sequence(", "@join(": "array_join(", "@int": "bigint",
}
_DUCK = {
    "~/": " // ", "@bytes(": "strlen(", "@str": "varchar",
    "@fn ": "lambda ", "@->": ": ", "@map(": "list_transform(", "@keep(": "list_filter(",
    "@seq(": "generate_series(", "@join(": "array_to_string(", "@int": "bigint",
}


#: For Spark: the same choice with its key computed once and found by halves.
_HALVED: dict[str, str] = {}


def _choice(key: str, values: list[str], default: str | None = None) -> str:
    """CASE over the keys 0, 1, ...; an outer lambda would compute the key for every arm."""
    def halves(first: int, last: int) -> str:
        if first == last:
            return values[first]
        middle = (first + last + 1) // 2
        return f"case when k_ < {middle} then {halves(first, middle - 1)} else {halves(middle, last)} end"

    arms = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    other = "" if default is None else f" else {default}"
    text = f"case {key} {arms}{other} end"
    _HALVED[text] = (
        f"element_at(transform(array({key}), k_ -> case when k_ between 0 and {len(values) - 1} then {halves(0, len(values) - 1)}{other} end), 1)"
    )
    return text


def _dialect(text: str, tokens: dict[str, str]) -> str:
    if tokens is _SPARK:
        for case, halved in _HALVED.items():
            text = text.replace(case, halved)
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def code_line(tid: str, pk: str, q: str) -> str:
    """One line of source text chosen by ``tid`` in 0..45."""
    m, h = f"(({pk}) % 50)", f"md5(cast(({pk}) as @str))"
    lines = [
        "''",
        f"concat('// TODO: revisit ', {pk})",
        "'/* open'",
        f"concat('inside ', {pk})",
        "'close */'",
        f"concat('func Handle', {pk}, '(a int) int {{')",
        f"concat('    if a > ', {pk}, ' && b>0||c {{')",
        "'    }'",
        "'}'",
        f"concat('def run_', {pk}, '(x, y):')",
        f"concat('class C', {pk}, ':')",
        f"concat('console.log(', {q}, '); var y = 1;')",
        f"concat('password = \"', substr({h}, 1, 12), '\"')",
        f"concat('api_key: \"', {h}, '\"')",
        f"concat('client_secret = \"', {h}, '\"')",
        f"concat('ghp_', {h}, substr({h}, 1, 8))",
        f"concat('postgres://app:', {pk}, '@db', {q}, '/main')",
        f"concat('import {{ a', {pk}, ' }} from \"mod', {m}, '\"')",
        f"concat('from pkg', {m}, ' import x', {q})",
        f"concat('export async function go', {pk}, '(a) {{')",
        f"concat('public static int calc', {pk}, '(int a) {{')",
        f"concat('#include <lib', {m}, '.h>')",
        f"concat('# FIXME ', {pk})",
        "repeat('x', 130)",
        f"concat(repeat(' ', 40), 'return ', {pk}, ';')",
        "'USER root'",
        "'EXPOSE 8022'",
        "'Access-Control-Allow-Origin: *'",
        f"concat('// if old func f', {pk}, '()')",
        f"concat('print(', {q}, ')')",
        f"concat('type Shape', {pk}, ' struct {{')",
        f"concat('export class Widget', {pk}, ' {{')",
        f"concat('export const LIMIT_', {q}, ' = ', {pk}, ';')",
        f"concat('import java.util.M', {m}, ';')",
        f"concat('public class Main', {pk}, ' {{')",
        f"concat('public interface Api', {m}, ' {{')",
        f"concat('struct node', {q}, ' *next;')",
        f"concat('static int *alloc', {pk}, ' (int n, char *p) {{')",
        "'  credentials: true,'",
        "'add_header X-Frame-Options DENY;'",
        f"concat('    debugger; // see http://x/', {q})",
        f"concat('/* one line ', {pk}, ' */')",
        f"concat('\té = a?b:c; let z = ok?', {q}, ':1;  ')",
        f"concat('#!/bin/sh', '')",
        f"concat('const Max', {q}, ' = ', {pk}, ' // HACK')",
        f"concat('x = a&&b; while (x) {{ if(y){{}} }} // ', {q})",
    ]
    return _choice(f"({tid})", [text.replace("{{", "{").replace("}}", "}") for text in lines])


CODE_TEMPLATES = 46
_NL = "chr(10)"

_CODE_LINES = (
    "@map(@seq(1, 3 + o_orderkey % 11), @fn i@-> "
    + code_line(
        f"(o_orderkey * 7 + i * 13 + o_custkey) % {CODE_TEMPLATES}",
        "o_custkey * 10 + i",
        "((o_orderkey + i * 3) % 50 + 1)",
    )
    + ")"
)

CODE = (
    "orders",
    [
        ("id", "o_orderkey"),
        ("repo", "concat('r', o_custkey % 25)"),
        (
            "path",
            "concat(case (o_orderkey ~/ 12) % 3 when 0 then 'src' when 1 then 'lib' else 'test' end, "
            "'/f', o_orderkey, case when o_orderkey % 7 = 3 then '_test' else '' end, "
            "case o_orderkey % 12 when 0 then '.go' when 1 then '.js' when 2 then '.ts' "
            "when 3 then '.py' when 4 then '.java' when 5 then '.rb' when 6 then '.c' "
            "when 7 then '.sh' when 8 then '.css' when 9 then '.md' "
            "when 10 then '/Dockerfile' else '/nginx.conf' end)",
        ),
        (
            "content",
            f"concat(replace(@join({_CODE_LINES}, {_NL}), {_NL}, case when o_orderkey % 13 = 5 then concat(chr(13), {_NL}) else {_NL} end), "
            f"case when o_orderkey % 4 = 0 then {_NL} else '' end)",
        ),
        (
            "mode",
            "case o_orderkey % 7 when 0 then 438 when 1 then 493 when 2 then 384 else 420 end",
        ),
    ],
)

# one repository per 256 orders; slot = position inside the repository
_SLOT = "(o_orderkey % 256)"
_INV_SPECIAL = [
    "README.md", "Dockerfile", "package.json", "Makefile", "tsconfig.json", ".env",
    "id_rsa", "server.pem", ".gitlab-ci.yml", ".github/workflows/ci.yml",
    "docker-compose.yml", "x_test.go", "logo.png", "LICENSE", "webpack.config.js",
    "kubernetes/app.yaml", "prisma/schema.prisma", ".dockerignore", "Jenkinsfile",
    "node_modules/a/index.js", "build/out.o", "vendor/lib.go", "main.go", "Dockerfile.dev",
    "app.config", "my.credentials.key", "setup.py", "svc.k8s.yaml", "database.yml",
    "NOEXT", "Main.JAVA", "a.spec.ts", "keep.log", "logs/x.log", "dist/app.js", "index.html",
]
_INV_EXT = [
    ".go", ".js", ".ts", ".py", ".java", ".rb", ".php", ".cs", ".c", ".cpp", ".h", ".html",
    ".css", ".json", ".xml", ".md", ".sh", ".sql", ".rs", ".kt", ".R", ".yaml", ".txt",
]


def _arms(values: list[str]) -> str:
    return " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))


_INV_REPO = "concat('p', o_orderkey ~/ 256)"
_INV_PATH = (
    f"case {_SLOT} when 0 then '.gitignore' "
    "when 1 then case when (o_orderkey ~/ 256) % 2 = 0 then 'README.md' else 'NOTES.txt' end "
    "when 2 then 'package.json' when 3 then 'requirements.txt' when 4 then 'go.mod' else "
    f"concat('d', o_custkey % 12, '/', case when o_custkey % 3 = 0 then concat('s', o_custkey % 5, '/') else '' end, "
    f"case when o_custkey % 4 = 0 and {_SLOT} >= 20 and {_SLOT} < 230 then concat('u', {_SLOT}, '/', "
    f"case {_SLOT} % {len(_INV_SPECIAL)} {_arms(_INV_SPECIAL)} end) "
    f"else concat('f', o_orderkey, case o_custkey % {len(_INV_EXT)} {_arms(_INV_EXT)} end) end) end"
)
_INV_CONTENT = (
    f"case {_SLOT} when 0 then concat('# ignore', {_NL}, '*.log', {_NL}, '  d', o_custkey % 12, '/s1/ ', {_NL}, "
    f"'!keep.log', {_NL}, {_NL}, '**/dist', {_NL}, '/d2/*.go') "
    f"when 2 then concat('{{', {_NL}, '  \"scripts\": {{\"b\": \"parcel build\"}},', {_NL}, '  \"dependencies\": {{\"react\": \"^18.2.0\"}},', {_NL}, '  \"devDependencies\": {{\"jest\": \"29\"}}', {_NL}, '}}') "
    f"when 3 then concat('Django==4.2', {_NL}, '# x', {_NL}, 'redis>=5', {_NL}) "
    f"when 4 then concat('module m', {_NL}, 'go 1.21', {_NL}, 'require (', {_NL}, ')', {_NL}, 'require gorm v1.2.3') "
    "else case o_custkey % 9 when 0 then '' when 1 then '<html><body>x</body></html>' "
    "when 2 then concat('bin', chr(1), 'ary') when 3 then '%PDF-1.4 text' when 4 then '<?xml version=\"1.0\"?>' "
    "when 5 then concat(chr(9), ' <P >para') else concat('plain é text ', o_orderkey) end end"
).replace("{{", "{").replace("}}", "}")

INV = (
    "orders",
    [
        ("id", "o_orderkey"),
        ("repo", _INV_REPO),
        ("path", _INV_PATH),
        ("size", "cast(floor(o_totalprice) as @int)"),
        (
            "mode",
            "case o_orderkey % 7 when 0 then 438 when 1 then 493 when 2 then 384 else 420 end",
        ),
        ("content", _INV_CONTENT),
        ("mtime", "o_orderdate"),
    ],
)

# one repository per ten orders; at most one manifest of each kind in it
_N = "(2 + o_custkey % 6)"
_Q = "((o_orderkey + i) % 20)"
_KNOWN = [
    "lodash", "axios", "express", "django", "flask", "requests", "request", "react",
    "jest", "redis", "vue", "koa", "pytest", "gorm", "sqlalchemy", "mysql2", "imp", "next",
    "vitest", "fastapi",
]
_NAME = f"""({_choice("(o_custkey * 3 + i * 7) % 40", [f"'{k}'" for k in _KNOWN], "concat('pkg', (o_custkey * 3 + i * 7) % 40, '-', o_orderkey % 100)")})"""
_VERSION = (
    f"(case (o_orderkey ~/ 10 + i) % 7 when 0 then '4.17.15' when 1 then concat('^0.', {_Q}, '.1') "
    f"when 2 then concat({_Q}, '.0.0-beta') when 3 then concat('0.0.', {_Q}) when 4 then '==2.2.0' "
    f"when 5 then concat('~1.', {_Q}, '.0') else 'v2.19.0' end)"
)


def _entries(condition: str, text: str, sep: str) -> str:
    return f"@join(@map(@keep(@seq(1, {_N}), @fn i@-> {condition}), @fn i@-> {text}), {sep})"


_JSON_ENTRY = f"concat('\"', {_NAME}, '\": \"', {_VERSION}, '\"')"
_TOML_ENTRY = f"concat({_NAME}, ' = \"', {_VERSION}, '\"')"


def _json_section(name: str, remainder: int, extra: str = "") -> str:
    return f"'  \"{name}\": {{', {_entries(f'i % 4 = {remainder}', _JSON_ENTRY, repr(', '))}, '{extra}}}'"


def _toml(first: str, second: str, third: str) -> str:
    return (
        f"'{first}', {_NL}, {_entries('i % 4 in (0, 1)', _TOML_ENTRY, _NL)}, {_NL}, "
        f"'{second}', {_NL}, {_entries('i % 4 = 2', _TOML_ENTRY, _NL)}, {_NL}, '# a = b', {_NL}, "
        f"'{third}', {_NL}, {_entries('i % 4 = 3', _TOML_ENTRY, _NL)}, {_NL}, "
        f"'[other]', {_NL}, 'skip = \"1\"', {_NL}"
    )


_MAN_CONTENT = (
    "case o_orderkey % 10 when 0 then concat('{', "
    f"'\"engines\": {{\"node\": \">=', o_custkey % 20, '\"}}, \"weird\": [1],', {_NL}, "
    f"{_json_section('dependencies', 1)}, ',', {_NL}, {_json_section('devDependencies', 2)}, ',', {_NL}, "
    f"{_json_section('optionalDependencies', 3)}, ',', {_NL}, {_json_section('peerDependencies', 0)}, "
    f"case when o_custkey % 11 = 0 then '' else '}}' end) "
    f"when 1 then concat('module m', {_NL}, {_NL}, 'go 1.', o_custkey % 22, {_NL}, 'require (', {_NL}, "
    f"{_entries('i > 1', f'concat(chr(9), {_NAME}, chr(32), {_VERSION}, case when i % 3 = 0 then {chr(39)} // indirect{chr(39)} else {chr(39)}{chr(39)} end)', _NL)}, "
    f"{_NL}, '// note', {_NL}, ')', {_NL}, 'require github.com/lib/pq v1.', o_custkey % 9, '.0', {_NL}, 'lone') "
    f"when 2 then concat('# c', {_NL}, {_entries('i >= 1', f'concat({_NAME}, case when i % 3 = 0 then {chr(39)}[x]>=1{chr(39)} else {chr(39)}=={chr(39)} end, {_VERSION})', _NL)}, {_NL}, '-r base.txt', {_NL}) "
    f"when 3 then concat({_entries('i >= 1', f'concat({_NAME}, {chr(39)}~={chr(39)}, {_VERSION})', _NL)}, {_NL}, 'Flask', {_NL}) "
    f"when 4 then concat('[tool.poetry.dependencies]', {_NL}, 'python = \"^3.', o_custkey % 12, '\"', {_NL}, "
    + _toml("[tool.poetry.dependencies]", "[tool.poetry.dev-dependencies]", "[tool.poetry.group.dev.dependencies]")
    + ") when 5 then concat(" + _toml("[packages]", "[dev-packages]", "[packages]")
    + f") when 6 then concat('rust-version = \"1.', o_custkey % 80, '\"', {_NL}, "
    + _toml("[dependencies]", "[dev-dependencies]", "[build-dependencies]")
    + f") when 7 then concat('source \"x\"', {_NL}, "
    + _entries(
        "i >= 1",
        f"concat('gem \"', {_NAME}, '\"', case when i % 3 = 1 then concat(', \"', {_VERSION}, '\"') else '' end, "
        "case when i % 4 = 2 then ', group: :test' else '' end)",
        _NL,
    )
    + f", {_NL}) when 8 then concat('{{\"require\": {{\"php\": \"8.1\", \"n\": 7, ', "
    f"{_entries('i % 2 = 0', _JSON_ENTRY, repr(', '))}, '}}, \"require-dev\": {{\"php\": \"8.2\"', "
    f"@join(@map(@keep(@seq(1, {_N}), @fn i@-> i % 2 = 1), @fn i@-> concat(', ', {_JSON_ENTRY})), ''), '}}}}}}}}') "
    f"else case (o_orderkey ~/ 10) % 4 when 0 then concat('package x', {_NL}, 'import \"github.com/gin-gonic/gin\"') "
    f"when 1 then concat('import \"github.com/labstack/echo/v4\"', {_NL}, '// github.com/gofiber/fiber') "
    f"when 2 then concat('setup(', {_NL}, ' python_requires = ''>=3.', o_custkey % 9, ''')') "
    "else 'model User {}' end end"
).replace("{{", "{").replace("}}", "}")

MAN = (
    "orders",
    [
        ("id", "o_orderkey"),
        ("repo", "concat('m', o_orderkey ~/ 10)"),
        (
            "path",
            "case o_orderkey % 10 when 0 then 'package.json' when 1 then 'go.mod' when 2 then 'requirements.txt' "
            "when 3 then 'requirements-dev.txt' when 4 then 'pyproject.toml' when 5 then 'Pipfile' "
            "when 6 then 'Cargo.toml' when 7 then 'Gemfile' when 8 then 'composer.json' "
            "else case (o_orderkey ~/ 10) % 4 when 0 then 'src/main.go' when 1 then 'api/web_test.go' "
            "when 2 then 'setup.py' else 'prisma/schema.prisma' end end",
        ),
        ("content", _MAN_CONTENT),
        ("mode", "420"),
    ],
)

DOCS = (
    "documents",
    [
        ("id", "doc_id"),
        ("repo", "source"),
        ("path", "concat(lang, '/', doc_id, '.txt')"),
        ("content", "text"),
        ("mode", "420"),
    ],
)

WEB = (
    "pages",
    [
        ("id", "page_id"),
        ("repo", "regexp_extract(url, '//([^/?#]+)', 1)"),
        (
            "path",
            "concat('w/', page_id, case page_id % 6 when 0 then '.html' when 1 then '.png' when 2 then '.json' "
            "when 3 then '.js' when 4 then '' else '.tmpl' end)",
        ),
        (
            "content",
            "case page_id % 5 when 0 then html when 1 then concat('text ', url, ' ', html) "
            "when 2 then concat(' ', chr(10), html) when 3 then concat('BM', html) else concat(url, chr(0), html) end",
        ),
        ("mode", "420"),
    ],
)

# commits and their trees; a commit is a (repo, commit_seq) pair
CHG = (
    "events",
    [
        ("repo", "concat('g', user_id % 20)"),
        ("path", "concat('src/f', event_id % 60, '.go')"),
        ("commit_seq", "event_id ~/ 500"),
        ("blob", "value"),
        (
            "staging",
            "case event_type when 'signup' then 'added' when 'click' then 'modified' "
            "when 'error' then 'unmodified' when 'view' then 'untracked' else 'unmodified' end",
        ),
        (
            "worktree",
            "case event_type when 'signup' then 'modified' when 'click' then 'unmodified' "
            "when 'error' then 'deleted' when 'view' then 'untracked' else 'modified' end",
        ),
        ("event_id", "event_id"),
    ],
)

_LINT_JSON_SEV = "case when i % 3 = 0 then 2 else 1 end"
LINTR = (
    "orders",
    [
        ("id", "o_orderkey"),
        ("repo", "concat('r', o_custkey % 25)"),
        (
            "golint",
            "@join(@map(@seq(0, o_orderkey % 5), @fn i@-> case i % 4 "
            "when 0 then concat('src/f', o_orderkey, '.go:', i + 1, ':', o_custkey % 60, ': message ', o_custkey) "
            "when 1 then concat('src/f', o_orderkey, '.go:x', i, ': 7 :  spaced: text ') "
            f"when 2 then 'no position' else '' end), {_NL})",
        ),
        (
            "eslint",
            "concat('[{\"filePath\": \"/work/src/f', o_orderkey, '.js\", \"messages\": [', "
            "@join(@map(@seq(1, 1 + o_orderkey % 4), @fn i@-> concat('{\"line\": ', i, ', \"column\": ', o_custkey % 80, "
            f"', \"severity\": ', {_LINT_JSON_SEV}, ', \"message\": \"m', o_custkey, '\", \"ruleId\": \"rule-', i, '\"', "
            "case when i % 2 = 0 then ', \"fix\": {\"range\": [1,2], \"text\": \"\"}' else '' end, '}')), ','), "
            "']}, {\"filePath\": \"/work/lib/e', o_orderkey, '.js\", \"messages\": []}', "
            "case when o_orderkey % 17 = 0 then '' else ']' end)",
        ),
        (
            "pylint",
            "concat('[', @join(@map(@seq(1, 1 + o_orderkey % 3), @fn i@-> concat('{\"type\": \"', "
            "case (o_orderkey + i) % 5 when 0 then 'error' when 1 then 'fatal' when 2 then 'warning' "
            "when 3 then 'convention' else 'refactor' end, "
            "'\", \"path\": \"/work/src/f', o_orderkey, '.py\", \"line\": ', i * 3, ', \"column\": ', o_custkey % 40, "
            "', \"message\": \"m', o_custkey, '\", \"symbol\": \"s', i, '\"}')), ','), ']')",
        ),
    ],
)

URLS = (
    "supplier",
    [
        (
            "url",
            "case s_suppkey % 7 when 0 then concat('https://github.com/own', s_nationkey, '/rep', s_suppkey) "
            "when 1 then concat('https://github.com/own', s_nationkey, '/rep', s_suppkey, '.git') "
            "when 2 then concat('git@github.com:own', s_nationkey, '/rep', s_suppkey, '.git') "
            "when 3 then concat('ftp://github.com/own', s_nationkey, '/rep', s_suppkey) "
            "when 4 then concat('rep', s_suppkey) when 5 then '' "
            "else concat('http://example.org/own', s_nationkey, '/rep', s_suppkey, '/tree') end",
        ),
    ],
)

CORPORA = {
    "code": CODE, "inv": INV, "man": MAN, "docs": DOCS, "web": WEB,
    "chg": CHG, "lintr": LINTR, "urls": URLS,
}


#: Rows that a task renders. Rendering multiplies their bytes and takes far longer than reading.
TASK_ROWS = 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """Use every core, and tasks of about TASK_ROWS rows, when the table arrives in fewer files.

    A table in many small files has splits enough and is left alone. The number of
    rows comes from the footers of the files.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def render(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Corpus as a lazy projection of its driver table."""
    table, columns = CORPORA[name]
    df = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    out = df.selectExpr(*[f"{_dialect(text, _SPARK)} as `{col}`" for col, text in columns])
    if "content" in out.columns and "size" not in out.columns:
        out = out.selectExpr("*", "cast(octet_length(content) as bigint) as size")
    return out


_INGESTED: dict[tuple[str, str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The corpus as an ingested table.

    Rendered once per application and table into the shared folder, so queries
    read a columnar ``files`` table the way a production job would: column
    pruning and pushed filters apply, and content is read only where needed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INGESTED:
        _INGESTED[key] = stage(render(spark, sf_dir, name))
    return _INGESTED[key]


def duck(name: str) -> str:
    """The same corpus as one SQL subquery."""
    table, columns = CORPORA[name]
    inner = "select " + ", ".join(f"{_dialect(text, _DUCK)} as {col}" for col, text in columns) + f" from {table}"
    if any(c == "content" for c, _ in columns) and not any(c == "size" for c, _ in columns):
        return f"select *, cast(strlen(content) as bigint) as size from ({inner})"
    return inner
