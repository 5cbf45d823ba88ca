"""Symbol and import queries."""

from pyspark.sql import functions as F

from codestrata.operators import symbols
from codestrata.plans.corpora import duck, load, spread
from codestrata.plans.oracle_parts import base, ext, trim


def _code(op, *args):
    return lambda spark, sf: op(load(spark, sf, "code"), *args)


#: One Go file per order, with what line patterns cannot see: type parameters,
#: functions and channels as parameters, grouped types, block comments, directives.
#: %K is the order's key, %N a number of it, %T a name of it.
NESTED_GO = """/*
Package p%K holds

   things of %T.

*/
package p%K

/* Stack%K is generic. */
//go:generate stringer
type Stack%K[K comparable, V map[K][]int] struct {
	Field []V
}

type (
	Set%K[T any] interface {
		Has(T) bool
	}
	Pair%K [%N]int
)

//
// Push%K adds
//
//
// %T.
//go:noinline
func (s *Stack%K[K, V]) Push%K(f func(a int, b ...string) (x, y int), m map[[%N]string][]V, c chan<- func() error) (out []func(int) bool, err error) {
	return nil, nil
}

func Build%K[T any, L ~[]T](
	items L, // the list
	each func(T) func() error,
	opts ...Option[T],
) *Set%K[T] {
	return nil
}
/*
func Hidden%K() {}
*/

func Last%K(x interface{ M(int) string }, s struct{ A, B int }, n [%N]*pkg.T) func(int) chan int { return f(func() {}) }
"""
#: kind, name, signature and doc of its symbols, in order.
NESTED_SYMBOLS = [
    ("type", "Stack%K", "type Stack%K struct", " Stack%K is generic.\n"),
    ("interface", "Set%K", "type Set%K interface", ""),
    ("type", "Pair%K", "type Pair%K", ""),
    ("function", "Push%K", "func s *... Push%K(f func, m map[[]string][]V, c ...) out []func, err error", "Push%K adds\n\n%T.\n"),
    ("function", "Build%K", "func Build%K(items L, each func, opts ...) *...", ""),
    ("function", "Last%K", "func Last%K(x interface{}, s ..., n []*pkg.T) func", ""),
]


def _nested_go(spark, sf):
    def put(template, values):
        for mark, value in values.items():
            template = F.replace(template, F.lit(mark), value)
        return template

    values = {
        "%K": F.col("o_orderkey").cast("string"), "%N": (F.col("o_custkey") % 7 + 1).cast("string"),
        "%T": F.lower(F.col("o_orderstatus")),
    }
    made = spread(spark.read.parquet(f"{sf}/orders.parquet")).select(
        F.lit("nested").alias("repo"), F.concat(F.lit("p"), values["%K"], F.lit("/a.go")).alias("path"),
        put(F.lit(NESTED_GO), values).alias("content"),
    )
    return symbols.go_symbols(made).select("path", "pos", "kind", "name", "signature", "doc")


PATTERNS = ["src/**/*.js", "**/*.py", "lib/*.go", "test/*"]

QUERIES = {
    "go_symbols": _code(symbols.go_symbols),
    "go_symbols_nested": _nested_go,
    "js_symbols": _code(symbols.js_symbols),
    "py_symbols": _code(symbols.py_symbols),
    "java_symbols": _code(symbols.java_symbols),
    "c_symbols": _code(symbols.c_symbols),
    "imports": _code(symbols.imports),
    "summarize": _code(symbols.summarize),
    "render_summary": _code(symbols.render_summary),
    "apply_summaries": _code(symbols.apply_summaries, PATTERNS),
}

# --- oracle -----------------------------------------------------------------------

_LANG = f"case lower({ext()}) " + " ".join(f"when '{e}' then '{l}'" for e, l in symbols.LANGUAGES.items()) + f" else lower({ext()}) end"
_SRC = f"src as materialized (select repo, path, {_LANG} as language, content, replace(content, chr(13) || chr(10), chr(10)) as unix from ({duck('code')}))"


def _hits(language, step, kind, pattern, name, signature, text="content", keep="true"):
    """All matches of a pattern; a group is taken from each match."""
    def g(n):
        return f"regexp_extract(hit, '{pattern}', {n})"
    sig = signature.replace("G1", g(1)).replace("G2", g(2)).replace("G3", g(3))
    return (
        f"select repo, path, language, {step} as step, ord, '{kind}' as kind, {g(name)} as name, {sig} as signature, '' as doc from "
        f"(select repo, path, language, unnest(h) as hit, unnest(generate_series(1, len(h))) as ord from "
        f"(select *, regexp_extract_all({text}, '{pattern}') as h from src where language = '{language}')) where {keep.replace('NAME', g(name))}"
    )


_PY_LINES = (
    "(select repo, path, language, unnest(string_split(content, chr(10))) as line, "
    "unnest(generate_series(1, len(string_split(content, chr(10))))) as ord from src where language = 'python')"
)


def _py(step, kind, pattern, signature):
    def g(n):
        return f"regexp_extract(line, '{pattern}', {n})"
    sig = signature.replace("G1", g(1)).replace("G2", g(2))
    return (
        f"select repo, path, language, {step} as step, ord, '{kind}' as kind, {g(1)} as name, {sig} as signature, '' as doc "
        f"from {_PY_LINES} where regexp_matches(line, '{pattern}')"
    )


# comment block and the line behind it; the corpus has no grouped declarations
_GO_CHUNK = "(?m)(?:^//[^\\n]*\\n)*^(?:func|type|const|var) [^\\n]*"
_GO = (
    "select repo, path, language, 1 as step, ord, case when decl[1:4] = 'func' then 'function' when decl[1:4] = 'type' then 'type' else 'const' end as kind, "
    "regexp_extract(decl, '^(?:func|type|const) ([A-Z]\\w*)', 1) as name, "
    "case when decl[1:4] = 'func' then replace(decl, ' {', '') when decl[1:4] = 'type' then replace(decl, ' {', '') "
    "else 'const ' || regexp_extract(decl, '^const ([A-Z]\\w*)', 1) end as signature, "
    "regexp_replace(comment, '(?m)^// ?', '', 'g') as doc from (select *, regexp_extract(hit, '^(?:func|type|const|var) [^\\n]*', 0, 'm') as decl0, "
    "regexp_extract(hit, '[^\\n]*$') as decl, hit[1:len(hit) - len(regexp_extract(hit, '[^\\n]*$'))] as comment from "
    "(select repo, path, language, unnest(h) as hit, unnest(generate_series(1, len(h))) as ord from "
    f"(select *, regexp_extract_all(unix, '{_GO_CHUNK}') as h from src where language = 'go'))) "
    "where regexp_matches(decl, '^(?:func|type|const|var) [A-Z]')"
).replace("regexp_extract(hit, '^(?:func|type|const|var) [^\\n]*', 0, 'm') as decl0, ", "'' as decl0, ")
_JS = " union all ".join([
    _hits("javascript", 1, "function", r"export\s+(?:async\s+)?function\s+(\w+)\s*\((.*?)\)", 1, "'function ' || G1 || '(' || G2 || ')'"),
    _hits("javascript", 2, "class", r"export\s+class\s+(\w+)", 1, "'class ' || G1"),
    _hits("javascript", 3, "const", r"export\s+const\s+(\w+)", 1, "'const ' || G1"),
])
_PY = " union all ".join([
    _py(1, "function", r"^def\s+(\w+)\s*\((.*?)\)", "'def ' || G1 || '(' || G2 || ')'"),
    _py(2, "class", r"^class\s+(\w+)", "'class ' || G1"),
])
_JAVA = " union all ".join([
    _hits("java", 1, "class", r"public\s+class\s+(\w+)", 1, "'public class ' || G1"),
    _hits("java", 2, "interface", r"public\s+interface\s+(\w+)", 1, "'public interface ' || G1"),
    _hits("java", 3, "method", r"public\s+(?:static\s+)?(\w+)\s+(\w+)\s*\((.*?)\)", 2, "'public ' || G1 || ' ' || G2 || '(' || G3 || ')'"),
])
_C = " union all ".join([
    _hits("c/c++", 1, "function", r"(?m)^[\w\s\*]+\s+(\w+)\s*\((.*?)\)\s*[;{]", 1, "G1 || '(' || G2 || ')'",
          keep="NAME not in ('if', 'while', 'for', 'switch')"),
    _hits("c/c++", 2, "struct", r"(?:typedef\s+)?struct\s+(\w+)", 1, "'struct ' || G1"),
])
_ALL = " union all ".join(f"select repo, path, language, step, ord, kind, name, signature, doc from ({p})" for p in (_GO, _JS, _PY, _JAVA, _C))
_POS = "row_number() over (partition by repo, path order by step, ord)"


def _symbols(sql):
    return f"with {_SRC} select repo, path, language, {_POS} as pos, kind, name, signature, doc from ({sql})"


def _imp(language, pattern):
    return (
        "select repo, path, language, unnest(h) as target, unnest(generate_series(1, len(h))) as ord from "
        f"(select *, regexp_extract_all(content, '{pattern}', 1) as h from src where language = '{language}')"
    )


_Q = "[''\"]"
_IMPORTS = " union all ".join([
    _imp("javascript", rf"import\s+.*?\s+from\s+{_Q}(.+?){_Q}"),
    _imp("java", r"import\s+(.+?);"),
    _imp("c/c++", r"#include\s+[<\"](.+?)[>\"]"),
    "select repo, path, language, regexp_extract(" + trim("line") + r", '^from\s+(\S+)\s+import\s+.+', 1) as target, ord from " + _PY_LINES
    + " where regexp_matches(" + trim("line") + r", '^from\s+(\S+)\s+import\s+.+')",
])
_PARTS = (
    f"{_SRC}, sym as (select *, {_POS} as pos from ({_ALL})), imp as (select *, row_number() over (partition by repo, path order by ord) as pos "
    f"from ({_IMPORTS})), "
    "sums as (select src.repo, src.path, src.language, case when language in ('go', 'javascript', 'python', 'java', 'c/c++') then '' "
    f"else 'File: ' || {base('src.path')} || ' (unsupported for detailed summarization)' end as doc from src)"
)
_RENDER = (
    "select s.repo, s.path, '# ' || s.path || E'\\n\\n' || case when doc <> '' then E'## Documentation\\n' || doc || E'\\n\\n' else '' end "
    "|| coalesce(E'## Imports\\n' || i.txt || E'\\n', '') || coalesce(E'## Exports\\n' || e.txt, '') as text from sums s "
    "left join (select repo, path, string_agg('- ' || target || E'\\n', '' order by pos) as txt from imp group by repo, path) i on s.repo = i.repo and s.path = i.path "
    "left join (select repo, path, string_agg('### ' || kind || ': ' || name || E'\\n```\\n' || signature || E'\\n```\\n' || "
    "case when doc <> '' then doc || E'\\n' else '' end || E'\\n', '' order by pos) as txt from sym group by repo, path) e "
    "on s.repo = e.repo and s.path = e.path"
)



def _nested_expected():
    """The rows by construction: nothing is parsed here."""
    def text(template):
        quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '")
        return f"replace(replace('{quoted}', '%K', o_orderkey::varchar), '%T', lower(o_orderstatus))"

    return " union all ".join(
        f"select 'p' || o_orderkey || '/a.go' as path, {pos}::bigint as pos, '{kind}' as kind, {text(name)} as name, "
        f"{text(signature)} as signature, {text(doc)} as doc from orders"
        for pos, (kind, name, signature, doc) in enumerate(NESTED_SYMBOLS, 1)
    )


ORACLES = {
    "go_symbols_nested": _nested_expected(),
    "go_symbols": _symbols(_GO),
    "js_symbols": _symbols(_JS),
    "py_symbols": _symbols(_PY),
    "java_symbols": _symbols(_JAVA),
    "c_symbols": _symbols(_C),
    "imports": f"with {_SRC} select repo, path, language, row_number() over (partition by repo, path order by ord) as pos, target from ({_IMPORTS})",
    "summarize": f"with {_PARTS} select s.repo, s.path, s.language, s.doc, coalesce(i.n, 0)::bigint as import_count, "
    "coalesce(e.n, 0)::bigint as symbol_count from sums s left join (select repo, path, count(*) as n from imp group by 1, 2) i "
    "on s.repo = i.repo and s.path = i.path left join (select repo, path, count(*) as n from sym group by 1, 2) e on s.repo = e.repo and s.path = e.path",
    "render_summary": f"with {_PARTS} {_RENDER}",
    "apply_summaries": f"with {_PARTS}, shown as ({_RENDER}) select src.repo, src.path, case when "
    "regexp_matches(src.path, '^src/(.*/)?[^/]*\\.js$|^(.*/)?[^/]*\\.py$|^lib/[^/]*\\.go$|^test/[^/]*$') then text else content end as content "
    "from src join shown on src.repo = shown.repo and src.path = shown.path",
}
