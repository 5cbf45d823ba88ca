"""Lint queries."""

from pyspark.sql import functions as F

from codestrata.operators import lint
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import any_contains, any_suffix, quote, split_lines, trim


def _code(op):
    return lambda spark, sf: op(load(spark, sf, "code"))


def _report(op, column, *args):
    def query(spark, sf):
        return op(load(spark, sf, "lintr").select("repo", F.col(column).alias("report")), *args)
    return query


QUERIES = {
    "lint_js": _code(lint.lint_js),
    "lint_go": _code(lint.lint_go),
    "lint_py": _code(lint.lint_py),
    "lint": lambda s, d: lint.lint(load(s, d, "code")).drop("stage", "seq"),
    "lint_summary": lambda s, d: lint.lint_summary(lint.lint(load(s, d, "code"))),
    "ingest_eslint": _report(lint.ingest_eslint, "eslint", "/work"),
    "ingest_pylint": _report(lint.ingest_pylint, "pylint", "/work"),
    "ingest_golint": _report(lint.ingest_golint, "golint"),
    "ingest_govet": _report(lint.ingest_govet, "golint"),
}

# --- oracle -----------------------------------------------------------------------

_LINES = f"lines as (select repo, path, line_no, line, {trim('line')} as t from ({split_lines('code')}))"


def _rule(linter, stage, seq, rule, where):
    name, severity, message, fixable = rule
    return (
        f"select repo, path, line_no as line, 0::bigint as \"column\", '{severity}' as severity, {quote(message)} as message, "
        f"'{name}' as rule, '{linter}' as linter, {str(fixable).lower()} as fixable, {stage} as stage, {seq} as seq from lines where {where}"
    )


_JS = " union all ".join(
    _rule("basic-js", 1, i, r, f"{any_suffix('path', ['.js', '.ts'])} and contains(line, '{m}') and not contains(line, '//')")
    for i, (m, r) in enumerate(lint.JS_RULES.items())
)
_GO = _rule(
    "basic-go", 2, 0, lint.GO_RULE,
    f"ends_with(path, '.go') and starts_with(t, '// ') and {any_contains('substr(t, 4)', ['func ', 'if '])}",
)
_PY = _rule("basic-py", 3, 0, lint.PY_RULE, "ends_with(path, '.py') and starts_with(t, 'print(')")
_ALL = f"{_JS} union all {_GO} union all {_PY}"
_C = 'repo, path, line, "column", severity, message, rule, linter, fixable'


def _cols(sql):
    return f"with {_LINES} select {_C} from ({sql})"


_COUNTS = " union all ".join(
    f"select repo, 'totals' as section, '{k}' as key, {e}::bigint as count from issues group by repo"
    for k, e in [
        ("total", "count(*)"), ("error", "count_if(severity = 'error')"), ("warning", "count_if(severity = 'warning')"),
        ("info", "count_if(severity = 'info')"), ("fixable", "count_if(fixable)"),
    ]
)


def _rel(x):
    return f"regexp_replace({x}, '^/work/', '')"


_J = f"(select repo, try_cast(eslint as json) as j from ({duck('lintr')}))"
_P = f"(select repo, try_cast(pylint as json) as j from ({duck('lintr')}))"
# fields: first three colon-separated parts and the remainder
_F = (
    "(select repo, p, p[1] as a, p[2] as b, p[3] as c, array_to_string(p[4:], ':') as d from (select repo, string_split(l, ':') as p from "
    f"(select repo, unnest(string_split(golint, chr(10))) as l from ({duck('lintr')}))) where len(p) >= 3)"
)


def _int(x):
    return f"(case when regexp_matches(trim({x}), '^[0-9]+$') then trim({x})::bigint else 0 end)"


ORACLES = {
    "lint_js": _cols(_JS),
    "lint_go": _cols(_GO),
    "lint_py": _cols(_PY),
    "lint": _cols(_ALL),
    "lint_summary": f"with {_LINES}, issues as ({_ALL}) {_COUNTS} "
    "union all select repo, 'linter', linter, count(*) from issues group by repo, linter "
    "union all select repo, 'file', path, count(*) from issues group by repo, path "
    "union all select repo, 'top', path || ':' || line || ' ' || rule, rn from (select *, row_number() over (partition by repo "
    "order by stage, path, line, seq) as rn from issues) where rn <= 10",
    "ingest_eslint": "select repo, path, (m->>'line')::bigint as line, (m->>'column')::bigint as \"column\", "
    "case when (m->>'severity')::int = 2 then 'error' else 'warning' end as severity, m->>'message' as message, m->>'ruleId' as rule, "
    "'eslint' as linter, json_type(m, '$.fix') is not null as fixable from (select repo, "
    f"{_rel(chr(40) + 'f->>' + quote('filePath') + chr(41))} as path, unnest(cast(f->'messages' as json[])) as m from "
    f"(select repo, unnest(cast(j as json[])) as f from {_J} where j is not null))",
    "ingest_pylint": f"select repo, {_rel(chr(40) + 'm->>' + quote('path') + chr(41))} as path, (m->>'line')::bigint as line, "
    "(m->>'column')::bigint as \"column\", case when m->>'type' in ('error', 'fatal') then 'error' when m->>'type' = 'warning' then 'warning' "
    "else 'info' end as severity, m->>'message' as message, m->>'symbol' as rule, 'pylint' as linter, false as fixable from "
    f"(select repo, unnest(cast(j as json[])) as m from {_P} where j is not null)",
    "ingest_golint": f"select repo, a as path, {_int('b')} as line, {_int('c')} as \"column\", 'warning' as severity, "
    f"trim(d) as message, '' as rule, 'golint' as linter, false as fixable from {_F}",
    "ingest_govet": f"select repo, a as path, {_int('b')} as line, 0::bigint as \"column\", 'error' as severity, "
    f"trim(case when len(p) > 3 then c || ':' || d else c end) as message, 'go-vet' as rule, 'go-vet' as linter, false as fixable from {_F}",
}
