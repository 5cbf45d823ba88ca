"""Line analytics queries."""

from codestrata.functions import rules
from codestrata.operators import quality
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import any_contains, base, in_list, language, quote, scan_lines, split_lines, trim
from codestrata.sources.lines import explode_lines
from pyspark.sql import functions as F


def _with(op, corpus="code", **kwargs):
    return lambda spark, sf: op(load(spark, sf, corpus), **kwargs)


def _rounded(op, *columns, corpus="code"):
    def run(spark, sf):
        df = op(load(spark, sf, corpus))
        return df.withColumns({c: F.round(c, 6) for c in columns})
    return run


def _explode(model):
    def run(spark, sf):
        rows = explode_lines(load(spark, sf, "docs"), model)
        return rows.select("repo", "path", "line_no", F.md5("line").alias("line_md5"))
    return run


# --- oracle ------------------------------------------------------------------


def facts(corpus: str) -> str:
    """Line facts with the block state as a window over the file."""
    block = in_list(rules.BLOCK_COMMENT_LANGUAGES)
    tokens = " + ".join(
        f"len(regexp_extract_all(line, {quote(chr(92) + 'b' + t + chr(92) + 'b')}))"
        for t in rules.COMPLEXITY_WORDS + rules.COMPLEXITY_SIGNS
    )
    debug = any_contains("line", rules.DEBUG_MARKS)
    colon = in_list(rules.COLON_NESTING_LANGUAGES)

    def count(ch):
        return f"(len(line) - len(replace(line, '{ch}', '')))"

    smells = [
        "strlen(line) > 120",
        f"language not in {colon} and {count(';')} > 1",
        "contains(upper(line), 'TODO')", "contains(upper(line), 'FIXME')", "contains(upper(line), 'HACK')",
        debug,
        f"not contains(text, 'const') and not contains(text, 'final') and regexp_matches(line, {quote(rules.MAGIC_NUMBER)})",
        "len(line) - len(ltrim(line, concat(' ', chr(9)))) > 32",
    ]
    smell_cols = ", ".join(f"(text <> '' and {s})::bigint as smell_{i}" for i, s in enumerate(smells))
    return f"""
raw as (select *, {trim('line')} as text from ({scan_lines(corpus, 'repo, path')})),
marked as (select *, {language()} as language,
  case when ends_with(text, '*/') then 0 when starts_with(text, '/*') then 1 end as event from raw),
stated as (select *, coalesce(last_value(event ignore nulls) over (partition by repo, path order by line_no
  rows between unbounded preceding and 1 preceding), 0) as in_block from marked),
classed as (select *, case when text = '' then 'blank'
  when language in {block} and (starts_with(text, '//') or starts_with(text, '/*') or in_block = 1) then 'comment'
  when language in ('Python', 'Ruby', 'Shell') and starts_with(text, '#') then 'comment'
  when language in ('HTML', 'XML') and starts_with(text, '<!--') then 'comment'
  when language = 'CSS' and starts_with(text, '/*') then 'comment' else 'code' end as kind from stated),
facts as (select *, case when text = '' then 0 else {tokens} end as complexity,
  text <> '' and case when language = 'Go' then starts_with(text, 'func ')
    when language in ('JavaScript', 'TypeScript') then contains(line, 'function ')
      or regexp_matches(line, '=>\\s*{{') or regexp_matches(line, '\\w+\\s*\\([^)]*\\)\\s*{{')
    when language in ('Python', 'Ruby') then starts_with(text, 'def ')
    when language in ('Java', 'C', 'C++', 'C#') then regexp_matches(line, '\\w+\\s+\\w+\\s*\\([^)]*\\)\\s*{{')
    else false end as is_function,
  text <> '' and case when language = 'Go' then starts_with(text, 'type ') and contains(text, 'struct')
    when language in ('JavaScript', 'TypeScript', 'Python', 'Ruby') then starts_with(text, 'class ')
    when language in ('Java', 'C++', 'C#') then starts_with(text, 'class ') or starts_with(text, 'public class ')
      or starts_with(text, 'private class ') else false end as is_class,
  case when text = '' then 0 else {count('{')} - {count('}')}
    + case when language in {colon} and ends_with(text, ':') then 1 else 0 end end as delta,
  {smell_cols} from classed),
depths as (select *, sum(delta) over (partition by repo, path order by line_no) as depth from facts),
per_file as (select f.repo, f.path, {language('f.path')} as language,
  greatest(0, coalesce(max(depth), 0))::bigint as max_nesting,
  count(line_no)::bigint as lines, count_if(kind = 'code')::bigint as code_lines,
  count_if(kind = 'comment')::bigint as comment_lines, count_if(kind = 'blank')::bigint as blank_lines,
  coalesce(sum(complexity), 0)::bigint as complexity, count_if(is_function)::bigint as functions,
  count_if(is_class)::bigint as classes,
  coalesce(sum({' + '.join(f'smell_{i}' for i in range(8))}), 0)::bigint as smells,
  {', '.join(f'coalesce(sum(smell_{i}), 0)::bigint as smell_{i}' for i in range(8))}
  from ({duck(corpus)}) f left join depths d on f.repo = d.repo and f.path = d.path group by all),
per_repo as (select repo, count(*)::bigint as total_files, sum(lines)::bigint as total_lines,
  sum(code_lines)::bigint as code_lines, sum(comment_lines)::bigint as comment_lines,
  sum(blank_lines)::bigint as blank_lines, sum(complexity) / count(*) as avg_complexity,
  sum(smells)::bigint as smells,
  count_if(contains(lower({base()}), 'test') or contains(lower({base()}), 'spec'))::bigint as test_files,
  {', '.join(f'sum(smell_{i})::bigint as smell_{i}' for i in range(8))}
  from per_file group by repo),
scored as (select *, test_files / total_files * 100 as test_coverage,
  case when code_lines = 0 then 100.0 else least(100.0, greatest(0.0, 171.0
    - 5.2 * (length(bin(floor(code_lines::double * 1.2)::bigint)) - 1) - 0.23 * (avg_complexity * 2.0)
    - 16.2 * (length(bin(code_lines)) - 1) + comment_lines / total_lines * 20.0 - smells * 0.5)) end::double as maintainability
  from per_repo)"""


_SMELL_NAMES = [
    rules.SMELL_LONG, rules.SMELL_MULTI, rules.SMELL_TODO, rules.SMELL_FIXME,
    rules.SMELL_HACK, rules.SMELL_DEBUG, rules.SMELL_MAGIC, rules.SMELL_DEEP,
]


def _trunc(x: str, digits: int) -> str:
    out = f"floor({x})::bigint::varchar || '.'"
    step = f"(({x}) - floor({x}))"
    for _ in range(digits):
        step = f"({step} * 10)"
        out += f" || (floor({step})::bigint % 10)::varchar"
    return f"({out})"


def _smell_sql(corpus: str) -> str:
    parts = " union all ".join(
        f"select repo, path, language, line_no, {quote(name)} as smell from facts where smell_{i} = 1"
        for i, name in enumerate(_SMELL_NAMES)
    )
    return f"with {facts(corpus)} {parts}"


def _summary_sql() -> str:
    def share(c):
        return f"{c}::varchar || case when total_lines > 0 then ' (' || {_trunc(f'{c} / total_lines * 100', 1)} || '%)' else '' end"

    rows = {
        "Total Files": "total_files::varchar", "Total Lines": "total_lines::varchar",
        "Code Lines": share("code_lines"), "Comment Lines": share("comment_lines"),
        "Blank Lines": "blank_lines::varchar",
        "Average Cyclomatic Complexity": _trunc("avg_complexity", 2),
        "Test Coverage Estimate": f"{_trunc('test_coverage', 1)} || '% (' || test_files || ' test files)'",
        "Maintainability Index": f"{_trunc('maintainability', 1)} || '/100'",
    }
    parts = [f"select repo, 'totals' as section, {quote(k)} as key, {v} as value from scored" for k, v in rows.items()]
    parts.append("select repo, 'totals', 'Code Smells Detected', smells::varchar from scored where smells > 0")
    parts += [
        f"select repo, 'smell', {quote(n)}, smell_{i}::varchar from scored where smell_{i} > 0"
        for i, n in enumerate(_SMELL_NAMES)
    ]
    parts.append(
        "select repo, 'language', language, count(*) || ' files, ' || sum(lines)::bigint || ' lines' from per_file group by repo, language"
    )
    return f"with {facts('code')} " + " union all ".join(parts)


def _lang_sql() -> str:
    return (
        f"with {facts('code')} select repo, language, count(*)::bigint as file_count, sum(lines)::bigint as lines, "
        "sum(code_lines)::bigint as code_lines, sum(comment_lines)::bigint as comment_lines, "
        "sum(blank_lines)::bigint as blank_lines, round(sum(complexity) / count(*), 6) as avg_complexity "
        "from per_file group by repo, language"
    )


QUERIES = {
    "lines_scan": _explode("scan"),
    "lines_split": _explode("split"),
    "classify_lines": _with(quality.classify_lines),
    "line_complexity": _with(quality.line_complexity),
    "line_complexity_docs": _with(quality.line_complexity, "docs"),
    "declarations": _with(quality.declarations),
    "nesting_depth": _with(quality.nesting_depth),
    "line_smells": _with(quality.line_smells),
    "line_smells_docs": _with(quality.line_smells, "docs"),
    "file_metrics": _with(quality.file_metrics),
    "language_metrics": _rounded(quality.language_metrics, "avg_complexity"),
    "project_metrics": _rounded(quality.project_metrics, "avg_complexity", "test_coverage", "maintainability"),
    "project_metrics_docs": _rounded(
        quality.project_metrics, "avg_complexity", "test_coverage", "maintainability", corpus="docs"
    ),
    "test_coverage": _rounded(quality.test_coverage, "test_coverage"),
    "quality_summary": _with(quality.quality_summary),
}

_PROJECT = (
    "select repo, total_files, total_lines, code_lines, comment_lines, blank_lines, round(avg_complexity, 6) as avg_complexity, "
    "smells, test_files, round(test_coverage, 6) as test_coverage, round(maintainability, 6) as maintainability from scored"
)

ORACLES = {
    "lines_scan": f"select repo, path, line_no, md5(line) as line_md5 from ({scan_lines('docs')})",
    "lines_split": f"select repo, path, line_no, md5(line) as line_md5 from ({split_lines('docs')})",
    "classify_lines": f"with {facts('code')} select repo, path, language, line_no, kind from facts",
    "line_complexity": f"with {facts('code')} select repo, path, line_no, complexity::bigint as complexity from facts where text <> ''",
    "line_complexity_docs": f"with {facts('docs')} select repo, path, line_no, complexity::bigint as complexity from facts where text <> ''",
    "declarations": f"with {facts('code')} select repo, path, language, line_no, is_function, is_class from facts where is_function or is_class",
    "nesting_depth": f"with {facts('code')} select repo, path, language, max_nesting from per_file",
    "line_smells": _smell_sql("code"),
    "line_smells_docs": _smell_sql("docs"),
    "file_metrics": f"with {facts('code')} select repo, path, language, max_nesting, lines, code_lines, comment_lines, "
    "blank_lines, complexity, functions, classes, smells from per_file",
    "language_metrics": _lang_sql(),
    "project_metrics": f"with {facts('code')} {_PROJECT}",
    "project_metrics_docs": f"with {facts('docs')} {_PROJECT}",
    "test_coverage": f"with {facts('code')} select repo, total_files as analysed_files, test_files, round(test_coverage, 6) as test_coverage from scored",
    "quality_summary": _summary_sql(),
}
