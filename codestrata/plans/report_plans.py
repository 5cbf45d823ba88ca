"""Prompt, report and batch queries."""

from pyspark.sql import functions as F

from codestrata.operators import batches, report
from codestrata.plans.corpora import duck, load
from codestrata.plans.inventory_plans import ORACLES as INVENTORY
from codestrata.plans.oracle_parts import language
from codestrata.plans.token_plans import ORACLES as TOKENS
from codestrata.plans.tree_plans import ORACLES as TREES
from codestrata.session import scratch_path
from codestrata.sources.report_sink import commit_report, committed_parts
from codestrata.sources.sinks import write_report

BUDGET = 200_000


def _sink(fmt):
    """Write the report rows, read them back."""
    def query(spark, sf):
        location = scratch_path(spark, f"report-{fmt}")
        rows = report.project_report(load(spark, sf, "code"))
        if fmt == "txt":
            rows = rows.selectExpr("repo", "section", "key", "concat_ws(' ', section, key, value) as text")
        write_report(rows, fmt, location, ["section", "key"])
        if fmt == "txt":
            return spark.read.text(location).selectExpr("repo", "value as text")
        if fmt == "json":
            back = spark.read.schema("section string, key string, value string, repo string").json(location)
        else:
            back = spark.read.format("xml").option("rowTag", "row").schema(
                "section string, key string, value string, repo string"
            ).load(location)
        return back.selectExpr("repo", "section", "key", "coalesce(value, '') as value")
    return query


def _prompt_sink(spark, sf):
    location = scratch_path(spark, "prompt")
    write_report(report.prompt_text(load(spark, sf, "code")), "txt", location, report.PROMPT_ORDER)
    return spark.read.text(location).selectExpr("repo", "value as line")


def _committed(kind):
    """Two runs of one report, the second repeated, read back from the committed files of that one."""
    def query(spark, sf):
        folder = scratch_path(spark, f"reports-{kind}").removeprefix("file://").removeprefix("file:")
        rows = report.project_report(load(spark, sf, "docs"))
        keys = ["repo", "section", "key"]
        commit_report(rows.limit(0), kind, folder, "r1", "corpus", keys)
        for _ in range(2):
            location = commit_report(rows, kind, folder, "r2", "corpus", keys)
        names = spark.createDataFrame([(f,) for f in committed_parts(location)], "file string")
        fields = "repo string, section string, key string, value string"
        lines = spark.read.text([r["file"] for r in names.collect()])
        if kind == "json":
            row = F.from_json(F.regexp_replace("value", r"\A,", ""), fields)
            return lines.filter("startswith(value, ',')").select(row.alias("r")).select("r.*")
        row = F.from_xml("value", fields)
        return lines.filter("startswith(value, '<row>')").select(row.alias("r")).select("r.*").withColumn("value", F.coalesce("value", F.lit("")))
    return query


QUERIES = {
    "report_commit_json": _committed("json"),
    "report_commit_xml": _committed("xml"),
    "prompt_text": lambda s, d: report.prompt_text(load(s, d, "docs")),
    "prompt_sink": _prompt_sink,
    "project_report": lambda s, d: report.project_report(load(s, d, "code")),
    "render_report_json": lambda s, d: report.render_report(report.project_report(load(s, d, "docs")), "json"),
    "render_report_xml": lambda s, d: report.render_report(report.project_report(load(s, d, "docs")), "xml"),
    "render_report_txt": lambda s, d: report.render_report(report.project_report(load(s, d, "docs")), "txt", 40),
    "report_sink_json": _sink("json"),
    "report_sink_xml": _sink("xml"),
    "report_sink_txt": _sink("txt"),
    "pack_batches": lambda s, d: batches.pack_batches(load(s, d, "docs"), BUDGET),
}

# --- oracle ----------------------------------------------------------------------


def _on(sql: str, old: str, new: str) -> str:
    return sql.replace(f"({duck(old)})", f"({duck(new)})")


def _report(corpus: str) -> str:
    stats = _on(TOKENS["project_stats"], "docs", corpus)
    parts = [
        f"select repo, 'statistics' as section, '{n}' as key, {n}::varchar as value from ({stats})"
        for n in ("file_count", "total_size", "avg_file_size", "token_count", "char_count")
    ]
    parts += [
        f"select repo, 'technologies', technology, '' from ({_on(INVENTORY['technologies'], 'inv', corpus)})",
        f"select repo, 'key_files', path, '' from ({_on(INVENTORY['key_files'], 'inv', corpus)})",
        f"select repo, 'issues', issue, '' from ({_on(INVENTORY['project_issues'], 'inv', corpus)})",
        f"select repo, 'file_types', extension, file_count::varchar from ({_on(INVENTORY['file_types'], 'inv', corpus)})",
        f"select repo, 'files', path, size || ' ' || {language()} from ({duck(corpus)}) where content <> ''",
    ]
    return " union all ".join(parts)


_TREE = _on(TREES["tree_text"], "inv", "docs")
_PROMPT = " union all ".join([
    f"select distinct repo, 1::bigint as section, 0::bigint as line_no, '' as path, 0::bigint as part, "
    f"chr(10) || 'PROJECT STRUCTURE:' || chr(10) || repeat('-', 53) || chr(10) as text from ({duck('docs')})",
    f"select repo, 2, line_no, '', 0, text from ({_TREE})",
    f"select distinct repo, 3, 0, '', 0, chr(10) || 'FILE CONTENTS:' || chr(10) || repeat('-', 53) from ({duck('docs')})",
    f"select repo, 4, 0, path, 0, chr(10) || repeat('=', 48) || chr(10) || 'File: ' || path || chr(10) || repeat('=', 48) from ({duck('docs')}) where content <> ''",
    f"select repo, 4, 0, path, 1, content from ({duck('docs')}) where content <> ''",
])
_PAIRS = ", ".join(
    f"'{s}', coalesce(to_json(list({{'key': key, 'value': value}} order by key) filter (section = '{s}')), '[]'::json)"
    for s in report.SECTIONS
)
_RANKED = f"select *, row_number() over (partition by repo order by section, key) as rank from ({_report('docs')})"

ORACLES = {
    "report_commit_json": _report("docs"),
    "report_commit_xml": _report("docs"),
    "prompt_text": _PROMPT,
    "prompt_sink": f"select repo, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) as line from ({_on(_PROMPT, 'docs', 'code')})",
    "project_report": _report("code"),
    "render_report_json": f"select repo, 0::bigint as part, json_object('name', repo, 'part', 0, {_PAIRS})::varchar as document from ({_report('docs')}) group by repo",
    "render_report_txt": "select repo, part, 'PROJECT: ' || repo || chr(10) || string_agg(section || ': ' || key || ' ' || value, chr(10) order by rank) as document "
    f"from (select *, (rank - 1) // 40 as part from ({_RANKED})) group by repo, part",
    "report_sink_json": _report("code"),
    "report_sink_xml": _report("code"),
    "report_sink_txt": f"select repo, case when value = '' then section || ' ' || key || ' ' else section || ' ' || key || ' ' || value end as text from ({_report('code')})",
    # the sequential rule as a recursive walk over the ordered files
    "pack_batches": f"""with recursive numbered as (select repo, path, size, row_number() over (partition by repo order by path) as n from ({duck('docs')})),
walk(repo, path, size, n, held, batch_id) as (
  select repo, path, size, n, size, 0::bigint from numbered where n = 1
  union all
  select x.repo, x.path, x.size, x.n, case when held + x.size > {BUDGET} and held > 0 then x.size else held + x.size end,
    case when held + x.size > {BUDGET} and held > 0 then batch_id + 1 else batch_id end
  from walk join numbered x on x.repo = walk.repo and x.n = walk.n + 1)
select repo, path, size, batch_id, false as direct from walk""",
}
