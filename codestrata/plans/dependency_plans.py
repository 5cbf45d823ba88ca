"""Manifest, dependency and advisory queries."""

from codestrata.functions import rules
from codestrata.operators import advisories, dependencies
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import quote, split_lines, trim
from codestrata.sources.manifests import json_section
from codestrata.sources.sinks import write_vuln_report
from codestrata.session import scratch_path, stage
from pyspark.sql import Window, functions as F

_MAN = duck("man")


def _on_man(op):
    return lambda spark, sf: op(load(spark, sf, "man"))


def _on_deps(op):
    return lambda spark, sf: op(dependencies.dependencies(load(spark, sf, "man")))


def _checked(spark, sf):
    # parsed once; the checks read the narrow dependency rows
    deps = stage(dependencies.dependencies(load(spark, sf, "man")))
    return deps, advisories.check_dependencies(deps, advisories.load_advisories(spark)), advisories.outdated(deps)


def _known(strict):
    def run(spark, sf):
        deps = dependencies.dependencies(load(spark, sf, "man"))
        return advisories.match_advisories(deps, advisories.load_advisories(spark), strict)
    return run


def _vuln_report(spark, sf):
    _, findings, old = _checked(spark, sf)
    location = scratch_path(spark, "vuln-report")
    write_vuln_report(findings, old, location)
    return spark.read.json(f"{location}/summary").select(
        "repo", "total_vulnerabilities", "critical", "high", "medium", "low", "total_outdated"
    )


#: Entries of one feed file.
FEED_ENTRIES = 20_000


def _feed(spark, sf):
    """JSON objects with an entry per source, written from the documents, read by tasks of 64 KiB.

    Each object is written by one task, so there are as many as keep it to about
    FEED_ENTRIES entries; a name is always in the same one.
    """
    folder = scratch_path(spark, "feed").removeprefix("file://").removeprefix("file:")
    item = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("version"), F.lit("low").alias("severity"), F.coalesce("text", F.lit("")).alias("description")
    ))
    name = F.concat("source", F.lit("/"), "doc_id")
    entry = F.concat(F.to_json(F.array(name)), F.lit(":["), item, F.lit("]"))
    entry = F.regexp_replace(entry, r"\A\[(.*?)\]:", "$1:")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("source is not null")
    files = max(1, -(-docs.count() // FEED_ENTRIES))
    rows = docs.select(F.pmod(F.xxhash64(name), F.lit(files)).cast("int").alias("file"), "doc_id", entry.alias("entry"))
    order = Window.partitionBy("file").orderBy("doc_id")
    rows.select("file", F.concat(
        F.when(F.lag(F.lit(1)).over(order).isNull(), "{\n").otherwise(""), "entry",
        F.when(F.lead(F.lit(1)).over(order).isNull(), "\n}").otherwise(","),
    ).alias("value")).write.partitionBy("file").text(folder)
    rows = advisories.feed_advisories(spark, folder, 1 << 16)
    return rows.select("name", "version", "severity", F.md5("description").alias("digest"))


QUERIES = {
    "advisory_feed": _feed,
    "json_section": lambda s, d: json_section(load(s, d, "man").filter("path = 'package.json'"), "dependencies"),
    "node_deps": _on_man(dependencies.node_deps),
    "go_deps": _on_man(dependencies.go_deps),
    "python_requirements": _on_man(dependencies.python_requirements),
    "pyproject_deps": _on_man(dependencies.pyproject_deps),
    "pipfile_deps": _on_man(dependencies.pipfile_deps),
    "cargo_deps": _on_man(dependencies.cargo_deps),
    "gemfile_deps": _on_man(dependencies.gemfile_deps),
    "composer_deps": _on_man(dependencies.composer_deps),
    "dependencies": _on_man(dependencies.dependencies),
    "dependency_analysis": _on_deps(dependencies.dependency_analysis),
    "dependency_summary": _on_deps(dependencies.dependency_summary),
    "external_dep_count": _on_man(dependencies.external_dep_count),
    "match_advisories": _known(False),
    "match_advisories_strict": _known(True),
    "deprecated_packages": _on_deps(advisories.deprecated),
    "very_old_versions": _on_deps(advisories.very_old),
    "prerelease_versions": _on_deps(advisories.prerelease),
    "outdated_packages": _on_deps(advisories.outdated),
    "check_dependencies": lambda s, d: _checked(s, d)[1],
    "vuln_summary": lambda s, d: advisories.vuln_summary(*_checked(s, d)[1:]),
    "vuln_report": _vuln_report,
}

# --- oracle --------------------------------------------------------------------

_LINES = (
    f"lines as (select repo, path, line_no, {trim('line')} as line from ({split_lines('man')}))"
)


def _json(ecosystem, manifest, sections, skip="false"):
    parts = []
    for field, kind in sections.items():
        parts.append(
            f"select repo, name, json_extract_string(j, '$.\"{field}\".\"' || name || '\"') as version, '{kind}' as type "
            f"from (select repo, j, unnest(json_keys(j, '$.\"{field}\"')) as name from "
            f"(select repo, try_cast(content as json) as j from ({_MAN}) where path = '{manifest}') where j is not null "
            f"and json_type(j, '$.\"{field}\"') = 'OBJECT') "
            f"where json_type(j, '$.\"{field}\".\"' || name || '\"') = 'VARCHAR' and not ({skip.replace('KIND', quote(kind))})"
        )
    return (
        f"select repo, '{ecosystem}' as ecosystem, '{manifest}' as manifest, name, version, type, true as direct, "
        f"cast(null as bigint) as line_no from ({' union all '.join(parts)})"
    )


def _stated(manifest, mark):
    return (
        "select *, last_value(mark ignore nulls) over (partition by repo order by line_no rows unbounded preceding) as state "
        f"from (select *, {mark} as mark from lines where path = '{manifest}')"
    )


_NODE = _json("Node.js", "package.json", rules.NODE_SECTIONS)
_PHP = _json("PHP", "composer.json", rules.COMPOSER_SECTIONS, "name = 'php' and KIND = 'production'")
_GO = (
    "select repo, 'Go' as ecosystem, path as manifest, w[1] as name, w[2] as version, "
    "case when contains(line, '// indirect') then 'development' else 'production' end as type, "
    "not contains(line, '// indirect') as direct, line_no from (select *, regexp_extract_all(line, '[^ \\t]+') as w from "
    "(select repo, path, line_no, trim(regexp_replace(line, '^require ', '')) as line from ("
    + _stated("go.mod", "case when starts_with(line, 'require (') then 'b' when line = ')' then 'x' end")
    + ") where mark is null and (state = 'b' or starts_with(line, 'require ')))) where len(w) >= 2 and not starts_with(line, '//')"
)
_REQ_RE = "^([a-zA-Z0-9\\-_.]+)([><=!~]+)?(.*)$"
_REQ = (
    "select repo, 'Python' as ecosystem, path as manifest, regexp_extract(line, '" + _REQ_RE + "', 1) as name, "
    "regexp_extract(line, '" + _REQ_RE + "', 2) || regexp_extract(line, '" + _REQ_RE + "', 3) as version, "
    "case when path = 'requirements.txt' then 'production' else 'development' end as type, true as direct, line_no from lines "
    "where path in ('requirements.txt', 'requirements-dev.txt') and line <> '' and not starts_with(line, '#') "
    "and regexp_matches(line, '" + _REQ_RE + "')"
)


def _toml(ecosystem, manifest, mark):
    return (
        f"select repo, '{ecosystem}' as ecosystem, path as manifest, trim(split_part(line, '=', 1)) as name, "
        "trim(trim(substr(line, instr(line, '=') + 1)), '\"''') as version, "
        "case state when 'p' then 'production' else 'development' end as type, true as direct, line_no from ("
        + _stated(manifest, mark) + ") where mark is null and state in ('p', 'd') and contains(line, '=')"
    )


_PYPROJECT = _toml(
    "Python", "pyproject.toml",
    "case when starts_with(line, '[tool.poetry.dependencies]') then 'p' when starts_with(line, '[tool.poetry.dev-dependencies]') "
    "or starts_with(line, '[tool.poetry.group.dev.dependencies]') then 'd' when starts_with(line, '[') then 'x' end",
)
_PIPFILE = _toml(
    "Python", "Pipfile",
    "case when line = '[packages]' then 'p' when line = '[dev-packages]' then 'd' when starts_with(line, '[') then 'x' end",
)
_CARGO = _toml(
    "Rust", "Cargo.toml",
    "case when line = '[dependencies]' then 'p' when line in ('[dev-dependencies]', '[build-dependencies]') then 'd' "
    "when starts_with(line, '[') then 'x' end",
)
_GEM_RE = "gem\\s+['\"\"]([^'\"\"]+)['\"\"](?:\\s*,\\s*['\"\"]([^'\"\"]+)['\"\"])?".replace('""', '"').replace("'", "''")
_GEM = (
    f"select repo, 'Ruby' as ecosystem, path as manifest, regexp_extract(line, '{_GEM_RE}', 1) as name, "
    f"regexp_extract(line, '{_GEM_RE}', 2) as version, case when contains(line, 'group:') and (contains(line, 'development') "
    "or contains(line, 'test')) then 'development' else 'production' end as type, true as direct, line_no from lines "
    f"where path = 'Gemfile' and starts_with(line, 'gem ') and regexp_matches(line, '{_GEM_RE}')"
)
_ALL = " union all ".join(f"({p})" for p in (_NODE, _GO, _REQ, _PYPROJECT, _PIPFILE, _CARGO, _GEM, _PHP))
DEPS = f"{_LINES}, deps as ({_ALL})"

_ECO = {e: e.lower().replace(".", "") + "_count" for e in dependencies.ECOSYSTEMS}
_ANALYSIS = (
    "select repo, count(*)::bigint as total, "
    + ", ".join(f"count_if(type = '{k}')::bigint as {k}_count" for k in ("production", "development", "optional", "peer"))
    + ", count_if(direct)::bigint as direct_count, count_if(not direct)::bigint as transitive_count, "
    + ", ".join(f"count_if(ecosystem = '{e}')::bigint as {c}" for e, c in _ECO.items())
    + " from deps group by repo"
)
_SUMMARY = " union all ".join(
    [
        f"select repo, 'totals' as section, '{key}' as key, {c} as count from totals{w}"
        for key, c, w in [
            ("Total Dependencies", "total", ""), ("Production", "production_count", ""),
            ("Development", "development_count", ""), ("Optional", "optional_count", " where optional_count > 0"),
            ("Direct Dependencies", "direct_count", ""),
            ("Transitive Dependencies", "transitive_count", " where transitive_count > 0"),
        ]
    ]
    + [f"select repo, 'ecosystem', '{e}', {c} from totals where {c} > 0" for e, c in _ECO.items()]
)


def _clean(x: str) -> str:
    for p in rules.VERSION_PREFIXES:
        x = f"regexp_replace({x}, '^{chr(92) if p == '^' else ''}{p}', '')"
    return f"trim({x})"


_ADV = "adv(aname, aver, severity, cve_id, description, recommendation) as (values " + ", ".join(
    "(" + ", ".join(quote(v) for v in row) + ")" for row in rules.ADVISORIES
) + ")"
_OUT = "repo, ecosystem, manifest, name, version, type, line_no"


def _known_sql(clean) -> str:
    return (
        f"select {_OUT}, aver as advisory_version, severity, cve_id, description, recommendation from deps join adv on name = aname "
        f"where starts_with({clean('version')}, {clean('aver')})"
    )


def _finding(where, severity, description, recommendation) -> str:
    return (
        f"select {_OUT}, cast(null as varchar) as advisory_version, '{severity}' as severity, '' as cve_id, "
        f"{description} as description, '{recommendation}' as recommendation from deps where {where}"
    )


_DEPRECATED = (
    f"select {_OUT}, cast(null as varchar) as advisory_version, 'medium' as severity, '' as cve_id, "
    "'Package is deprecated: ' || reason as description, 'Consider migrating to an alternative package' as recommendation "
    "from deps join (values " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in rules.DEPRECATED.items())
    + ") d(dname, reason) on name = dname"
)
_OLD = _finding(
    "regexp_matches(version, '^[~^>=<]*([0-2])\\.') and regexp_extract(version, '^[~^>=<]*([0-2])\\.', 1) = '0'", "medium",
    "'Package version is very old and may contain known vulnerabilities'", "Update to the latest stable version",
)
_PRE = _finding(
    "type = 'production' and regexp_matches(lower(version), 'alpha|beta|rc|pre|preview|canary|next|dev')", "low",
    "'Using pre-release version in production dependencies'", "Use stable release versions for production",
)
_OUTDATED = (
    "select repo, ecosystem, manifest, name, version as current_version, 'unknown' as latest_version, type, line_no from deps "
    f"where starts_with({_clean('version')}, '0.0.')"
)
_CHECKS = f"{_known_sql(_clean)}", _OLD, _PRE, _DEPRECATED
_FINDINGS = " union all ".join(f"select *, {i}::bigint as stage from ({c})" for i, c in enumerate(_CHECKS, start=1))
_CHECKED = f"{DEPS}, {_ADV}, findings as ({_FINDINGS}), outdated as ({_OUTDATED})"
_COUNTS = (
    "counts as (select repo, count_if(severity <> 'outdated')::bigint as total_vulnerabilities, "
    + ", ".join(f"count_if(severity = '{s}')::bigint as {s}" for s in rules.SEVERITY_RANK)
    + ", count_if(severity = 'outdated')::bigint as total_outdated from (select repo, severity from findings union all "
    "select repo, 'outdated' from outdated) group by repo)"
)
_ORDER = (
    "case ecosystem when 'Node.js' then 0 when 'Go' then 1 when 'Python' then 2 when 'Rust' then 3 when 'Ruby' then 4 else 5 end, "
    "case manifest when 'requirements.txt' then 0 when 'requirements-dev.txt' then 1 when 'pyproject.toml' then 2 when 'Pipfile' then 3 else -1 end, "
    "coalesce(line_no, 0), case type when 'production' then 1 when 'development' then 2 when 'optional' then 3 else 4 end, name"
)
_VULN_SUMMARY = (
    f"with {_CHECKED}, {_COUNTS}, top as (select *, row_number() over (partition by repo order by "
    "case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end, "
    f"{_ORDER}, version, stage, advisory_version nulls first, cve_id) as rn from findings), old as (select *, row_number() over "
    f"(partition by repo order by {_ORDER}, current_version) as rn from outdated) "
    + " union all ".join(
        f"select repo, 'count' as section, {i}::bigint as rank, '{s}: ' || {s} as text from counts where {s} > 0"
        for s, i in rules.SEVERITY_RANK.items()
    )
    + " union all select repo, 'outdated', 6, '... and ' || (total_outdated - 5) || ' more' from counts where total_outdated > 5"
    " union all select repo, 'top', rn, name || '@' || version || ' [' || severity || ']' || chr(10) || '    ' || description "
    "|| case when cve_id <> '' then chr(10) || '    CVE: ' || cve_id else '' end || chr(10) || '    Fix: ' || recommendation from top where rn <= 5"
    " union all select repo, 'outdated', rn, name || ': ' || current_version from old where rn <= 5"
)


def _deps(sql: str) -> str:
    return f"with {DEPS} {sql}"


def _eco(part: str) -> str:
    return f"with {_LINES} {part}"


ORACLES = {
    "advisory_feed": "select source || '/' || doc_id as name, doc_id::varchar as version, 'low' as severity, md5(coalesce(text, '')) as digest "
    "from documents where source is not null",
    "json_section": "select repo, 'package.json' as path, name, version from (" + _json("x", "package.json", {"dependencies": "p"}) + ")",
    "node_deps": _NODE,
    "go_deps": _eco(_GO),
    "python_requirements": _eco(_REQ),
    "pyproject_deps": _eco(_PYPROJECT),
    "pipfile_deps": _eco(_PIPFILE),
    "cargo_deps": _eco(_CARGO),
    "gemfile_deps": _eco(_GEM),
    "composer_deps": _PHP,
    "dependencies": _deps("select * from deps"),
    "dependency_analysis": _deps(_ANALYSIS),
    "dependency_summary": f"with {DEPS}, totals as ({_ANALYSIS}) {_SUMMARY}",
    "external_dep_count": _eco(
        "select repo, sum(case when path = 'go.mod' then starts_with(line, 'require ') "
        "when path = 'package.json' then contains(line, 'dependencies') or contains(line, 'devDependencies') "
        "else line <> '' and not starts_with(line, '#') end::int)::bigint as external_deps from lines "
        "where path in ('go.mod', 'package.json', 'requirements.txt') group by repo"
    ),
    "match_advisories": f"with {DEPS}, {_ADV} {_known_sql(_clean)}",
    "match_advisories_strict": f"with {DEPS}, {_ADV} "
    + _known_sql(lambda x: f"trim(regexp_replace({x}, '^[\\^~><=! ]*v?', ''))"),
    "deprecated_packages": _deps(_DEPRECATED),
    "very_old_versions": _deps(_OLD),
    "prerelease_versions": _deps(_PRE),
    "outdated_packages": _deps(_OUTDATED),
    "check_dependencies": f"with {_CHECKED} select * from findings",
    "vuln_summary": _VULN_SUMMARY,
    "vuln_report": f"with {_CHECKED}, {_COUNTS} select * from counts",
}
