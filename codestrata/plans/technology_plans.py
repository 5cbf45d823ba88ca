"""Technology detection queries."""

from pyspark.sql import functions as F

from codestrata.functions import rules
from codestrata.operators import technology
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import base, case_map, ext, quote

_MAN, _INV = duck("man"), duck("inv")


def _run(op, corpus):
    def query(spark, sf):
        df = op(load(spark, sf, corpus))
        return df.withColumn("confidence", F.round("confidence", 6)) if "confidence" in df.columns else df
    return query


QUERIES = {
    "language_confidence": _run(technology.language_confidence, "inv"),
    "language_versions": _run(technology.language_versions, "man"),
    "frontend_frameworks": _run(technology.frontend_frameworks, "man"),
    "backend_frameworks": _run(technology.backend_frameworks, "man"),
    "build_tools": _run(technology.build_tools, "inv"),
    "databases": _run(technology.databases, "man"),
    "testing_frameworks": _run(technology.testing_frameworks, "man"),
    "containerization": _run(technology.containerization, "inv"),
    "cicd": _run(technology.cicd, "inv"),
    "detect_all": _run(technology.detect_all, "man"),
    "detect_all_inv": _run(technology.detect_all, "inv"),
}

# --- oracle ---------------------------------------------------------------------


def _files(corpus, where):
    return f"(select repo, path, content from ({duck(corpus)}) where {where})"


def _values(table):
    return "(values " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items()) + ") r(k, v)"


def _row(table_sql, confidence, category, version="''", name="v"):
    return f"select repo, {name} as name, {version} as version, {confidence}::double as confidence, '{category}' as category from {table_sql}"


def _npm(corpus, table, fields, confidence, category, version=None, strings=True):
    """JSON object members; a later field replaces an earlier one."""
    parts = []
    for n, field in enumerate(fields):
        at = f"'$.\"{field}\".\"' || k || '\"'"
        ok = f"json_type(j, {at}) = 'VARCHAR'" if strings else f"json_type(j, {at}) is not null"
        parts.append(
            f"select repo, v, {n} as pr, json_extract_string(j, {at}) as ver from (select repo, try_cast(content as json) as j "
            f"from {_files(corpus, chr(112) + 'ath = ' + quote('package.json'))}) x, {_values(table)} where j is not null and {ok}"
        )
    got = f"(select repo, v, max_by(ver, pr) as ver from ({' union all '.join(parts)}) group by repo, v)"
    return _row(got, confidence, category, "regexp_replace(ver, '^\\^', '')" if version else "''")


def _text(corpus, where, table, confidence, category, text="lower(content)"):
    got = f"(select distinct repo, v from {_files(corpus, where)} f, {_values(table)} where contains({text}, k))"
    return _row(got, confidence, category)


def _parts(corpus):
    b = base()
    return {
        "frontend": [_npm(corpus, rules.FRONTEND_PACKAGES, ["dependencies", "devDependencies"], 1.0, "framework", True)],
        "backend": [
            _npm(corpus, rules.BACKEND_PACKAGES, ["dependencies"], 0.9, "framework", True),
            _text(corpus, "path = 'requirements.txt'", rules.BACKEND_PYTHON, 0.9, "framework"),
            _text(corpus, "ends_with(path, '.go')", rules.BACKEND_GO, 0.9, "framework", "content"),
        ],
        "build": [
            _row(f"(select distinct repo, {case_map(b, rules.BUILD_FILES)} as v from ({duck(corpus)})) where v is not null", 1.0, "build-tool"),
            _row(f"(select distinct repo, 'Parcel' as v from ({duck(corpus)}) where path = 'package.json' and contains(content, 'parcel'))", 0.8, "build-tool"),
        ],
        "databases": [
            _text(corpus, "true", rules.DATABASE_PATHS, 1.0, "database", "path"),
            _npm(corpus, rules.DATABASE_NPM, ["dependencies", "devDependencies"], 0.9, "database", strings=False),
            _text(corpus, "path = 'requirements.txt'", rules.DATABASE_PYTHON, 0.9, "database"),
            _text(corpus, "path = 'go.mod'", rules.DATABASE_GO, 0.9, "database"),
        ],
        "testing": [
            _npm(corpus, rules.TEST_NPM, ["devDependencies"], 1.0, "testing", strings=False),
            _text(corpus, "path = 'requirements.txt'", rules.TEST_PYTHON, 0.9, "testing"),
            _row(f"(select distinct repo, 'Go Testing' as v from ({duck(corpus)}) where ends_with(path, '_test.go'))", 1.0, "testing"),
        ],
        "containers": [
            _row(
                f"(select repo, v, max(c) as c from (select repo, case when {b} = 'Dockerfile' or starts_with({b}, 'Dockerfile.') or {b} = '.dockerignore' "
                f"then 'Docker' when {b} in ('docker-compose.yml', 'docker-compose.yaml') then 'Docker Compose' end as v, "
                f"case when {b} = '.dockerignore' then 0.8 else 1.0 end as c from ({duck(corpus)})) where v is not null group by repo, v)",
                "c", "containerization",
            ),
            _row(
                f"(select distinct repo, 'Kubernetes' as v from ({duck(corpus)}) where contains(path, 'kubernetes') or ends_with(path, '.k8s.yaml'))",
                0.9, "containerization",
            ),
        ],
        "cicd": [_text(corpus, "true", rules.CICD_PATHS, 1.0, "ci-cd", "path")],
    }


def _stage(corpus, name):
    return (
        "select repo, name, max(version) as version, round(max(confidence), 6) as confidence, max(category) as category from ("
        + " union all ".join(_parts(corpus)[name]) + ") group by repo, name"
    )


def _share(corpus):
    return (
        f"select repo, name, n / total as confidence from (select *, sum(n) over (partition by repo) as total from "
        f"(select repo, {case_map(f'lower({ext()})', rules.SHARE_LANGUAGE)} as name, count(*) as n from ({duck(corpus)}) group by 1, 2)) "
        "where name is not null and n / total > 0.01"
    )


def _versions(corpus):
    f = f"({duck(corpus)})"
    setup = "python_requires\\s*=\\s*[''\"]([^''\"]+)[''\"]"
    rows = [
        f"select repo, 'Go' as language, regexp_extract(content, 'go\\s+(\\d+\\.\\d+)', 1) as version, 1 as pr from {f} where path = 'go.mod'",
        f"select repo, l, json_extract_string(try_cast(content as json), '$.engines.node'), 1 from {f}, (values ('JavaScript'), ('TypeScript')) t(l) where path = 'package.json'",
        f"select repo, 'Python', regexp_extract(content, 'python\\s*=\\s*\"([^\"]+)\"', 1), 2 from {f} where path = 'pyproject.toml'",
        f"select repo, 'Python', regexp_extract(content, '{setup}', 1), 1 from {f} where path = 'setup.py'",
        f"select repo, 'Rust', regexp_extract(content, 'rust-version\\s*=\\s*\"([^\"]+)\"', 1), 1 from {f} where path = 'Cargo.toml'",
    ]
    return f"select repo, language, max_by(version, pr) as version from ({' union all '.join(rows)}) where version <> '' group by 1, 2"


_ORDER = ["frontend", "backend", "build", "databases", "testing", "containers", "cicd"]


def _all(corpus):
    stages = [
        f"select s.repo, s.name, coalesce(v.version, '') as version, round(s.confidence, 6) as confidence, 'language' as category, 1 as stage "
        f"from ({_share(corpus)}) s left join ({_versions(corpus)}) v on s.repo = v.repo and s.name = v.language"
    ] + [f"select *, {i} as stage from ({_stage(corpus, n)})" for i, n in enumerate(_ORDER, start=2)]
    return (
        "select repo, name, version, confidence, category, row_number() over (partition by repo order by confidence desc, name) as rank from ("
        "select *, row_number() over (partition by repo, name order by stage desc) as pick from (" + " union all ".join(stages) + ")) where pick = 1"
    )


ORACLES = {
    "language_confidence": f"select repo, name, round(confidence, 6) as confidence from ({_share('inv')})",
    "language_versions": _versions("man"),
    "frontend_frameworks": _stage("man", "frontend"),
    "backend_frameworks": _stage("man", "backend"),
    "build_tools": _stage("inv", "build"),
    "databases": _stage("man", "databases"),
    "testing_frameworks": _stage("man", "testing"),
    "containerization": _stage("inv", "containers"),
    "cicd": _stage("inv", "cicd"),
    "detect_all": _all("man"),
    "detect_all_inv": _all("inv"),
}
