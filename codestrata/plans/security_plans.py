"""Security queries."""

from codestrata.functions import rules
from codestrata.operators import security
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import any_contains, any_suffix, base, quote, scan_lines, split_lines, trim


def _run(op, corpus):
    return lambda spark, sf: op(load(spark, sf, corpus))


QUERIES = {
    "scan_secrets": _run(security.scan_secrets, "code"),
    "secret_scan_scope": lambda s, d: security.secret_scan_scope(load(s, d, "inv")).select("repo", "path"),
    "check_permissions": _run(security.check_permissions, "inv"),
    "route_config": _run(security.route_config, "inv"),
    "check_dockerfile": _run(security.check_dockerfile, "code"),
    "check_nginx": _run(security.check_nginx, "code"),
    "check_cors": _run(security.check_cors, "code"),
    "dangerous_files": _run(security.dangerous_files, "inv"),
    "security_issues": lambda s, d: security.security_issues(load(s, d, "code")).drop("seq"),
    "security_totals": lambda s, d: security.security_totals(security.security_issues(load(s, d, "code"))),
    "security_top": lambda s, d: security.security_top(security.security_issues(load(s, d, "code"))),
}

# --- oracle ----------------------------------------------------------------------


def _scope(x: str) -> str:
    return (
        f"not {any_contains(x, rules.SECRET_SKIP_DIRS)} and not {any_suffix(x, rules.SECRET_SKIP_SUFFIXES)}"
    )


def _secrets(corpus):
    rows = ", ".join(
        f"({i}, {quote(n)}, {quote(s)}, {quote(('(?i)' if fold else '') + p)})"
        for i, (n, s, fold, p) in enumerate(rules.SECRET_PATTERNS)
    )
    hit = " ".join(
        f"when {i} then regexp_extract(line, {quote(('(?i)' if fold else '') + p)})"
        for i, (n, s, fold, p) in enumerate(rules.SECRET_PATTERNS)
    )
    return (
        "select repo, 2::bigint as stage, 'secret' as type, severity, path, line_no as line, name || ' detected in code' as description, "
        f"{quote(rules.SECRET_SUGGESTION)} as suggestion, hit as matched, seq "
        f"from (select *, case seq {hit} end as hit from (select * from ({scan_lines(corpus, 'repo, path, size')}) "
        f"where {_scope('path')} and not regexp_matches({trim('line')}, '^(//|#|/\\*)')), "
        f"(values {rows}) p(seq, name, severity, pattern)) where hit <> ''"
    )


def _config_sql(select):
    return (
        "select repo, 3::bigint as stage, 'config' as type, severity, path, line::bigint as line, description, suggestion, '' as matched, seq::bigint as seq "
        f"from ({select})"
    )


def _row(severity, line, description, suggestion, seq, source):
    return (
        f"select repo, path, '{severity}' as severity, {line} as line, {quote(description)} as description, "
        f"{quote(suggestion)} as suggestion, {seq} as seq from {source}"
    )


def _docker(corpus):
    lines = f"(select repo, path, line_no, {trim('line')} as t from ({split_lines(corpus, where='contains(path, ' + quote('Dockerfile') + ')')}))"
    return _config_sql(" union all ".join([
        _row("high", "line_no", "Container runs as root user", "Create and use a non-root user in Dockerfile", 0, f"{lines} where starts_with(t, 'USER root')"),
        _row("high", "line_no", "SSH port exposed in container", "Avoid exposing SSH in containers", 0, f"{lines} where starts_with(t, 'EXPOSE') and contains(t, '22')"),
        _row("medium", "0", "No USER instruction found - container will run as root", "Add USER instruction to run as non-root", 1,
             f"(select repo, path from {lines} group by 1, 2 having not bool_or(starts_with(t, 'USER ')))"),
    ]))


def _nginx(corpus):
    return _config_sql(" union all ".join(
        _row("medium", "0", f"Missing security header: {h}", f"Add header: add_header {h} {v};", i,
             f"({duck(corpus)}) where contains(path, 'nginx.conf') and not contains(content, '{h}')")
        for i, (h, v) in enumerate(rules.NGINX_HEADERS.items())
    ))


def _cors(corpus):
    cols = "repo, path, content"
    lines = f"({split_lines(corpus, cols, any_suffix('path', ['.js', '.ts', '.go', '.py']))})"
    return _config_sql(" union all ".join([
        _row("high", "line_no", "CORS allows all origins (*)", "Restrict CORS to specific trusted domains", 0,
             f"{lines} where contains(line, '{rules.CORS_HEADER}') and contains(line, '*')"),
        _row("critical", "line_no", "CORS allows credentials with wildcard origin", "Never use credentials: true with origin: *", 1,
             f"{lines} where {any_contains('line', rules.CORS_CREDENTIALS)} and contains(content, '{rules.CORS_HEADER}') and contains(content, '*')"),
    ]))


def _permissions(corpus):
    config = f"({any_suffix('path', rules.CONFIG_SUFFIXES)} or " + " or ".join(
        f"starts_with({base()}, '{n}')" for n in rules.CONFIG_NAMES
    ) + ")"
    parts = [
        ("high", "File is world-writable", "Remove write permissions for others: chmod o-w ", "mode & 2 <> 0"),
        ("medium", "Configuration file should not be executable", "Remove executable bit: chmod -x ", f"{config} and mode & 73 <> 0"),
        ("critical", "Private key has overly permissive permissions", "Restrict permissions: chmod 600 ",
         f"{any_contains('path', rules.PRIVATE_KEY_MARKS)} and mode & 63 <> 0"),
    ]
    return " union all ".join(
        f"select repo, 1::bigint as stage, 'permission' as type, '{s}' as severity, path, 0::bigint as line, '{d}' as description, "
        f"'{g}' || path as suggestion, '' as matched, {i}::bigint as seq from ({duck(corpus)}) where {w.replace('mode & 2 <> 0', '(mode & 2) <> 0').replace('mode & 73', '(mode & 73)').replace('mode & 63', '(mode & 63)')}"
        for i, (s, d, g, w) in enumerate(parts)
    )


def _dangerous(corpus):
    return " union all ".join(
        f"select repo, 4::bigint as stage, 'file' as type, '{s}' as severity, path, 0::bigint as line, '{d}' as description, "
        f"'{rules.DANGEROUS_SUGGESTION}' as suggestion, '' as matched, {i}::bigint as seq from ({duck(corpus)}) where contains({base()}, '{m}')"
        for i, (m, s, d) in enumerate(rules.DANGEROUS_FILES)
    )


_COLS = ", ".join(security.COLUMNS)
_ALL = " union all ".join(
    f"select {_COLS}, seq from ({p})" for p in
    (_permissions("code"), _secrets("code"), _docker("code"), _nginx("code"), _cors("code"), _dangerous("code"))
)


def _cols(sql):
    return f"select {_COLS} from ({sql})"


ORACLES = {
    "scan_secrets": _cols(_secrets("code")),
    "secret_scan_scope": f"select repo, path from ({duck('inv')}) where {_scope('path')}",
    "check_permissions": _cols(_permissions("inv")),
    "route_config": " union all ".join(
        f"select repo, path, '{name}' as \"check\" from ({duck('inv')}) where "
        + " or ".join(f"ends_with(path, '{p[1:]}')" if p.startswith("*") else f"contains(path, '{p}')" for p in pattern.split("|"))
        for name, pattern in rules.CONFIG_CHECKS
    ),
    "check_dockerfile": _cols(_docker("code")),
    "check_nginx": _cols(_nginx("code")),
    "check_cors": _cols(_cors("code")),
    "dangerous_files": _cols(_dangerous("inv")),
    "security_issues": _cols(_ALL),
    "security_totals": "select repo, count(*)::bigint as total_issues, "
    + ", ".join(f"count_if(severity = '{s}')::bigint as {s}_count" for s in rules.SEVERITY_RANK) + ", "
    + ", ".join(f"count_if(type = '{t}')::bigint as {t}_issues" for t in ("permission", "secret", "config", "file"))
    + f" from ({_ALL}) group by repo",
    "security_top": "select repo, rank, severity, description, path, line from (select *, row_number() over (partition by repo order by "
    f"stage, path, line, seq, description) as rank from ({_ALL}) where severity in ('critical', 'high')) where rank <= 5",
}
