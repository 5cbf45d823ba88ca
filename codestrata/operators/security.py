"""Secrets, permissions, unsafe configuration, dangerous files.

Issue columns: repo, stage, type, severity, path, line, description,
suggestion, matched. Stages: 1 permission, 2 secret, 3 config, 4 file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import rules
from codestrata.functions.text import (
    any_of, basename, contains_any, ends_with_any, rx, scan_lines, split_lines, trim,
)

COLUMNS = ["repo", "stage", "type", "severity", "path", "line", "description", "suggestion", "matched"]


def _issue(
    severity, description, suggestion, line: Column | None = None, matched: Column | None = None, seq: int | Column = 0
) -> Column:
    def text(x) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(
        text(severity).alias("severity"),
        (F.lit(0) if line is None else line).cast("long").alias("line"),
        text(description).alias("description"), text(suggestion).alias("suggestion"),
        (F.lit("") if matched is None else matched).alias("matched"),
        (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"),
    )


def _issues(files: DataFrame, stage: int, kind: str, found: Column) -> DataFrame:
    """Rows from an array of issues inside each file."""
    return files.select("repo", "path", F.inline(found)).select(
        "repo", F.lit(stage).cast("long").alias("stage"), F.lit(kind).alias("type"), "severity", "path", "line",
        "description", "suggestion", "matched", "seq",
    )


# --- secrets --------------------------------------------------------------------


_SECRET_HINT = rx(rules.SECRET_HINT, ignore_case=True)


def _is_plain(path: Column) -> Column:
    return ~contains_any(path, rules.SECRET_SKIP_DIRS) & ~ends_with_any(path, rules.SECRET_SKIP_SUFFIXES)


def _may_hold_secret(line: Column) -> Column:
    text = trim(line)
    return line.rlike(_SECRET_HINT) & ~(text.startswith("//") | text.startswith("#") | text.startswith("/*"))


def _secret_issues(line: Column, number: Column, max_match_chars: int | None = None) -> Column:
    """Issues of one line; each pattern runs once."""
    candidates = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(i).alias("seq"),
            F.regexp_extract(line, rx(pattern, fold), 0).alias("hit"),
        )
        for i, (name, severity, fold, pattern) in enumerate(rules.SECRET_PATTERNS)
    ])

    def issue(c: Column) -> Column:
        matched = c["hit"]
        if max_match_chars is not None:
            short = F.concat(F.left(matched, F.lit(max_match_chars)), F.lit("..."))
            matched = F.when(F.length(matched) > max_match_chars, short).otherwise(matched)
        description = F.concat(c["name"], F.lit(" detected in code"))
        return _issue(c["severity"], description, rules.SECRET_SUGGESTION, number, matched, c["seq"])

    return F.transform(F.filter(candidates, lambda c: c["hit"] != ""), issue)


def secret_scan_scope(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Files plain enough to be searched for secrets, and small enough if a limit is given."""
    plain = files.filter(_is_plain(F.col("path")))
    return plain if max_file_bytes is None else plain.filter(F.col("size") <= max_file_bytes)


def _secret_scan(files: DataFrame, max_file_bytes: int | None = None, max_match_chars: int | None = None) -> DataFrame:
    """One issue per (line, pattern).

    A cheap hint every match must contain removes whole files, then lines,
    before the patterns run; each pattern runs once per remaining line.
    """
    lines = (
        secret_scan_scope(files, max_file_bytes).filter(F.col("content").rlike(_SECRET_HINT))
        .select("repo", "path", F.posexplode(scan_lines(F.col("content"))).alias("_pos", "_line"))
        .filter(_may_hold_secret(F.col("_line")))
    )
    return _issues(lines, 2, "secret", _secret_issues(F.col("_line"), F.col("_pos") + 1, max_match_chars))


def scan_secrets(files: DataFrame, max_file_bytes: int | None = None, max_match_chars: int | None = None) -> DataFrame:
    """Secrets in all lines; the keywords limit files and the shown match, both off by default."""
    return _secret_scan(files, max_file_bytes, max_match_chars).select(*COLUMNS)


# --- permissions ------------------------------------------------------------------


def is_config_file(path: Column) -> Column:
    named = any_of(basename(path).startswith(n) for n in rules.CONFIG_NAMES)
    return ends_with_any(path, rules.CONFIG_SUFFIXES) | named


def _permission_issues() -> Column:
    path, mode = F.col("path"), F.col("mode")

    def bits(mask: int) -> Column:
        return F.coalesce(mode.bitwiseAND(mask) != 0, F.lit(False))

    return F.array_compact(F.array(
        F.when(bits(0o002), _issue(
            "high", "File is world-writable",
            F.concat(F.lit("Remove write permissions for others: chmod o-w "), path), seq=0)),
        F.when(is_config_file(path) & bits(0o111), _issue(
            "medium", "Configuration file should not be executable",
            F.concat(F.lit("Remove executable bit: chmod -x "), path), seq=1)),
        F.when(contains_any(path, rules.PRIVATE_KEY_MARKS) & bits(0o077), _issue(
            "critical", "Private key has overly permissive permissions",
            F.concat(F.lit("Restrict permissions: chmod 600 "), path), seq=2)),
    ))


def _permissions(files: DataFrame) -> DataFrame:
    return _issues(files, 1, "permission", _permission_issues())


def check_permissions(files: DataFrame) -> DataFrame:
    return _permissions(files).select(*COLUMNS)


# --- configuration -----------------------------------------------------------------


def pattern_test(path: Column, pattern: str) -> Column:
    """``a|b`` alternatives, ``*suffix``, or a substring of the whole path."""
    if "|" in pattern:
        return any_of(pattern_test(path, p) for p in pattern.split("|"))
    if pattern == "*":
        return F.lit(True)
    if "*" in pattern:
        return path.endswith(pattern.removeprefix("*"))
    return path.contains(pattern)


def route_config(files: DataFrame) -> DataFrame:
    """(repo, path, check) for every check a file takes."""
    checks = F.array_compact(F.array(*[F.when(pattern_test(F.col("path"), p), name) for name, p in rules.CONFIG_CHECKS]))
    return files.select("repo", "path", F.explode(checks).alias("check"))


def _numbered(content: Column, with_trim: bool) -> Column:
    return F.transform(
        split_lines(content),
        lambda x, i: F.struct((i + 1).cast("long").alias("no"), (trim(x) if with_trim else x).alias("text")),
    )


def _dockerfile_issues(content: Column) -> Column:
    lines = F.filter(
        _numbered(content, True),
        lambda x: x["text"].startswith("USER root") | (x["text"].startswith("EXPOSE") & x["text"].contains("22")),
    )
    flagged = F.transform(
        lines,
        lambda x: F.when(
            x["text"].startswith("USER root"),
            _issue("high", "Container runs as root user", "Create and use a non-root user in Dockerfile", x["no"]),
        ).otherwise(
            _issue("high", "SSH port exposed in container", "Avoid exposing SSH in containers", x["no"])
        ),
    )
    no_user = ~F.exists(split_lines(content), lambda x: trim(x).startswith("USER "))
    missing = F.array_compact(F.array(F.when(no_user, _issue(
        "medium", "No USER instruction found - container will run as root", "Add USER instruction to run as non-root", seq=1,
    ))))
    return F.concat(flagged, missing)


def _nginx_issues(content: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(~content.contains(h), _issue(
            "medium", f"Missing security header: {h}", f"Add header: add_header {h} {v};", seq=i))
        for i, (h, v) in enumerate(rules.NGINX_HEADERS.items())
    ]))


def _cors_issues(content: Column) -> Column:
    open_file = content.contains(rules.CORS_HEADER) & content.contains("*")
    # both findings need the header and a star somewhere in the file
    lines = F.when(open_file, F.filter(
        _numbered(content, False),
        lambda x: x["text"].contains(rules.CORS_HEADER) | contains_any(x["text"], rules.CORS_CREDENTIALS),
    ))

    def per_line(x: Column) -> Column:
        wild = x["text"].contains(rules.CORS_HEADER) & x["text"].contains("*")
        return F.array_compact(F.array(
            F.when(wild, _issue(
                "high", "CORS allows all origins (*)", "Restrict CORS to specific trusted domains", x["no"], seq=0)),
            F.when(contains_any(x["text"], rules.CORS_CREDENTIALS), _issue(
                "critical", "CORS allows credentials with wildcard origin",
                "Never use credentials: true with origin: *", x["no"], seq=1)),
        ))

    return F.flatten(F.transform(lines, per_line))


_CHECKS = {"Docker Exposed Ports": _dockerfile_issues, "Nginx Security Headers": _nginx_issues,
           "CORS Configuration": _cors_issues}
_ISSUE = "array<struct<severity:string,line:bigint,description:string,suggestion:string,matched:string,seq:bigint>>"


def _config_issues(*checks: str) -> Column:
    """Issues of the chosen checks; their order is part of the reporting order."""
    path, empty = F.col("path"), F.array().cast(_ISSUE)
    return F.concat(*[
        F.coalesce(F.when(pattern_test(path, p), _CHECKS[name](F.col("content"))), empty)
        for name, p in rules.CONFIG_CHECKS if name in checks
    ])


def _config(files: DataFrame, *checks: str) -> DataFrame:
    """Chosen checks in one pass; content is read only for routed files."""
    routed = files.filter(any_of(pattern_test(F.col("path"), p) for name, p in rules.CONFIG_CHECKS if name in checks))
    return _issues(routed, 3, "config", _config_issues(*checks))


def check_dockerfile(files: DataFrame) -> DataFrame:
    return _config(files, "Docker Exposed Ports").select(*COLUMNS)


def check_nginx(files: DataFrame) -> DataFrame:
    return _config(files, "Nginx Security Headers").select(*COLUMNS)


def check_cors(files: DataFrame) -> DataFrame:
    return _config(files, "CORS Configuration").select(*COLUMNS)


# --- dangerous files ---------------------------------------------------------------


def _dangerous_issues() -> Column:
    name = basename(F.col("path"))
    return F.array_compact(F.array(*[
        F.when(name.contains(mark), _issue(severity, text, rules.DANGEROUS_SUGGESTION, seq=i))
        for i, (mark, severity, text) in enumerate(rules.DANGEROUS_FILES)
    ]))


def _dangerous(files: DataFrame) -> DataFrame:
    return _issues(files, 4, "file", _dangerous_issues())


def dangerous_files(files: DataFrame) -> DataFrame:
    return _dangerous(files).select(*COLUMNS)


# --- report -------------------------------------------------------------------------


_STAGES = {1: "permission", 2: "secret", 3: "config", 4: "file"}


def security_issues(files: DataFrame) -> DataFrame:
    """All issues in one pass over the contents; ``seq`` completes the reporting order (stage, path, line, seq).

    Lines are made of files that may hold secrets only; the issues of a whole file
    go with its first line, or with the one row of a file without lines.
    """
    def staged(stage: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(stage).cast("long").alias("stage"), x.alias("issue")))

    content = F.col("content")
    whole = F.concat(staged(1, _permission_issues()), staged(3, _config_issues(*_CHECKS)), staged(4, _dangerous_issues()))
    lines = F.when(_is_plain(F.col("path")) & content.rlike(_SECRET_HINT), scan_lines(content))
    rows = files.select("repo", "path", whole.alias("_whole"), lines.alias("_lines")).select(
        "repo", "path", "_whole", F.posexplode_outer("_lines").alias("_pos", "_line")
    )
    first, secret = F.coalesce("_pos", F.lit(0)) == 0, _may_hold_secret(F.col("_line"))
    secrets = F.when(secret, staged(2, _secret_issues(F.col("_line"), F.col("_pos") + 1)))
    empty = F.slice("_whole", 1, 0)
    found = F.concat(F.when(first, F.col("_whole")).otherwise(empty), F.coalesce(secrets, empty))
    kind = F.create_map(*[F.lit(x) for pair in _STAGES.items() for x in pair])
    return (
        rows.filter((first & (F.size("_whole") > 0)) | secret)
        .select("repo", "path", F.inline(found)).select(
            "repo", "stage", kind[F.col("stage").cast("int")].alias("type"), "issue.severity", "path", "issue.line",
            "issue.description", "issue.suggestion", "issue.matched", "issue.seq",
        )
    )


def security_totals(issues: DataFrame) -> DataFrame:
    """Counts by severity and by type per repository."""
    return issues.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in rules.SEVERITY_RANK],
        *[F.count_if(F.col("type") == t).alias(f"{t}_issues") for t in ("permission", "secret", "config", "file")],
    )


def security_top(issues: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` critical or high issues of each repository in reporting order."""
    order = Window.partitionBy("repo").orderBy("stage", "path", "line", "seq", "description")
    return (
        issues.filter(F.col("severity").isin("critical", "high"))
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= n)
        .select("repo", "rank", "severity", "description", "path", "line")
    )
