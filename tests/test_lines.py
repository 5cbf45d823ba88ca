"""Line models, quality rules and token sums on small hand-made files."""

import random

import pytest

from codestrata.functions import rules
from codestrata.functions.tokens import CHARS_BY_WEIGHT, estimate
from codestrata.functions.text import WHITE_SPACE
from codestrata.operators import lint, quality, security, tokens
from codestrata.session import stage
from codestrata.sources.lines import explode_lines
from pyspark.sql import functions as F


def texts(df, model):
    return [r.line for r in explode_lines(df, model).orderBy("line_no").collect()]


@pytest.mark.parametrize("content,scan,split", [
    ("", [], [""]),
    ("a", ["a"], ["a"]),
    ("a\n", ["a"], ["a", ""]),
    ("a\n\n", ["a", ""], ["a", "", ""]),
    ("a\r\nb\r\r\n", ["a", "b\r"], ["a\r", "b\r\r", ""]),
    ("\n", [""], ["", ""]),
])
def test_line_models(files, content, scan, split):
    df = files(("x.go", content))
    assert texts(df, "scan") == scan
    assert texts(df, "split") == split


def test_block_comments(files):
    body = "/* a\n\nx */\ncode\n/* one */\ncode\nx */ y\n/* open\n// in\nend */ z\nstill"
    rows = quality.classify_lines(files(("x.go", body))).orderBy("line_no").collect()
    assert [r.kind for r in rows] == [
        "comment", "blank", "comment", "code", "comment", "code", "code", "comment", "comment", "comment", "comment",
    ]


def test_complexity_boundaries(files):
    body = "a&&b\na && b\nx?y:z\néif (a)\nif_x\nreturn if\n"
    rows = quality.line_complexity(files(("x.js", body))).orderBy("line_no").collect()
    assert [r.complexity for r in rows] == [1, 0, 1, 1, 0, 2]


def test_over_long_line(files):
    long = "x" * 200_000
    df = files(("a.go", f"a\n{long}\n"), ("b.go", f'{long} password = "12345678{long}"\nx\npassword = "12345678"\n'))
    assert {r.path: r.lines for r in quality.file_metrics(df).collect()} == {"a.go": 2, "b.go": 3}
    found = security.scan_secrets(df).collect()
    assert sorted(r.line for r in found) == [1, 3] and max(len(r.matched) for r in found) > 200_000
    short = security.scan_secrets(df, max_match_chars=50).collect()
    assert max(len(r.matched) for r in short) == 53
    assert security.scan_secrets(df, max_file_bytes=100_000).count() == 0
    assert min(r.tokens for r in tokens.file_tokens(df).collect()) > 10_000
    assert quality.test_coverage(df).first().analysed_files == 2
    assert quality.project_metrics(df).first().total_files == 2


def test_empty_file_counts(files):
    row = quality.project_metrics(files(("a.go", ""), ("b_test.go", "x\n"))).first()
    assert (row.total_files, row.total_lines, row.test_files, row.test_coverage) == (2, 1, 1, 50.0)
    assert quality.project_metrics(files(("a.go", ""))).first().maintainability == 100.0


def test_line_classes_add_up(spark):
    from conftest import SF
    from codestrata.plans.corpora import load

    rows = quality.file_metrics(load(spark, SF, "code"))
    assert rows.filter("lines <> code_lines + comment_lines + blank_lines").count() == 0


def test_nesting_and_declarations(files):
    df = files(
        ("a.py", "class A:\n    def f(self):\n        if x:\n"), ("b.c", "}\n}\nint main(void) {\n"),
        ("c.java", "public class A {\n  int f(int a) {\n"),
    )
    depth = {r.path: r.max_nesting for r in quality.nesting_depth(df).collect()}
    assert depth == {"a.py": 3, "b.c": 0, "c.java": 2}
    got = {(r.path, r.line_no, r.is_function, r.is_class) for r in quality.declarations(df).collect()}
    assert got == {
        ("a.py", 1, False, True), ("a.py", 2, True, False), ("b.c", 3, True, False),
        ("c.java", 1, False, True), ("c.java", 2, True, False),
    }


def test_smells(files):
    body = "x" * 121 + "\na;b;\n// ToDo fixme\n" + " " * 33 + "y\nconst x = 10 ;\nx = 10 ;\nprintln(1)\n"
    rows = quality.line_smells(files(("x.go", body))).orderBy("line_no").collect()
    assert [(r.line_no, r.smell) for r in rows] == [
        (1, rules.SMELL_LONG), (2, rules.SMELL_MULTI), (3, rules.SMELL_TODO), (3, rules.SMELL_FIXME),
        (4, rules.SMELL_DEEP), (6, rules.SMELL_MAGIC), (7, rules.SMELL_DEBUG),
    ]


def expected_tokens(text, other):
    weights = {c: w for w, chars in CHARS_BY_WEIGHT.items() for c in chars}
    total = 0.0
    for ch in text:
        total += weights.get(ch, 0.3 if ch in WHITE_SPACE else other)
    return int(total)


def test_tokens_match_the_sum_in_doubles(spark):
    rng = random.Random(7)
    alphabet = "".join(CHARS_BY_WEIGHT.values()) + "abcXYZ019é漢😀\u00a0\x0b\x01\x02\x03"
    samples = ["", " " * 10, "..........", "a" * 40] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600)
    ]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", estimate(F.col("t"), True).alias("c"), estimate(F.col("t"), False).alias("p")).collect()
    for r in got:
        assert (r.c, r.p) == (expected_tokens(r.t, 0.8), expected_tokens(r.t, 0.25)), repr(r.t)


def test_secrets(files):
    h = "a" * 40
    body = "\n".join([
        f'token = "ghp_{h}"', f"# ghp_{h}", 'PASSWORD: "abcdefgh"', "password = short", "AWS_ACCESS_KEY_ID=" + "A" * 20,
        'aws_secret_access_key = "' + "b" * 40 + '"', "-----BEGIN RSA PRIVATE KEY-----",
        "Bearer " + "x" * 20, "sk_live_" + "y" * 24, "mongodb://u:p@host/db",
        "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "xoxb-" + "1" * 12 + "-" + "2" * 12 + "-" + "z" * 24,
        'client_secret = "' + "q" * 20 + '"', "pa\u017f\u017fword = 'abcdefgh'",
    ])
    rows = security.scan_secrets(files(("a.py", body), ("node_modules/a.py", body), ("a.png", body))).collect()
    got = sorted((r.path, r.line, r.description.removesuffix(" detected in code")) for r in rows)
    assert got == sorted([
        ("a.py", 1, "GitHub Token"), ("a.py", 3, "Password in Code"), ("a.py", 5, "AWS Access Key"),
        ("a.py", 6, "AWS Secret Key"), ("a.py", 7, "Private Key"), ("a.py", 8, "Bearer Token"), ("a.py", 9, "Stripe Key"),
        ("a.py", 10, "Database URL"), ("a.py", 11, "JWT Token"), ("a.py", 12, "Slack Token"),
        ("a.py", 13, "OAuth Client Secret"), ("a.py", 13, "Secret in Code"), ("a.py", 14, "Password in Code"),
    ])
    cut = [r.matched for r in rows if r.description.startswith("AWS Secret")][0]
    assert len(cut) == 66 and cut.endswith('b"')  # whole matches


def test_configuration_checks(files):
    df = files(
        ("Dockerfile", "FROM x\nEXPOSE 8022\n"), ("a/Dockerfile", "USER root\n"),
        ("a.js", "Access-Control-Allow-Origin\ncredentials: true\n*\n"), ("b.js", "credentials: true\n"),
    )
    got = sorted((r.path, r.line, r.severity) for r in security.security_issues(df).filter("stage = 3").collect())
    assert got == [("Dockerfile", 0, "medium"), ("Dockerfile", 2, "high"), ("a.js", 2, "critical"), ("a/Dockerfile", 1, "high")]


def test_lint_reads_contents_once(files):
    given = stage(files(
        ("a.js", "x\ndebugger\n"), ("b.go", "// if x\n"), ("c.py", "print(1)\nvar\n"), ("d.md", "debugger\n"), ("e.ts", ""), ("f.py", "debugger // if print("),
    ))
    found = lint.lint(given)
    assert sorted((r["path"], r["line"], r["rule"], r["linter"], r["stage"]) for r in found.collect()) == [
        ("a.js", 2, "no-debugger", "basic-js", 1), ("b.go", 1, "no-commented-code", "basic-go", 2), ("c.py", 1, "use-logging", "basic-py", 3),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert lint.lint_summary(found).filter("section = 'top'").count() == 3
