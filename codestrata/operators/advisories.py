"""Dependencies against advisories, deprecations and version patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codestrata.functions import rules
from codestrata.functions.text import contains_any, lookup, trim
from codestrata.session import stage
from codestrata.sources.json_object import SPLIT, json_entries

_KEEP = ["repo", "ecosystem", "manifest", "name", "version", "type", "line_no"]


def load_advisories(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in advisories, plus a JSON feed ``{package: [advisory, ...]}``.

    The built-in rows are literals and a feed is a file, so Spark knows the size
    of both and broadcasts them only while they are small.
    """
    columns = ["name", "version", "severity", "cve_id", "description", "recommendation"]
    literals = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rules.ADVISORIES]
    seed = spark.range(1).select(F.inline(F.array(*literals)))
    if path is None:
        return seed
    return seed.unionByName(feed_advisories(spark, path))


_FEED_ITEM = (
    "struct<package_name:string,version:string,severity:string,cve_id:string,"
    "description:string,recommendation:string>"
)


def feed_advisories(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Advisories of a feed ``{package: [advisory, ...]}``, read by many tasks.

    Of a package listed twice the last list counts. A feed that does not parse,
    in brackets, quotes or any entry, gives nothing.
    """
    entries, whole = json_entries(spark, path, split)
    parsed = stage(entries.select(
        "file", "at", F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,array<{_FEED_ITEM}>>").alias("_map")
    ))
    broken = parsed.filter("_map is null or cardinality(_map) != 1").select("file").union(whole.filter("not whole").select("file")).distinct()
    sound = parsed.join(broken, "file", "left_anti").select("file", "at", F.explode("_map").alias("name", "_items"))
    last = sound.groupBy("file", "name").agg(F.max_by("_items", "at").alias("_items"))
    columns = ("version", "severity", "cve_id", "description", "recommendation")
    return last.select("name", F.inline("_items")).select("name", *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def clean_version(version: Column) -> Column:
    """Strip each known prefix at most once, in the fixed order."""
    prefixes = "".join(rf"(?:\Q{p}\E)?" for p in rules.VERSION_PREFIXES)
    return trim(F.regexp_replace(version, rf"\A{prefixes}", ""))


def strip_operators(version: Column) -> Column:
    """All leading operator characters and one ``v``."""
    return trim(F.regexp_replace(version, r"\A[\^~><=! ]*v?", ""))


def _pattern(stage: int, test: Column, severity: str, description: Column, recommendation: str) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(stage).cast("long").alias("stage"), F.lit(None).cast("string").alias("advisory_version"),
            F.lit(severity).alias("severity"), F.lit("").alias("cve_id"), description.alias("description"),
            F.lit(recommendation).alias("recommendation"),
        ),
    )


def _very_old() -> Column:
    return _pattern(
        2, F.col("version").rlike(r"\A[~^>=<]*0\."), "medium",
        F.lit("Package version is very old and may contain known vulnerabilities"),
        "Update to the latest stable version",
    )


def _prerelease() -> Column:
    marked = contains_any(F.lower("version"), rules.PRERELEASE_MARKS)
    return _pattern(
        3, (F.col("type") == "production") & marked, "low",
        F.lit("Using pre-release version in production dependencies"), "Use stable release versions for production",
    )


def _deprecated() -> Column:
    reason = lookup(F.col("name"), rules.DEPRECATED)
    return _pattern(
        4, reason.isNotNull(), "medium", F.concat(F.lit("Package is deprecated: "), reason),
        "Consider migrating to an alternative package",
    )


def _findings(rows: DataFrame, facts: Column) -> DataFrame:
    return rows.select(*_KEEP, F.inline(facts))


def _single(deps: DataFrame, fact: Column) -> DataFrame:
    return _findings(deps, F.array_compact(F.array(fact))).drop("stage")


def match_advisories(deps: DataFrame, advisories: DataFrame, strict: bool = False) -> DataFrame:
    """Known advisories: same name, version equal to or starting with the listed one.

    An equi-join on the package name. Spark broadcasts the advisories while
    their size is below its threshold; beyond it AQE splits a popular name.
    ``strict`` cleans pins such as ``==1.2`` completely.
    """
    clean = strip_operators if strict else clean_version
    listed = advisories.select(
        F.col("name").alias("_name"), clean(F.col("version")).alias("_affected"),
        F.col("version").alias("advisory_version"), "severity", "cve_id", "description", "recommendation",
    )
    installed = deps.select(*_KEEP).withColumn("_installed", clean(F.col("version")))
    hit = (F.col("name") == F.col("_name")) & F.col("_installed").startswith(F.col("_affected"))
    return installed.join(listed, hit).drop("_name", "_affected", "_installed")


def deprecated(deps: DataFrame) -> DataFrame:
    return _single(deps, _deprecated())


def very_old(deps: DataFrame) -> DataFrame:
    return _single(deps, _very_old())


def prerelease(deps: DataFrame) -> DataFrame:
    return _single(deps, _prerelease())


def outdated(deps: DataFrame) -> DataFrame:
    return deps.filter(clean_version(F.col("version")).startswith("0.0.")).select(
        "repo", "ecosystem", "manifest", "name", F.col("version").alias("current_version"),
        F.lit("unknown").alias("latest_version"), "type", "line_no",
    )


def check_dependencies(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """All findings; ``stage`` is the order of the checks for one dependency.

    The three version checks are one pass, the advisory join is another.
    """
    known = match_advisories(deps, advisories).withColumn("stage", F.lit(1).cast("long"))
    patterns = F.array_compact(F.array(_very_old(), _prerelease(), _deprecated()))
    return known.unionByName(_findings(deps, patterns))


def _encounter() -> list[Column]:
    """Reporting order of dependencies (ecosystem, manifest, line, name)."""
    kinds = {"production": 1, "development": 2, "optional": 3, "peer": 4}
    ecosystems = {e: i for i, e in enumerate(["Node.js", "Go", "Python", "Rust", "Ruby", "PHP"])}
    manifests = {m: i for i, m in enumerate(["requirements.txt", "requirements-dev.txt", "pyproject.toml", "Pipfile"])}
    return [
        lookup(F.col("ecosystem"), ecosystems), F.coalesce(lookup(F.col("manifest"), manifests), F.lit(-1)),
        F.coalesce(F.col("line_no"), F.lit(0)), lookup(F.col("type"), kinds), F.col("name"), F.col("version"),
    ]


def vuln_counts(findings: DataFrame, old: DataFrame) -> DataFrame:
    """Counts by severity and of outdated packages per repository."""
    rows = findings.select("repo", "severity").unionByName(old.select("repo", F.lit("outdated").alias("severity")))
    severity = F.col("severity")
    return rows.groupBy("repo").agg(
        F.count_if(severity != "outdated").alias("total_vulnerabilities"),
        *[F.count_if(severity == s).alias(s) for s in rules.SEVERITY_RANK],
        F.count_if(severity == "outdated").alias("total_outdated"),
    )


def vuln_summary(findings: DataFrame, old: DataFrame, n: int = 5) -> DataFrame:
    """Report rows: counts, the ``n`` most severe findings with CVE and fix, the
    first ``n`` outdated packages and how many more there are.

    Findings and outdated packages are computed once, into one narrow table;
    counts and rankings read that.
    """
    found = findings.withColumn("current_version", F.lit(None).cast("string")).withColumn("kind", F.lit("top"))
    listed = old.withColumn("version", F.col("current_version")).withColumn("kind", F.lit("outdated"))
    rows = stage(found.unionByName(listed.drop("latest_version"), allowMissingColumns=True))
    text = F.when(F.col("kind") == "outdated", F.concat("name", F.lit(": "), "current_version")).otherwise(F.concat(
        "name", F.lit("@"), "version", F.lit(" ["), "severity", F.lit("]\n    "), "description",
        F.when(F.col("cve_id") != "", F.concat(F.lit("\n    CVE: "), "cve_id")).otherwise(""), F.lit("\n    Fix: "), "recommendation",
    ))
    worst = Window.partitionBy("repo", "kind").orderBy(
        lookup(F.col("severity"), rules.SEVERITY_RANK), *_encounter(), "stage", "advisory_version", "cve_id"
    )
    ranked = rows.withColumn("rank", F.row_number().over(worst).cast("long")).filter(F.col("rank") <= n).select(
        "repo", F.col("kind").alias("section"), "rank", text.alias("text")
    )
    counts = vuln_counts(rows.filter("kind = 'top'"), rows.filter("kind = 'outdated'"))

    def entry(section: str, rank: int, text: Column, when: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(section).alias("section"), F.lit(rank).cast("long").alias("rank"), text.alias("text"))
        )

    lines = [
        entry("count", i, F.concat(F.lit(f"{s}: "), F.col(s).cast("string")), F.col(s) > 0)
        for s, i in rules.SEVERITY_RANK.items()
    ] + [
        entry(
            "outdated", n + 1, F.concat(F.lit("... and "), (F.col("total_outdated") - n).cast("string"), F.lit(" more")),
            F.col("total_outdated") > n,
        )
    ]
    return counts.select("repo", F.inline(F.array_compact(F.array(*lines)))).unionByName(ranked)
