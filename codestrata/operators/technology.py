"""Technologies with confidence, from paths and root manifests.

Every detector emits (name, version, confidence, category, stage) facts from
inside the file's row; facts of a repository are merged by name with a partial
aggregate, so no group is ever held in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import rules
from codestrata.functions.text import basename, extension, lookup, rx
from codestrata.sources.manifests import json_maps, string_values

_FACT = "struct<name:string,version:string,confidence:double,category:string>"
_SP = r"[\t\n\f\r ]"


def language_confidence(files: DataFrame) -> DataFrame:
    """Share of each language among all files, above one percent."""
    language = lookup(F.lower(extension(F.col("path"))), rules.SHARE_LANGUAGE)
    counts = files.select("repo", language.alias("name")).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))
    # the counts table has one row per (repo, language)
    totals = counts.groupBy("repo").agg(F.sum("n").alias("total"))
    return (
        counts.filter(F.col("name").isNotNull()).join(totals, "repo")
        .select("repo", "name", (F.col("n") / F.col("total")).alias("confidence"))
        .filter(F.col("confidence") > rules.SHARE_MINIMUM)
    )


def language_versions(files: DataFrame) -> DataFrame:
    """(repo, language, version) from root manifests; Python prefers pyproject."""
    content = F.col("content")
    engines = string_values(json_maps(content, ["engines"])["engines"])
    version = (
        F.when(F.col("path") == "go.mod", F.regexp_extract(content, rx(rf"go{_SP}+([0-9]+\.[0-9]+)"), 1))
        .when(F.col("path") == "package.json", engines["node"])
        .when(F.col("path") == "pyproject.toml", F.regexp_extract(content, rx(rf'python{_SP}*={_SP}*"([^"]+)"'), 1))
        .when(
            F.col("path") == "setup.py",
            F.regexp_extract(content, rx(rf"python_requires{_SP}*={_SP}*['\"]([^'\"]+)['\"]"), 1),
        )
        .when(F.col("path") == "Cargo.toml", F.regexp_extract(content, rx(rf'rust-version{_SP}*={_SP}*"([^"]+)"'), 1))
    )
    languages = (
        F.when(F.col("path") == "go.mod", F.array(F.lit("Go")))
        .when(F.col("path") == "package.json", F.array(F.lit("JavaScript"), F.lit("TypeScript")))
        .when(F.col("path") == "Cargo.toml", F.array(F.lit("Rust")))
        .otherwise(F.array(F.lit("Python")))
    )
    manifests = ["go.mod", "package.json", "pyproject.toml", "setup.py", "Cargo.toml"]
    found = files.filter(F.col("path").isin(manifests)).select(
        "repo", F.explode(languages).alias("language"), version.alias("version"), (F.col("path") != "setup.py").alias("first")
    )
    return found.filter(F.col("version") != "").groupBy("repo", "language").agg(
        F.max_by("version", "first").alias("version")
    )


# --- facts from one file -------------------------------------------------------


def _fact(name, confidence: float, category: str, version: Column | None = None) -> Column:
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        (F.lit("") if version is None else version).alias("version"),
        F.lit(confidence).alias("confidence"), F.lit(category).alias("category"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{_FACT}>")


def _some(*facts: Column) -> Column:
    return F.array_compact(F.array(*facts)) if facts else _none()


def _contained(text: Column, table: dict[str, str], confidence: float, category: str) -> list[Column]:
    return [F.when(text.contains(k), _fact(v, confidence, category)) for k, v in table.items()]


def _parsed(files: DataFrame) -> DataFrame:
    """Adds the two package sections, parsed once: all keys and string values."""
    doc = F.when(F.col("path") == "package.json", json_maps(F.col("content"), ["dependencies", "devDependencies"]))
    return files.select("repo", "path", "content", doc.alias("_doc")).select(
        "repo", "path", "content",
        F.map_keys("_doc.dependencies").alias("_prod_names"), F.map_keys("_doc.devDependencies").alias("_dev_names"),
        string_values(F.col("_doc.dependencies")).alias("_prod"), string_values(F.col("_doc.devDependencies")).alias("_dev"),
    )


def _frontend() -> Column:
    prod, dev = F.col("_prod"), F.col("_dev")
    return _some(*[
        F.when(
            F.coalesce(dev[k], prod[k]).isNotNull(),
            _fact(v, 1.0, "framework", F.regexp_replace(F.coalesce(dev[k], prod[k]), r"\A\^", "")),
        )
        for k, v in rules.FRONTEND_PACKAGES.items()
    ])


def _backend() -> Column:
    prod = F.col("_prod")
    node = [
        F.when(prod[k].isNotNull(), _fact(v, 0.9, "framework", F.regexp_replace(prod[k], r"\A\^", "")))
        for k, v in rules.BACKEND_PACKAGES.items()
    ]
    path, content = F.col("path"), F.col("content")
    return (
        F.when(path == "package.json", _some(*node))
        .when(path == "requirements.txt", _some(*_contained(F.lower(content), rules.BACKEND_PYTHON, 0.9, "framework")))
        .when(path.endswith(".go"), _some(*_contained(content, rules.BACKEND_GO, 0.9, "framework")))
        .otherwise(_none())
    )


def _build() -> Column:
    path = F.col("path")
    tool = lookup(basename(path), rules.BUILD_FILES)
    parcel = (path == "package.json") & F.when(path == "package.json", F.col("content").contains("parcel"))
    return _some(
        F.when(tool.isNotNull(), _fact(tool, 1.0, "build-tool")),
        F.when(parcel, _fact("Parcel", 0.8, "build-tool")),
    )


def _databases() -> Column:
    path, content = F.col("path"), F.col("content")
    names = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("_prod_names", "_dev_names")])
    npm = [F.when(F.array_contains(names, k), _fact(v, 0.9, "database")) for k, v in rules.DATABASE_NPM.items()]
    by_content = (
        F.when(path == "package.json", _some(*npm))
        .when(path == "requirements.txt", _some(*_contained(F.lower(content), rules.DATABASE_PYTHON, 0.9, "database")))
        .when(path == "go.mod", _some(*_contained(F.lower(content), rules.DATABASE_GO, 0.9, "database")))
        .otherwise(_none())
    )
    return F.concat(_some(*_contained(path, rules.DATABASE_PATHS, 1.0, "database")), by_content)


def _testing() -> Column:
    path = F.col("path")
    npm = [F.when(F.array_contains("_dev_names", k), _fact(v, 1.0, "testing")) for k, v in rules.TEST_NPM.items()]
    return (
        F.when(path == "package.json", _some(*npm))
        .when(path == "requirements.txt", _some(*_contained(F.lower("content"), rules.TEST_PYTHON, 0.9, "testing")))
        .when(path.endswith("_test.go"), _some(_fact("Go Testing", 1.0, "testing")))
        .otherwise(_none())
    )


def _containers() -> Column:
    path, name = F.col("path"), basename(F.col("path"))
    docker = (name == "Dockerfile") | name.startswith("Dockerfile.")
    return _some(
        F.when(docker, _fact("Docker", 1.0, "containerization")),
        F.when(name.isin("docker-compose.yml", "docker-compose.yaml"), _fact("Docker Compose", 1.0, "containerization")),
        F.when(name == ".dockerignore", _fact("Docker", 0.8, "containerization")),
        F.when(path.contains("kubernetes") | path.endswith(".k8s.yaml"), _fact("Kubernetes", 0.9, "containerization")),
    )


def _cicd() -> Column:
    return _some(*_contained(F.col("path"), rules.CICD_PATHS, 1.0, "ci-cd"))


# order of the detectors; a later one replaces an earlier one of the same name
_DETECTORS = {
    "frontend": (2, _frontend), "backend": (3, _backend), "build": (4, _build), "databases": (5, _databases),
    "testing": (6, _testing), "containers": (7, _containers), "cicd": (8, _cicd),
}


_OPENED = frozenset(["frontend", "backend", "build", "databases", "testing"])
_MANIFESTS = ("package.json", "requirements.txt", "go.mod")


def _detect(files: DataFrame, *names: str) -> DataFrame:
    """(repo, name, version, confidence, category, stage) in one pass over the files."""
    def tag(stage: int, facts: Column) -> Column:
        return F.transform(facts, lambda f: f.withField("stage", F.lit(stage)))

    tagged = [tag(stage, detector()) for stage, detector in (_DETECTORS[n] for n in names)]
    facts = F.inline(F.concat(*tagged))
    if not _OPENED.intersection(names):
        return _parsed(files).select("repo", facts)
    # content is read of the files that are looked into; of the others the path
    opened = F.col("path").isin(*_MANIFESTS)
    if "backend" in names:
        opened |= F.col("path").endswith(".go")
    others = files.select("repo", "path").filter(~opened).withColumn("content", F.lit(None).cast("string"))
    return _parsed(files.filter(opened)).select("repo", facts).unionByName(_parsed(others).select("repo", facts))


def _merged(facts: DataFrame) -> DataFrame:
    """Best stage wins, within a stage the highest confidence."""
    best = F.max(F.struct("stage", "confidence", "version", "category"))
    return facts.groupBy("repo", "name").agg(best.alias("_b")).select(
        "repo", "name", F.col("_b.version").alias("version"), F.col("_b.confidence").alias("confidence"),
        F.col("_b.category").alias("category"),
    )


def frontend_frameworks(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "frontend"))


def backend_frameworks(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "backend"))


def build_tools(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "build"))


def databases(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "databases"))


def testing_frameworks(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "testing"))


def containerization(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "containers"))


def cicd(files: DataFrame) -> DataFrame:
    return _merged(_detect(files, "cicd"))


def detect_all(files: DataFrame) -> DataFrame:
    """Every technology of a repository with its rank by confidence, then name.

    The table of technologies is bounded by the rule tables, so ranking it per
    repository is cheap.
    """
    languages = (
        language_confidence(files)
        .join(language_versions(files).withColumnRenamed("language", "name"), ["repo", "name"], "left")
        .select(
            "repo", "name", F.coalesce("version", F.lit("")).alias("version"), "confidence",
            F.lit("language").alias("category"), F.lit(1).alias("stage"),
        )
    )
    merged = _merged(languages.unionByName(_detect(files, *_DETECTORS)))
    order = Window.partitionBy("repo").orderBy(F.desc("confidence"), "name")
    return merged.withColumn("rank", F.row_number().over(order).cast("long"))
