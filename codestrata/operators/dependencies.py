"""Dependencies declared in root manifests of six ecosystems.

Manifests are picked by exact root path before their content is read. Each
parser is an array expression inside the manifest's row, so all ecosystems
together are one pass without a shuffle. Result columns:
repo, ecosystem, manifest, name, version, type, direct, line_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import rules
from codestrata.functions.text import any_of, rx, split_lines, trim
from codestrata.sources.manifests import json_maps, numbered_lines, section_lines, string_values

_SP = r"[\t\n\f\r ]"
_ENTRY = "array<struct<name:string,version:string,type:string,direct:boolean,line_no:bigint>>"


def _entry(name: Column, version: Column, kind: Column | str, line_no: Column | None, direct: Column | None = None) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (F.lit(True) if direct is None else direct).alias("direct"),
        (F.lit(None).cast("long") if line_no is None else line_no).alias("line_no"),
    )


def _json_entries(sections: dict[str, str]) -> Column:
    """The document is parsed once for all sections."""
    doc = json_maps(F.col("content"), list(sections))

    def members(d: Column, field: str, kind: str) -> Column:
        found = F.transform(
            F.map_entries(string_values(d[field])), lambda e: _entry(e["key"], e["value"], kind, None)
        )
        return F.coalesce(found, F.array().cast(_ENTRY))

    # a one-element array binds the parsed document for all sections
    return F.flatten(
        F.transform(F.array(doc), lambda d: F.concat(*[members(d, f, k) for f, k in sections.items()]))
    )


def _node() -> Column:
    return _json_entries(rules.NODE_SECTIONS)


def _composer() -> Column:
    return F.filter(
        _json_entries(rules.COMPOSER_SECTIONS), lambda e: ~((e["name"] == "php") & (e["type"] == "production"))
    )


def _go() -> Column:
    """Require block or single line; ``// indirect`` marks a transitive one."""
    def marker(line: Column) -> Column:
        # a lone ")" matters only inside a block, where it closes it
        return F.when(line.startswith("require ("), "b").when(line == ")", "x")

    required = F.filter(
        section_lines(F.col("content"), marker),
        lambda x: (x["section"] == "b") | x["line"].startswith("require "),
    )
    words = F.transform(
        required,
        lambda x: F.struct(
            x["line_no"].alias("line_no"), x["line"].contains("// indirect").alias("indirect"),
            F.filter(
                F.split(trim(F.regexp_replace(x["line"], r"\Arequire ", "")), _SP + "+"), lambda w: w != ""
            ).alias("words"),
        ),
    )
    complete = F.filter(words, lambda x: (F.size(x["words"]) >= 2) & ~F.get(x["words"], F.lit(0)).startswith("//"))
    return F.transform(
        complete,
        lambda x: _entry(
            F.get(x["words"], F.lit(0)), F.get(x["words"], F.lit(1)),
            F.when(x["indirect"], "development").otherwise("production"), x["line_no"], ~x["indirect"],
        ),
    )


_REQUIREMENT = rx(r"\A([a-zA-Z0-9\-_.]+)([><=!~]+)?(.*)\z")


def _requirements(kind: str) -> Column:
    named = F.filter(
        numbered_lines(F.col("content")),
        lambda x: (x["line"] != "") & ~x["line"].startswith("#") & x["line"].rlike(_REQUIREMENT),
    )
    return F.transform(
        named,
        lambda x: _entry(
            F.regexp_extract(x["line"], _REQUIREMENT, 1),
            F.concat(F.regexp_extract(x["line"], _REQUIREMENT, 2), F.regexp_extract(x["line"], _REQUIREMENT, 3)),
            kind, x["line_no"],
        ),
    )


def _toml_entries(marker) -> Column:
    """``name = value`` lines; section state ``p`` is production, ``d`` development."""
    assigned = F.filter(
        section_lines(F.col("content"), marker),
        lambda x: x["section"].isin("p", "d") & x["line"].contains("="),
    )

    def parse(x: Column) -> Column:
        line = x["line"]
        cut = F.instr(line, "=")
        return _entry(
            trim(F.left(line, cut - 1)),
            F.btrim(trim(F.substring(line, cut + 1, F.length(line))), F.lit("\"'")),
            F.when(x["section"] == "p", "production").otherwise("development"), x["line_no"],
        )

    return F.transform(assigned, parse)


def _pyproject() -> Column:
    def marker(line: Column) -> Column:
        dev = any_of(
            line.startswith(h) for h in ("[tool.poetry.dev-dependencies]", "[tool.poetry.group.dev.dependencies]")
        )
        return (
            F.when(line.startswith("[tool.poetry.dependencies]"), "p").when(dev, "d").when(line.startswith("["), "x")
        )

    return _toml_entries(marker)


def _pipfile() -> Column:
    return _toml_entries(
        lambda line: F.when(line == "[packages]", "p").when(line == "[dev-packages]", "d").when(line.startswith("["), "x")
    )


def _cargo() -> Column:
    return _toml_entries(
        lambda line: F.when(line == "[dependencies]", "p")
        .when(line.isin("[dev-dependencies]", "[build-dependencies]"), "d")
        .when(line.startswith("["), "x")
    )


_GEM = rx(rf"gem{_SP}+['\"]([^'\"]+)['\"](?:{_SP}*,{_SP}*['\"]([^'\"]+)['\"])?")


def _gemfile() -> Column:
    gems = F.filter(
        numbered_lines(F.col("content")), lambda x: x["line"].startswith("gem ") & x["line"].rlike(_GEM)
    )

    def parse(x: Column) -> Column:
        line = x["line"]
        dev = line.contains("group:") & (line.contains("development") | line.contains("test"))
        return _entry(
            F.regexp_extract(line, _GEM, 1), F.regexp_extract(line, _GEM, 2),
            F.when(dev, "development").otherwise("production"), x["line_no"],
        )

    return F.transform(gems, parse)


ECOSYSTEMS = ["Node.js", "Go", "Python", "Rust", "Ruby", "PHP"]

# root manifest to (ecosystem, parser)
_PARSERS = {
    "package.json": ("Node.js", _node),
    "go.mod": ("Go", _go),
    "requirements.txt": ("Python", lambda: _requirements("production")),
    "requirements-dev.txt": ("Python", lambda: _requirements("development")),
    "pyproject.toml": ("Python", _pyproject),
    "Pipfile": ("Python", _pipfile),
    "Cargo.toml": ("Rust", _cargo),
    "Gemfile": ("Ruby", _gemfile),
    "composer.json": ("PHP", _composer),
}


def dependencies(files: DataFrame, manifests: list[str] | None = None) -> DataFrame:
    """Dependencies of the given root manifests, by default of all of them."""
    chosen = {m: _PARSERS[m] for m in (manifests or _PARSERS)}
    path = F.col("path")
    entries, ecosystem = None, None
    for name, (eco, parser) in chosen.items():
        here = path == name
        entries = F.when(here, parser()) if entries is None else entries.when(here, parser())
        ecosystem = F.when(here, eco) if ecosystem is None else ecosystem.when(here, eco)
    return files.filter(path.isin(list(chosen))).select(
        "repo", ecosystem.alias("ecosystem"), path.alias("manifest"), F.inline(entries)
    )


def node_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["package.json"])


def go_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["go.mod"])


def python_requirements(files: DataFrame) -> DataFrame:
    return dependencies(files, ["requirements.txt", "requirements-dev.txt"])


def pyproject_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["pyproject.toml"])


def pipfile_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["Pipfile"])


def cargo_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["Cargo.toml"])


def gemfile_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["Gemfile"])


def composer_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ["composer.json"])


def dependency_analysis(deps: DataFrame) -> DataFrame:
    """Totals per repository; peer dependencies count in the total only."""
    kind = F.col("type")
    return deps.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("production", "development", "optional", "peer")],
        F.count_if("direct").alias("direct_count"),
        F.count_if(~F.col("direct")).alias("transitive_count"),
        *[
            F.count_if(F.col("ecosystem") == e).alias(f"{e.lower().replace('.', '')}_count")
            for e in ECOSYSTEMS
        ],
    )


def dependency_summary(deps: DataFrame) -> DataFrame:
    """Report lines per repository: (section, key, count)."""
    totals = dependency_analysis(deps)

    def entry(section: str, key: str, column: str, always: bool = False) -> Column:
        row = F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), F.col(column).alias("count"))
        return row if always else F.when(F.col(column) > 0, row)

    rows = [
        entry("totals", "Total Dependencies", "total", True),
        entry("totals", "Production", "production_count", True),
        entry("totals", "Development", "development_count", True),
        entry("totals", "Optional", "optional_count"),
        entry("totals", "Direct Dependencies", "direct_count", True),
        entry("totals", "Transitive Dependencies", "transitive_count"),
    ] + [entry("ecosystem", e, f"{e.lower().replace('.', '')}_count") for e in ECOSYSTEMS]
    return totals.select("repo", F.inline(F.array_compact(F.array(*rows))))


def external_dep_count(files: DataFrame) -> DataFrame:
    """Line heuristic over three root manifests."""
    def counted(line: Column) -> Column:
        return (
            F.when(F.col("path") == "go.mod", line.startswith("require "))
            .when(F.col("path") == "package.json", line.contains("dependencies") | line.contains("devDependencies"))
            .otherwise((line != "") & ~line.startswith("#"))
        )

    hits = F.filter(F.transform(split_lines(F.col("content")), trim), counted)
    return (
        files.filter(F.col("path").isin("go.mod", "package.json", "requirements.txt"))
        .groupBy("repo").agg(F.sum(F.size(hits).cast("long")).alias("external_deps"))
    )
