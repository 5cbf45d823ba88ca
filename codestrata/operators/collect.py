"""Which files take part: globs, ignore rules, binary detection, limits.

Filters read metadata only, except binary detection, which looks at the first
bytes. Selections return metadata; join them back to content when needed.
"""

from __future__ import annotations

import dataclasses
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from codestrata.functions import rules
from codestrata.functions.globs import NEVER, ignore_rule, path_glob, python_regex
from codestrata.functions.text import any_of, extension, split_lines, trim
from codestrata.operators.ordering import first_n, prefix
from codestrata.session import stage


def include(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Keep files whose whole path matches any glob; no patterns keep all."""
    if not patterns:
        return files
    compiled = [r for r in map(path_glob, patterns) if r]
    return files.filter(any_of(F.col("path").rlike(r) for r in compiled))


# --- ignore rules -------------------------------------------------------------


def default_excludes() -> list[str]:
    return list(rules.DEFAULT_EXCLUDES)


def _decide(path: Column, patterns: list[str], on_dir: bool) -> Column:
    """True / False by the last matching rule, null if none matches.

    Neighbouring rules of the same sign are one alternation.
    """
    compiled = [ignore_rule(p) for p in patterns]
    decision = None
    for exclude_, group in groupby(reversed(compiled), key=lambda r: r.exclude):
        regex = "|".join(f"(?:{r.on_dir if on_dir else r.on_file})" for r in group)
        test = path.rlike(regex)
        decision = F.when(test, exclude_) if decision is None else decision.when(test, exclude_)
    return F.lit(None).cast("boolean") if decision is None else decision


def ancestors(path: Column) -> Column:
    """Directories above the file, outermost first."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _root_excluded(patterns: list[str]) -> bool:
    for r in map(ignore_rule, reversed(patterns)):
        if python_regex(r.on_dir).search("."):
            return r.exclude
    return False


def exclude(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop files whose last matching rule excludes them."""
    return files.filter(~F.coalesce(_decide(F.col("path"), patterns, on_dir=False), F.lit(False)))


def prune_dirs(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop everything below an excluded directory; later ``!`` rules cannot
    bring such files back."""
    if _root_excluded(patterns):
        return files.filter(F.lit(False))
    hidden = F.exists(
        ancestors(F.col("path")), lambda d: F.coalesce(_decide(d, patterns, on_dir=True), F.lit(False))
    )
    return files.filter(~hidden)


def ignore_patterns(files: DataFrame) -> DataFrame:
    """Patterns of each repository's root ignore file, numbered."""
    return (
        files.filter(F.col("path") == ".gitignore")
        .select("repo", F.posexplode(_pattern_array()).alias("_pos", "pattern"))
        .select("repo", (F.col("_pos") + 1).cast("long").alias("seq"), "pattern")
    )


def _pattern_array() -> Column:
    lines = F.transform(split_lines(F.col("content")), trim)
    return F.filter(lines, lambda p: (p != "") & ~p.startswith("#"))


#: Characters that make a component of an ignore pattern more than literal text.
_WILD = r"*?\[\\"


def _by_shape(patterns: Column) -> Column:
    """A repository's patterns as (shape, text, code, dir_only, pattern).

    ``code`` grows with the position and is odd where the rule excludes, so the
    last matching rule is the one with the largest code. Shapes: ``name`` (a whole
    component), ``suffix`` and ``prefix`` of a component, ``path`` from the root;
    ``other`` needs a regular expression.
    """

    def rule(pattern: Column, at: Column) -> Column:
        excludes = ~pattern.startswith("!")
        body = F.when(excludes, pattern).otherwise(F.substr(pattern, F.lit(2)))
        dir_only = body.endswith("/")
        body = F.regexp_replace(body, r"/\z", "")
        inner = body.contains("/")
        shape = (
            F.when(inner & ~body.rlike(f"[{_WILD}]"), "path")
            .when(inner | (body == ""), "other")
            .when(~body.rlike(f"[{_WILD}]"), "name")
            .when(body.rlike(rf"\A\*[^{_WILD}]*\z"), "suffix")
            .when(body.rlike(rf"\A[^{_WILD}]+\*\z"), "prefix")
            .otherwise("other")
        )
        text = (
            F.when(shape == "path", F.array_join(F.filter(F.split(body, "/"), lambda c: c != ""), "/"))
            .when(shape == "suffix", F.substr(body, F.lit(2)))
            .when(shape == "prefix", F.substr(body, F.lit(1), F.length(body) - 1))
            .otherwise(body)
        )
        return F.struct(
            shape.alias("shape"), text.alias("text"), (at * 2 + excludes.cast("int")).alias("code"),
            dir_only.alias("dir_only"), pattern.alias("pattern"),
        )

    return F.transform(patterns, rule)


_REGEXES = T.StructType().add("any", T.StringType()).add(
    "rules", T.ArrayType(T.StructType().add("code", T.IntegerType()).add("on_file", T.StringType()).add("on_dir", T.StringType()))
)


@F.pandas_udf(_REGEXES)
def _regexes(rules_: pd.Series) -> pd.DataFrame:
    """Regular expressions of a repository's ``other`` rules, and one that any path they touch fits.

    What cannot be compiled matches nothing.
    """

    def one(r: dict) -> dict:
        compiled = ignore_rule(r["pattern"])
        try:
            python_regex(compiled.on_dir)
            return {"code": r["code"], "on_file": compiled.on_file, "on_dir": compiled.on_dir}
        except re.error:
            return {"code": r["code"], "on_file": NEVER, "on_dir": NEVER}

    compiled = [[one(r) for r in own] for own in rules_]
    return pd.DataFrame({"any": ["|".join(f"(?:{r['on_dir']})" for r in own) or None for own in compiled], "rules": compiled})


def repository_rules(ignore_files: DataFrame) -> DataFrame:
    """The rules of each root ignore file by shape, one row per repository, and what they say of the root."""
    own = ignore_files.filter(F.col("path") == ".gitignore").select("repo", _by_shape(_pattern_array()).alias("_rules"))

    def of(shape: str) -> Column:
        return F.filter("_rules", lambda r: (r.shape == shape) & ((r.text != "") | (r.shape != "path")))

    others = F.transform(of("other"), lambda r: F.struct(r.code.alias("code"), r.pattern.alias("pattern")))
    shapes = {"names": "name", "suffixes": "suffix", "prefixes": "prefix", "paths": "path"}
    return own.select(
        "repo", *(of(shape).alias(f"_{name}") for name, shape in shapes.items()),
        _regexes(others).alias("_others"),
    ).withColumn("_root", _last_rule(F.lit("."), F.lit("."), True, on_root=True))


_OWN = ["_names", "_suffixes", "_prefixes", "_paths", "_others"]


def _last_rule(component: Column, path: Column, on_dir: bool, on_root: bool = False) -> Column:
    """Largest code among the own rules that fit the last component or the whole path, null if none does."""

    def best(rules_: str, fits) -> Column:
        def test(r: Column) -> Column:
            return fits(r) if on_dir or rules_ == "_others.rules" else fits(r) & ~r.dir_only

        return F.array_max(F.transform(F.filter(rules_, test), lambda r: r.code))

    # one expression per repository stays compiled from row to row; what fits a
    # directory or a file as a rule fits the file's path here
    touched = F.regexp_instr(F.lit(".") if on_root else F.col("path"), F.col("_others.any")) > 0

    return F.greatest(
        best("_names", lambda r: r.text == component),
        best("_suffixes", lambda r: component.endswith(r.text)),
        best("_prefixes", lambda r: component.startswith(r.text)),
        best("_paths", lambda r: r.text == path),
        F.when(touched, best("_others.rules", lambda r: F.rlike(path, r.on_dir if on_dir else r.on_file))),
    )


def exclude_by_repo(files: DataFrame, ignore_files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Common ``patterns`` first, then each repository's own ignore file.

    Own rules are told apart by shape once per repository; names, suffixes,
    prefixes and paths are compared as text, only the rest as regular
    expressions. ``ignore_files`` has one row per repository at most, so the join
    adds its rules to each file and moves nothing else; AQE broadcasts it when
    small and splits a repository with very many files when not.
    """
    patterns = list(patterns)
    parts = F.split("path", "/")
    # every directory of the path from the outermost on, then the file, each bound once
    places = F.zip_with(
        parts, F.concat(ancestors(F.col("path")), F.array("path")),
        lambda component, path: F.struct(component.alias("component"), path.alias("path"), (path == F.col("path")).alias("is_file")),
    )

    def judge(place: Column) -> Column:
        c, path = place.component, place.path
        return F.struct(
            F.when(place.is_file, _last_rule(c, path, False)).otherwise(_last_rule(c, path, True)).alias("code"),
            F.when(place.is_file, _decide(path, patterns, False)).otherwise(_decide(path, patterns, True)).alias("common"),
        )

    def go_down(above: Column, here: Column) -> Column:
        # a rule that fits a directory fits everything below
        code = F.greatest(above.code, here.code)
        return F.struct(
            code.alias("code"), (above.hidden | F.coalesce(code % 2 == 1, here.common, F.lit(False))).alias("hidden")
        )

    root = F.coalesce(F.col("_root") % 2 == 1, _decide(F.lit("."), patterns, True), F.lit(False))
    start = F.struct(F.lit(None).cast("int").alias("code"), root.alias("hidden"))
    hidden = F.aggregate(F.transform(places, judge), start, go_down, lambda end: end.hidden)
    return files.join(repository_rules(ignore_files), "repo", "left").filter(~hidden).drop(*_OWN, "_root")


# --- sizes and limits ---------------------------------------------------------


def parse_size(text: str) -> int:
    """``"10MB"`` to bytes, base 1024."""
    units = {"": 1, "B": 1, "K": 2**10, "M": 2**20, "G": 2**30, "T": 2**40}
    text = text.strip()
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    unit = text[len(digits):].strip().upper()
    unit = unit[:-1] if len(unit) == 2 and unit.endswith("B") else unit
    if not text or unit not in units:
        raise ValueError(f"not a size: {text!r}")
    return int(digits or 0) * units[unit]


def size_between(files: DataFrame, lo: int = 0, hi: int = 0) -> DataFrame:
    """Inclusive bounds; 0 disables a bound."""
    if lo > 0:
        files = files.filter(F.col("size") >= lo)
    return files.filter(F.col("size") <= hi) if hi > 0 else files


def walk_order() -> list[Column]:
    """Directory walk order: lexical per path component."""
    return [F.split(F.col("path"), "/")]


def limit_files(files: DataFrame, n: int) -> DataFrame:
    """First ``n`` files of each repository in walk order; 0 keeps all.

    Metadata only: content is dropped before the rows are exchanged.
    """
    files = files.drop("content")
    return first_n(files, ["repo"], walk_order(), n).drop("rank") if n > 0 else files


#: Bits of a size that one histogram tells apart: at most 4,096 rows per repository.
_HISTOGRAM_BITS = 12


def size_cuts(files: DataFrame, max_total: int) -> DataFrame:
    """(repo, cut, room) of the repositories over budget.

    Files below ``cut`` bytes fit; ``room`` bytes are left for those of exactly
    ``cut``. Found by histograms of sizes, each over the bucket in which the
    budget ran out before, so no file is ordered.
    """
    sizes = files.filter(F.col("size") <= max_total).select("repo", F.col("size").cast("long").alias("size"))
    shift = max_total.bit_length()
    cuts = None
    while shift > 0:
        width, shift = shift, max(0, shift - _HISTOGRAM_BITS)
        rows = sizes
        room = F.lit(max_total).cast("long")
        if cuts is not None:
            rows = sizes.join(cuts, ["repo"]).filter(F.shiftright("size", width) == F.shiftright("cut", width))
            room = F.col("room")
        buckets = rows.groupBy("repo", F.shiftright("size", shift).alias("bucket")).agg(
            F.sum("size").alias("total"), F.max(room).alias("room")
        )
        so_far = Window.partitionBy("repo").orderBy("bucket")
        cuts = (
            buckets.withColumn("running", F.sum("total").over(so_far))
            .filter(F.col("running") > F.col("room"))
            .groupBy("repo").agg(F.min(F.struct("bucket", "running", "total", "room")).alias("at"))
            .select(
                "repo", F.shiftleft("at.bucket", shift).alias("cut"),
                (F.col("at.room") - F.col("at.running") + F.col("at.total")).alias("room"),
            )
        )
    return cuts


def fit_budget(files: DataFrame, max_total: int) -> DataFrame:
    """Where a repository is over budget, keep its smallest files that fit.

    Files of the cut-off size that do not all fit are taken by path; only these
    are ranked. Metadata only: content is dropped before the rows are exchanged.
    """
    files = files.drop("content")
    if max_total <= 0:
        return files
    # a file above the budget on its own never fits
    cuts = stage(size_cuts(files, max_total)).select("repo", F.col("cut").alias("_cut"), F.col("room").alias("_room"))
    judged = files.join(cuts, "repo", "left")
    size, cut = F.col("size"), F.col("_cut")
    inside = (size <= max_total) & (cut.isNull() | (size < cut))
    tied = judged.filter((size == cut) & (F.col("_room") >= cut))
    kept = prefix(tied, ["repo"], ["path"]).filter(F.col("rank") * cut <= F.col("_room"))
    return judged.filter(inside).drop("_cut", "_room").unionByName(kept.drop("_cut", "_room", "rank"))


def is_large_project(
    files: DataFrame, size: int = 500 * 2**20, count: int = 10_000, some: int = 5_000, mean: int = 50 * 2**10,
) -> DataFrame:
    """Gate per repository: more bytes, more files, or ``some`` files of more than ``mean`` bytes."""
    n, total = F.col("file_count"), F.col("total_size")
    return (
        files.groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"))
        .withColumn(
            "is_large",
            (total > size) | (n > count) | ((n > some) & (F.floor(total / n) > mean)),
        )
    )


# --- binary detection ----------------------------------------------------------


def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def sniffed_binary(content: Column, sniff_bytes: int = rules.SNIFF_BYTES) -> Column:
    """The first ``sniff_bytes`` bytes are not plain UTF-8 text."""
    head = F.substring(content.cast("binary"), 1, sniff_bytes)
    signature = "|".join(map(_hex, rules.SNIFF_PREFIXES))
    riff = "52494646.{8}(?:" + "|".join(map(_hex, rules.SNIFF_RIFF)) + ")"
    form = "464F524D.{8}(?:" + "|".join(map(_hex, rules.SNIFF_FORM)) + ")"
    blank = "(?:09|0A|0C|0D|20)*"

    def either_case(tag: str) -> str:
        return "".join(
            f"(?:{_hex(c)}|{_hex(c.lower())})" if c.isalpha() else _hex(c) for c in tag
        )

    tags = "|".join(either_case(t) for t in rules.SNIFF_MARKUP_TAGS)
    markup = rf"{blank}(?:3C(?:{tags})(?:20|3E)|{_hex('<?xml')})"
    return F.hex(head).rlike(
        rf"{rules.SNIFF_CONTROL}|\A(?:{signature}|{riff}|{form}|{markup})"
    ) | _media_box(head)


def _media_box(head: Column) -> Column:
    """An ``ftyp`` box that fits into the bytes looked at and names an ``mp4`` brand."""
    box = F.conv(F.hex(F.substring(head, 1, 4)), 16, 10).cast("long")
    brands = F.filter(F.sequence(F.lit(8), (box - 1).cast("int"), F.lit(4)), lambda at: at != 12)
    named = F.exists(brands, lambda at: F.substring(head, at + 1, F.lit(3)) == F.lit(b"mp4"))
    fits = (F.octet_length(head) >= 12) & (box % 4 == 0) & box.between(12, F.octet_length(head))
    return F.when(fits & (F.substring(head, 5, 4) == F.lit(b"ftyp")), named).otherwise(False)


def binary_test(path: Column, content: Column, sniff_bytes: int = rules.SNIFF_BYTES) -> Column:
    """Extension, then media type by extension, then content; empty is binary."""
    ext = F.lower(extension(path))
    return (
        F.when(ext.isin(rules.BINARY_EXTENSIONS + rules.MIME_BINARY), True)
        .when(ext.isin(rules.MIME_TEXT), False)
        .when(content.isNull() | (F.octet_length(content) == 0), True)
        .otherwise(sniffed_binary(content, sniff_bytes))
    )


def classify_binary(files: DataFrame) -> DataFrame:
    """Adds ``is_binary``; content is dropped."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, binary_test(F.col("path"), F.col("content")).alias("is_binary"))


def classify_incremental(files: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all classified, newly classified) against memo(repo, path, size, mtime, is_binary).

    Files are split by key before their content is looked at.
    """
    key = ["repo", "path", "size", "mtime"]
    known = files.select(*key).join(memo.select(*key, "is_binary"), key)
    fresh = classify_binary(files.join(memo.select(*key), key, "left_anti")).select(*key, "is_binary")
    return known.unionByName(fresh), fresh


# --- the whole selection ---------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class CollectOptions:
    """What to select. Every limit is off (0) unless it is given."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    use_defaults: bool = True
    use_ignore_files: bool = True
    min_size: int = 0
    max_size: int = 0
    max_files: int = 0
    max_total_size: int = 0


def collect(files: DataFrame, options: CollectOptions = CollectOptions()) -> DataFrame:
    """(repo, path, size) of the selected files.

    Cheap metadata filters run before the content check; all of them are pure
    filters, so the order among them does not change the result.
    """
    patterns = list(options.exclude) + (default_excludes() if options.use_defaults else [])
    chosen = size_between(include(files, list(options.include)), options.min_size, options.max_size)
    if not options.use_ignore_files:
        chosen = prune_dirs(exclude(chosen, patterns), patterns)
    # content ends here: the joins and windows below move metadata only
    chosen = chosen.filter(~binary_test(F.col("path"), F.col("content"))).select("repo", "path", "size")
    if options.use_ignore_files:
        chosen = exclude_by_repo(chosen, files, patterns)
    # what reads content runs once; ranks and sums work on the narrow staged rows
    chosen = stage(chosen)
    return fit_budget(limit_files(chosen, options.max_files), options.max_total_size)
