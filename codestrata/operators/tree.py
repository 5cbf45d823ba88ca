"""Directory trees as flat node tables, and their renderings as ordered rows.

A rendering is never one value: it is (repo, line_no, text) rows, so a
repository of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.operators.ordering import prefix
from codestrata.session import stage

FILE, DIRECTORY = "file", "dir"


def tree_nodes(files: DataFrame) -> DataFrame:
    """nodes(repo, node_path, parent, name, kind, depth); the root has path ''."""
    parts = F.split(F.col("path"), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))
    nodes = files.select("repo", F.size(parts).alias("_n"), F.explode(prefixes).alias("_p")).select(
        "repo", "_n", F.col("_p"), F.size("_p").alias("_depth")
    )
    return (
        nodes.select(
            "repo", F.array_join("_p", "/").alias("node_path"),
            F.when(F.col("_depth") == F.col("_n"), FILE).otherwise(DIRECTORY).alias("kind"),
            F.col("_depth").cast("long").alias("depth"),
        )
        # partial aggregation removes the repeated directories before the shuffle
        .distinct()
        .select(
            "repo", "node_path",
            F.when(F.col("depth") > 0, F.regexp_replace("node_path", r"/?[^/]*\z", "")).alias("parent"),
            F.substring_index("node_path", "/", -1).alias("name"), "kind", "depth",
        )
    )


def dir_counts(files: DataFrame) -> DataFrame:
    """Files below each directory, all levels, without recursion."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return files.select("repo", F.explode(above).alias("dir")).groupBy("repo", "dir").agg(
        F.count(F.lit(1)).alias("file_count")
    )


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Graph edges and files per repository."""
    return nodes.groupBy("repo").agg(
        (F.count(F.lit(1)) - 1).alias("edge_count"), F.count_if(F.col("kind") == FILE).alias("file_count")
    )


def _walk_key(node_path: Column, kind: Column) -> Column:
    """Sorts nodes depth first, files of a directory before its subdirectories."""
    parts = F.split(node_path, "/")
    last = F.size(parts) - 1
    keyed = F.transform(
        parts,
        lambda p, i: F.struct(
            F.when((i == last) & (kind == FILE), 0).otherwise(1).alias("is_dir"), p.alias("name")
        ),
    )
    empty = F.array().cast("array<struct<is_dir:int,name:string>>")
    return F.when(node_path == "", empty).otherwise(keyed)


def _ranked(nodes: DataFrame, *columns: str) -> DataFrame:
    keyed = nodes.select("repo", *columns, _walk_key(F.col("node_path"), F.col("kind")).alias("_walk"))
    return prefix(keyed, ["repo"], ["_walk"]).drop("_walk")


def _last_children(nodes: DataFrame) -> DataFrame:
    """(repo, parent, last child): the last directory, else the last file. Grows with the nodes, so it is never sent whole."""
    order = F.struct((F.col("kind") == DIRECTORY).alias("d"), F.col("name").alias("n"))
    return (
        nodes.filter(F.col("parent").isNotNull()).groupBy("repo", "parent").agg(F.max(order).alias("_m"))
        .select("repo", F.col("parent"), F.col("_m.n").alias("_last_name"), F.col("_m.d").alias("_last_dir")).hint("merge")
    )


def _is_last() -> Column:
    here = (F.col("name") == F.col("_last_name")) & ((F.col("kind") == DIRECTORY) == F.col("_last_dir"))
    return F.coalesce(here, F.lit(True))


def _inside(nodes: DataFrame, last: DataFrame) -> DataFrame:
    """(repo, parent, _indent, last child): what every directory hands down to its children.

    Only directories look at the directories above them, a fraction of the nodes;
    files take all they need from their own. Written tables of paths are small and
    unpack to many times their size, so none of the joins may send one side whole.
    """
    dirs = stage(
        nodes.filter(F.col("kind") == DIRECTORY).join(last, ["repo", "parent"], "left").select(
            "repo", "node_path", "depth", F.when(_is_last(), "    ").otherwise("│   ").alias("_piece")
        )
    )
    parts = F.split(F.col("node_path"), "/")
    path = F.transform(F.sequence(F.lit(1), F.col("depth").cast("int")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = dirs.filter("depth > 0").select("repo", "node_path", F.posexplode(path).alias("_at", "_dir"))
    drawn = (
        steps.join(dirs.select("repo", F.col("node_path").alias("_dir"), "_piece").hint("merge"), ["repo", "_dir"])
        # one entry per level of the path
        .groupBy("repo", "node_path").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_steps"))
        .select("repo", "node_path", F.array_join(F.transform("_steps", lambda s: s["_piece"]), "").alias("_drawn"))
    )
    # the root's piece is blank
    indent = F.concat(F.lit("    "), F.coalesce("_drawn", F.lit("")))
    inside = dirs.join(drawn.hint("merge"), ["repo", "node_path"], "left").select("repo", F.col("node_path").alias("parent"), indent.alias("_indent"))
    return inside.join(last, ["repo", "parent"], "left").hint("merge")


def tree_text(nodes: DataFrame, root_name: Column | None = None) -> DataFrame:
    """(repo, line_no, text): the tree drawn with box glyphs.

    The narrow node table is used several times, so it is staged once.
    """
    nodes = stage(nodes)
    root = F.col("repo") if root_name is None else root_name
    text = F.concat(
        F.coalesce("_indent", F.lit("")), F.when(_is_last(), "└── ").otherwise("├── "),
        F.when(F.col("depth") == 0, root).otherwise(F.col("name")),
        F.when(F.col("kind") == DIRECTORY, "/").otherwise(""),
    )
    # numbered before the joins: a range partition reads its input twice
    lines = _ranked(nodes, "parent", "name", "kind", "depth").join(_inside(nodes, _last_children(nodes)), ["repo", "parent"], "left")
    return lines.select("repo", F.col("rank").alias("line_no"), text.alias("text"))


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Nodes numbered depth first, with the number of their parent.

    Columns: repo, id, label, kind, parent_id (null for the root). A range
    partition reads its input twice, so the nodes are staged before.
    """
    ids = _ranked(stage(nodes), "node_path", "parent", "name", "kind").withColumn("id", F.col("rank") - 1)
    parents = ids.filter(F.col("kind") == DIRECTORY).select(
        "repo", F.col("node_path").alias("parent"), F.col("id").alias("parent_id")
    )
    return ids.join(parents, ["repo", "parent"], "left").select(
        "repo", "id", F.when(F.col("parent").isNull(), F.col("repo")).otherwise(F.col("name")).alias("label"),
        "kind", "parent_id",
    )


def to_dot(edges: DataFrame) -> DataFrame:
    """(repo, line_no, text): the graph in DOT, a node line and its edge line.

    The edges are used twice here, and again by whoever sorts the lines, so they
    are staged once.
    """
    edges = stage(edges)
    label = F.concat(F.col("kind"), F.lit("_"), F.col("id").cast("string"))
    shown = F.concat(F.col("label"), F.when(F.col("kind") == DIRECTORY, "/").otherwise(""))
    node = F.concat(
        F.lit("  "), label, F.lit(' [label="'), shown, F.lit('", shape='),
        F.when(F.col("kind") == DIRECTORY, "folder").otherwise("note"), F.lit("];"),
    )
    edge = F.concat(F.lit("  dir_"), F.col("parent_id").cast("string"), F.lit(" -> "), label, F.lit(";"))

    def row(n: Column, text: Column) -> Column:
        return F.struct(n.cast("long").alias("line_no"), text.alias("text"))

    rows = F.array_compact(F.array(
        F.when(F.col("id") == 0, row(F.lit(0), F.lit("digraph G {"))),
        row(F.col("id") * 2 + 1, node),
        F.when(F.col("parent_id").isNotNull(), row(F.col("id") * 2 + 2, edge)),
    ))
    body = edges.select("repo", F.inline(rows))
    closing = edges.groupBy("repo").agg((F.max("id") * 2 + 3).alias("line_no")).withColumn("text", F.lit("}"))
    return body.unionByName(closing)


def tree_json(nodes: DataFrame) -> DataFrame:
    """(repo, line_no, text): lines that together are the nested JSON document.

    A directory contributes opening and closing lines, a file one line; all of
    them are sorted by their place in the document.
    """
    nodes = stage(nodes)

    def encoded(text: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)

    is_dir = F.col("kind") == DIRECTORY
    last_of_kind = nodes.filter(F.col("parent").isNotNull()).groupBy("repo", "parent").agg(
        F.max(F.when(is_dir, F.col("name"))).alias("_last_subdir"),
        F.max(F.when(~is_dir, F.col("name"))).alias("_last_file"),
    )
    inside = last_of_kind.select("repo", F.col("parent").alias("node_path"), F.col("_last_subdir").isNotNull().alias("_has_dirs"),
                                 F.col("_last_file").isNotNull().alias("_has_files"))
    rows = nodes.join(last_of_kind, ["repo", "parent"], "left").join(inside, ["repo", "node_path"], "left")

    # document order of one level: 0 opening, 1 subdirectories, 2 between, 3 files, 4 closing
    parts = F.split(F.col("node_path"), "/")
    depth = F.col("depth").cast("int")
    own = F.when(is_dir, 1).otherwise(3)
    path_key = F.transform(
        F.when(F.col("node_path") == "", F.array().cast("array<string>")).otherwise(parts),
        lambda p, i: F.struct(F.when(i == depth - 1, own).otherwise(1).alias("place"), p.alias("name")),
    )

    def key(place: int) -> Column:
        return F.concat(path_key, F.array(F.struct(F.lit(place).alias("place"), F.lit("").alias("name"))))

    def line(place: int, text: Column) -> Column:
        return F.struct(key(place).alias("_walk"), text.alias("text"))

    pad = F.repeat(F.lit("  "), depth * 2)
    comma = F.when(
        (depth > 0) & ~F.coalesce(F.col("name") == F.when(is_dir, F.col("_last_subdir")).otherwise(F.col("_last_file")), F.lit(False)), ","
    ).otherwise("")
    label = F.when(depth == 0, F.col("repo")).otherwise(F.col("name"))
    opening = F.concat(
        pad, F.when(depth == 0, "").otherwise(F.concat(encoded(F.col("name")), F.lit(": "))), F.lit('{"Name": '), encoded(label),
        F.lit(', "SubDirs": {'),
    )
    dirs = F.array(
        line(0, opening),
        line(2, F.concat(pad, F.lit('}, "Files": ['))),
        line(4, F.concat(pad, F.lit("]}"), comma)),
    )
    files_ = F.array(line(0, F.concat(pad, encoded(F.col("name")), comma)))
    lines = rows.select("repo", F.inline(F.when(is_dir, dirs).otherwise(files_)))
    return prefix(lines, ["repo"], ["_walk"]).withColumnRenamed("rank", "line_no").select("repo", "line_no", "text")
