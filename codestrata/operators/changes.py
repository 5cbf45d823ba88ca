"""Change sets from status, commit and tree tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions.text import trim


def classify_changes(status: DataFrame) -> DataFrame:
    """status(repo, path, staging, worktree) to changes(repo, path, change_type, is_staged).

    A staged change wins over an unstaged one; other states are dropped.
    """
    staged = F.when(F.col("staging").isin("added", "modified", "deleted"), F.col("staging"))
    unstaged = F.when(F.col("worktree").isin("modified", "deleted"), F.col("worktree")).when(
        F.col("worktree") == "untracked", "added"
    )
    return status.select(
        "repo", "path", F.coalesce(staged, unstaged).alias("change_type"), staged.isNotNull().alias("is_staged")
    ).filter(F.col("change_type").isNotNull())


def recent_changes(commits: DataFrame, trees: DataFrame, n: int = 1) -> DataFrame:
    """Paths that differ between consecutive snapshots of the last ``n`` commits.

    The oldest commit of the window has no parent inside it, so all its files
    count. Each tree entry stands for its own commit and as parent of the next
    one; one aggregation per (repo, commit, path) compares the two.
    """
    newest = Window.partitionBy("repo").orderBy(F.desc("commit_seq"))
    window = (
        commits.select("repo", "commit_seq").distinct()
        .withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= max(n, 1))
    )
    entries = trees.join(window, ["repo", "commit_seq"]).select("repo", "path", "_age", "blob")
    sides = entries.select(
        "repo", "path",
        F.inline(F.array(
            F.struct(F.col("_age").alias("at"), F.col("blob").alias("now"), F.lit(None).cast(trees.schema["blob"].dataType).alias("was")),
            F.struct((F.col("_age") - 1).alias("at"), F.lit(None).cast(trees.schema["blob"].dataType).alias("now"), F.col("blob").alias("was")),
        )),
    ).filter(F.col("at") >= 1)
    differs = ~F.max("now").eqNullSafe(F.max("was"))
    return (
        sides.groupBy("repo", "path", "at").agg(differs.alias("_changed")).filter("_changed")
        .select("repo", "path").distinct()
        .select("repo", "path", F.lit("modified").alias("change_type"), F.lit(False).alias("is_staged"))
    )


def all_changes(status: DataFrame, commits: DataFrame, trees: DataFrame, n: int) -> DataFrame:
    """Working-tree changes and recent commits; the working tree wins per path."""
    current = classify_changes(status).withColumn("_first", F.lit(1))
    if n <= 0:
        return current.drop("_first")
    recent = recent_changes(commits, trees, n).withColumn("_first", F.lit(0))
    best = F.max_by(F.struct("change_type", "is_staged"), F.col("_first"))
    return current.unionByName(recent).groupBy("repo", "path").agg(best.alias("_b")).select("repo", "path", "_b.*")


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts and flag per repository."""
    return changes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("changed_files"), F.count_if("is_staged").alias("staged"),
        F.count_if(~F.col("is_staged")).alias("unstaged"),
    ).withColumn("has_changes", F.col("changed_files") > 0)


def latest_commit(commits: DataFrame) -> DataFrame:
    """Newest commit of each repository: trimmed message, short hash, branch.

    A detached head (null branch) shows the short hash instead.
    """
    newest = F.max_by(F.struct("commit_id", "message", "branch"), "commit_seq")
    short = F.left(F.col("_c.commit_id"), F.lit(7))
    return commits.groupBy("repo").agg(newest.alias("_c")).select(
        "repo", trim(F.col("_c.message")).alias("message"), short.alias("hash"),
        F.coalesce(F.regexp_replace("_c.branch", r"\Arefs/heads/", ""), short).alias("branch"),
    )


def focus_changes(files: DataFrame, changes: DataFrame, only: bool = False) -> DataFrame:
    """Changed files first (``priority`` 0), or only them."""
    changed = changes.select("repo", "path").distinct()
    if only:
        return files.join(changed, ["repo", "path"], "left_semi")
    return files.join(changed.withColumn("_c", F.lit(0)), ["repo", "path"], "left").withColumn(
        "priority", F.coalesce("_c", F.lit(1)).cast("long")
    ).drop("_c")


def parse_repo_urls(urls: DataFrame, branch: str = "") -> DataFrame:
    """Owner, name, branch and validity of repository addresses in column ``url``."""
    url = F.col("url")
    bare = F.regexp_replace(url, r"\.git\z", "")
    ssh = bare.startswith("git@github.com:")
    web = bare
    for p in ("https://", "http://", "github.com/"):
        web = F.regexp_replace(web, r"\A" + p, "")
    parts = F.split(F.when(ssh, F.regexp_replace(bare, r"\Agit@github\.com:", "")).otherwise(web), "/")

    def part(n: int) -> Column:
        return F.when(F.size(parts) >= 2, F.get(parts, F.lit(n))).otherwise("")

    known = url.startswith("https://") | url.startswith("http://") | url.startswith("git@")
    return urls.select(
        "url", part(0).alias("owner"), part(1).alias("name"), F.lit(branch or "main").alias("branch"),
        ((url != "") & url.contains("github.com") & known).alias("is_valid"),
    )
