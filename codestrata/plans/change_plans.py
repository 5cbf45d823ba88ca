"""Change-set queries."""

from codestrata.operators import changes
from codestrata.plans.corpora import duck, load
from pyspark.sql import functions as F


def _status(spark, sf):
    """One status row per path: that of its newest event."""
    rows = load(spark, sf, "chg")
    newest = F.max_by(F.struct("staging", "worktree"), "event_id")
    return rows.groupBy("repo", "path").agg(newest.alias("_s")).select("repo", "path", "_s.*")


def _trees(spark, sf):
    return load(spark, sf, "chg").groupBy("repo", "commit_seq", "path").agg(F.max("blob").alias("blob"))


def _commits(spark, sf):
    seq = F.col("commit_seq").cast("string")
    return load(spark, sf, "chg").select("repo", "commit_seq").distinct().select(
        "repo", "commit_seq", F.md5(F.concat("repo", F.lit("-"), seq)).alias("commit_id"),
        F.concat(F.lit(" \n fix "), seq, F.lit("\n\n")).alias("message"),
        F.when(F.col("commit_seq") % 3 == 0, F.lit(None)).otherwise(F.lit("refs/heads/main")).cast("string").alias("branch"),
    )


def _urls(spark, sf):
    return changes.parse_repo_urls(load(spark, sf, "urls"))


def _files(spark, sf):
    return _trees(spark, sf).select("repo", "path").distinct()


QUERIES = {
    "classify_changes": lambda s, d: changes.classify_changes(_status(s, d)),
    "recent_changes": lambda s, d: changes.recent_changes(_commits(s, d), _trees(s, d), 4),
    "recent_changes_default": lambda s, d: changes.recent_changes(_commits(s, d), _trees(s, d), 0),
    "all_changes": lambda s, d: changes.all_changes(_status(s, d), _commits(s, d), _trees(s, d), 3),
    "change_summary": lambda s, d: changes.change_summary(changes.classify_changes(_status(s, d))),
    "latest_commit": lambda s, d: changes.latest_commit(_commits(s, d)),
    "focus_changes": lambda s, d: changes.focus_changes(_files(s, d), changes.classify_changes(_status(s, d))),
    "focus_changes_only": lambda s, d: changes.focus_changes(_files(s, d), changes.classify_changes(_status(s, d)), only=True),
    "parse_repo_urls": _urls,
}

# --- oracle ------------------------------------------------------------------------

_BASE = f"""chg as ({duck('chg')}),
status as (select repo, path, max_by(staging, event_id) as staging, max_by(worktree, event_id) as worktree from chg group by repo, path),
trees as (select repo, commit_seq, path, max(blob) as blob from chg group by all),
commits as (select distinct repo, commit_seq from chg),
current as (select * from (select repo, path, case when staging in ('added', 'modified', 'deleted') then staging
  when worktree in ('modified', 'deleted') then worktree when worktree = 'untracked' then 'added' end as change_type,
  staging in ('added', 'modified', 'deleted') as is_staged from status) where change_type is not null)"""


def _recent(n):
    return f"""recent as (
select distinct coalesce(c.repo, p.repo) as repo, coalesce(c.path, p.path) as path from
  (select t.*, w.age from trees t join aged w using (repo, commit_seq) where age <= {n}) c
  full outer join (select t.*, w.age - 1 as age from trees t join aged w using (repo, commit_seq) where w.age between 2 and {n}) p
  on c.repo = p.repo and c.path = p.path and c.age = p.age where c.blob is distinct from p.blob)"""


_AGED = "aged as (select *, row_number() over (partition by repo order by commit_seq desc) as age from commits)"

ORACLES = {
    "classify_changes": f"with {_BASE} select * from current",
    "recent_changes": f"with {_BASE}, {_AGED}, {_recent(4)} select repo, path, 'modified' as change_type, false as is_staged from recent",
    "recent_changes_default": f"with {_BASE}, {_AGED}, {_recent(1)} select repo, path, 'modified' as change_type, false as is_staged from recent",
    "all_changes": f"with {_BASE}, {_AGED}, {_recent(3)} select * from current union all select repo, path, 'modified', false from recent r "
    "where not exists (select 1 from current c where c.repo = r.repo and c.path = r.path)",
    "change_summary": f"with {_BASE} select repo, count(*)::bigint as changed_files, count_if(is_staged)::bigint as staged, "
    "count_if(not is_staged)::bigint as unstaged, count(*) > 0 as has_changes from current group by repo",
    "latest_commit": f"with {_BASE} select repo, 'fix ' || seq as message, h as hash, case when seq % 3 = 0 then h else 'main' end as branch from "
    "(select repo, max(commit_seq) as seq, md5(repo || '-' || max(commit_seq))[1:7] as h from commits group by repo)",
    "focus_changes": f"with {_BASE} select f.repo, f.path, case when c.path is null then 1 else 0 end::bigint as priority from "
    "(select distinct repo, path from chg) f left join current c on f.repo = c.repo and f.path = c.path",
    "focus_changes_only": f"with {_BASE} select distinct chg.repo, chg.path from chg join current using (repo, path)",
    "parse_repo_urls": "select url, case when len(p) >= 2 then p[1] else '' end as owner, case when len(p) >= 2 then p[2] else '' end as name, "
    "'main' as branch, url <> '' and contains(url, 'github.com') and regexp_matches(url, '^(https?://|git@)') as is_valid from "
    "(select url, string_split(regexp_replace(regexp_replace(case when starts_with(url, 'git@github.com:') then url[16:] else "
    "regexp_replace(regexp_replace(url, '^https://', ''), '^http://', '') end, '^github\\.com/', ''), '\\.git$', ''), '/') as p "
    f"from ({duck('urls')}))",
}
