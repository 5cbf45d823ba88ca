"""Inventory queries."""

from codestrata.functions import rules
from codestrata.operators import inventory
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import base, case_map, ext, in_list, language

_INV = duck("inv")


def _on_inv(op, **kwargs):
    return lambda spark, sf: op(load(spark, sf, "inv"), **kwargs)


QUERIES = {
    "with_language": lambda s, d: inventory.with_language(load(s, d, "inv")).select("repo", "path", "language"),
    "with_language_ext": lambda s, d: inventory.with_language(load(s, d, "inv"), extended=True).select(
        "repo", "path", "language"
    ),
    "file_types": _on_inv(inventory.file_types),
    "technologies": _on_inv(inventory.technologies),
    "technologies_ext": _on_inv(inventory.technologies_ext),
    "key_files": _on_inv(inventory.key_files),
    "key_files_ext": _on_inv(inventory.key_files_ext),
    "project_issues": _on_inv(inventory.project_issues),
    "project_issues_ext": _on_inv(inventory.project_issues_ext),
    "repo_size": _on_inv(inventory.repo_size),
}


def _tech(suffixes, names):
    return (
        f"select distinct repo, technology from (select repo, {case_map(ext(), suffixes)} as technology from ({_INV}) "
        f"union all select repo, {case_map(base(), names)} from ({_INV})) where technology is not null"
    )


def _issues(*tests):
    return " union all ".join(
        f"select repo, '{name}' as issue from ({_INV}) group by repo having not bool_or({test})" for name, test in tests
    )


_B = f"lower({base()})"
_README = (rules.ISSUE_README, f"contains({_B}, 'readme')")

ORACLES = {
    "with_language": f"select repo, path, {language()} as language from ({_INV})",
    "with_language_ext": f"select repo, path, {language(extended=True)} as language from ({_INV})",
    "file_types": f"select repo, case when {ext()} = '' then '(no extension)' else {ext()} end as extension, "
    f"count(*)::bigint as file_count from ({_INV}) group by all",
    "technologies": _tech(rules.TECH_SUFFIX_BASIC, rules.TECH_BASENAME_BASIC),
    "technologies_ext": _tech(rules.TECH_SUFFIX_EXTENDED, rules.TECH_BASENAME_EXTENDED),
    "key_files": f"select repo, path from ({_INV}) where {base()} in {in_list(rules.KEY_FILES_BASIC)}",
    "key_files_ext": f"select repo, path from ({_INV}) where {base()} in {in_list(rules.KEY_FILES_EXTENDED)}",
    "project_issues": _issues(_README),
    "project_issues_ext": _issues(
        _README,
        (rules.ISSUE_LICENSE, f"contains({_B}, 'license') or contains({_B}, 'licence')"),
        (rules.ISSUE_GITIGNORE, f"{_B} = '.gitignore'"),
        (rules.ISSUE_TESTS, f"contains({_B}, 'test') or contains({_B}, 'spec')"),
    ),
    "repo_size": f"select repo, sum(case when regexp_matches(path, '(^|/)\\.git/') then 0 else size end)::bigint as size "
    f"from ({_INV}) group by repo",
}
