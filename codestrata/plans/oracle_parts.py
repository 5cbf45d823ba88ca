"""Shared building blocks of the SQL oracles (text only)."""

from codestrata.functions import rules
from codestrata.functions.text import WHITE_SPACE
from codestrata.plans.corpora import duck


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


# all white-space characters as one SQL string expression
_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def case_map(x: str, table: dict, default: str = "null") -> str:
    return f"case {x} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items()) + f" else {default} end"


def any_contains(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def any_suffix(x: str, needles) -> str:
    return "(" + " or ".join(f"ends_with({x}, {quote(n)})" for n in needles) + ")"


def base(x: str = "path") -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def ext(x: str = "path") -> str:
    return f"regexp_extract({x}, '\\.[^./]*$')"


def language(x: str = "path", extended: bool = False) -> str:
    table = rules.LANGUAGE_EXTENDED if extended else rules.LANGUAGE_BASIC
    return case_map(f"lower({ext(x)})", table, quote(rules.LANGUAGE_DEFAULT))


def split_lines(corpus: str, columns: str = "repo, path", where: str = "true") -> str:
    """Numbered split-model lines of a corpus."""
    return (
        f"select {columns}, unnest(a) as line, unnest(generate_series(1, len(a))) as line_no, len(a) as n "
        f"from (select *, string_split(content, chr(10)) as a from ({duck(corpus)}) where {where})"
    )


def scan_lines(corpus: str, columns: str = "repo, path", where: str = "true") -> str:
    """Numbered scan-model lines of a corpus."""
    return (
        f"select {columns}, line_no, regexp_replace(line, '\\r$', '') as line "
        f"from ({split_lines(corpus, columns, where)}) where not (line_no = n and line = '')"
    )
