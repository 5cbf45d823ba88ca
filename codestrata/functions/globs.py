"""Glob and ignore patterns compiled to regular expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

_META = set("\\^$.|?*+()[]{}")


def _quote(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def _char_class(glob: str, start: int) -> tuple[str, int]:
    """Translate ``[...]`` starting at ``start``; returns (regex, next index)."""
    end = start + 1
    if end < len(glob) and glob[end] in "^!":
        end += 1
    if end < len(glob) and glob[end] == "]":
        end += 1
    while end < len(glob) and glob[end] != "]":
        end += 2 if glob[end] == "\\" else 1
    if end >= len(glob):
        raise ValueError(f"unterminated character class in {glob!r}")
    body = glob[start + 1 : end]
    negated = body[:1] in ("^", "!")
    body = body[1:] if negated else body
    body = body.replace("[", r"\[").replace("&&", r"&\&")
    return f"(?!/)[{'^' if negated else ''}{body}]", end + 1


def _component(glob: str) -> str:
    """Regex for one path component (no separators)."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            text, i = _char_class(glob, i)
            out.append(text)
            continue
        elif ch == "\\":
            if i + 1 >= len(glob):
                raise ValueError(f"trailing backslash in {glob!r}")
            i += 1
            out.append(_quote(glob[i]))
        else:
            out.append(_quote(ch))
        i += 1
    return "".join(out)


def _braces(glob: str) -> list[str]:
    """Expand the first ``{a,b}`` group (nested groups by recursion)."""
    start = i = glob.find("{")
    if start < 0:
        return [glob]
    depth, cuts = 0, [start]
    while i < len(glob):
        if glob[i] == "\\":
            i += 2
            continue
        if glob[i] == "{":
            depth += 1
        elif glob[i] == "}":
            depth -= 1
            if depth == 0:
                break
        elif glob[i] == "," and depth == 1:
            cuts.append(i)
        i += 1
    if depth or i >= len(glob):
        raise ValueError(f"unbalanced braces in {glob!r}")
    cuts.append(i)
    parts = [glob[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
    return [x for p in parts for x in _braces(glob[:start] + p + glob[i + 1 :])]


def path_glob(glob: str) -> str | None:
    """Whole-path glob: ``*`` stays in a component, ``**`` spans any number.

    Returns None for a malformed pattern, which then matches nothing.
    """
    try:
        alternatives = [_path_glob(g) for g in _braces(glob)]
    except ValueError:
        return None
    return r"\A(?:" + "|".join(alternatives) + r")\z"


def _path_glob(glob: str) -> str:
    parts = glob.split("/")
    out = []
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            if last:
                # after a directory, "**" also accepts the directory itself
                if out and out[-1].endswith("/"):
                    out[-1] = out[-1][:-1]
                    out.append("(?:/.*)?")
                else:
                    out.append(".*")
            else:
                out.append("(?:[^/]*/)*")
        else:
            out.append(_component(part) + ("" if last else "/"))
    return "".join(out)


class IgnoreRule(NamedTuple):
    """One ignore pattern; ``on_file`` / ``on_dir`` are regexes over the path."""

    exclude: bool
    on_file: str
    on_dir: str


NEVER = r"(?!)"


def ignore_rule(pattern: str) -> IgnoreRule:
    """Compile one ignore pattern.

    A pattern without an inner slash is tried against every component. With a
    slash it is anchored at the root and may stop at any directory of the path.
    ``**`` skips to the first component that fits and does not retry. A final
    slash restricts the last component to directories.
    """
    exclude = not pattern.startswith("!")
    body = pattern if exclude else pattern[1:]
    dir_only = body.endswith("/")
    body = body[:-1] if dir_only else body
    try:
        core = _anchored(body) if "/" in body else rf"\A(?:[^/]+/)*?(?:{_component(body)})"
    except ValueError:
        return IgnoreRule(exclude, NEVER, NEVER)
    if core is None:
        return IgnoreRule(exclude, NEVER, NEVER)
    below, at_or_below = core + "/", core + r"(?:/|\z)"
    return IgnoreRule(exclude, below if dir_only else at_or_below, at_or_below)


def _anchored(body: str) -> str | None:
    parts = body.split("/")
    out, skipping, matched = [r"\A"], False, False
    for n, part in enumerate(parts):
        if part == "":
            skipping = False
            continue
        if part == "**":
            if n == len(parts) - 1:
                break
            skipping = True
            continue
        if "**" in part:
            return None
        here = f"(?:{_component(part)})"
        if matched:
            out.append("/")
        if skipping:
            out.append(rf"(?:(?!{here}(?:/|\z))[^/]+/)*+")
            skipping = False
        out.append(here)
        matched = True
    return "".join(out) if matched else None


def python_regex(java: str) -> re.Pattern:
    """Same pattern for Python's engine (used by tests)."""
    return re.compile(java.replace(r"\z", r"\Z"))
