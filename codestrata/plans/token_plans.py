"""Token and statistics queries."""

from codestrata.functions.text import WHITE_SPACE
from codestrata.functions.tokens import CHARS_BY_WEIGHT, CODE_WEIGHT, TEXT_WEIGHT
from codestrata.operators import tokens
from codestrata.plans.corpora import duck, load
from codestrata.plans.oracle_parts import scan_lines
from codestrata.plans.corpora import spread


def _conversations(spark, sf):
    turns = spread(spark.read.parquet(f"{sf}/conversations.parquet"))
    return tokens.with_tokens(turns, "text").select("conv_id", "turn", "tokens")


QUERIES = {
    "text_tokens": _conversations,
    "file_tokens": lambda s, d: tokens.file_tokens(load(s, d, "docs")),
    "file_tokens_code": lambda s, d: tokens.file_tokens(load(s, d, "code")),
    "basic_tokens": lambda s, d: tokens.with_basic_tokens(load(s, d, "docs"), "size").select("repo", "path", "basic_tokens"),
    "project_stats": lambda s, d: tokens.project_stats(load(s, d, "docs")),
}

# --- oracle: the sum in doubles, character by character --------------------------


def _chars(text: str) -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in text) + ")"


def _weight(ch: str, other: float) -> str:
    arms = " ".join(f"when contains({_chars(c)}, {ch}) then {w}" for w, c in CHARS_BY_WEIGHT.items())
    return f"case {arms} when contains({_chars(WHITE_SPACE)}, {ch}) then 0.3 else {other} end"


def _estimate(x: str, other: float) -> str:
    """Weights as doubles, added from the left."""
    weights = f"list_transform(string_split({x}, ''), lambda c: ({_weight('c', other)})::double)"
    return f"(case when {x} = '' then 0 else floor(list_reduce({weights}, lambda a, b: a + b, 0.0::double)) end)::bigint"


def _files(corpus):
    return (
        f"select f.repo, f.path, f.size, strlen(f.content) as bytes, coalesce(t.tokens, 0)::bigint as tokens from ({duck(corpus)}) f left join "
        f"(select repo, path, sum({_estimate('line', CODE_WEIGHT)} + 1) as tokens from ({scan_lines(corpus)}) group by repo, path) t "
        "on f.repo = t.repo and f.path = t.path"
    )


ORACLES = {
    "text_tokens": f"select conv_id, turn, {_estimate('text', TEXT_WEIGHT)} as tokens from conversations",
    "file_tokens": f"select repo, path, tokens from ({_files('docs')})",
    "file_tokens_code": f"select repo, path, tokens from ({_files('code')})",
    "basic_tokens": f"select repo, path, size // 4 as basic_tokens from ({duck('docs')})",
    "project_stats": "select repo, count(*)::bigint as file_count, sum(size)::bigint as total_size, sum(tokens)::bigint as token_count, "
    f"sum(bytes)::bigint as char_count, (sum(size) // greatest(count(*), 1))::bigint as avg_file_size from ({_files('docs')}) group by repo",
}
