"""Exported symbols and imports, extracted inside the file's row.

Each language is an array expression over the content; nothing is shuffled.
Symbols: repo, path, language, pos, kind, name, signature, doc.
Imports: repo, path, language, pos, target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions.globs import path_glob
from codestrata.functions.text import any_of, basename, extension, rx, split_lines, trim

_SP = r"[\t\n\f\r ]"
_NSP = r"[^\t\n\f\r ]"
_W = r"\w"
_SYMBOL = "struct<kind:string,name:string,signature:string,doc:string>"

GO, JS, PY, JAVA, C = "go", "javascript", "python", "java", "c/c++"
# Extension to summarised language.
LANGUAGES = {
    ".go": GO, ".js": JS, ".jsx": JS, ".ts": JS, ".tsx": JS, ".py": PY, ".java": JAVA,
    ".c": C, ".h": C, ".cpp": C, ".hpp": C, ".cc": C, ".cxx": C,
}


def _symbol(kind: Column | str, name: Column, signature: Column, doc: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"),
        signature.alias("signature"), (F.lit("") if doc is None else doc).alias("doc"),
    )


def _no_symbols() -> Column:
    return F.array().cast(f"array<{_SYMBOL}>")


def _once(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often ``make`` uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _each(text: Column, pattern: str, make) -> Column:
    """One symbol per match; ``make`` receives a group accessor."""
    def build(hit: Column) -> Column:
        return make(lambda n: F.regexp_extract(hit, pattern, n))
    return F.transform(_all(text, pattern), build)


def _named(kind: str, prefix: str):
    """Symbol whose signature is a prefix and the name."""
    return lambda g: _symbol(kind, g(1), F.concat(F.lit(prefix + " "), g(1)))


# --- JavaScript / TypeScript ---------------------------------------------------

_JS_IMPORT = rx(rf"import{_SP}+.*?{_SP}+from{_SP}+['\"](.+?)['\"]")
_JS_FUNCTION = rx(rf"export{_SP}+(?:async{_SP}+)?function{_SP}+({_W}+){_SP}*\((.*?)\)")
_JS_CLASS = rx(rf"export{_SP}+class{_SP}+({_W}+)")
_JS_CONST = rx(rf"export{_SP}+const{_SP}+({_W}+)")


def _js_symbols(text: Column) -> Column:
    found = F.concat(
        _each(text, _JS_FUNCTION, lambda g: _symbol("function", g(1), F.concat(F.lit("function "), g(1), F.lit("("), g(2), F.lit(")")))),
        _each(text, _JS_CLASS, _named("class", "class")),
        _each(text, _JS_CONST, _named("const", "const")),
    )
    return F.when(text.contains("export"), found).otherwise(_no_symbols())


def _js_imports(text: Column) -> Column:
    both = text.contains("import") & text.contains("from")
    return F.when(both, _all(text, _JS_IMPORT, 1)).otherwise(F.array().cast("array<string>"))


def _js_doc(text: Column) -> Column:
    return trim(F.regexp_extract(text, r"(?ds)\A/\*\*.*?\*/", 0))


# --- Python ------------------------------------------------------------------------

_PY_IMPORT = rx(rf"\Afrom{_SP}+({_NSP}+){_SP}+import{_SP}+.")
_PY_FUNCTION = rx(rf"\Adef{_SP}+({_W}+){_SP}*\((.*?)\)")
_PY_CLASS = rx(rf"\Aclass{_SP}+({_W}+)")


def _py_lines(text: Column, pattern: str, make) -> Column:
    """Only lines that begin with the pattern (top level)."""
    hits = F.filter(split_lines(text), lambda x: x.rlike(pattern))
    return F.transform(hits, lambda x: make(lambda n: F.regexp_extract(x, pattern, n)))


def _py_symbols(text: Column) -> Column:
    return F.concat(
        _py_lines(text, _PY_FUNCTION, lambda g: _symbol("function", g(1), F.concat(F.lit("def "), g(1), F.lit("("), g(2), F.lit(")")))),
        _py_lines(text, _PY_CLASS, _named("class", "class")),
    )


def _py_imports(text: Column) -> Column:
    hits = F.filter(F.transform(split_lines(text), trim), lambda x: x.rlike(_PY_IMPORT))
    return F.transform(hits, lambda x: F.regexp_extract(x, _PY_IMPORT, 1))


def _py_doc(text: Column) -> Column:
    return trim(F.regexp_extract(text, rx(r'\A"""(.*?)"""'), 1))


# --- Java ----------------------------------------------------------------------------

_JAVA_IMPORT = rx(rf"import{_SP}+(.+?);")
_JAVA_CLASS = rx(rf"public{_SP}+class{_SP}+({_W}+)")
_JAVA_INTERFACE = rx(rf"public{_SP}+interface{_SP}+({_W}+)")
_JAVA_METHOD = rx(rf"public{_SP}+(?:static{_SP}+)?({_W}+){_SP}+({_W}+){_SP}*\((.*?)\)")


def _java_symbols(text: Column) -> Column:
    found = F.concat(
        _each(text, _JAVA_CLASS, _named("class", "public class")),
        _each(text, _JAVA_INTERFACE, _named("interface", "public interface")),
        _each(text, _JAVA_METHOD, lambda g: _symbol(
            "method", g(2), F.concat(F.lit("public "), g(1), F.lit(" "), g(2), F.lit("("), g(3), F.lit(")")))),
    )
    return F.when(text.contains("public"), found).otherwise(_no_symbols())


def _java_imports(text: Column) -> Column:
    return _all(text, _JAVA_IMPORT, 1)


# --- C / C++ ---------------------------------------------------------------------------

_C_INCLUDE = rx(rf"#include{_SP}+[<\"](.+?)[>\"]")
_C_RUN = r"[\w\t\n\f\r *]"
# A run of words, blanks and stars from a line start is consumed as a whole, with
# or without a parameter list behind it: every character is visited once.
_C_HEAD = rf"(?dm)^{_C_RUN}++(?:\(.*?\){_SP}*[;{{])?"
_C_NAME = rf"\A{_C_RUN}*{_C_RUN}{_SP}({_W}+){_SP}*\("
_C_PARAMS = rf"(?d)\((.*?)\){_SP}*[;{{]\z"
_C_STRUCT = rx(rf"struct{_SP}+({_W}+)")
_C_KEYWORDS = ["if", "while", "for", "switch"]


def _c_symbols(text: Column) -> Column:
    heads = F.filter(_all(text, _C_HEAD), lambda h: h.contains("("))
    named = F.filter(
        F.transform(heads, lambda h: F.struct(
            F.regexp_extract(h, _C_NAME, 1).alias("name"), F.regexp_extract(h, _C_PARAMS, 1).alias("params"))),
        lambda f: (f["name"] != "") & ~f["name"].isin(_C_KEYWORDS),
    )
    functions = F.transform(
        named, lambda f: _symbol("function", f["name"], F.concat(f["name"], F.lit("("), f["params"], F.lit(")")))
    )
    return F.concat(functions, _each(text, _C_STRUCT, _named("struct", "struct")))


def _c_imports(text: Column) -> Column:
    return _all(text, _C_INCLUDE, 1)


# --- Go ----------------------------------------------------------------------------------

# The layout of formatted Go. A comment block with the declaration
# behind it, or a declaration alone. Grouped declarations and parameter lists over
# several lines run to the closing bracket at the line start.
_GO_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_GO_COMMENTS = rf"(?:^//[^\n]*\n|^{_GO_BLOCK}[ \t]*\n)"
_GO_DECL = (
    r"(?:^(?:const|var|type|import) \([^\n]*\n(?:[^)\n][^\n]*\n|\n)*+\)"
    r"|^func [^\n]*[(\[,]\n(?:[ \t][^\n]*\n|\n)*+[)\]][^\n]*"
    r"|^(?:package|func|type|const|var|import) [^\n]*)"
)
_GO_CHUNK = rf"(?dm){_GO_COMMENTS}++(?:{_GO_DECL})?|{_GO_DECL}"
_GO_FUNC = r"(?ds)\Afunc (?:\(([^()]*)\) )?(\p{Lu}[\p{L}\p{N}_]*)(.*)\z"
_GO_EXPORTED_FUNC = r"(?dm)^func (?:\([^)\n]*\) )?(\p{Lu}[\p{L}\p{N}_]*)[\[(]"
_GO_VALUE_HEAD = r"(?dm)^(?:(?:const|var) |\t)([\p{L}_][\p{L}\p{N}_]*(?:, *[\p{L}_][\p{L}\p{N}_]*)*)"
_GO_DIRECTIVE = r"\A//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )"
_GO_PARAMETERS = r"(?:\[(?:[^\[\]\n]|\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\])*\])?"
_GO_TYPE = rf"(?dm)^(?:type |\t)(\p{{Lu}}[\p{{L}}\p{{N}}_]*){_GO_PARAMETERS} (?:= )?(struct|interface|[^\n]*)"

# Private characters that stand for types printed already: interface{}, a form
# without a plain spelling, func, [], the brackets of a map, and the dots of a
# variable parameter.
_EMPTY, _OTHER, _FUNC, _SLICE, _OPEN, _CLOSE, _DOTS = "\ue001\ue002\ue003\ue004\ue005\ue006\ue007"
_GO_WORD = rf"[\p{{L}}\p{{N}}_.*{_EMPTY}-{_DOTS}]"
#: One round replaces every innermost bracket by what is printed for it.
_GO_ROUND = [
    (r"\bmap\[([^\[\](){}]+)\]", f"map{_OPEN}$1{_CLOSE}"),
    (r"(?<![\p{L}\p{N}_.])(?!map\[)[\p{L}_][\p{L}\p{N}_.]*\[[^\[\](){}]+\]", _OTHER),
    (r"(?<![\p{L}\p{N}_.])\[[^\[\](){}]*\](?=[^\s,)])", _SLICE),
    (rf"(?:<-chan|chan<-|\bchan) (?!chan\b|<-){_GO_WORD}++(?![\[({{])", _OTHER),
    (rf"\bfunc\([^()\[\]{{}}]*\)(?: \([^()\[\]{{}}]*\)| (?!chan\b){_GO_WORD}++)?(?=\z|[,)\]}};])", _FUNC),
    (r"\bstruct ?\{[^{}]*\}", _OTHER),
    (r"\binterface ?\{[^{}]*\}", _EMPTY),
    # not the parameters right behind type parameters
    (rf"(?<=[*{_SLICE}{_CLOSE}{_DOTS}])(?<!\A.)\([^()]*\)", _OTHER),
]
_GO_HEAD = rf"\A[{_SLICE}{_OTHER}]?\(([^()]*)\)(?: \(([^()]*)\)| ([^()]+))? *\z"


def _go_flat(text: Column) -> Column:
    """A signature whose types hold no brackets: nested ones are replaced from the inside, to any depth."""
    start = F.regexp_replace(F.regexp_replace(text, rf"//[^\n]*|{_GO_BLOCK}", ""), r"\s+", " ")
    start = F.regexp_replace(start, r"\.\.\.", _DOTS)

    def once(t: Column) -> Column:
        for pattern, by in _GO_ROUND:
            t = F.regexp_replace(t, pattern, by)
        return t

    def step(at: Column, _: Column) -> Column:
        # a round that changed nothing was the last one
        return F.when(at["text"] == at["before"], at).otherwise(F.struct(once(at["text"]).alias("text"), at["text"].alias("before")))

    def flat(text: Column) -> Column:
        # each round closes at least one bracket or channel
        rounds = F.regexp_count(text, F.lit(r"[\[{]|func\(|\bchan\b|[*\]]\("))
        first = F.struct(text.alias("text"), F.lit(None).cast("string").alias("before"))
        return _once(rounds, lambda n: F.when(n == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), n), first, step)["text"]))

    return _once(start, flat)


def _go_type(text: Column) -> Column:
    """Type as printed in a signature; forms without a plain spelling give ``...``."""
    out = F.regexp_replace(text, f"{_DOTS}.*", _OTHER)
    for mark, shown in ((_EMPTY, "interface{}"), (_OTHER, "..."), (_FUNC, "func"), (_SLICE, "[]"), (_OPEN, "["), (_CLOSE, "]")):
        out = F.replace(out, F.lit(mark), F.lit(shown))
    return out


def _go_fields(text: Column) -> Column:
    """``a, b int, c string`` to ``a int, b int, c string``."""
    def cut(p: Column) -> Column:
        return F.instr(p, " ")

    def step(acc: Column, p: Column) -> Column:
        kind = F.when(p.contains(" "), _go_type(trim(F.substring(p, cut(p) + 1, F.length(p))))).otherwise(acc["kind"])
        name = F.when(p.contains(" "), F.left(p, cut(p) - 1)).otherwise(p)
        return _once(kind, lambda k: F.struct(
            k.alias("kind"),
            F.concat(name, F.lit(" "), k, F.when(acc["out"] == "", "").otherwise(F.concat(F.lit(", "), acc["out"]))).alias("out"),
        ))

    start = F.struct(F.lit("").alias("kind"), F.lit("").alias("out"))

    def printed(parts: Column) -> Column:
        named = F.exists(parts, lambda p: p.contains(" "))
        return F.when(named, F.aggregate(F.reverse(parts), start, step)["out"]).otherwise(
            F.array_join(F.transform(parts, _go_type), ", ")
        )

    return _once(F.filter(F.transform(F.split(text, ","), trim), lambda p: p != ""), printed)


def _go_function(decl: Column, doc: Column) -> Column:
    def group(text: Column, pattern: str, n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    def printed(parts: Column, t: Column) -> Column:
        owner, name = parts["owner"], parts["name"]
        receiver = F.when(owner != "", F.concat(_go_fields(_go_flat(owner)), F.lit(" "))).otherwise("")
        result = _once(F.struct(group(t, _GO_HEAD, 2).alias("list"), group(t, _GO_HEAD, 3).alias("one")), lambda g: (
            F.when(g["list"] != "", _go_fields(g["list"])).when(g["one"] != "", _go_type(trim(g["one"]))).otherwise("")
        ))
        whole = F.concat(
            F.lit("func "), receiver, name, F.lit("("), _go_fields(group(t, _GO_HEAD, 1)), F.lit(")"),
            _once(result, lambda r: F.when(r != "", F.concat(F.lit(" "), r)).otherwise("")),
        )
        # what does not parse is left as written
        raw = F.concat(F.lit("func "), F.when(owner != "", F.concat(F.lit("("), owner, F.lit(") "))).otherwise(""), name, parts["rest"])
        return _symbol("function", name, F.when(t.rlike(_GO_HEAD), whole).otherwise(raw), doc)

    parts = F.struct(
        group(decl, _GO_FUNC, 1).alias("owner"), group(decl, _GO_FUNC, 2).alias("name"),
        # the signature ends where the body opens
        F.regexp_replace(group(decl, _GO_FUNC, 3), r"(?s)(?<!\bstruct)(?<!\binterface) \{.*\z", "").alias("rest"),
    )
    return F.transform(F.array(parts), lambda p: _once(_go_flat(p["rest"]), lambda t: printed(p, t)))


def _go_types(decl: Column, doc: Column) -> Column:
    def make(g) -> Column:
        kind = F.when(g(2) == "interface", "interface").otherwise("type")
        tail = F.when(g(2).isin("interface", "struct"), F.concat(F.lit(" "), g(2))).otherwise("")
        return _symbol(kind, g(1), F.concat(F.lit("type "), g(1), tail), doc)

    return _each(F.regexp_replace(decl, _GO_BLOCK, ""), _GO_TYPE, make)


def _go_values(decl: Column, kind: str, doc: Column) -> Column:
    heads = _all(F.regexp_replace(decl, _GO_BLOCK, ""), _GO_VALUE_HEAD, 1)
    names = F.filter(
        F.flatten(F.transform(heads, lambda h: F.transform(F.split(h, ","), trim))), lambda n: n.rlike(r"\A\p{Lu}")
    )
    return F.transform(names, lambda n: _symbol(kind, n, F.concat(F.lit(kind + " "), n), doc))


def _go_doc_text(comment: Column) -> Column:
    """Text of a comment block: markers, directives and superfluous blank lines are left out."""
    def lines(c: Column) -> Column:
        return F.when(c.startswith("/*"), F.split(F.substring(c, F.lit(3), F.length(c) - 4), "\n")).otherwise(
            F.array(F.regexp_replace(c, r"\A// ?", ""))
        )

    comments = F.filter(_all(comment, rf"(?dm)^//[^\n]*|^{_GO_BLOCK}"), lambda c: ~c.rlike(_GO_DIRECTIVE))
    kept = F.transform(F.flatten(F.transform(comments, lines)), lambda l: F.regexp_replace(l, r"[ \t\r]+\z", ""))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"\A\n+|\n+\z", "")
    return _once(text, lambda t: F.when(t == "", "").otherwise(F.concat(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit("\n"))))


def _go_chunks(text: Column) -> Column:
    """array<struct<doc, decl>> of the top-level declarations."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))

    def cut(chunk: Column) -> Column:
        return _once(F.regexp_extract(chunk, rf"(?dm)\A{_GO_COMMENTS}+", 0), lambda comment: F.struct(
            F.when(comment == "", "").otherwise(_go_doc_text(comment)).alias("doc"),
            F.substring(chunk, F.length(comment) + 1, F.length(chunk)).alias("decl"),
        ))

    return F.filter(F.transform(_all(plain, _GO_CHUNK), cut), lambda c: c["decl"] != "")


def _go_symbols(text: Column) -> Column:
    def per_chunk(c: Column) -> Column:
        decl, doc = c["decl"], c["doc"]
        return (
            F.when(decl.rlike(_GO_EXPORTED_FUNC), _go_function(decl, doc))
            .when(decl.startswith("type "), _go_types(decl, doc))
            .when(decl.startswith("const "), _go_values(decl, "const", doc))
            .when(decl.startswith("var "), _go_values(decl, "var", doc))
            .otherwise(_no_symbols())
        )

    return F.flatten(F.transform(_go_chunks(text), per_chunk))


def _go_imports(text: Column) -> Column:
    imports = F.filter(_go_chunks(text), lambda c: c["decl"].startswith("import "))
    return F.flatten(F.transform(imports, lambda c: _all(c["decl"], r'(?dm)^(?:import |\t)(?:[\p{L}\p{N}_.]+ )?"([^"\n]+)"', 1)))


def _go_doc(text: Column) -> Column:
    package = F.filter(_go_chunks(text), lambda c: c["decl"].startswith("package "))
    return F.coalesce(F.get(package, F.lit(0))["doc"], F.lit(""))


# --- relations ----------------------------------------------------------------------------

_EXTRACT = {
    GO: (_go_symbols, _go_imports, _go_doc),
    JS: (_js_symbols, _js_imports, _js_doc),
    PY: (_py_symbols, _py_imports, _py_doc),
    JAVA: (_java_symbols, _java_imports, lambda _: F.lit("")),
    C: (_c_symbols, _c_imports, lambda _: F.lit("")),
}


def _by_language(part: int, languages: list[str], other: Column) -> Column:
    chosen = None
    for language in languages:
        value = _EXTRACT[language][part](F.col("content"))
        test = F.col("language") == language
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(other)


def _with_language(files: DataFrame) -> DataFrame:
    ext = F.lower(extension(F.col("path")))
    known = None
    for language in _EXTRACT:
        test = ext.isin([e for e, l in LANGUAGES.items() if l == language])
        known = F.when(test, language) if known is None else known.when(test, language)
    return files.select("repo", "path", "content", known.otherwise(ext).alias("language"))


def symbols(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    chosen = languages or list(_EXTRACT)
    return (
        _with_language(files).filter(F.col("language").isin(chosen))
        .select("repo", "path", "language", F.posexplode(_by_language(0, chosen, _no_symbols())).alias("_pos", "_s"))
        .select("repo", "path", "language", (F.col("_pos") + 1).cast("long").alias("pos"), "_s.*")
    )


def imports(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    chosen = languages or list(_EXTRACT)
    none = F.array().cast("array<string>")
    return (
        _with_language(files).filter(F.col("language").isin(chosen))
        .select("repo", "path", "language", F.posexplode(_by_language(1, chosen, none)).alias("_pos", "target"))
        .select("repo", "path", "language", (F.col("_pos") + 1).cast("long").alias("pos"), "target")
    )


def go_symbols(files: DataFrame) -> DataFrame:
    return symbols(files, [GO])


def js_symbols(files: DataFrame) -> DataFrame:
    return symbols(files, [JS])


def py_symbols(files: DataFrame) -> DataFrame:
    return symbols(files, [PY])


def java_symbols(files: DataFrame) -> DataFrame:
    return symbols(files, [JAVA])


def c_symbols(files: DataFrame) -> DataFrame:
    return symbols(files, [C])


def _summaries(files: DataFrame) -> DataFrame:
    """(repo, path, content, language, doc, _imports, _symbols), one row per file."""
    every = list(_EXTRACT)
    unsupported = F.concat(F.lit("File: "), basename(F.col("path")), F.lit(" (unsupported for detailed summarization)"))
    return _with_language(files).select(
        "repo", "path", "content", "language", _by_language(2, every, unsupported).alias("doc"),
        _by_language(1, every, F.array().cast("array<string>")).alias("_imports"),
        _by_language(0, every, _no_symbols()).alias("_symbols"),
    )


def summarize(files: DataFrame) -> DataFrame:
    """One row per file: language, doc text, number of symbols and imports."""
    return _summaries(files).select(
        "repo", "path", "language", "doc",
        F.size("_imports").cast("long").alias("import_count"), F.size("_symbols").cast("long").alias("symbol_count"),
    )


def _markdown() -> Column:
    """Summary text from the columns of ``_summaries``."""
    doc = F.when(F.col("doc") != "", F.concat(F.lit("## Documentation\n"), F.col("doc"), F.lit("\n\n"))).otherwise("")
    listed = F.array_join(F.transform("_imports", lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), "")
    imported = F.when(F.size("_imports") > 0, F.concat(F.lit("## Imports\n"), listed, F.lit("\n"))).otherwise("")

    def section(s: Column) -> Column:
        return F.concat(
            F.lit("### "), s["kind"], F.lit(": "), s["name"], F.lit("\n```\n"), s["signature"], F.lit("\n```\n"),
            F.when(s["doc"] != "", F.concat(s["doc"], F.lit("\n"))).otherwise(""), F.lit("\n"),
        )

    exported = F.when(
        F.size("_symbols") > 0,
        F.concat(F.lit("## Exports\n"), F.array_join(F.transform("_symbols", section), "")),
    ).otherwise("")
    return F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), doc, imported, exported)


def render_summary(files: DataFrame) -> DataFrame:
    """(repo, path, text): the summary of each file as markdown."""
    return _summaries(files).select("repo", "path", _markdown().alias("text"))


def apply_summaries(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Content of files matching any glob is replaced by its summary, in one pass."""
    chosen = any_of(F.col("path").rlike(r) for r in map(path_glob, patterns) if r)
    return _summaries(files).select(
        "repo", "path", F.when(chosen, _markdown()).otherwise(F.col("content")).alias("content")
    )
