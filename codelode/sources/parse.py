"""Symbols and imports of source files: Python by its own parser, languages with braces by a scanner of declarations.

One pass over the files in Arrow batches gives both; a file that does not parse has neither.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "name string, qualified_name string, kind string, parent string, visibility string, signature string, docstring string, start_line int, end_line int"
IMPORT = "module string, names array<string>, alias string, line int, is_relative boolean"
_S = [x.split()[0] for x in SYMBOL.split(", ")]


def _py_visibility(name: str) -> str:
    return "public" if name.startswith("__") and name.endswith("__") or not name.startswith("_") else "private"


def parse_python(source: str) -> tuple[list[dict], list[dict]]:
    """Top-level classes and functions and the methods of the classes; imports anywhere at the top and in top-level ifs."""
    tree, symbols, imports = ast.parse(source), [], []

    def signature(n: ast.AST) -> str:
        if isinstance(n, ast.ClassDef):
            bases = ", ".join(ast.unparse(b) for b in n.bases)
            return f"class {n.name}({bases})" if bases else f"class {n.name}"
        back = f" -> {ast.unparse(n.returns)}" if n.returns else ""
        return f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)}){back}"

    def add(n: ast.AST, kind: str, parent: str | None) -> None:
        first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
        symbols.append(dict(name=n.name, qualified_name=f"{parent}.{n.name}" if parent else n.name, kind=kind, parent=parent, visibility=_py_visibility(n.name), signature=signature(n), docstring=ast.get_docstring(n), start_line=first, end_line=n.end_lineno))

    def imported(n: ast.AST) -> None:
        if isinstance(n, ast.Import):
            for a in n.names:
                imports.append(dict(module=a.name, names=[], alias=a.asname, line=n.lineno, is_relative=False))
        elif isinstance(n, ast.ImportFrom):
            alias = n.names[0].asname if len(n.names) == 1 else None
            imports.append(dict(module="." * n.level + (n.module or ""), names=[a.name for a in n.names], alias=alias, line=n.lineno, is_relative=n.level > 0))

    for n in tree.body:
        imported(n)
        if isinstance(n, ast.If):
            for m in n.body + n.orelse:
                imported(m)
        elif isinstance(n, ast.ClassDef):
            add(n, "class", None)
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(m, "method", n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(n, "function", None)
    return symbols, imports


_ID = r"[A-Za-z_$][\w$]*"
_MOD = r"(?:(?:export|default|declare|abstract|async|public|private|protected|internal|fileprivate|open|static|final|sealed|override|data|virtual|partial|readonly|inline|suspend|unsafe|const|extern|mutating|companion|pub(?:\([^)]*\))?)\s+)*"
#: (pattern with groups mods and name, kind); the first that matches a line's code counts.
DECLARATIONS = {
    "go": [(rf"^(?P<mods>)func\s+\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*(?P<name>{_ID})", "method"), (rf"^(?P<mods>)func\s+(?P<name>{_ID})", "function"), (rf"^(?P<mods>)type\s+(?P<name>{_ID})\s+interface\b", "interface"), (rf"^(?P<mods>)type\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>)const\s+(?P<name>{_ID})", "constant"), (rf"^(?P<mods>)var\s+(?P<name>{_ID})", "variable")],
    "rust": [(rf"^(?P<mods>{_MOD})fn\s+(?P<name>{_ID})", "function"), (rf"^(?P<mods>{_MOD})struct\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>{_MOD})enum\s+(?P<name>{_ID})", "enum"), (rf"^(?P<mods>{_MOD})trait\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})type\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>{_MOD})(?:static|const)\s+(?P<name>{_ID})\s*:", "constant"), (rf"^(?P<mods>)impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_ID})", "impl"), (rf"^(?P<mods>)macro_rules!\s*(?P<name>{_ID})", "function")],
    "typescript": [(rf"^(?P<mods>{_MOD})function\*?\s+(?P<name>{_ID})", "function"), (rf"^(?P<mods>{_MOD})class\s+(?P<name>{_ID})", "class"), (rf"^(?P<mods>{_MOD})interface\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})enum\s+(?P<name>{_ID})", "enum"), (rf"^(?P<mods>{_MOD})type\s+(?P<name>{_ID})\s*[=<]", "type"), (rf"^(?P<mods>{_MOD})(?:const|let|var)\s+(?P<name>{_ID})", "variable"), (rf"^(?P<mods>{_MOD})(?:get\s+|set\s+)?(?!(?:if|for|while|switch|catch|return)\b)(?P<name>#?{_ID})\s*\([^)]*\)\s*(?::\s*[^{{]+)?\{{", "member")],
    "java": [(rf"^(?P<mods>{_MOD})(?:class|record)\s+(?P<name>{_ID})", "class"), (rf"^(?P<mods>{_MOD})@?interface\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})enum\s+(?P<name>{_ID})", "enum"), (rf"^(?P<mods>{_MOD})(?:<[^>]*>\s*)?(?!(?:return|new|else|throw|if|for|while|switch|catch)\b)(?:[\w.<>\[\],?]+\s+)?(?P<name>{_ID})\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?[{{;]", "member")],
    "kotlin": [(rf"^(?P<mods>{_MOD})(?:(?:enum|annotation|inner|value)\s+)?(?:class|object)\s+(?P<name>{_ID})", "class"), (rf"^(?P<mods>{_MOD})(?:fun\s+)?interface\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})fun\s+(?:<[^>]*>\s*)?(?:(?P<recv>[A-Z]\w*)\.)?(?P<name>{_ID})", "function"), (rf"^(?P<mods>{_MOD})(?:val|var)\s+(?P<name>{_ID})", "variable"), (rf"^(?P<mods>{_MOD})typealias\s+(?P<name>{_ID})", "type")],
    "csharp": [(rf"^(?P<mods>{_MOD})namespace\s+(?P<name>[\w.]+)", "namespace"), (rf"^(?P<mods>{_MOD})(?:class|record)\s+(?P<name>{_ID})", "class"), (rf"^(?P<mods>{_MOD})interface\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})struct\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>{_MOD})enum\s+(?P<name>{_ID})", "enum"), (rf"^(?P<mods>{_MOD})delegate\s+[\w<>\[\]]+\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>{_MOD})event\s+[\w<>?]+\s+(?P<name>{_ID})", "variable"), (rf"^(?P<mods>{_MOD})(?!(?:return|new|else|throw|if|for|foreach|while|switch|catch|using|lock)\b)(?:[\w.<>\[\],?]+\s+)?(?P<name>{_ID})\s*\([^)]*\)\s*(?:\{{|=>|;|$)", "member"), (rf"^(?P<mods>{_MOD})[\w<>\[\],?]+\s+(?P<name>{_ID})\s*\{{\s*(?:get|set|init)", "variable")],
    "swift": [(rf"^(?P<mods>{_MOD})(?:class|actor)\s+(?P<name>(?!func\b|var\b){_ID})", "class"), (rf"^(?P<mods>{_MOD})struct\s+(?P<name>{_ID})", "type"), (rf"^(?P<mods>{_MOD})protocol\s+(?P<name>{_ID})", "interface"), (rf"^(?P<mods>{_MOD})enum\s+(?P<name>{_ID})", "enum"), (rf"^(?P<mods>{_MOD})extension\s+(?P<name>{_ID})", "impl"), (rf"^(?P<mods>{_MOD})(?:class\s+)?func\s+(?P<name>{_ID})", "function"), (rf"^(?P<mods>{_MOD})(?P<name>init|subscript)\b", "function"), (rf"^(?P<mods>{_MOD})(?:let|var)\s+(?P<name>{_ID})", "variable"), (rf"^(?P<mods>{_MOD})typealias\s+(?P<name>{_ID})", "type")],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in DECLARATIONS.items()}
IMPORTS = {
    "go": r"^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[^\"]+)\"",
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<module>[^;]+);",
    "typescript": r"^\s*(?:import|export)\s+(?:.*?\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]|require\(\s*['\"](?P<required>[^'\"]+)['\"]\s*\)",
    "java": r"^\s*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;",
    "kotlin": r"^\s*import\s+(?P<module>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?",
    "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;",
    "swift": r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?(?P<module>[\w.]+)",
}
IMPORTS["javascript"] = IMPORTS["typescript"]
_OWNERS = {"class", "interface", "type", "enum", "impl", "namespace"}


def blank_strings(source: str, language: str = "") -> str:
    """The source with comments and the insides of strings blanked, lines kept."""
    quotes = r"\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`" + ("" if language == "rust" else r"|'(?:\\.|[^'\\\n])*'")
    rx = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|" + quotes, re.S)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _visibility(language: str, mods: str, name: str, inside_interface: bool) -> str:
    words = set(mods.replace("(", " ").split())
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if "pub" in words else "private"
    if language in ("typescript", "javascript"):
        return "private" if "private" in words or name.startswith("#") else "public" if words & {"export", "public"} or inside_interface else "private"
    if "private" in words or "fileprivate" in words:
        return "private"
    if words & {"public", "open"} or inside_interface:
        return "public"
    return {"java": "internal", "csharp": "internal", "swift": "internal", "kotlin": "public"}[language]


def parse_braces(source: str, language: str) -> tuple[list[dict], list[dict]]:
    """Declarations line by line, owned by the open declaration whose braces they stand in; bodies of functions are not looked into."""
    code, raw = blank_strings(source, language).split("\n"), source.split("\n")
    symbols, stack, depth = [], [], 0  # stack: (depth inside, symbol, kind)
    for n, line in enumerate(code, 1):
        body = line.strip()
        inside = stack[-1] if stack else None
        if body and (inside is None or inside[2] in _OWNERS and depth == inside[0]):
            for rx, kind in _COMPILED[language]:
                m = rx.match(re.sub(r"^(?:@\w+(?:\([^)]*\))?\s+|#\[[^\]]*\]\s*)+", "", body))
                if not m:
                    continue
                name, parent = m["name"], None
                if kind == "member":
                    if inside is None:
                        break
                    kind = "method"
                if inside is not None:
                    parent = inside[1]["qualified_name"]
                    kind = "method" if kind == "function" else kind
                recv = m.groupdict().get("recv")
                if recv:
                    parent, kind = recv, "method"
                sep = "::" if language == "rust" and parent else "."
                in_class = inside is not None and language in ("typescript", "javascript")
                s = dict(name=name, qualified_name=f"{parent}{sep}{name}" if parent else name, kind=kind, parent=parent, visibility=_visibility(language, m["mods"] or "", name, in_class or inside is not None and inside[2] == "interface"), signature=re.sub(r"\s*\{?\s*$", "", raw[n - 1].strip()), docstring=None, start_line=n, end_line=n)
                if kind not in ("impl", "namespace"):
                    symbols.append(s)
                opened = line.count("{") - line.count("}")
                if opened > 0 or "{" not in line and not body.endswith((";", ")")) and kind in _OWNERS or "{" not in line and kind in ("function", "method") and not body.endswith(";") and any("{" in x for x in code[n : n + 1]):
                    stack.append((depth + 1, s, kind))
                break
        depth += line.count("{") - line.count("}")
        while stack and depth < stack[-1][0] and ("}" in line or stack[-1][1]["start_line"] < n - 1):
            stack.pop()[1]["end_line"] = n
    imports = []
    rx = re.compile(IMPORTS[language])
    block = False
    for n, line in enumerate(raw, 1):
        if language == "go":
            if re.match(r"\s*import\s*\(", line):
                block = True
                continue
            if block and line.strip().startswith(")"):
                block = False
            if not block and not line.lstrip().startswith("import"):
                continue
        for m in rx.finditer(line):
            g = m.groupdict()
            module = (g.get("module") or g.get("required") or "").strip()
            alias = g.get("alias")
            alias = None if alias in ("_", ".") else alias
            for one in _flat_use(module) if language == "rust" else [module]:
                imports.append(dict(module=one, names=[], alias=alias, line=n, is_relative=one.startswith((".", "crate", "super", "self"))))
    return symbols, imports


def _flat_use(tree: str) -> list[str]:
    """The paths of a use tree, lists flattened, aliases dropped."""
    tree = re.sub(r"\s+as\s+\w+", "", tree.strip())
    m = re.match(r"^(.*?)\{(.*)\}$", tree, re.S)
    if not m:
        return [tree]
    parts, depth, cur = [], 0, ""
    for c in m[2]:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [(m[1] + x).removesuffix("::self") for p in [*parts, cur] if p.strip() for x in _flat_use(p)]


Parser = Callable[[str], tuple[list[dict], list[dict]]]
PARSERS: dict[str, Parser] = {"python": parse_python} | {k: (lambda s, k=k: parse_braces(s, k)) for k in DECLARATIONS}


def register_parser(language: str, parser: Parser) -> None:
    PARSERS[language] = parser


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, language, lines, symbols, imports, parse_error) of files (path, language, content as bytes or text); a file that does not parse has neither symbols nor imports."""
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, language, content in zip(f["path"], f["language"], f["content"]):
                text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
                symbols, imports, error = [], [], False
                if language in parsers:
                    try:
                        symbols, imports = parsers[language](text)
                    except (SyntaxError, ValueError, RecursionError):
                        error = True
                        if strict:
                            raise
                out.append((path, language, text.count("\n") + (text != "" and not text.endswith("\n")), symbols, imports, error))
            yield pd.DataFrame(out, columns=["path", "language", "lines", "symbols", "imports", "parse_error"])

    return files.select("path", "language", "content").mapInPandas(run, f"path string, language string, lines int, symbols array<struct<{', '.join(x.replace(' ', ':', 1) for x in SYMBOL.split(', '))}>>, imports array<struct<{', '.join(x.replace(' ', ':', 1) for x in IMPORT.split(', '))}>>, parse_error boolean")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), "language", F.explode("symbols").alias("s")).select("file_path", "language", "s.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), "language", F.explode("imports").alias("i")).select("file_path", "language", "i.*")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved_path, null where no file (path) matches: every import gives ranked candidate keys, an equi-join finds them, the best rank stays."""
    d = F.regexp_replace(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1), "/$", "")
    up = F.length(F.regexp_extract("module", r"^\.*", 0)) - 1
    bare = F.regexp_replace("module", r"^\.+", "")
    dir_parts = F.filter(F.split(d, "/"), lambda x: x != "")
    above = F.slice(dir_parts, F.lit(1), F.greatest(F.lit(0), F.size(dir_parts) - up))
    dotted = F.split(bare, "[.]")
    relative = F.array_join(F.concat(above, F.filter(dotted, lambda x: x != "")), "/")
    prefixes = F.transform(F.sequence(F.size(dotted), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(dotted, F.lit(1), n), "/"))
    py = F.flatten(F.transform(F.when(F.col("module").startswith("."), F.array(relative)).otherwise(F.concat(*[F.transform(prefixes, _under(p)) for p in ("", "src/", "lib/", "source/")])), lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    joined = F.array_join(F.concat(dir_parts, F.split("module", "/")), "/")
    flat = F.regexp_replace(joined, r"(^|/)\./", "$1")
    for _ in range(4):
        flat = F.regexp_replace(flat, r"(^|/)\./", "$1")
        flat = F.regexp_replace(flat, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    stem = F.regexp_replace(flat, r"\.jsx?$", "")
    ts = F.array(flat, *[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")])
    # others by name: the file of the last part, or a file in the directory of that name
    last = F.lower(F.element_at(F.split(F.regexp_replace("module", r"\.\*$|::\*$", ""), r"[./]|::"), -1))
    named = F.array(F.concat(F.lit("name:"), last), F.concat(F.lit("dir:"), last))
    keys = F.when(F.col("language") == "python", py).when(F.col("language").isin("typescript", "javascript"), F.when(F.col("module").startswith("."), ts).otherwise(F.array().cast("array<string>"))).otherwise(named)
    i = imports.withColumn("_id", F.xxhash64("file_path", "line", "module", F.to_json(F.struct("names", "alias"))))
    asked = i.select("_id", "file_path", "language", F.posexplode(keys).alias("rank", "key"))
    low = F.lower("path")
    places = files.select("path", F.explode(F.array(F.col("path"), F.concat(F.lit("name:"), F.regexp_extract(low, r"([^/]*?)\.[^./]*$", 1)), F.concat(F.lit("dir:"), F.regexp_extract(low, r"([^/]+)/[^/]*$", 1)))).alias("key"))
    best = asked.join(places, "key").where("path <> file_path").groupBy("_id").agg(F.min(F.struct("rank", "path")).alias("b")).select("_id", F.col("b.path").alias("resolved_path"))
    return i.join(best, "_id", "left").drop("_id")


def _under(prefix: str):
    return lambda p: F.concat(F.lit(prefix), p)


def entry_points(files: DataFrame) -> DataFrame:
    """(path) of files (path, language, content) where a program begins."""
    text, path = F.col("content").cast("string"), F.col("path")
    main = {"python": r"if __name__ ==|(?m)^def main\(", "go": r"(?m)^func main\(", "rust": r"(?m)^(?:async )?fn main\(", "java": r"public static void main", "kotlin": r"(?m)^fun main\(", "csharp": r"static (?:async )?(?:void|int|Task) Main", "swift": r"@main"}
    out = path.endswith("__main__.py") | path.rlike(r"(^|/)(?:index|main)\.[jt]sx?$|(^|/)main\.swift$|(^|/)Program\.cs$")
    for language, rx in main.items():
        out = out | ((F.col("language") == language) & text.rlike(rx))
    return files.where(out).select("path")
