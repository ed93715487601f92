"""Column expressions over identifiers, paths and questions. All are built-in functions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search query drops.
SEARCH_STOP = frozenset("you will with why who which where when what we was to this the that so or on of its it is in if i how have has from for does do by be at as are and an a".split())
#: Words that say nothing about paths.
PATH_NOISE = frozenset("value data type return call define make create using used work code file module class method function manage handle what implement does how".split())
#: Words that say nothing about symbols.
SYMBOL_NOISE = PATH_NOISE | frozenset("some each also will when which where does been have into from with that this explain describe search look find show implement".split())
#: Words that a question's terms leave out.
QUERY_STOP = PATH_NOISE | frozenset("find show that this from with for and the".split())
SUFFIXES = ["ous", "ies", "ity", "ness", "ment", "tion", "ing", "ers", "ors"]
#: What code calls the things that questions name.
SYNONYMS = {
    "runtime": "executor loop scheduler spawn",
    "task": "celery dispatch execute job worker",
    "orm": "entity mapper model schema table",
    "hook": "callback event listener subscriber",
    "session": "client connection pool transport",
    "query": "fetch find lookup retrieve search",
    "dependency": "depend inject require resolve",
    "indexing": "catalog delta index reindex",
    "routing": "dispatch endpoint path route router",
    "injection": "depend inject resolve wire",
    "adapter": "bridge connector driver plugin",
    "registry": "catalog factory provider register",
    "middleware": "filter handler hook interceptor",
    "pipeline": "chain pipe process stage workflow",
}
ENTRY_POINTS = ["index.mjs", "index.tsx", "index.jsx", "index.ts", "index.js", "lib.rs", "mod.rs", "__init__.pyi", "__init__.py"]
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "swift": "swift"}


def _words(items) -> Column:
    return F.array(*[F.lit(x) for x in sorted(items)])


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def blank_split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def search_phrases(question: Column) -> Column:
    """A question's words, other characters than letters, digits, _ and . removed, stop words dropped; duplicates stay."""
    clean = F.transform(blank_split(question), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9_.]", ""))
    return F.filter(clean, lambda w: (w != "") & ~F.array_contains(_words(SEARCH_STOP), F.lower(w)))


def word_estimate(text: Column) -> Column:
    """Tokens estimated as 1.3 a word."""
    return F.floor(F.size(blank_split(text)) * F.lit(1.3)).cast("long")


def estimate_tokens(text: Column, stored: Column) -> Column:
    return F.when(F.coalesce(stored, F.lit(0)) > 0, stored.cast("long")).otherwise(word_estimate(text))


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull() | (text == ""), 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def camel_parts(token: Column) -> Column:
    """Runs that an upper-case letter may begin, and whole runs of upper-case letters before one."""
    marked = F.regexp_replace(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(marked, "[ _]+"), lambda p: p != "")


def expand_identifiers(text: Column) -> Column:
    """The text, and on a new line the sorted distinct parts (of two characters or more) of its compound identifiers."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    compound = F.filter(names, lambda n: n.rlike("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"))
    parts = F.flatten(F.filter(F.transform(F.array_distinct(compound), lambda n: camel_parts(n)), lambda p: F.size(p) > 1))
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: F.length(p) > 1)))
    return F.when(F.size(parts) > 0, F.concat(text, F.lit("\n"), F.array_join(parts, " "))).otherwise(text)


def compound_split(token: Column) -> Column:
    """The token and, if it has several, its parts."""
    snake = F.filter(F.split(token, "_"), lambda p: p != "")
    camel = camel_parts(token)
    return (
        F.when(~token.rlike("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), F.array(token))
        .when(token.contains("_") & (F.size(snake) > 1), F.concat(F.array(token), snake))
        .when(~token.contains("_") & (F.size(camel) > 1), F.concat(F.array(token), F.transform(camel, lambda p: F.lower(p))))
        .otherwise(F.array(token))
    )


def _neighbours(items: Column) -> Column:
    """Adjacent items joined by _; the array is computed once a row, not once an item."""
    both = F.arrays_zip(items.alias("a"), F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(0))).alias("b"))
    return F.transform(F.filter(both, lambda x: x["b"].isNotNull()), lambda x: F.concat_ws("_", x["a"], x["b"]))


def query_terms(question: Column) -> Column:
    """Sorted content words, parts of compounds, adjacent pairs joined by _, and synonyms of architectural words."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    stop = _words(QUERY_STOP)
    kept = F.filter(found, lambda w: ~F.array_contains(stop, F.lower(w)))
    flat = F.flatten(F.transform(kept, lambda w: F.transform(compound_split(w), lambda p: F.lower(p))))
    flat = F.filter(flat, lambda p: (F.length(p) >= 3) & ~F.array_contains(stop, p))
    pairs = _neighbours(flat)
    table = F.create_map(*[x for k, v in sorted(SYNONYMS.items()) for x in (F.lit(k), _words(v.split()))])
    both = F.array_distinct(F.concat(flat, pairs))
    more = F.flatten(F.transform(F.filter(both, lambda t: F.map_contains_key(table, t)), lambda t: F.try_element_at(table, t)))
    return F.array_sort(F.array_distinct(F.concat(both, more)))


def path_terms(question: Column) -> Column:
    """Words of four letters or more that may name files, and their stems, longest first, then by name."""
    found = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)), lambda w: F.lower(w))
    kept = F.filter(found, lambda w: ~F.array_contains(_words(PATH_NOISE), w))
    ends = F.array(*[F.lit(s) for s in SUFFIXES])
    stems = F.flatten(F.transform(kept, lambda w: F.transform(F.filter(ends, lambda s: F.endswith(w, s) & (F.length(w) - F.length(s) >= 4)), lambda s: F.substring(w, F.lit(1), F.length(w) - F.length(s)))))
    keyed = F.transform(F.array_distinct(F.concat(kept, stems)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def symbol_terms(question: Column) -> Column:
    """Adjacent pairs joined by _, then words of six letters or more."""
    found = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: F.lower(w))
    kept = F.filter(found, lambda w: ~F.array_contains(_words(SYMBOL_NOISE), w))
    pairs = _neighbours(kept)
    return F.array_distinct(F.concat(pairs, F.filter(kept, lambda w: F.length(w) >= 6)))


def is_architecture(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.exists(_words(SYNONYMS), lambda k: F.contains(low, k))


def path_parts(path: Column) -> Column:
    return F.split(F.lower(path), r"[/\\._]")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def is_test_path(path: Column) -> Column:
    return F.lower(path).startswith("test") | F.lower(path).contains("/test")


def is_entry_point(path: Column) -> Column:
    return basename(path).isin(ENTRY_POINTS)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def _matching(rx: str):
    return lambda s: s.rlike(rx)


def matches_ignore(path: Column, patterns: list[str]) -> Column:
    """Patterns that end in / name a directory anywhere (with * as a wild card), others a whole path or a base name."""
    segments = F.split(path, "/")
    out = F.lit(False)
    for p in patterns:
        rx = "^" + "".join("[^/]*" if c == "*" else "[.]" if c == "." else c for c in p.rstrip("/")) + "$"
        if p.endswith("/"):
            out = out | F.exists(segments, _matching(rx))
        else:
            out = out | path.rlike(rx) | basename(path).rlike(rx)
    return out


def module_of(path: Column) -> Column:
    """Path as a dotted module: leading src, lib or app, the extension, and a last __init__ or index go."""
    p = F.regexp_replace(path, "^(?:src|lib|app)/", "")
    p = F.regexp_replace(p, r"\.[^./]+$", "")
    p = F.regexp_replace(p, "/(?:__init__|index)$", "")
    return F.replace(p, F.lit("/"), F.lit("."))


def symbol_id(path: Column, qualified: Column, kind: Column) -> Column:
    return F.concat(path, F.lit("::"), F.coalesce(qualified, F.lit("_module")), F.lit("#"), F.coalesce(kind, F.lit("module")))


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, F.coalesce(name, F.lit("_module")), line.cast("string"))


def parent_name(qualified: Column) -> Column:
    """What stands before the last ::, or else the last dot."""
    return F.when(qualified.contains("::"), F.regexp_extract(qualified, "^(.*)::", 1)).when(qualified.contains("."), F.regexp_extract(qualified, r"^(.*)\.", 1))


def breadcrumbs(path: Column, qualified: Column, kind: Column, parent: Column, parent_kind: Column) -> Column:
    own = F.when(qualified.isNull(), None).otherwise(F.concat(F.coalesce(kind, F.lit("symbol")), F.lit(": "), F.regexp_extract(qualified, "[^.:]*$", 0)))
    above = F.when(parent.isNull(), None).otherwise(F.concat(F.coalesce(parent_kind, F.lit("class")), F.lit(": "), parent))
    return F.concat_ws(" > ", F.concat(F.lit("module: "), module_of(path)), above, own)


def anchors(text: Column, limit: int = 8) -> Column:
    """The first distinct identifiers."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))), 1, limit)


def keywords(question: Column) -> Column:
    """Distinct lower-case words of three letters or more that are not stop words, in order."""
    stop = _words(SEARCH_STOP | QUERY_STOP)
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: F.lower(w)), lambda w: ~F.array_contains(stop, w)))
