"""Scalar column functions.  All of them are built-in expressions, and stay in generated code where Spark can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: An edge of a run of ASCII word characters, as the SQL's engine has it; Java's own edge depends on its version, and counts other letters to the word.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def half_up(numerator: Column, denominator: Column, digits: int) -> Column:
    """A ratio of integers rounded half up, decided in integers, so that ties never depend on binary fractions."""
    scale = 10**digits
    return F.floor((F.lit(2 * scale) * numerator + denominator) / (F.lit(2) * denominator)) / F.lit(float(scale))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def log_ratio(x: Column, most: Column) -> Column:
    """log1p(x) / log1p(most), 0 where most is 0."""
    return F.when(most > 0, F.log1p(x) / F.log1p(most)).otherwise(F.lit(0.0))


def recency_step(days: Column, near: int = 30, far: int = 90) -> Column:
    return F.when(days <= near, 1.0).when(days <= far, 0.5).otherwise(0.0)


def half_life(age: Column, half: float) -> Column:
    """0.5 ^ (age / half)."""
    return F.pow(F.lit(0.5), age / F.lit(float(half)))


def camel_words(name: Column) -> Column:
    """The words of an identifier: capital runs, capitalised words, lower-case runs, digits."""
    return F.regexp_extract_all(name, F.lit(f"({CAMEL})"), F.lit(1))


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(same, start, lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def title_words(title: Column, longer_than: int = 2) -> Column:
    """The sorted distinct lower-case words of a title that are longer than so many letters."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > longer_than)))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def snippet(text: Column, at: Column, width: int) -> Column:
    """``width`` characters centred on a 1-based place, with an ellipsis on each side that is cut."""
    start = F.greatest(F.lit(1), F.least(at - width // 2, F.length(text) - width + 1))
    body = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width <= F.length(text), "…").otherwise(""))


def strip_hidden(text: Column) -> Column:
    """Text without control and format characters, but for line breaks and tabs, and without HTML comments."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cf}\p{Cc}&&[^\n\r\t]]", ""), r"(?s)<!--.*?-->", "")


def relative_age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days ago")))
    )


def slug(title: Column, length: int = 48) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length), "-+$", "")


def tokens_estimate(text: Column, scale: float = 1.0) -> Column:
    return F.ceil(F.length(text) * F.lit(scale) / 4).cast("long")


def is_private(dotted: Column) -> Column:
    """Whether any part of a dotted name starts with an underscore and is no dunder."""
    return F.exists(F.split(dotted, r"\."), lambda p: p.rlike("^_") & ~p.rlike("^__.*__$"))


def looks_minified(head: Column, least: int = 2048, average: int = 300) -> Column:
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return (F.length(head) >= least) & (F.length(head) / lines > average)


def module_name(path: Column, roots: tuple[str, ...] = ("src",)) -> Column:
    """The dotted module of a source path: a root folder, the extension and a package file's own name are left out."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    for root in roots:
        stem = F.regexp_replace(stem, f"^{root}/", "")
    return F.translate(F.regexp_replace(stem, "/(__init__|index)$", ""), "/", ".")


def group_of(module: Column, is_package: Column) -> Column:
    """A package groups under itself, a module under its parent."""
    parent = F.regexp_extract(module, r"^(.*)\.[^.]*$", 1)
    return F.when(is_package | (parent == ""), module).otherwise(parent)


def relative_import(importer: Column, is_package: Column, level: Column, name: Column) -> Column:
    """The absolute module of a relative import."""
    parts = F.split(importer, r"\.")
    kept = F.greatest(F.size(parts) - level + F.when(is_package, 1).otherwise(0), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), kept), ".")
    return F.when(level == 0, name).otherwise(F.concat_ws(".", F.when(base != "", base), F.when(name != "", name)))


def relative_specifier(folder: Column, spec: Column) -> Column:
    """The path that a ``./x`` or ``../y`` specifier names, seen from a folder."""
    steps = F.concat(F.filter(F.split(folder, "/"), lambda p: p != ""), F.split(F.regexp_replace(spec, r"\.(js|jsx|ts|tsx)$", ""), "/"))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        steps, empty, lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.regexp_replace(F.array_join(folded, "/"), "/index$", "")


def url_segments(url: Column) -> Column:
    """The path segments of a URL, with parameters written <x>, {x} or :x as *."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^(<.*>|\{.*\}|:.*)$"), "*").otherwise(s))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; its ``*`` crosses folders."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "_/" else "\\" + c) for c in pattern) + "$"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def header_fields(text: Column) -> Column:
    """The ``- key: value`` lines at a decision's head as a map; of a repeated key, the last counts."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)^- ([A-Za-z_]+): (.*)$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^- ([A-Za-z_]+): ", 1)).alias("k"), F.trim(F.regexp_extract(p, r"^- [A-Za-z_]+: (.*)$", 1)).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def marked_regions(text: Column) -> Column:
    """(kind, name, body) of regions between ``<!-- begin:kind name -->`` and ``<!-- end:kind -->``."""
    pattern = r"(?s)<!-- begin:(\w+) ([\w./-]+) -->\n?(.*?)\n?<!-- end:\1 -->"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(whole, lambda r: F.struct(F.regexp_extract(r, pattern, 1).alias("kind"), F.regexp_extract(r, pattern, 2).alias("name"), F.regexp_extract(r, pattern, 3).alias("body")))


def marked_text(kind: str, name: str, body: str) -> str:
    """One region as ``marked_regions`` reads it."""
    return f"<!-- begin:{kind} {name} -->\n{body}\n<!-- end:{kind} -->"


def is_test_file(path: Column) -> Column:
    """File-name and folder conventions of tests across languages."""
    return any_of(
        path.rlike(r"(^|/)(tests?|__tests__|spec)/"), path.rlike(r"(^|/)test_[^/]*\.py$"), path.rlike(r"_test\.(py|go)$"),
        path.rlike(r"\.(test|spec)\.[jt]sx?$"), path.rlike(r"(^|/)[A-Z][^/]*Tests?\.(java|kt|swift)$"), path.rlike(r"_test\.dart$"), path.rlike(r"(^|/)conftest\.py$"),
    )


def subject_stem(path: Column) -> Column:
    """The subject that a test file's name states, or null."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    cut = F.regexp_replace(name, r"\.[^.]+$", "")
    return (
        F.when(cut.rlike("^test_."), F.regexp_replace(cut, "^test_", "")).when(cut.rlike("._test$"), F.regexp_replace(cut, "_test$", ""))
        .when(cut.rlike(r".\.(test|spec)$"), F.regexp_replace(cut, r"\.(test|spec)$", "")).when(cut.rlike("^[A-Z].*Tests?$"), F.regexp_replace(cut, "Tests?$", ""))
    )


def looks_secret(name: Column, value: Column) -> Column:
    """A credential's name with a value that is no placeholder, or a value of a known token's form."""
    named = F.lower(name).rlike("passw|secret|token|api_?key|credential") & (F.length(value) >= 8) & ~F.lower(value).rlike("example|changeme|placeholder|your_|xxx|^<|test")
    return named | value.rlike(r"^(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$")
