"""Source trees as relations: discovery, ignore rules, hashes, languages and decoding."""

from __future__ import annotations

import fnmatch
import re
import tomllib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewright.functions.scalars import looks_minified
from tracewright.session import ship

# Languages by extension and by interpreter.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "sh": "shell", "bash": "shell", "sql": "sql",
}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "shell", "sh": "shell", "ruby": "ruby", "deno": "typescript"}
# Folders of tools, builds and other people's code.
IGNORED = (
    ".git", ".hg", ".svn", ".dart_tool", ".gradle", "Pods", "DerivedData", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".tox", ".nox", "build", "dist", ".eggs", "site-packages", ".idea", ".vscode", "target", ".next", ".nuxt", "coverage", "htmlcov", "vendor",
)
TEXT_EXTENSIONS = ("md", "rst", "txt", "toml", "yaml", "yml", "json", "ini", "cfg", "html", "css", "sql", "sh")
LOCKFILES = ("package-lock.json", "poetry.lock", "uv.lock", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock")


def relative(root: str) -> Column:
    """A file's path below the root, from the URI that the reader gives."""
    plain = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(plain) + "/", "")


def language(path: Column, content: Column) -> Column:
    """By extension, else by the interpreter that the first line names."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for known, name in EXTENSIONS.items():
        out = F.when(extension == known, name).otherwise(out)
    # the interpreter's own name, or what ``env`` is asked for
    first = F.regexp_extract(F.decode(F.substring(content, 1, 128), "UTF-8"), r"^#!\s*(?:\S*/)?(?:env\s+)?(?:\S*/)?([A-Za-z]+)", 1)
    named = F.lit(None).cast("string")
    for known, name in reversed(INTERPRETERS.items()):
        named = F.when(first.startswith(known), name).otherwise(named)
    return F.when(extension == "", F.coalesce(out, named)).otherwise(out)


class IgnoreRules:
    """Rules of ignore files: the last one with an opinion wins, each holds below its folder, and ! takes files back."""

    def __init__(self, files: dict[str, str]):
        """{folder of the ignore file ('' for the root): its text}."""
        self.rules = []
        for base in sorted(files, key=lambda b: b.count("/") + bool(b)):
            for line in files[base].splitlines():
                line = line.strip()
                if line and not line.startswith("#"):
                    self.rules.append((base.strip("/"), line.lstrip("!"), line.startswith("!")))

    def condition(self, path: Column) -> Column:
        """Whether a path is ignored."""
        out = F.lit(False)
        for base, pattern, keeps in self.rules:
            hit = path.rlike(self.regex(base, pattern))
            out = F.when(hit, F.lit(not keeps)).otherwise(out)
        return out

    @staticmethod
    def regex(base: str, pattern: str) -> str:
        folder = pattern.endswith("/")
        anchored = "/" in pattern.rstrip("/")
        body = pattern.strip("/")
        parts = []
        for part in body.split("/"):
            if part == "**":
                parts.append(".*")
            else:
                parts.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part))
        inner = "/".join(parts).replace(".*/", "(?:.*/)?")
        head = (re.escape(base) + "/" if base else "") + ("" if anchored else "(?:.*/)?")
        return f"^{head}{inner}" + ("/.*$" if folder else "(/.*)?$")


def discover(spark: SparkSession, root: str, most_bytes: int = 1 << 20, rules: IgnoreRules | None = None, skip_generated: bool = True) -> DataFrame:
    """(path, language, size, sha256, mtime, content): the source files below a root; too large, binary, generated and ignored ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    path = relative(root)
    named = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), "content")
    ignored = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED)))
    if rules is not None:
        ignored = ignored | rules.condition(F.col("path"))
    binary = F.instr(F.encode(F.translate(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0", "\1"), "ISO-8859-1").cast("string"), "\1") > 0
    kept = named.filter(~ignored & ~binary).withColumn("language", language(F.col("path"), F.col("content"))).filter("language IS NOT NULL")
    if skip_generated:
        head = F.decode(F.substring("content", 1, 65536), "ISO-8859-1")
        kept = kept.filter(~F.col("path").rlike(r"\.min\.(js|css)$|_pb2\.py$|\.g\.dart$") & ~looks_minified(head))
    return kept.select("path", "language", "size", F.sha2("content", 256).alias("sha256"), "mtime", "content")


def oversize(spark: SparkSession, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, size) of the source files that ``discover`` leaves out for their size; their contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") > most_bytes)
    named = raw.select(relative(root).alias("path"), F.col("length").alias("size"))
    return named.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def text_files(spark: SparkSession, root: str, most: int = 4000) -> DataFrame:
    """(path, size, sha256, content) of prose and configuration files of 1 byte to 256 KiB, the first in order of their paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    fits = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*TEXT_EXTENSIONS) & ~name.isin(*LOCKFILES) & F.col("length").between(1, 262144)
    kept = raw.filter(fits).select(relative(root).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    return kept.orderBy("path").limit(most)


def decode_bytes(raw: bytes | None) -> str | None:
    """Source bytes as text: a byte-order mark, a declared coding, UTF-8, UTF-8 with a few bad bytes, else a Western code page."""
    if raw is None:
        return None
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    declared = re.search(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)", b"\n".join(raw.split(b"\n", 2)[:2]), re.MULTILINE)
    for coding in ([declared[1].decode("ascii")] if declared else []) + ["utf-8"]:
        try:
            return raw.decode(coding)
        except (LookupError, UnicodeDecodeError):
            pass
    lossy = raw.decode("utf-8", "replace")
    if lossy.count("�") <= 3:
        return lossy
    try:
        return raw.decode("cp1252")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode_bytes)


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition, for matching."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """Composed text; ASCII stays in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(composed(text))


def with_text(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.withColumn("text", decoded("content")).drop("content")


def load_config(text: str, table: str = "tracewright") -> dict:
    """Settings below [tool.<table>] of a TOML text; unknown keys and wrong types are errors of the caller's."""
    known = {"source_roots": list, "test_dirs": list, "exclude": list, "max_bytes": int, "drift_threshold": int}
    settings = tomllib.loads(text).get("tool", {}).get(table, {})
    for key, value in settings.items():
        if key not in known:
            raise ValueError(f"unknown setting {key}")
        if not isinstance(value, known[key]):
            raise ValueError(f"{key} must be a {known[key].__name__}")
    return settings


def dependencies(files: DataFrame) -> DataFrame:
    """(path, dependency): declared names of requirements files, pyproject.toml and package.json, from (path, text)."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    lines = files.filter(base.rlike(r"^requirements.*\.txt$")).select("path", F.explode(F.split("text", r"\r?\n")).alias("l"))
    required = lines.select("path", F.lower(F.regexp_extract("l", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("dependency"))
    project = files.filter(base == "pyproject.toml").select("path", F.explode(F.regexp_extract_all(F.regexp_extract("text", r"(?s)\ndependencies\s*=\s*\[(.*?)\n?\]", 1), F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))).alias("dependency"))
    package = files.filter(base == "package.json").select("path", F.explode(F.map_keys(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>"))).alias("dependency"))
    return required.union(project).union(package).filter("dependency != ''").distinct()


def glob_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(fnmatch.translate(pattern).replace("\\Z", "$").replace("(?s:", "(?s)(?:").replace("\\z", "$")))
