"""Parsers: source files to nested rows of symbols, imports, calls and facts.

Files are parsed by Arrow batch in Python tasks, a file at a time; what comes out are relations.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import ship

SYMBOL = "struct<name:string,qualname:string,kind:string,start:int,end:int,signature:string,doc:string,decorators:array<string>,bases:array<string>,calls:array<struct<target:string,line:int>>,parent:string,complexity:int,fields:array<string>,is_async:boolean,local_types:map<string,string>>"
PARSED = (
    f"path string, language string, symbols array<{SYMBOL}>, imports array<struct<module:string,name:string,alias:string,level:int,line:int>>, "
    "env_reads array<struct<key:string,line:int>>, smells array<struct<kind:string,line:int,detail:string>>, all_names array<string>, has_main_guard boolean, parse_error string"
)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)
RISKY = {"eval", "exec", "os.system", "pickle.loads", "yaml.load"}


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name or attribute chain, which may begin with a call of ``super``."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if parts and isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return ".".join(["super()", *reversed(parts)])
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def inside(node: ast.AST):
    """Nodes of a body, without those of classes and functions within."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            todo += ast.iter_child_nodes(n)


def complexity(node: ast.AST) -> int:
    """1 and a point for each branch, loop, handler, comprehension, case and boolean operand beyond the first."""
    return 1 + sum(isinstance(n, BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def calls(node: ast.AST) -> list[dict]:
    found = {(t, n.lineno) for n in inside(node) if isinstance(n, ast.Call) and (t := dotted(n.func))}
    return [{"target": t, "line": line} for t, line in sorted(found)]


def local_types(node: ast.AST) -> dict[str, str]:
    """What a function's parameters are annotated as and its names are built as: ``x: A`` and ``x = A(...)``."""
    out: dict[str, str] = {}
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None and (kind := dotted(a.annotation)):
                out[a.arg] = kind
        for n in sorted((n for n in inside(node) if isinstance(n, (ast.Assign, ast.AnnAssign))), key=lambda n: n.lineno):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            kind = dotted(n.annotation) if isinstance(n, ast.AnnAssign) else dotted(n.value.func) if isinstance(n.value, ast.Call) else None
            for t in targets:
                if kind and isinstance(t, ast.Name) and kind.split(".")[-1][:1].isupper():
                    out[t.id] = kind
    return out


def produces_shape(text: str, fields: list[str]) -> bool:
    """Whether code builds a mapping that has all the fields: by a literal, or by keyword arguments of ``dict``."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return False
    for n in ast.walk(tree):
        keys = {k.value for k in n.keys if isinstance(k, ast.Constant)} if isinstance(n, ast.Dict) else {k.arg for k in n.keywords} if isinstance(n, ast.Call) and dotted(n.func) == "dict" else set()
        if fields and set(fields) <= keys:
            return True
    return False


def local_support(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """(start, end, name) of the file's own top-level functions, classes and constants that lines lo to hi use, and that lie elsewhere."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and lo <= n.lineno <= hi}
    out = []
    for n in tree.body:
        names = [n.name] if hasattr(n, "name") else [t.id for t in getattr(n, "targets", [getattr(n, "target", None)]) if isinstance(t, ast.Name)]
        out += [(n.lineno, n.end_lineno, name) for name in names if name in used and not (lo <= n.lineno <= hi)]
    return sorted(out)


def support_blocks(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(file, lo, hi, start, end, name): what blocks (file, lo, hi) use of their own files (path, text)."""
    ship(blocks.sparkSession)

    def run(frames):
        for frame in frames:
            rows = [(r.file, r.lo, r.hi, *s) for r in frame.itertuples() for s in local_support(r.text, r.lo, r.hi)]
            yield pd.DataFrame(rows, columns=["file", "lo", "hi", "start", "end", "name"])

    both = blocks.select("file", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")).join(files.select(F.col("path").alias("file"), "text"), "file")
    return both.mapInPandas(run, "file string, lo int, hi int, start int, end int, name string")


def unused_imports(tree: ast.AST) -> list[tuple[str, int, str]]:
    """Names that a module imports and neither uses nor lists in ``__all__``; an alias that repeats its name is meant for others."""
    listed = {c.value for n in ast.walk(tree) if isinstance(n, (ast.Assign, ast.AugAssign)) and "__all__" in map(dotted, getattr(n, "targets", [getattr(n, "target", None)])) for c in ast.walk(n.value) if isinstance(c, ast.Constant)}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | listed
    # names inside annotations that are written as texts
    used |= {w for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and len(n.value) < 200 for w in re.findall(r"[A-Za-z_]\w*", n.value)}
    out = []
    for n in getattr(tree, "body", []):
        if isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", "") != "__future__":
            for a in n.names:
                name = a.asname or a.name.split(".")[0]
                if a.name != "*" and a.asname != a.name and name not in used:
                    out.append(("unused_import", n.lineno, name))
    return out


def missing_awaits(tree: ast.AST) -> list[tuple[str, int, str]]:
    """Calls of the module's own coroutines, by bare name or on ``self``, that stand alone inside another coroutine."""
    own = {n.name for n in ast.walk(tree) if isinstance(n, ast.AsyncFunctionDef)} - {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    out = []
    for f in ast.walk(tree):
        if isinstance(f, ast.AsyncFunctionDef):
            for n in inside(f):
                name = dotted(n.value.func) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) else None
                if name and name.removeprefix("self.") in own:
                    out.append(("missing_await", n.lineno, name))
    return out


def smells(tree: ast.AST, text: str) -> list[dict]:
    out = []
    for n in ast.walk(tree):
        line = getattr(n, "lineno", 0)
        if isinstance(n, ast.ExceptHandler):
            if n.type is None:
                out.append(("bare_except", line, ""))
            elif dotted(n.type) in ("Exception", "BaseException"):
                out.append(("broad_except", line, dotted(n.type)))
            if len(n.body) == 1 and isinstance(n.body[0], ast.Pass):
                out.append(("swallowed_exception", line, ""))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*n.args.defaults, *filter(None, n.args.kw_defaults)]):
                out.append(("mutable_default", line, n.name))
            if (n.end_lineno or line) - line >= 80:
                out.append(("long_function", line, n.name))
            for block in ast.walk(n):
                for body in (getattr(block, "body", None), getattr(block, "orelse", None)):
                    if isinstance(body, list):
                        for a, b in zip(body, body[1:], strict=False):
                            if isinstance(a, (ast.Return, ast.Raise, ast.Continue, ast.Break)):
                                out.append(("unreachable", b.lineno, n.name))
        elif isinstance(n, ast.Call) and (name := dotted(n.func)):
            if name in RISKY:
                out.append(("dangerous_call", line, name))
            if name.endswith(".execute") and n.args and isinstance(n.args[0], (ast.JoinedStr, ast.BinOp)):
                out.append(("sql_formatting", line, name))
    out += unused_imports(tree) + missing_awaits(tree)
    for i, line in enumerate(text.splitlines(), 1):
        if m := re.search(r"#.*\b(TODO|FIXME|XXX)\b", line):
            out.append(("todo", i, m[1]))
        if re.search(r"(?i)(password|secret|token|api_?key)\s*=\s*['\"][^'\"]{8,}['\"]", line):
            out.append(("hardcoded_secret", i, ""))
    return [{"kind": k, "line": n, "detail": d} for k, n, d in sorted(set(out), key=lambda s: (s[1], s[0]))]


def parse_python(path: str, text: str) -> dict:
    """One Python file; of a name defined twice, the last definition stays."""
    empty = {"symbols": [], "imports": [], "env_reads": [], "smells": [], "all_names": None, "has_main_guard": False}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return empty | {"parse_error": f"{type(e).__name__}: {e}"}
    symbols: dict[str, dict] = {}

    def visit(body: list[ast.stmt], parent: str | None, in_class: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{parent}.{n.name}" if parent else n.name
                is_class = isinstance(n, ast.ClassDef)
                fields = [dotted(s.target) for s in n.body if isinstance(s, ast.AnnAssign) and dotted(s.target)] if is_class else []
                signature = n.name if is_class else f"{n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                symbols[name] = {
                    "name": n.name, "qualname": name, "kind": "class" if is_class else "method" if in_class else "function", "start": n.lineno, "end": n.end_lineno, "signature": signature,
                    "doc": (ast.get_docstring(n) or "").split("\n")[0], "decorators": [ast.unparse(d) for d in n.decorator_list], "bases": [b for x in getattr(n, "bases", []) if (b := dotted(x))],
                    "calls": calls(n), "parent": parent, "complexity": 1 if is_class else complexity(n), "fields": fields, "is_async": isinstance(n, ast.AsyncFunctionDef), "local_types": local_types(n),
                }
                visit(n.body, name, is_class)
            elif not isinstance(n, ast.expr):  # definitions inside any other statement: branches, loops, handlers, cases
                blocks = [getattr(n, f, []) for f in ("body", "orelse", "finalbody")]
                blocks += [x.body for x in (*getattr(n, "handlers", ()), *getattr(n, "cases", ()))]
                for block in blocks:
                    visit([x for x in block if isinstance(x, ast.stmt)], parent, in_class)

    visit(tree.body, None, False)
    imports, env, names = [], [], None
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "name": None, "alias": a.asname, "level": 0, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module": n.module or "", "name": a.name, "alias": a.asname, "level": n.level, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.Call) and dotted(n.func) in ("os.getenv", "os.environ.get", "getenv") and n.args and isinstance(n.args[0], ast.Constant):
            env.append({"key": str(n.args[0].value), "line": n.lineno})
        elif isinstance(n, ast.Subscript) and dotted(n.value) == "os.environ" and isinstance(n.slice, ast.Constant):
            env.append({"key": str(n.slice.value), "line": n.lineno})
        elif isinstance(n, ast.Assign) and any(dotted(t) == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            names = [str(e.value) for e in n.value.elts if isinstance(e, ast.Constant)]
    guard = any(isinstance(n, ast.If) and "__name__" in ast.unparse(n.test) and "__main__" in ast.unparse(n.test) for n in tree.body)
    return {"symbols": list(symbols.values()), "imports": imports, "env_reads": env, "smells": smells(tree, text), "all_names": names, "has_main_guard": guard, "parse_error": None}


def masked(text: str) -> str:
    """Brace-language text with strings and comments blanked, so that braces count."""
    return re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


DECLARATION = re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|internal|open|abstract|final|static|override|async|suspend|data|sealed)\s+)*(?:(class|interface|enum|struct|protocol|object|extension|mixin)\s+(\w+)|(?:func|fun|function)\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:<[^>]*>)?\(|(?:[\w<>\[\],?.]+\s+)?(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?(?::\s*[\w<>\[\]|. ]+)?(?:async\s*)?\{)", re.MULTILINE)
KEYWORDS = frozenset("if for while switch catch return else new function guard when do try throw await".split())


def parse_braces(path: str, text: str) -> dict:
    """Classes and functions of a language with braces, by matching them; no grammar is needed."""
    plain = masked(text)
    found, closed = [], 0
    for m in DECLARATION.finditer(plain):
        kind, name = ("class", m[2]) if m[2] else ("function", m[3] or m[4])
        opened = plain.find("{", m.end() - 1)
        if name in KEYWORDS or opened < 0 or ";" in plain[m.end() : opened]:
            continue
        depth, at = 0, opened
        for b in re.finditer(r"[{}]", plain[opened:]):
            depth += 1 if b[0] == "{" else -1
            if depth == 0:
                at = opened + b.start()
                break
        found.append((m.start(), at, kind, name, opened))
    symbols = []
    for a, b, kind, name, opened in found:
        around = [f for f in found if f[0] < a and b <= f[1]]
        parent = ".".join(f[3] for f in around) or None
        body = plain[opened:b]
        called = {(c[1], plain.count("\n", 0, opened + c.start()) + 1) for c in re.finditer(r"([\w.]+)\s*\(", body) if c[1].split(".")[-1] not in KEYWORDS}
        first = plain.count("\n", 0, a + len(plain[a:]) - len(plain[a:].lstrip())) + 1
        symbols.append({
            "name": name, "qualname": f"{parent}.{name}" if parent else name, "kind": "class" if kind == "class" else "method" if around and around[-1][2] == "class" else "function", "start": first,
            "end": plain.count("\n", 0, b) + 1, "signature": " ".join(text[a:opened].split()), "doc": "", "decorators": [], "bases": [], "calls": [{"target": t, "line": n} for t, n in sorted(called)], "parent": parent,
            "complexity": 1 if kind == "class" else 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\s", body)), "fields": [], "is_async": "async" in text[a:opened] or "suspend" in text[a:opened], "local_types": {},
        })
        closed = max(closed, b)
    imports = [{"module": m[1] or m[2], "name": None, "alias": None, "level": 0, "line": text.count("\n", 0, m.start()) + 1} for m in re.finditer(r"^\s*import\b[^\n'\"]*?(?:['\"]([^'\"]+)['\"]|([\w.]+))", text, re.MULTILINE)]
    return {"symbols": symbols, "imports": imports, "env_reads": [], "smells": [], "all_names": None, "has_main_guard": False, "parse_error": None}


PARSERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python, **dict.fromkeys(("javascript", "typescript", "go", "java", "dart", "kotlin", "swift"), parse_braces)}


def register_parser(language: str, parser: Callable[[str, str], dict]) -> None:
    """Takes a function of (path, text) for a language's files."""
    PARSERS[language] = parser


def parse_files(files: DataFrame) -> DataFrame:
    """A row of PARSED for each (path, language, text)."""
    ship(files.sparkSession)
    parsers = dict(PARSERS)

    def run(frames):
        for frame in frames:
            rows = [{"path": r.path, "language": r.language, **parsers[r.language](r.path, r.text or "")} for r in frame.itertuples() if r.language in parsers]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in COLUMNS])

    return files.select("path", "language", "text").mapInPandas(run, PARSED)


COLUMNS = ("path", "language", "symbols", "imports", "env_reads", "smells", "all_names", "has_main_guard", "parse_error")


def symbols(parsed: DataFrame, module: str = "module") -> DataFrame:
    """(id, module, file and the symbol's own columns): the global table of symbols."""
    from tracewright.functions.scalars import is_private, module_name

    rows = parsed.select("path", module_name(F.col("path")).alias(module), F.explode("symbols").alias("s"))
    named = rows.select(F.concat_ws(".", module, "s.qualname").alias("id"), module, F.col("path").alias("file"), "s.*")
    return named.withColumn("visibility", F.when(is_private(F.col("id")), "private").otherwise("public"))


def call_edges(table: DataFrame, parsed: DataFrame, depth: int = 8) -> DataFrame:
    """(src, dst, confidence, resolution, line): calls resolved by the receiver's type, by their own class and its ancestors, by local and
    imported names, then by unique names.

    Each rule is a join; the first that answers for a call wins.  Inherited methods are looked for ``depth`` classes up, the
    nearest one first.
    """
    from tracewright.functions.scalars import module_name
    from tracewright.operators.relations import ancestors, first_rule

    made = table.select(F.col("id").alias("src"), "module", F.col("parent").alias("owner"), "local_types", F.explode("calls").alias("c")).select("src", "module", "owner", "local_types", F.col("c.target").alias("target"), F.col("c.line").alias("line"))
    bound = parsed.select(module_name(F.col("path")).alias("module"), F.explode("imports").alias("i"))
    names = bound.filter("i.name IS NOT NULL").select("module", F.coalesce("i.alias", "i.name").alias("head"), F.concat_ws(".", "i.module", "i.name").alias("full"))
    ids = table.select(F.col("id").alias("dst"))

    def resolved(refs: DataFrame, ref: str) -> DataFrame:
        """``refs`` with ``dst``: what a name written in a module stands for, its own definitions before imported ones."""
        keys = refs.columns
        local = refs.withColumn("dst", F.concat_ws(".", "module", ref))
        imported = refs.withColumn("head", F.substring_index(ref, ".", 1)).join(names, ["module", "head"])
        imported = imported.withColumn("dst", F.concat("full", F.expr(f"substring({ref}, length(head) + 1)"))).select(*keys, "dst")
        return first_rule([r.join(ids, "dst", "left_semi").select(*keys, "dst") for r in (local, imported)], keys).select(*keys, "dst")

    classes = table.filter("kind = 'class'").select(F.col("id").alias("cls"), "module", "bases")
    kinds = classes.select(F.col("cls").alias("dst"))
    bases = resolved(classes.select("cls", "module", F.explode("bases").alias("ref")), "ref").join(kinds, "dst", "left_semi").select("cls", F.col("dst").alias("base"))
    above = ancestors(bases, "cls", "base", depth).filter("node != ancestor")
    methods = table.filter("kind = 'method'").select(F.concat_ws(".", "module", "parent").alias("ancestor"), F.col("name").alias("method"), F.col("id").alias("dst"))
    nearest = F.row_number().over(Window.partitionBy("cls", "method").orderBy("distance", "ancestor"))
    inherited = above.join(methods, "ancestor").withColumnRenamed("node", "cls").withColumn("p", nearest).filter("p = 1").select("cls", "method", "dst")
    own = methods.withColumnRenamed("ancestor", "cls")
    call = ["src", "target", "line"]
    first, second = F.substring_index("target", ".", 1), F.regexp_extract("target", r"^[^.]+\.(\w+)$", 1)
    two = made.withColumn("head", first).withColumn("method", second).filter("method != ''")
    typed = two.withColumn("type", F.col("local_types")[F.col("head")]).filter("type IS NOT NULL").select(*call, "module", "method", "type")
    typed = resolved(typed, "type").join(kinds, "dst", "left_semi").select(*call, "method", F.col("dst").alias("cls"))
    owned = two.filter(F.col("owner").isNotNull() & F.col("head").isin("self", "cls", "this", "super()")).select(*call, "head", "method", F.concat_ws(".", "module", "owner").alias("cls"))
    mine = owned.filter("head != 'super()'")
    unique = table.filter("kind != 'class'").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("dst")).filter("n = 1")
    free = two.filter(~F.col("head").isin("self", "cls", "this", "super()") & ~F.col("method").startswith("__")).join(names.select("module", "head"), ["module", "head"], "left_anti")
    rules = [
        (typed.join(own, ["cls", "method"]), "medium"),
        (typed.join(inherited, ["cls", "method"]), "medium"),
        (mine.join(own, ["cls", "method"]), "high"),
        (owned.join(inherited, ["cls", "method"]), "medium"),
        (resolved(made.select(*call, "module"), "target"), "high"),
        (free.withColumnRenamed("method", "name").join(unique, "name"), "low"),
    ]
    best = first_rule([r.select(*call, "dst") for r, _ in rules], call)
    confidence = F.element_at(F.array(*(F.lit(c) for _, c in rules)), F.col("rule") + 1)
    edges = best.select("src", "dst", confidence.alias("confidence"), F.when(F.col("rule") == len(rules) - 1, "name").otherwise("resolved").alias("resolution"), "line")
    weight = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return edges.groupBy("src", "dst").agg(F.min(F.struct(weight.alias("r"), "line", "confidence", "resolution")).alias("m")).select("src", "dst", "m.confidence", "m.resolution", "m.line")


def routes(table: DataFrame) -> DataFrame:
    """(method, path, handler) of decorators such as ``app.post("/x")``."""
    d = table.select(F.col("id").alias("handler"), F.explode("decorators").alias("d"))
    pattern = r"""^[\w.]+\.(get|post|put|delete|patch|route)\(['"]([^'"]*)['"]"""
    found = d.filter(F.col("d").rlike(pattern))
    verb = F.regexp_extract("d", pattern, 1)
    listed = F.regexp_extract_all(F.regexp_extract("d", r"methods=\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    methods = F.when(verb != "route", F.array(F.upper(verb))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    return found.select(F.explode(methods).alias("method"), F.regexp_extract("d", pattern, 2).alias("path"), "handler")
