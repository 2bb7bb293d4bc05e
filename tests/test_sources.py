"""Sources, parsers and sinks on hand-written trees."""

import pytest

from tracewright.sources import code, files, logs, sinks

APP = '''"""App."""
import os
from lib.util import helper as h
from flask import Flask

app = Flask("x")
__all__ = ["main"]


class Base:
    name: str

    def run(self, items=[]):
        for i in items:
            if i and self.ready() or h(i):
                return eval(i)
        try:
            return self.ready()
        except Exception:
            pass

    def ready(self):
        return os.getenv("READY") == os.environ["OTHER"]


@app.route("/x", methods=["GET", "POST"])
def handler():
    return Base().run()


def main():  # TODO later
    password = "hunter2hunter2"
    return handler()
    print("never")


if __name__ == "__main__":
    main()
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {
        "src/app.py": APP, "src/lib/util.py": "def helper(x):\n    return x\n", "src/broken.py": "def (:\n", "tool": "#!/usr/bin/env python3\nprint(1)\n", "node_modules/a.js": "x", "web/big.min.js": "a=1",
        "web/page.ts": "// not { a brace\nexport class Page {\n  show(n: number) {\n    if (n) { draw('}'); }\n  }\n}\nfunction draw(x) { return x; }\n", "secret/x.py": "a = 1\n", "requirements.txt": "Flask>=2\n# no\nnumpy\n",
        "package.json": '{"dependencies": {"react": "1"}}', "README.md": "# hi\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "data.py").write_bytes(b"a\0b")
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, tree):
    found = files.discover(spark, tree, rules=files.IgnoreRules({"": "secret/\n*.log\n"}))
    return code.parse_files(files.with_text(found)).cache()


def test_discovery(spark, tree):
    found = files.discover(spark, tree, rules=files.IgnoreRules({"": "secret/\n!secret/x.py\n"}))
    assert {r.path: r.language for r in found.select("path", "language").collect()} == {
        "src/app.py": "python", "src/lib/util.py": "python", "src/broken.py": "python", "tool": "python", "web/page.ts": "typescript", "secret/x.py": "python",
    }
    assert [r.path for r in files.text_files(spark, tree).collect()] == ["README.md", "package.json", "requirements.txt"]


def test_ignore_rules(spark):
    rules = files.IgnoreRules({"": "*.log\nbuild/\n/top\n!keep.log", "sub": "local*"})
    paths = {"a.log": True, "x/b.log": True, "x/keep.log": False, "build/a": True, "x/build/a": True, "top": True, "x/top": False, "sub/local1": True, "local1": False, "sub/y/local": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.ignored for r in df.select("path", rules.condition(df.path).alias("ignored")).collect()} == paths


def test_parsing(spark, parsed):
    rows = {r.path: r for r in parsed.collect()}
    app = rows["src/app.py"]
    byname = {s.qualname: s for s in app.symbols}
    assert set(byname) == {"Base", "Base.run", "Base.ready", "handler", "main"}
    assert byname["Base.run"].complexity == 6 and byname["Base"].fields == ["name"] and byname["Base.run"].kind == "method"
    assert {s.kind for s in app.smells} >= {"mutable_default", "broad_except", "swallowed_exception", "dangerous_call", "todo", "hardcoded_secret", "unreachable"}
    assert {e.key for e in app.env_reads} == {"READY", "OTHER"} and app.has_main_guard and app.all_names == ["main"]
    assert rows["src/broken.py"].parse_error.startswith("SyntaxError")
    page = {s.qualname: s.kind for s in rows["web/page.ts"].symbols}
    assert page == {"Page": "class", "Page.show": "method", "draw": "function"}


def test_resolution_and_routes(spark, parsed):
    table = code.symbols(parsed)
    edges = {(r.src, r.dst): r.confidence for r in code.call_edges(table, parsed).collect()}
    assert edges["app.Base.run", "app.Base.ready"] == "high" and edges["app.main", "app.handler"] == "high" and edges["app.Base.run", "lib.util.helper"] == "high"
    assert {(r.method, r.path, r.handler) for r in code.routes(table).collect()} == {("GET", "/x", "app.handler"), ("POST", "/x", "app.handler")}


def test_calls_by_type_and_ancestor(spark):
    base = "class Base:\n    def save(self):\n        return 1\n\n    def load(self):\n        return self.save()\n"
    user = "from lib.base import Base\n\n\nclass Mid(Base):\n    pass\n\n\nclass Leaf(Mid):\n    def load(self):\n        self.save()\n        return super().load()\n\n\ndef run(x: Leaf):\n    x.load()\n    x.save()\n    y = Base()\n    y.save()\n    q.only_here()\n\n\ndef only_here():\n    return 0\n"
    parsed = code.parse_files(spark.createDataFrame([("lib/base.py", "python", base), ("lib/user.py", "python", user)], "path string, language string, text string"))
    edges = {(r.src, r.dst): (r.confidence, r.resolution) for r in code.call_edges(code.symbols(parsed), parsed).collect()}
    assert edges["lib.base.Base.load", "lib.base.Base.save"] == ("high", "resolved") and edges["lib.user.Leaf.load", "lib.base.Base.save"] == ("medium", "resolved")
    assert edges["lib.user.Leaf.load", "lib.base.Base.load"] == ("medium", "resolved") and edges["lib.user.run", "lib.user.Leaf.load"] == ("medium", "resolved")
    assert edges["lib.user.run", "lib.base.Base.save"] == ("medium", "resolved") and edges["lib.user.run", "lib.user.only_here"] == ("low", "name")
    assert edges["lib.user.run", "lib.base.Base"] == ("high", "resolved")


def test_unused_imports_and_missing_awaits():
    text = "import os\nimport sys as sys\nimport re, json\nfrom a import b, c as d\nfrom e import *\n__all__ = ['d']\n\n\nasync def go(x: 'json.Any'):\n    go(1)\n    await go(2)\n    y = go(3)\n\n\ndef plain():\n    go(4)\n    re.compile('x')\n"
    found = {(s["kind"], s["line"], s["detail"]) for s in code.parse_python("m.py", text)["smells"]}
    assert {f for f in found if f[0] in ("unused_import", "missing_await")} == {("unused_import", 1, "os"), ("unused_import", 4, "b"), ("missing_await", 10, "go")}


def test_folders_languages_and_sizes(spark, tmp_path):
    for name, text in {"a.rs": "fn main() {}", "vendor/b.py": "x = 1", "target/c.py": "x = 1", "run": "#!/usr/bin/env bash\nls", "tool": "#!/bin/sh\nls", "big.go": "package a" + " " * 5000, "env.py": "x = 1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.language for r in files.discover(spark, str(tmp_path), most_bytes=1000).collect()}
    assert got == {"a.rs": "rust", "run": "shell", "tool": "shell", "env.py": "python"}
    assert [(r.path, r.size) for r in files.oversize(spark, str(tmp_path), 1000).collect()] == [("big.go", 5009)]


def test_decoding():
    assert files.decode_bytes("é".encode()) == files.decode_bytes("é".encode("cp1252") * 5)[:1] == "é"
    assert files.decode_bytes(b"# coding: latin-1\n\xe9").endswith("é") and files.decode_bytes(b"\xef\xbb\xbfx") == "x" and files.decode_bytes(None) is None


def test_config_and_dependencies(spark, tree):
    assert files.load_config("[tool.tracewright]\nmax_bytes = 5\n") == {"max_bytes": 5}
    with pytest.raises(ValueError):
        files.load_config("[tool.tracewright]\nmax_bytes = 'x'\n")
    text = files.with_text(files.text_files(spark, tree))
    assert {r.dependency for r in files.dependencies(text).collect()} == {"flask", "numpy", "react"}


def test_log_and_diff(spark, monkeypatch):
    log = "\x1eaaa\x1fann\x1f100\n\nx.py\ny.py\n\x1ebbb\x1fbob\x1f200\n\nx.py\n\x1ebroken\n"
    assert {tuple(r) for r in logs.commits(spark, log).collect()} == {("aaa", "ann", 100, "x.py"), ("aaa", "ann", 100, "y.py"), ("bbb", "bob", 200, "x.py")}
    assert {r.file for r in logs.commits(spark, "\x1eccc\x1fann\x1f300\n\n0a0\n1b1\n").collect()} == {"0a0", "1b1"}
    diff = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@ f", "+a", "--- a/none", "@@ -9 +10,0 @@", "--- a/z", "+++ b/z", "@@ -0,0 +1 @@"]
    diff += ["--- a/gone", "+++ /dev/null", "@@ -1,4 +0,0 @@", "--- /dev/null", '+++ "b/t\\tb.py"', "@@ -0,0 +5,2 @@", "--- nothing", "+++ known", "@@ -1 +1 @@"]
    want = {("x", "x", 1, 2, 1, 3), ("x", "x", 9, 9, 10, 9), ("z", "z", 0, -1, 1, 1), ("gone", None, 1, 4, 0, -1), (None, "t\tb.py", 0, -1, 5, 6), (None, None, 1, 1, 1, 1)}
    rows = spark.createDataFrame(list(enumerate(diff)), "n long, line string")
    for block in (logs.DIFF_BLOCK, 4):
        monkeypatch.setattr(logs, "DIFF_BLOCK", block)
        assert {tuple(r) for r in logs.diff_hunks(rows).collect()} == want
    assert {tuple(r) for r in logs.diff_ranges(rows).collect()} == {("x", 1, 2), ("x", 1, 3), ("x", 9, 9), ("x", 10, 10), ("z", 1, 1), ("gone", 1, 4), ("t\tb.py", 5, 6)}


def test_coverage(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"files": {"src/app.py": {"summary": {"percent_covered": 50.0}}, "util.py": {"summary": {"percent_covered": 25.0}}}}')
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="app.py" line-rate="0.75"/></classes></package></packages></coverage>')
    indexed = spark.createDataFrame([("src/app.py",), ("lib/util.py",), ("old/util.py",)], "path string")
    assert {tuple(r) for r in logs.match_suffix(logs.coverage_json(spark, str(tmp_path / "c.json")), indexed).collect()} == {("src/app.py", 0.5)}
    report = spark.createDataFrame([("/home/me/src/app.py", 0.1), (".\\lib\\util.py", 0.2), ("/x/util.py", 0.3), ("none.py", 0.4)], "file string, ratio double")
    assert {tuple(r) for r in logs.match_suffix(report, indexed).collect()} == {("src/app.py", 0.1), ("lib/util.py", 0.2)}
    assert {tuple(r) for r in logs.match_suffix(logs.coverage_xml(spark, str(tmp_path / "c.xml")), indexed).collect()} == {("src/app.py", 0.75)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert [sinks.write_changed(df, str(tmp_path), "t"), sinks.write_changed(df.orderBy("dst"), str(tmp_path), "t"), sinks.write_changed(df.limit(1), str(tmp_path), "t")] == [True, False, True]
    sinks.append_events(df, str(tmp_path / "log"))
    sinks.append_events(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.mermaid(df).count() == 3 and sinks.dot(df).first().line == '"1" -> "2";' and sinks.graphml(df.select("src"), df).count() == 4
    assert "</script>" in sinks.html_page("t", {"a": "</script>"}) and sinks.html_page("t", {"a": "</script>"}).count("</script>") == 1
    assert {r.src: r.note for r in sinks.notes(df.select("src"), df, "src").collect()} == {1: "# 1\n- [[2]]", 2: "# 2\n- [[3]]"}


def test_types_shapes_and_support(spark, parsed):
    text = "LIMIT = 3\n\n\ndef used(x: Box) -> int:\n    y = Box(1)\n    z = lower()\n    return y\n\n\ndef main():\n    return {'a': used(LIMIT), 'b': 1}\n"
    made = code.parse_python("m.py", text)
    assert {s["name"]: s["local_types"] for s in made["symbols"]} == {"used": {"x": "Box", "y": "Box"}, "main": {}}
    assert code.produces_shape(text, ["a", "b"]) and not code.produces_shape(text, ["c"]) and not code.produces_shape("def (", ["a"])
    assert code.local_support(text, 10, 11) == [(1, 1, "LIMIT"), (4, 7, "used")]
    blocks = spark.createDataFrame([("m.py", 10, 11)], "file string, lo long, hi long")
    found = code.support_blocks(blocks, spark.createDataFrame([("m.py", text)], "path string, text string")).collect()
    assert [(r.start, r.end, r.name) for r in found] == [(1, 1, "LIMIT"), (4, 7, "used")]


def test_headers_and_regions(spark):
    from tracewright.functions.scalars import header_fields, marked_regions

    text = "# t\n- Status: open\n- date: 2024\n- status: closed\n<!-- begin:generated a/b -->\nx\ny\n<!-- end:generated --> <!-- begin:agent n -->z<!-- end:agent -->"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    rows = df.select(header_fields(df.t).alias("h"), marked_regions(df.t).alias("r")).collect()
    assert rows[0].h == {"status": "closed", "date": "2024"} and [tuple(x) for x in rows[0].r] == [("generated", "a/b", "x\ny"), ("agent", "n", "z")]
    assert rows[1].h == {} and rows[1].r == []
