"""Python strings, docstrings and comments told apart lexically, against Python's own tokenizer, and what the gate makes of them."""

import ast
import io
import random
import tokenize

from codesieve.operators import gate, imports, spans


def plain_tokens(text):
    """(start, stop, kind) by the standard library; text must be valid Python."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    docs = set()
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                docs.add((first.lineno, first.col_offset))
    out = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tokenize.STRING, tokenize.COMMENT):
            skip = len(t.string) - len(t.string.lstrip("rRbBuU")) if t.type == tokenize.STRING else 0
            kind = "comment" if t.type == tokenize.COMMENT else "docstring" if t.start in docs else "string"
            out.append((starts[t.start[0] - 1] + t.start[1] + skip, starts[t.end[0] - 1] + t.end[1], kind))
    return out


PIECES = ['x = "a # b"', "# it's", 'y = """two\n"" lines # no\n"""', "def f(a=(1, 'x'), b={'k': 1}):\n    '''doc \\''' more'''\n    return 'v'",
          'class A:\n    # note\n    "doc"\n    z = "n"', "async def g(\n    a: int,\n    b='#',\n) -> dict:\n    \"\"\"Doc.\n\n    more\n    \"\"\"\n    return {}",
          "z = r'\\d' + b\"q\\\"\" + u''", "def h(x): return x", 'if x:\n    "no doc"', "def k(): 'doc in the line'", "s = '\\\n'", 't = ""', "u = '''\n'''", "w = x[1:2]", "\n\n",
          'lambda a: "not a doc"', "class B(object): pass"]


def test_tokens_equal_those_of_the_standard_library(spark):
    rng = random.Random(5)
    texts = ["", '"""Opening."""\n', "# c\n'doc'\nx = 'y'"] + ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["\n".join(PIECES * 60)]
    files = spark.createDataFrame([(str(i), "python", t) for i, t in enumerate(texts)], "path string, language string, content string")
    got = {}
    for r in spans.tokens(files).collect():
        got.setdefault(int(r.path), []).append((r.start, r.stop, r.kind))
        text = texts[int(r.path)]
        assert (r.first_line, r.last_line) == (text.count("\n", 0, r.start) + 1, text.count("\n", 0, r.stop) + 1)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_tokens(text), text


TRIED = [
    # (language, text, lines with findings): markers in strings are data, in comments and docstrings findings
    ("python", 'message = "your code here"\n# TODO implement retry\nx = 1\n', {2}),
    ("python", 'text = """\nleft as an exercise\n# add logic here\n"""\n# left as an exercise\n', {5}),
    ("python", 'def f():\n    """Left as an exercise."""\n    return 1\n', {2}),
    ("javascript", 'const a = "left as an exercise";\nconst b = \'left as an exercise\';\n// left as an exercise for the reader\n', {3}),
    ("javascript", 'const s = "escaped \\" left as an exercise inside";\nlet x = 1;\n', set()),
    # the docstring rule asks for a real docstring with a trigger
    ("python", 'def f():\n    """TODO finish."""\n    return 1\n', {2}),
    ("python", 'def f():\n    return """TODO not implemented"""\n', set()),
    ("python", 'def f():\n    """Done."""\n    todo = 1\n    placeholderless = 1\n\n\ndef g():\n    """Done too."""\n', set()),
    # a named exception passed over is reported unless a comment on its line or the next explains it
    ("python", "try:\n    f()\nexcept ValueError:\n    pass\n", {3}), ("python", "try:\n    f()\nexcept ValueError:  # gone\n    pass\n", set()),
    ("python", "try:\n    f()\nexcept (A, B) as e:\n    # later\n    pass\n", set()), ("python", "try:\n    f()\nexcept A: pass\n", {3}),
    ("python", "try:\n    f()\nexcept A:\n    pass  # fine\n", set()), ("python", "try:\n    f()\nexcept A:\n\n    pass\n", {3}),
    ("python", "try:\n    f()\nexcept A:\n    log()\n", set()),
]


def test_what_the_gate_makes_of_strings_docstrings_and_comments(code):
    files = code(*[(str(i), language, text) for i, (language, text, _) in enumerate(TRIED)])
    rows = gate.listed(gate.collected(files)).collect()
    assert [{r.line_no for r in rows if r.path == str(i)} for i in range(len(TRIED))] == [lines for _, _, lines in TRIED]


def test_collected_equals_the_shuffled_way(spark, code):
    rng = random.Random(8)
    parts = ["def save(x):\n    pass", "# TODO: implement later", "function f() {\n}", "// left as an exercise", 'throw new Error("not implemented");', "x = 'XXX'", "return {}", "\x01 # FIXME", ""]
    files = code(*[(f"p{i}", rng.choice(["python", "go", None]), "\n".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(80)], ("null", "python", None))
    united = gate.adapt(gate.stubs.findings(files)).unionByName(gate.as_gate(gate.prose_findings(files))).unionByName(gate.as_gate(gate.structural_findings(files)))
    assert sorted(map(str, gate.text_findings(files).collect())) == sorted(map(str, gate.deduplicate(united).collect()))
    plan = gate.text_verdicts(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_language_by_look(spark):
    rows = [("a", None, "def f(x):\n    return x\n"), ("b", "", "function f(x) {\n  return x;\n}\n"), ("c", " PY ", "anything"), ("d", "go", "def f():\n"), ("e", None, None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    assert {r.path: r.p for r in files.select("path", spans.is_python(files.language, files.content).alias("p")).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": None}


def plain_imports(text):
    """(line, top-level name) of imports by Python's parser."""
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not node.level:
            out.append((node.lineno, node.module.split(".")[0]))
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if name in ("import_module", "__import__") and not node.args[0].value.startswith("."):
                out.append((node.lineno, node.args[0].value.split(".")[0]))
    return sorted(out)


FORMS = ["import requests", "import os.path, sys as s, \\\n    json", "from flask import Flask", "from . import sibling", "from ..pkg import thing", "import importlib",
         'plugin = importlib.import_module("dynamic_pkg.x")', "legacy = __import__('legacy_pkg')", "from a.b import (\n    c,  # why\n    d,\n)", "x = 1; import y; import z",
         '"""\nimport no\n"""', "# import no", "if x: import inner", "def f():\n    from deep import one\n    return 'import no'", "from \\\n    split import it", "t = '''a\n'''; after = 1", ""]


def test_imports_of_logical_lines(spark):
    rng = random.Random(12)
    texts = [form for form in FORMS] + ["\n".join(rng.choice(FORMS) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    broken = "import requests\ndef broken(:\n    from flask import x\n"
    files = spark.createDataFrame([(str(i), "python", t) for i, t in enumerate([*texts, broken, None])], "path string, language string, content string")
    got = {}
    for r in imports.python_imports(files).collect():
        got.setdefault(int(r.path), []).append((r.line_no, r.name))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_imports(text), text
    assert sorted(got[len(texts)]) == [(1, "requests"), (3, "flask")] and len(texts) + 1 not in got
