"""Verdicts of the rule gate on small snippets."""

import pytest

from codesieve.operators import gate

BAD = [
    ("js-empty", "javascript", "function handle(req) {\n}\n"),
    ("java-empty", "java", "class S {\n    public void save(User u) {\n    }\n}\n"),
    ("catch", "javascript", "try { work(); } catch (e) { /* nothing */ }\n"),
    ("bare", "python", "try:\n    run()\nexcept: pass\n"),
    ("throw", "typescript", 'function f() { throw new Error("unimplemented"); }\n'),
    ("ellipsis", "python", "def f(a: int) -> int: ...\n"),
    ("todo", "python", "def process(d):\n    # TODO: implement later\n    return d + 1\n"),
    ("raise", "python", "def compute(v):\n    raise NotImplementedError\n"),
    ("rest", "python", "def a():\n    return 1\n# rest of the implementation follows\n"),
    ("exercise", "javascript", "// retries are left as an exercise for you\n"),
    ("macro", "rust", "fn parse(s: &str) -> Ast {\n    todo!()\n}\n"),
    ("panic", "go", 'func Save(u User) error {\n    panic("not implemented")\n}\n'),
]
GOOD = [
    ("plain", "python", "def add(a, b):\n    return a + b\n"),
    ("string", "python", 'text = "left as an exercise"\n'),
    ("abstract", "python", "class P(Protocol):\n    def f(self) -> int: ...\n"),
    ("js-string", "javascript", 'const s = "rest of the code";\nrun(s);\n'),
    ("documented", "python", "try:\n    run()\nexcept KeyError:  # optional key\n    pass\n"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(n, lang, text) for n, lang, text in BAD + GOOD]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    return {r.path: r.verdict for r in gate.text_verdicts(files).collect()}


@pytest.mark.parametrize("name", [b[0] for b in BAD])
def test_incomplete_code_fails(verdicts, name):
    assert verdicts[name] == "FAIL"


@pytest.mark.parametrize("name", [g[0] for g in GOOD])
def test_legitimate_code_does_not_fail(verdicts, name):
    assert verdicts[name] != "FAIL"


def test_violation_beats_warning(spark):
    rows = [("p", 1, "c", "f", "warning", "b"), ("p", 1, "c", "f", "violation", "a"), ("p", 2, "c", "f", "warning", "a")]
    df = spark.createDataFrame(rows, "path string, line_no int, class string, finding string, severity string, source string") \
        .selectExpr("*", "cast(null as double) confidence", "cast(null as string) suggestion", "cast(null as string) cwe")
    out = {(r.line_no): r.severity for r in gate.deduplicate(df).collect()}
    assert out == {1: "violation", 2: "warning"}


def test_marker_inside_escaped_string(code):
    files = code(("a.js", "javascript", 'x = "a \\" your code here"; y = 1; // your code here\n'))
    assert gate.prose_findings(files).where("finding like '%your code here%'").count() == 1
