"""Python-like texts with strings, docstrings, comments and handlers, derived from the documents.

Every line of a document is kept whole as a comment and followed by one snippet chosen by key and position; every third
text opens with a docstring. Most carry the hint ``python``, some another language or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import text_array
from codesieve.sources.tables import spread, table

SNIPPETS = '''def load_{n}(path, mode="r"):
    """TODO load row {j} from the path."""
    return open(path)
====
message_{j} = "TODO: not a real deferral, your code here"
====
text_{j} = """
left as an exercise for {n}
# add logic here
"""
====
# left as an exercise for the reader {j}
====
class Box{j}:
    \'\'\'Holds {n}; the rest of the code is elsewhere.\'\'\'
    size = {n}
====
try:
    step_{j}()
except ValueError:
    pass
====
try:
    step_{j}()
except (KeyError, OSError):  # gone already
    pass
====
try:
    step_{j}()
except KeyError as error:
    # a retry follows
    pass
====
pattern_{j} = r'\\d+"' + 'it\\'s omitted for brevity' + "\\"XXX\\" {n}"
====
def nested_{j}(a=(1, (2, 3)), b: str = "x"):
    # first a comment
    "follows the same pattern"
    return a
====
async def wait_{j}(
    one: int,
    two="XXX",
) -> dict:
    """Placeholder for {n}.

    FIXME: more
    """
    return one
====
total_{j} = {"a": "b",  # XXX count
    "c": {n}}
====
def plain_{j}():
    return """TODO not implemented {n}"""
====
left_{j} = "open quote
right_{j} = 'in production, you would'
====
def later_{j}(x): return x
"""your code here"""
====
import alpha_{n}.sub as a, beta_{j}, \\
    gamma_{n}
====
from delta_{j}.core import (  # several
    one,
    two,
)
====
plugin_{j} = importlib.import_module("epsilon_{n}.tree"); import zeta_{j}
====
note_{j} = """
import not_this_{n}
"""; legacy_{j} = __import__('eta_{j}')
====
if x: import theta_{n}
from .near import sibling
====
const a_{j} = `XXX {n}`; // XXX {j}'''.split("\n====\n")
OPENING = '"""Module {n}.\n\nTODO: split it.\n"""\n'


def python_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, language, content)``, one row per document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = F.col("doc_id")
    number = (d % 97).cast("string")

    def piece(line, pos):
        pick = (d * 7 + pos * 13 + F.floor(d / 10)) % len(SNIPPETS) + 1
        snippet = F.element_at(text_array(SNIPPETS), pick.cast("int"))
        return F.concat(F.lit("# "), line, F.lit("\n"), F.replace(F.replace(snippet, F.lit("{n}"), number), F.lit("{j}"), pos.cast("string")))

    body = F.array_join(F.transform(F.concat(F.split("text", "\n"), F.array_repeat(F.lit("end"), (d % 6 + 3).cast("int"))), piece), "\n")
    opening = F.when(d % 3 == 0, F.replace(F.lit(OPENING), F.lit("{n}"), number)).otherwise(F.lit(""))
    language = F.when(d % 8 == 5, F.lit("javascript")).when(d % 8 == 6, F.lit(None)).when(d % 8 == 7, F.lit(" Python ")).otherwise(F.lit("python"))
    return settled(docs.select("doc_id", F.concat(F.lit("lib/t"), d.cast("string"), F.lit(".py")).alias("path"), language.alias("language"),
                               F.concat(opening, body).alias("content")))
