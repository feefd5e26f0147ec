r"""Line patterns and keyword lists of the regex parser tier.

Keys: f function, c class, i import (or include), m block-comment start,
e block-comment end, l line comment.
"""

_SLASH = {"l": r"^//.*$", "m": r"/\*", "e": r"\*/"}
LINE_PATTERNS = {
    "python": {
        "f": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", "c": r"^\s*class\s+(\w+)",
        "i": r"^\s*(?:from\s+(\S+)\s+)?import\s+(.+)", "l": r"^#.*$", "m": r"\"\"\"|''' "},
    "javascript": {
        "f": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|(\w+)\s*:\s*(?:async\s+)?function)",
        "c": r"class\s+(\w+)",
        "i": r"import\s+.*from\s+[\"']([^\"']+)[\"']|require\([\"']([^\"']+)[\"']\)", **_SLASH},
    "typescript": {
        "f": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::\s*\S+\s*)?=\s*(?:async\s*)?\([^)]*\)\s*=>|(\w+)\s*\([^)]*\)\s*(?::\s*\S+\s*)?\{)",
        "c": r"class\s+(\w+)", "i": r"import\s+.*from\s+[\"']([^\"']+)[\"']", **_SLASH},
    "java": {
        "f": r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:\s*,\s*\w+)*)?\s*\{",
        "c": r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)",
        "i": r"import\s+(?:static\s+)?([^;]+);", **_SLASH},
    "go": {"f": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",
           "i": r"import\s+(?:\(\s*)?[\"']([^\"']+)[\"']", **_SLASH},
    "rust": {"f": r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "i": r"use\s+([^;]+);", **_SLASH},
    "ruby": {"f": r"def\s+(\w+[?!]?)", "c": r"class\s+(\w+)",
             "i": r"require\s+[\"']([^\"']+)[\"']|require_relative\s+[\"']([^\"']+)[\"']",
             "l": r"^#.*$", "m": r"^=begin", "e": r"^=end"},
    "php": {"f": r"(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)",
            "c": r"(?:abstract\s+)?class\s+(\w+)",
            "i": r"use\s+([^;]+);|require(?:_once)?\s*\(?[\"']([^\"']+)[\"']\)?",
            "l": r"^(?://|#).*$", "m": r"/\*", "e": r"\*/"},
    "c": {"f": r"(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{",
          "i": r"#include\s*[<\"]([^>\"]+)[>\"]", **_SLASH},
    "cpp": {"f": r"(?:\w+(?:::\w+)?(?:<[^>]+>)?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?\{",
            "c": r"class\s+(\w+)", "i": r"#include\s*[<\"]([^>\"]+)[>\"]", **_SLASH},
}

_SCRIPT = "if else for while do switch case try catch && || ?"
COMPLEXITY_KEYWORDS = {key: words.split() for key, words in {
    "python": "if elif else for while try except with and or",
    "javascript": _SCRIPT, "typescript": _SCRIPT, "java": _SCRIPT,
    "go": "if else for switch case select && ||",
    "rust": "if else for while loop match && || ?",
    "ruby": "if elsif else unless case when while until for and or",
    "php": "if elseif else for foreach while do switch case try catch && || ?",
    "c": "if else for while do switch case && || ?",
    "cpp": _SCRIPT,
}.items()}

#: Keywords counted (as substrings, at most three per line) by the line fallback.
DECISION_WORDS = {
    "python": ["if", "elif", "for", "while", "except", "and", "or", "case"],
    "javascript": ["if", "else if", "for", "while", "catch", "&&", "||", "case", "?"],
}
DECISION_WORDS["typescript"] = DECISION_WORDS["java"] = DECISION_WORDS["javascript"]

#: Halstead tokens and the operator words and signs.
HALSTEAD_TOKEN = r"[\w]+|[+\-*/%=<>!&|^~]+|[.,;:()\[\]{}]"
HALSTEAD_OPERATORS = """+ - * / % // ** = += -= *= /= %= //= **= == != < > <= >= and or not in is
    & | ^ ~ << >> if elif else for while try except finally def class return yield lambda with as
    import from raise assert pass break continue . , : ; ( ) [ ] { }""".split()
PYTHON_DEF = r"^\s*(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)"
