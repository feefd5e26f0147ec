r"""Import forms, module lists and aliases."""

import sys

#: Standard library of the running interpreter.
STDLIB = sorted(sys.stdlib_module_names)

NODE_BUILTINS = """assert async_hooks buffer child_process cluster console constants crypto dgram
    diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks
    process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url
    util v8 vm wasi worker_threads zlib""".split()

#: Import name -> distribution name where they differ.
ALIASES = dict(row.split() for row in """
attr attrs
bs4 beautifulsoup4
Crypto pycryptodome
cv2 opencv-python
dateutil python-dateutil
docx python-docx
dotenv python-dotenv
fitz PyMuPDF
git GitPython
github PyGithub
jwt PyJWT
kafka kafka-python
magic python-magic
MySQLdb mysqlclient
OpenSSL pyOpenSSL
PIL Pillow
pptx python-pptx
serial pyserial
sklearn scikit-learn
usb pyusb
win32api pywin32
win32com pywin32
yaml PyYAML
""".strip().splitlines())

PY_IMPORT_LINE = r"^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\b)"
# Forms on a logical line; \x02 is a joined line break.
PY_IMPORT_LIST = (r"(?:^|[;:])[\s\x02]*import[\s\x02]+([\w.]+(?:[\s\x02]+as[\s\x02]+\w+)?(?:[\s\x02]*,[\s\x02]*[\w.]+(?:[\s\x02]+as[\s\x02]+\w+)?)*)")
PY_FROM = r"(?:^|[;:])[\s\x02]*from[\s\x02]+(\w[\w.]*)[\s\x02]+import\b"
PY_DYNAMIC_HEAD = r"(?:\bimportlib\.import_module|\b__import__)[\s\x02]*\([\s\x02]*$"
PY_DYNAMIC = r"""(?:\bimportlib\.import_module|\b__import__)[\s\x02]*\([\s\x02]*["']+(\w[\w.]*)["']"""
JS_IMPORT_FORMS = (
    r"""\bimport\s+(?:[\w{}\s,*$]+\s+from\s+)?["']([^"']+)["']""",
    r"""\bexport\s+[\w{}\s,*$]+\s+from\s+["']([^"']+)["']""",
    r"""\b(?:require|import)\s*\(\s*["']([^"']+)["']\s*\)""",
)
#: Each form above holds one of these.
JS_IMPORT_WORDS = ("import", "export", "require")
NPM_NAME = r"^(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*$"
PY_MODULE = r"^[A-Za-z_][A-Za-z0-9_]*$"
JS_EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
MAX_NPM_NAME = 214
