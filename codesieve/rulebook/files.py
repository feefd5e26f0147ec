r"""Language, binary and directory tables, test-path globs."""


def _pairs(table: str) -> dict[str, str]:
    """``language: ext ext ...`` lines to an extension map (later lines win)."""
    out: dict[str, str] = {}
    for row in table.strip().splitlines():
        language, exts = row.split(":", 1)
        out.update({ext: language.strip() for ext in exts.split()})
    return out


# Extension (or whole file name) -> language, keys as looked up after lower-casing.
LANGUAGES = _pairs("""
python: .py .pyw .pyi
javascript: .js .jsx .mjs .cjs
typescript: .ts .tsx
html: .html .htm .xhtml
css: .css
scss: .scss
sass: .sass
less: .less
vue: .vue
svelte: .svelte
java: .java
kotlin: .kt .kts
scala: .scala
groovy: .groovy .gradle
c: .c .h
cpp: .cpp .cc .cxx .c++ .hpp .hh .hxx .h++
csharp: .cs .csx
fsharp: .fs .fsx .fsi
visualbasic: .vb
go: .go
rust: .rs
zig: .zig
nim: .nim
ruby: .rb
php: .php .php3 .php4 .php5 .phtml
perl: .pl .pm .t
shell: .sh .bash .zsh .fish .ksh
lua: .lua
swift: .swift
objective-c++: .mm
dart: .dart
elixir: .ex .exs
erlang: .erl .hrl
clojure: .clj .cljs .cljc .edn
haskell: .hs .lhs
elm: .elm
ocaml: .ml .mli
lisp: .lisp .cl .el
r: .r
rmarkdown: .rmd
julia: .jl
matlab: .m .mat
json: .json .jsonc .json5
yaml: .yaml .yml
toml: .toml
xml: .xml
ini: .ini
config: .cfg .conf
properties: .properties
markdown: .md .markdown
restructuredtext: .rst
latex: .tex
asciidoc: .adoc
sql: .sql
postgresql: .psql .pgsql
mysql: .mysql
terraform: .tf .tfvars
hcl: .hcl
makefile: .mk
cmake: .cmake
verilog: .v .vh
systemverilog: .sv .svh
vhdl: .vhd .vhdl .vht
jupyter: .ipynb
gdscript: .gd
shader: .shader
glsl: .glsl
hlsl: .hlsl
protobuf: .proto
thrift: .thrift
graphql: .graphql .gql
""")
SPECIAL_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake"}

BINARY_EXTENSIONS = """.pyc .pyo .pyd .so .dll .dylib .o .a .lib .class .jar .war .ear .exe .out
    .png .jpg .jpeg .gif .bmp .ico .svg .webp .tiff .tif .psd .ai .eps
    .zip .tar .gz .bz2 .xz .7z .rar .tgz .mp3 .mp4 .avi .mov .wmv .flv .mkv .wav .ogg .m4a .aac
    .pdf .doc .docx .xls .xlsx .ppt .pptx .ttf .otf .woff .woff2 .eot
    .db .sqlite .sqlite3 .bin .dat .dmp""".split()

#: Header bytes (hex) of known binary formats.
BINARY_HEADERS = ("7F454C46", "4D5A", "CAFEBABE", "89504E47", "FFD8FF", "47494638", "25504446",
                  "504B0304", "1F8B", "424D", "494433")

# Words voting for a language where an extension is shared.
MATLAB_WORDS = ("function", "%", "end", "disp(", "fprintf(", "matrix", "plot(", "figure(")
OBJC_WORDS = ("@interface", "@implementation", "@property", "#import", "NSString", "NS", "[[", "alloc]", "init]")
VERILOG_WORDS = ("module", "endmodule", "wire", "reg", "always", "assign")
VLANG_WORDS = ("fn ", "struct ", "mut ", "pub fn", "import ")
CPP_WORDS = ("class ", "namespace", "template<", "std::", "::")

EXCLUDED_DIRS = """venv .venv env .env __pycache__ .pytest_cache .mypy_cache .tox .eggs htmlcov .coverage
    build dist *.egg-info node_modules .next .nuxt .cache .npm out target _build .git .svn .hg .bzr
    .vscode .idea .eclipse .settings .vs vendor Pods Carthage .gradle .m2 .cargo elm-stuff .stack-work
    .terraform .bundle tmp temp .tmp coverage .sass-cache""".split()

# Extension -> language for reviewable code; anything else is not code.
REVIEW_LANGUAGES = _pairs("""
python: .py .pyw .pyi
javascript: .js .mjs .cjs .jsx
typescript: .ts .tsx
java: .java
go: .go
rust: .rs
ruby: .rb
php: .php
c: .c .h
cpp: .cpp .cxx .cc .hpp .hxx
csharp: .cs
swift: .swift
kotlin: .kt .kts
scala: .scala
lua: .lua
bash: .sh .bash .zsh
""")

LANGUAGE_ALIASES = _pairs("""
javascript: javascript js jsx node
typescript: typescript ts tsx
java: java
go: go golang
rust: rust rs
ruby: ruby rb
c: c
cpp: cpp c++ cc
""")

TEST_GLOBS = """test/* tests/* testing/* spec/* specs/* __tests__/* src/test/* conftest.py test_*.py *_test.py
    *_test.go *Test.java *Tests.java *IT.java *.spec.ts *.spec.tsx *.spec.js *.spec.jsx *.test.ts *.test.tsx
    *.test.js *.test.jsx *_spec.rb *_test.rb *_test.c *_test.cc *_test.cpp""".split()
