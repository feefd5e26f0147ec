"""Code snippets woven around document text to obtain source files.

Each document becomes one file: every line of its text is kept whole (as a
comment in code, as a paragraph in markdown) and is followed by one snippet
chosen from the document key and the line position.  ``{n}`` becomes
``doc_id % 97``, ``{j}`` the line position and ``{k}`` a two-digit number from
01 to 18.  Python snippets parse on their own, so the files parse as a whole.
"""

PYTHON = '''def process_{n}(data):
    return data
====
def always_{j}(value):
    return True
====
def pending_{j}(a, b):
    pass
====
def later_{j}(a):
    ...
====
def missing_{j}(x):
    raise NotImplementedError
====
def deny_{n}(x):
    return False
====
def nothing_{n}(x):
    return None
====
# TODO: implement later
value_{n} = {n}
====
password = 'hunter{n}xyz'
api_key = "example-key-{n}"
token = random.randint(0, {n})
====
os.system('ls ' + name_{n})
subprocess.run(cmd, shell=True)
result = eval(user_input)
====
query = "SELECT * FROM t WHERE id = " + uid
cursor.execute("DELETE FROM logs WHERE id = %s" % (uid,))
cursor.execute(f"SELECT {n} FROM t")
====
digest = hashlib.md5(data).hexdigest()
cipher = AES.new(key, AES.MODE_ECB)
key = "short{n}"
====
def compute_{j}(alpha, beta, gamma):
    total = 0
    for item in alpha:
        if item and beta or gamma:
            for sub in item:
                while sub > 3:
                    if sub == 404:
                        total += sub * 37
                        return total
    try:
        total += compute_{j}(beta, 7, 12)
    except ValueError as error:
        raise RuntimeError(error)
    return total
====
def many_{j}(self, alpha, beta, gamma, delta, epsilon, zeta, eta, theta, iota):
    return alpha + beta + gamma
====
def toggle_{j}(active, enabled, force, verbose=False):
    configure(True, False, True)
    setup(True, True)
    return [1, 2, 3]
====
class Abstract{n}Factory:
    def build_{j}(self, temp1):
        self.cache_{n} = {}
        self.value = Redis()
        return Widget(temp1)
====
class Order{j}(Base, Mixin, Left, Right, Upper):
    """Args: x
    Returns: y
    Raises: z
    """
    _instance = None

    def load(self, request):
        return open("data/" + name)
====
# Note that this is basically a data helper
# First, we need to loop through the items
for item in items:
    print(item)
====
# increment the counter
counter = counter + 1
# return the result
# TODO
====
try:
    risky_{n}()
except ValueError:
    pass
====
try:
    risky_{n}()
except:
    pass
====
try:
    risky_{j}()
except KeyError:  # deliberate, the key is optional
    pass
====
if True:
    x_{j} = 1
else:
    x_{j} = 1
====
while waiting_{n}:
    pass
====
def stop_{j}(flag):
    if flag:
        return 1
        print("unreachable")
    return 2
====
import requests
from os import path
import yaml, numpy
from collections import OrderedDict
====
from django.db import models
import MySQLdb
import totally_made_up_{n}
import importlib
mod_{j} = importlib.import_module("sklearn.tree")
====
from api.routes import handler
from service.core import task
====
blob = pickle.loads(raw)
cfg = yaml.load(stream)
obj = marshal.loads(raw)
====
resp = requests.get("http://host/" + part)
page = urllib.request.urlopen(user_url)
tree = xml.etree.ElementTree.parse(source)
====
with open(f"{base}/x") as fh:
    body = fh.read()
secret_path = "../secret/{n}"
====
timeout = 30
retries = 5
port = 8080
time.sleep(12)
if status == 404:
    buffer = 4096
====
_cache = {}
flags = (1 << 4) | 0x1F
@lru_cache(maxsize=None)
def cached_{j}(x):
    return x
====
ENABLE_BETA_{n} = True
if ENABLE_BETA_{n}:
    USE_BETA_API = False
====
def validate_{j}(value):
    return value
====
def login_user_{j}(name):
    log(name)
    return True
====
def save_all_{j}(rows):
    print("would save")
    return None
====
def fake_user_{j}():
    return {"name": "John", "status": "ok"}
====
def empty_{j}(a):
    return []
limit_{n} = 3.75
ratio = scale(0.08, width=0.25, depth=[7])
====
# rest of the implementation goes here
# ... omitted for brevity
# XXX check later, your code goes here
====
note = "rest of the code is left as an exercise"
====
class ServiceLocator{n}:
    def __init__(self):
        self.first = 1
        self.second = 2
    def get(self, k):
        return container.get(k)
====
class Proxy{j}(ABC):
    @abstractmethod
    def call(self):
        pass
    def call_all(self, *args, **kwargs):
        return self.inner.call_all(*args, **kwargs)
====
doc_{j} = \'\'\'
TODO: placeholder text in module {n}
\'\'\'
====
def described_{j}(x):
    """Not implemented yet, TODO."""
    return x + 11
====
# furthermore, in order to utilize the robust, scalable and elegant API we leverage it
# let's explore how it is essential to delve; basically just simply really fine
====
print("launch \U0001F680 done ✨\U0001F525")  # ✅ ok
status_{n} = "ok"  # \U0001F389
====
alpha_total = load(alpha)
beta_total = load(beta)
gamma_total = load(gamma)
delta_total = load(delta)
alpha_total = load(alpha)
beta_total = load(beta)
gamma_total = load(gamma)
delta_total = load(delta)
====
class UserAdapter{j}:
    def adapt(self, other):
        return other
class OrderStrategy{j}:
    def run(self):
        return 1
class Tree{j}Visitor:
    def visit_leaf(self):
        return [[[a for a in b] for b in c] for c in d]
====
def sample_{j}():
    return "mock_value"
user_id = "john_doe"
mail = "test@example.com"
====
class ReportBuilder{j}:
    def add(self, part):
        return self
    def build(self):
        return "TODO"
====
def configure_{j}(self, a1, b1, c1, d1, e1, f1, g1):
    FEATURE_X = True
    if USE_NEW and a1 or b1 and c1 or d1:
        return {"valid": True}
    elif USE_OLD and e1 or f1 or g1:
        return 0 if a1 else 1 if b1 else 2
    for step in range(9):
        while step and a1 and b1:
            step -= 1
    return configure_{j}(a1)
====
# def old_handler{j}(x): return x
# TODO: remove unused helper
user_name = fetch(user)  # user name fetch'''.split("\n====\n")
PYTHON.append("def long_{j}(x):\n" + "\n".join(f"    x = x + {{n}} * {i}" for i in range(55)) + "\n    return x")

SCRIPT = '''function load{n}(data) {
}
====
const save{j} = async (value) => {
  return null;
};
====
element.innerHTML = "<b>" + userInput;
document.write("<p>" + input);
====
try { run(); } catch (e) { }
try { run(); } catch (e) { /* optional cleanup */ }
====
import React from 'react';
const fs = require('fs');
import { x } from './local/file';
export { y } from "@scope/pkg/sub";
const lp = require("left-padder-{n}");
====
// TODO: implement later
const value_{n} = {n};
====
throw new Error("not implemented");
====
// add logic here
eval(userData);
const token = Math.random();
====
fetch("/api/" + id);
axios.get("/u/" + id);
====
class Widget{n} extends Base {
  render() { return false; }
}
====
let someValue = 1;
var other_value = 2;
const UPPER_V = 3;
const PascalV = 4;
let plain = 5;
====
/* block comment
 * second line {n}
 */
let after{j} = 12345;
====
function deep{j}(a) {
  if (a) { for (const b of a) { while (b) {
    if (b && a || b) { go((1), {x: {y: 777}}); }
  } } }
}
====
setup(true, false);
const html = "quote's end";
====
// for example, as you can see this will facilitate
// Simply put, we need to loop
====
const q = "SELECT name FROM t WHERE id = " + id;
const password = "s3cretvalue{n}";
====
// user name fetch
const userName = fetch(user, name);
====
render("\U0001F680"); // \U0001F389 ✅ ✨
if (mode ? a : b ? c : d) { run(); }'''.split("\n====\n")

JAVA = '''public class Order{n} {
    private void handle{j}(String value) { }
}
====
public int total{j}(int a, int b) throws IOException {
    return 0;
}
====
String token = seed(new java.util.Random());
ObjectInputStream in = new ObjectInputStream(s);
====
DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
String sql = "SELECT * FROM t WHERE id=" + id;
====
import java.util.List;
import com.acme.core.Service;
====
/* comment
   more \U0001F389 */
catch (Exception e) { // ignored
}
====
// Simply put, this will be handled
if (a && b || c) { switch (x) { case 1: break; } }
====
throw new UnsupportedOperationException("not supported yet");
====
int limit{j} = 250;
int retries = 7;
// FIXME: later
====
class Builder{j} implements Proxy {
    Object build(Decorator d) { return new Facade(d, 1); }
}'''.split("\n====\n")

MARKDOWN = '''## Section {n} overview
====
### KA-{k} details
====
```
## not a heading {n}
```
====
- [ ] task {n}
- [x] done
====
# TODO
internal use only
====
## PART IX - rules
### Rule {k} - limits
====
Phase {n}: draft version, estimated effort
====
# Implementation plan
## Next steps
====
meeting notes, do not distribute
====
## PREAMBLE - directive
====
This document describes the development
## Open questions
====
plain paragraph {n}'''.split("\n====\n")

MANIFEST = '''requests==2.31.0
pkg-{n}==1.{n}.0-alpha
====
numpy==2.0.0rc1
other==0.0.{n}
====
"left-pad": "1.0.0-beta.2",
"react": "18.2.0",
====
lib-n==20240101-nightly
torch==2.1.dev{n}
====
tool=1.0-unstable
plain>=1.2
====
# pinned==1.0-beta
stable==4.5.6
====
preview-kit==3.0-preview1
edge==9-canary'''.split("\n====\n")

#: Slot (doc_id % 10) -> (language, snippets, prefix of a text line).
SLOTS = [
    *[("python", PYTHON, "# ")] * 5,
    ("javascript", SCRIPT, "// "),
    ("typescript", SCRIPT, "// "),
    ("java", JAVA, "// "),
    ("markdown", MARKDOWN, ""),
    ("unknown", MANIFEST, "# "),
]
EXTENSIONS = {"python": ".py", "javascript": ".js", "typescript": ".ts", "java": ".java"}
LAYERS = ["api", "service", "data", "core", "tests"]
DOC_NAMES = ["README.md", "TODO.md", "IMPLEMENTATION_PLAN.md", "notes.md", "DRAFT_ideas.md", "guide.md",
             "QUICKSTART.md", "meeting-notes.md", "overview.md", "summary.md"]
MANIFEST_NAMES = ["requirements.txt", "package.json", "Cargo.toml"]
