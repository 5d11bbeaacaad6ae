import ast
import re

from barloom.llm.code_docs import function_docs, lex_javascript, lex_python

SCHEMA = "id string, primitive string, summary string, props map<string,string>, doc string"

PY = '''"""Module text that documents no function at all."""
import math
TEMPLATE = """
def inside_string(): pass
"""
# def inside_comment(): pass

@register(name="x", mode=":")
async def alpha(a, b=(1, 2), *, c: dict[str, int] = {"k": ":"}) -> dict[str, int]:
    # note first
    """The steady signal crosses the lower band.

    Args:
        a: four words that should not count
    """
    def inner(q=lambda z: z): return 1
    class Local:
        def deep(self):
            r"""Counts \\d windows of the held frame."""
            if a:
                def deeper():
                    'An early ' "exit closes the open trade."
                    return 2
            return 3
    return a

class Outer(Base):
    """A class is no function."""
    x = {"def": 1}
    def method(self): "Short inline text documents this one."; return 0
    def no_doc(self):
        y = 0
        """This string is no docstring at all, really."""
    def fstring(self):
        f"""The formatted {y} text is no docstring."""
    def bytes_doc(self):
        b"bytes are no documentation for anything"
    def added(self):
        "Joined text is " + "no docstring of it"
    def todo(self):
        """TODO: write about this function some day soon."""
    def paren(self):
        ("Parentheses around the text change nothing here.")
\tdef tabbed(self):
\t\t"""Tabs and blanks may mix in older sources."""
print "old", x
def last(x):
  \'\'\'Two blanks suffice to indent this body.\'\'\'
  return x'''

JS = """'use strict';
/** The module comment documents nothing because code lies between. */
const K = /[/'"]}/g, t = `a${ {b: `}`} }c {`;
/**
 * Draws the held band over every window.
 * @param x function words that never count here
 */
export default async function draw(a, b = { k: '}' }) {
  /** Counts the open bars inside the frame. */
  function count() { return a / b / 2; }
  /* function hidden() {} */
  if (a) { while (b) { b--; } }
}
/** A class comment is no function comment here. */
class View extends mixin(Base) {
  x = call(1);
  /** Renders all rows of the visible table. */
  static async render(a) { return `${a}}`; }
  /** Reads the current value of the field. */
  get value() { return 1; }
  // between
  plain() { return 2; }
  /** Near but not directly before, sadly enough. */
  /* other */
  apart() { return 3; }
}
/** Adds two prices and returns their mean. */
const mean = (a, b) => (a + b) / 2;
/** Wraps a single argument into an array. */
export const wrap = async x => {
  /** Nested arrow turns values into strings quickly. */
  const text = (v) => { return String(v); };
};
/** */
function empty() {}
// /** commented out docs of nothing at all */ function gone() {}
"""


def expected(src):
    src = re.sub(r'print "old", x', "print(x)", src)
    out = {}

    def walk(node, pre):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out[".".join([*pre, c.name])] = ast.get_docstring(c, clean=False)
                walk(c, [*pre, c.name])
            else:
                walk(c, [*pre, c.name] if isinstance(c, ast.ClassDef) else pre)

    walk(ast.parse(src), [])
    return out


def run(spark, rows, **kw):
    return {(r.node_id, r.func_name): r for r in function_docs(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_python(spark):
    src = PY.replace("\tdef tabbed", "    def tabbed").replace("\t\t\"\"\"Tabs", "\t\"\"\"Tabs")
    got = {k[1] for k in run(spark, [("m", "Module", None, {"source_text": src, "lang": "python"}, "d")])}
    docs = expected(src.expandtabs(8))
    assert got == {"alpha", "alpha.Local.deep", "alpha.Local.deep.deeper", "Outer.method", "Outer.paren", "Outer.tabbed", "last"}
    assert all(docs[g] for g in got)
    for ends in ("\r\n", "\r"):
        assert {k[1] for k in run(spark, [("m", "Module", None, {"source_text": src.replace("\n", ends), "lang": "python"}, "d")])} == got


def test_javascript(spark):
    got = run(spark, [("j", "Module", None, {"source_text": JS, "lang": "javascript"}, "d")], with_code=True)
    assert {k[1] for k in got} == {"draw", "draw.count", "View.render", "View.value", "mean", "wrap", "wrap.text"}
    assert got["j", "mean"].code == "const mean = (a, b) => (a + b) / 2;" and got["j", "draw"].code.startswith("export default async function draw(")
    assert got["j", "draw"].description == "Draws the held band over every window."
    assert got["j", "View.render"].code == "static async render(a) { return `${a}}`; }"


def test_summary_fallback_and_repeats(spark):
    s = "The lagging band filters the open trades."
    one, two, empty = "def f(x):\n    return 1\n", "def f(x):\n    return 1\ndef g(x):\n    return 2\n", 'def f(x):\n    ""\n'
    rows = [("a", "Procedure", s, {"source_text": one}, "d")] * 2 + [("b", "Procedure", s, {"source_text": two}, "d"), ("c", "Module", s, {"source_text": one}, "d"), ("e", "Procedure", s, {"source_text": empty}, "d")]
    rows += [("n", "Procedure", None, {"source_text": one}, "d"), ("p", "Procedure", s, None, "d"), ("q", "Procedure", s, {"source_text": ""}, "d"), (None, "Procedure", s, {"source_text": one}, "d"), ("r", "Procedure", s, {"lang": "python"}, "d")]
    assert set(run(spark, rows)) == {("a", "f")}
    assert run(spark, rows[:0]) == {}


def test_own_name_does_not_count(spark):
    src = 'def smooth_open_trade(x):\n    """Smooth open trade, smooth trade bands twice."""\n'
    assert not run(spark, [("a", "Module", None, {"source_text": src}, "d")])


def test_lexers_survive_broken_sources():
    for src in ('"""never closed', "def f(:\n  x = 'open", "((((", "}}}}", "\\", "`${`${", "/* open", "x = 'a\nb'", "\x00\x0c\ufeff def"):
        assert isinstance(lex_python(src), list) and isinstance(lex_javascript(src), list)
