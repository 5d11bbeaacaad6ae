"""Functions of source files paired with their documentation.

Method: sources are lexed and their tokens exploded into rows.  A cumulative sum of opening and
closing tokens (brackets; indents in Python) gives the depth of each; within one depth, openers
and closers alternate, so windows over (source, depth) match them and delimit functions.  Lag
windows attach the comment or the string that documents a function.  All windows are partitioned
by source in the partitioning that removed repeated sources: nothing is shuffled after that.

The lexers emit what can delimit or name a function; runs of other tokens are one row.  Each language
has its own plan, rows hold offsets instead of texts, and code and documentation are cut out of the
source at the end, for the functions found.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line starts that end a description, and beginnings of documentation that says nothing.
DESCRIPTION_ENDS = r"^(@|:param|Args:|Arguments:|Parameters|Returns:|Raises:)"
TRIVIAL = r"(?i)^(todo|fixme|tbd|xxx)"
LEAST_WORDS = 4

_TOKENS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("upto", T.IntegerType())]))

_PY = re.compile(
    r'''(?P<str>[rbufRBUF]{0,3}(?:"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""|\'\'\'[^\'\\]*(?:(?:\\.|\'(?!\'\'))[^\'\\]*)*\'\'\'|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|.))*"|\'(?!\'\')(?:[^\'\\\r\n]|\\(?:\r\n|.))*\'))'''
    r'''|(?P<lost>"""|\'\'\'|["\'][^\r\n]*)|(?P<note>\#[^\r\n]*)|(?P<nl>\r\n|\r|\n)|(?P<cont>\\(?:\r\n|\r|\n))|(?P<open>[(\[{])|(?P<close>[)\]}])'''
    r"""|(?P<colon>:(?!=))|(?P<semi>;)|(?P<word>[^\W\d]\w*)|(?P<ws>[ \t\f]+)|(?P<x>[^\s\w"'#\\()\[\]{}:;]+|.)""",
    re.S,
)
_JS = re.compile(
    r"""(?P<doc>/\*\*(?!/)[\s\S]*?\*/)|(?P<note>/\*[\s\S]*?(?:\*/|\Z)|//[^\r\n]*)|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')|(?P<tick>`)|(?P<slash>/)"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<arrow>=>)|(?P<eq>=(?!=))|(?P<semi>;)|(?P<star>\*)|(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<ws>\s+)|(?P<x>\.?\d[\w.]*|==+|.)""",
    re.S,
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*")
_HEADS = frozenset(("def", "class", "async"))
#: A JavaScript word is kept if it is one of these, follows one of _NAMED or comes before one of _NAMING; others only separate.
_JS_HEADS = frozenset("function class const let var export default async static get set".split())
_NAMED = frozenset("function class const let var async static get set".split())
_NAMING = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\r\n]*)*(?:\(|=)")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _width(ws: str) -> int:
    n = 0
    for c in ws:
        n = 0 if c == "\f" else n + 8 - n % 8 if c == "\t" else n + 1
    return n


def _literal(raw: str) -> str | None:
    """The value of a plain string literal; None for bytes, f-strings and what is no literal."""
    try:
        v = ast.literal_eval(raw)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return v if isinstance(v, str) else None


@F.pandas_udf(T.StringType())
def _docstring(raw: pd.Series) -> pd.Series:
    """The value of neighbouring literals, with the comments and line ends between them."""
    return pd.Series([None if r is None else _literal("(" + re.sub("\r\n?", "\n", r) + "\n)") for r in raw], dtype=object)


def lex_python(src: str) -> list[tuple]:
    """Tokens (pos, kind, text, start, end): header words and names, brackets, colons, new lines, indents and dedents, strings; other runs as one x."""
    out: list[tuple] = []
    stack, depth, fresh, n = [0], 0, True, 0

    def put(kind, text, a, b):
        nonlocal n
        out.append((n, kind, text, a, b))
        n += 1

    pending, at, end = 0, 0, len(src)  # pending: indentation seen since the line began
    while at < end:
        m = _PY.match(src, at)
        kind, a, b = m.lastgroup, at, m.end()
        at = b
        if kind == "ws":
            if fresh:
                pending = _width(m.group())
            continue
        if kind in ("note", "cont"):
            continue
        if kind == "nl":
            if depth == 0:
                if not fresh:
                    put("nl", None, a, b)
                fresh, pending = True, 0
            continue
        if fresh:
            fresh = False
            if pending > stack[-1]:
                stack.append(pending)
                put("indent", None, a, a)
            while pending < stack[-1]:
                stack.pop()
                put("dedent", None, a, a)
        if kind == "open":
            depth += 1
            put(m.group(), None, a, b)
        elif kind == "close":
            if depth:
                depth -= 1
                put(m.group(), None, a, b)
        elif kind == "str":
            parts = [m.group()]
            while True:  # neighbouring literals are one string
                gap = re.compile(r"(?:[ \t\f]|\\(?:\r\n|\r|\n))*").match(src, at).end() if depth == 0 else re.compile(r"(?:\s|\\(?:\r\n|\r|\n)|\#[^\r\n]*)*").match(src, at).end()
                nxt = _PY.match(src, gap) if gap < end else None
                if nxt is None or nxt.lastgroup != "str":
                    break
                parts.append(nxt.group())
                at = b = nxt.end()
            first = not out or out[-1][1] in ("nl", "indent", "dedent", "colon", "semi", "(")
            plain = first and None not in [_literal(re.sub("\r\n?", "\n", p)) for p in parts]
            if plain or not out or out[-1][1] != "x":
                put("str" if plain else "x", None, a, b)
        elif kind == "lost":
            if m.group() in ('"""', "'''"):  # never closed: the rest is no code
                at = end
            put("x", None, a, at)
        elif kind == "word" and (m.group() in _HEADS or out and out[-1][2] in ("def", "class")):
            put("word", m.group(), a, b)
        elif kind in ("colon", "semi"):
            put(kind, None, a, b)
        elif not out or out[-1][1] != "x":
            put("x", None, a, b)
    for _ in range(depth):
        put(")", None, end, end)
    if not fresh:
        put("nl", None, end, end)
    for _ in stack[1:]:
        put("dedent", None, end, end)
    return out


def _template_end(src: str, at: int) -> int:
    """Behind the template literal that begins at ``at``, with nested substitutions."""
    i, n, braces = at + 1, len(src), []
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
            continue
        if braces and braces[-1] >= 0:  # inside a substitution
            if c == "{":
                braces[-1] += 1
            elif c == "}":
                if braces[-1] == 0:
                    braces.pop()
                else:
                    braces[-1] -= 1
            elif c == "`":
                braces.append(-1)
            elif c in "\"'":
                m = re.compile(r"(['\"])(?:(?!\1)[^\\\r\n]|\\[\s\S])*\1").match(src, i)
                if m:
                    i = m.end()
                    continue
        elif c == "`":
            if not braces:
                return i + 1
            braces.pop()
        elif c == "$" and src[i + 1 : i + 2] == "{":
            braces.append(0)
            i += 1
        i += 1
    return n


def lex_javascript(src: str) -> list[tuple]:
    """Tokens (pos, kind, text, start, end) of JavaScript; strings, templates and regular expressions are one token each."""
    out: list[tuple] = []
    n, at, end, depth = 0, 0, len(src), 0
    last_kind, last_text = "", ""
    while at < end:
        m = _JS.match(src, at)
        kind, text, a, b = m.lastgroup, m.group(), at, m.end()
        at = b
        if kind == "ws":
            continue
        if kind == "tick":
            kind, at = "str", _template_end(src, a)
        elif kind == "slash":
            value_before = last_kind in (")", "]", "}", "str", "num") or last_kind == "word" and last_text not in _BEFORE_REGEX
            r = None if value_before else _JS_REGEX.match(src, a)
            kind, at = ("str", r.end()) if r else ("x", b)
        if kind in ("open", "close"):
            depth += 1 if kind == "open" else -1
            if depth < 0:
                depth = 0
                continue
            kind, text = text, None
        elif kind == "x" and text[0].isdigit():
            kind = "num"
        if kind not in ("doc", "note"):
            last_kind, last_text = kind, text or ""
        if kind == "word" and not (text in _JS_HEADS or out and (out[-1][2] in _NAMED or out[-1][1] == "star") or _NAMING.match(src, at)):
            kind = "x"
        if kind in ("x", "num", "str"):
            if out and out[-1][1] == "x":
                continue
            kind, text = "x", None
        elif kind != "word":
            text = None
        out.append((n, kind, text, a, at))
        n += 1
    for _ in range(depth):
        out.append((n, "}", None, end, end))
        n += 1
    return out


@F.pandas_udf(_TOKENS)
def _lex_python(source: pd.Series) -> pd.Series:
    return source.map(lex_python, na_action="ignore")


@F.pandas_udf(_TOKENS)
def _lex_javascript(source: pd.Series) -> pd.Series:
    return source.map(lex_javascript, na_action="ignore")


_OPEN, _CLOSE = ["(", "[", "{", "indent"], [")", "]", "}", "dedent"]
_MODIFIERS = ["export", "default", "async", "static", "get", "set"]
_NO_METHOD = "if for while switch catch with function return typeof new await yield super import".split()
_LINE_START = ["nl", "indent", "dedent"]


def _order():
    return Window.partitionBy("id").orderBy("pos")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _upto():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _ahead():
    """The rows behind one on its own depth."""
    return Window.partitionBy("id", "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def _lag(c, n=1) -> Column:
    return F.lag(c, n).over(_order())


def _lead(c, n=1) -> Column:
    return F.lead(c, n).over(_order())


def _depth() -> Column:
    kind = F.col("kind")
    return F.sum(F.when(kind.isin(_OPEN), 1).when(kind.isin(_CLOSE), -1).otherwise(0)).over(_upto()).cast("int").alias("depth")


def _scope(name, what) -> Column:
    return F.struct(name.alias("name"), what.alias("what"))


def _python_functions(t: DataFrame) -> DataFrame:
    """``id, pos, depth, made, scope`` of headers and blocks from tokens ``id, pos, kind, text, at, upto``."""
    kind, text = F.col("kind"), F.col("text")
    ahead = [_lead("kind", i).alias(f"k{i}") for i in range(1, 7)] + [_lead(c, i).alias(f"{c}{i}") for c in ("at", "upto") for i in range(1, 5)]
    t = t.select("*", _depth(), _lag("kind").alias("b1"), _lead("text").alias("t1"), _lead("text", 2).alias("t2"), *ahead)
    # the header of the logical line, seen from its first token
    line_start = ~kind.isin(_LINE_START) & (F.col("b1").isNull() | F.col("b1").isin(_LINE_START))
    later = (text == "async") & (F.col("t1") == "def")
    word = F.when(text.isin("def", "class"), text).when(later, F.col("t1")).otherwise("")
    name = F.when(text.isin("def", "class"), F.col("t1")).when(later, F.col("t2"))
    # the string behind a colon, on its line or first in the block below
    deep = (F.col("k1") == "nl") & (F.col("k2") == "indent")

    def docstring(first: int) -> Column:
        ends = lambda i: F.coalesce(F.col(f"k{i}"), F.lit("nl")).isin("nl", "semi")
        span = lambda i: F.struct(F.col(f"at{i}").alias("at"), F.col(f"upto{i}").alias("upto"))
        bare, braced = F.col(f"k{first}") == "str", (F.col(f"k{first}") == "(") & (F.col(f"k{first + 1}") == "str") & (F.col(f"k{first + 2}") == ")")
        return F.when(bare & ends(first + 1), span(first)).when(braced & ends(first + 3), span(first + 1))

    body = F.when(kind == "colon", F.struct(F.when(deep, docstring(3)).otherwise(docstring(1)).alias("doc"), F.coalesce(deep, F.lit(False)).alias("deep")))
    line = F.when(line_start, _scope(F.coalesce(name, F.lit("")), word))
    t = t.select("id", "pos", "kind", "at", "upto", "depth", line.alias("line"), body.alias("body"))
    t = t.select("*", F.when(kind == "indent", F.last("line", True).over(_before())).alias("scope"))
    # the colon of a header, the dedent that ends its block and the end of its line are the next of their kind on its depth
    t = t.select(
        "id", "pos", "at", "depth", "line", "scope", F.last("body", True).over(_ahead()).alias("body"),
        F.last(F.when(kind == "dedent", F.col("upto")), True).over(_ahead()).alias("block_end"), F.last(F.when(kind == "nl", F.col("upto")), True).over(_ahead()).alias("line_end"),
    )
    made = F.when((F.col("line.what") == "def") & (F.col("line.name") != ""), F.struct(
        F.col("line.name").alias("name"), F.lit("def").alias("what"), F.col("body.doc").alias("doc"), F.col("at").alias("start"),
        F.when(F.col("body.deep"), F.col("block_end")).otherwise(F.col("line_end")).alias("stop"), F.col("depth").alias("outer"),
    ))
    return t.select("id", "pos", "depth", made.alias("made"), "scope")


def _javascript_functions(t: DataFrame) -> DataFrame:
    """The same of JavaScript."""
    kind, text = F.col("kind"), F.col("text")
    # a comment goes to the token behind it, then comments leave
    doc = F.when(_lag("kind") == "doc", F.struct(_lag("at").alias("at"), _lag("upto").alias("upto")))
    t = t.select("*", doc.alias("note")).where(~kind.isin("doc", "note"))
    before = [_lag("kind", i).alias(f"k{i}") for i in range(1, 6)] + [_lag("text", i).alias(f"x{i}") for i in range(1, 6)]
    modifier = F.coalesce(text.isin(_MODIFIERS), F.lit(False)) | (kind == "star")
    t = t.select("*", _depth(), *before, modifier.alias("mod"), _lead("kind").alias("next"), _lead("text").alias("next_text"))
    # documentation before a run of modifiers counts for what they modify
    run_start = ~F.coalesce((F.col("k1") == "star") | F.col("x1").isin(_MODIFIERS), F.lit(False))
    class_mark = F.when((text == "class") & (F.col("next") == "word"), F.col("next_text")).when(kind.isin("{", "}", "semi"), F.lit(""))
    t = t.select("*", F.last(F.when(run_start, F.struct(F.col("note").alias("doc"), F.col("at").alias("at"))), True).over(_upto()).alias("run"), class_mark.alias("class_mark"))
    t = t.select("*", *[_lag("run", i).alias(f"r{i}") for i in range(1, 6)], F.when(kind == "{", F.last("class_mark", True).over(_before())).alias("class_name"))
    # what a parameter list or a bare arrow belongs to
    k, x, r = ({i: F.col(f"{c}{i}") for i in range(1, 6)} for c in "kxr")
    is_const = lambda c: c.isin("const", "let", "var")
    candidate = lambda name, what, run: F.struct(name.alias("name"), F.lit(what).alias("what"), run["doc"].alias("doc"), run["at"].alias("at"))
    params = F.when(kind == "(", F.coalesce(
        F.when((k[1] == "word") & (x[2] == "function"), candidate(x[1], "function", r[2])),
        F.when((k[1] == "word") & (k[2] == "star") & (x[3] == "function"), candidate(x[1], "function", r[3])),
        F.when((k[1] == "eq") & (k[2] == "word") & is_const(x[3]), candidate(x[2], "arrow", r[3])),
        F.when((x[1] == "async") & (k[2] == "eq") & (k[3] == "word") & is_const(x[4]), candidate(x[3], "arrow", r[4])),
        F.when((x[1] == "function") & (k[2] == "eq") & (k[3] == "word") & is_const(x[4]), candidate(x[3], "function", r[4])),
        F.when((x[1] == "function") & (x[2] == "async") & (k[3] == "eq") & (k[4] == "word") & is_const(x[5]), candidate(x[4], "function", r[5])),
        F.when((k[1] == "word") & ~x[1].isin(_NO_METHOD) & (k[2].isin("{", "}", "semi", "star") | x[2].isin("static", "async", "get", "set")), candidate(x[1], "method", r[1])),
    ))
    bare = F.when(
        kind == "arrow",
        F.when((k[1] == "word") & (k[2] == "eq") & (k[3] == "word") & is_const(x[4]), candidate(x[3], "arrow", r[4])).when(
            (k[1] == "word") & (x[2] == "async") & (k[3] == "eq") & (k[4] == "word") & is_const(x[5]), candidate(x[4], "arrow", r[5])
        ),
    )
    opens = kind.isin(_OPEN)
    level = F.when(opens, F.col("depth")).when(kind.isin(_CLOSE), F.col("depth") + 1)  # that of a bracket pair
    t = t.select("id", "pos", "kind", "at", "upto", "depth", "k1", "next", "class_name", level.alias("level"), F.coalesce(params, bare).alias("head"))
    # a pair of brackets alternates on its level: the closer takes over what the opener knows, the opener learns the end
    pair = Window.partitionBy("id", "level").orderBy("pos")
    t = t.select("*", F.when(kind == ")", F.lag("head").over(pair)).alias("closed"), F.when(opens, F.lead("upto").over(pair)).alias("match_end"))
    t = t.select("*", _lag("closed").alias("list"), _lead("match_end").alias("next_end"))
    arrow = F.when(kind == "arrow", F.coalesce("head", F.when(F.col("list.what") == "arrow", F.col("list"))))
    block = F.when((kind == "{") & (F.col("k1") == ")") & (F.col("list.what") != "arrow"), F.col("list"))
    t = t.select("*", arrow.alias("arrow"), block.alias("block"))
    name = F.coalesce(F.col("block.name"), F.when(kind == "{", _lag("arrow")["name"]))
    is_class = name.isNull() & (F.col("class_name") != "")
    scope = F.when(kind == "{", _scope(F.coalesce(name, F.col("class_name"), F.lit("")), F.when(is_class, "class").otherwise(""))).when(opens, _scope(F.lit(""), F.lit("")))
    t = t.select("id", "pos", "kind", "upto", "depth", "next", "match_end", "next_end", "arrow", "block", scope.alias("scope"))
    t = t.select("*", F.last(F.when(kind == "semi", F.col("upto")), True).over(_ahead()).alias("semi"))
    function = lambda head, stop, outer: F.struct(F.col(f"{head}.name"), F.col(f"{head}.what"), F.col(f"{head}.doc"), F.col(f"{head}.at").alias("start"), stop.alias("stop"), outer.alias("outer"))
    ends = F.when(F.col("next") == "{", F.col("next_end")).otherwise(F.coalesce("semi", "upto"))
    made = F.when(F.col("block").isNotNull(), function("block", F.col("match_end"), F.col("depth") - 1)).when(F.col("arrow").isNotNull(), function("arrow", ends, F.col("depth")))
    return t.select("id", "pos", "depth", made.alias("made"), "scope")


def _qualified(t: DataFrame) -> DataFrame:
    """``id, name, doc, start, stop, qualified`` of each function: it asks every level around it for the scope that is open there."""
    t = t.where("made is not null or scope is not null")
    no_scope = F.lit(None).cast("struct<name:string,what:string>")
    entry = lambda level, scope, ask: F.struct(level.cast("int").alias("level"), scope.alias("scope"), F.lit(ask).alias("ask"))
    asks = F.when(F.col("made.outer") > 0, F.transform(F.sequence(F.lit(1), F.col("made.outer")), lambda j: entry(j, no_scope, True))).when(F.col("made").isNotNull(), F.array(entry(F.lit(0), no_scope, True)))
    own = F.when(F.col("scope").isNotNull(), F.array(entry(F.col("depth"), F.col("scope"), False)))
    none = F.array().cast("array<struct<level:int,scope:struct<name:string,what:string>,ask:boolean>>")
    e = t.select("id", "pos", "made", F.explode(F.concat(F.coalesce(asks, none), F.coalesce(own, none))).alias("e"))
    around = F.last("e.scope", True).over(Window.partitionBy("id", "e.level").orderBy("pos", F.desc("e.ask")).rowsBetween(Window.unboundedPreceding, -1))
    e = e.select("*", around.alias("around")).where("e.ask")
    chain = e.groupBy("id", "pos").agg(F.first("made").alias("made"), F.array_sort(F.collect_list(F.struct("e.level", "around"))).alias("chain"))
    inner = F.element_at("chain", -1)["around"]["what"]
    names = F.filter(F.transform("chain", lambda c: c["around"]["name"]), lambda n: n != "")
    kept = chain.where((F.col("made.what") != "method") | (inner == "class"))
    return kept.select("id", "made.name", "made.doc", "made.start", "made.stop", F.array_join(F.concat(names, F.array("made.name")), ".").alias("qualified"))


def description(doc: Column) -> Column:
    """The lines of a documentation before its first tag or section."""
    lines = F.transform(F.split(doc, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.array_position(F.transform(lines, lambda x: x.rlike(DESCRIPTION_ENDS)), True)
    return F.regexp_replace(F.array_join(F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines), "\n"), r"^\s+|\s+$", "")


def worthwhile(text: Column, name: Column) -> Column:
    """Whether a description says more than the function's name."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]{2,})"), F.lit(1)), F.lower))
    parts = F.transform(F.regexp_extract_all(name, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), F.lit(1)), F.lower)
    return ~text.rlike(TRIVIAL) & (F.size(F.array_except(words, parts)) >= LEAST_WORDS)


def function_docs(nodes: DataFrame, *, with_code: bool = False) -> DataFrame:
    """``node_id, func_name, description[, code]``: functions whose documentation is worthwhile.

    A source is ``props['source_text']`` in the language ``props['lang']`` (javascript, else read as
    Python).  ``func_name`` is qualified by enclosing classes and functions.  A Python function's
    documentation is its docstring (f-strings and bytes are none), a JavaScript function's,
    method's or arrow constant's the ``/** */`` comment directly before it; the only function of a
    Procedure node without any has the node's ``summary``.  Repeated rows count once; of different
    rows with one id the smallest source, language and summary count.  Null and empty sources have
    no functions; a name defined twice in a source gives a row for each different documentation.
    """
    own = nodes.where(F.col("id").isNotNull() & F.col("props").isNotNull()).select(
        "id", "primitive", "summary", F.col("props")["source_text"].alias("source"), F.coalesce(F.col("props")["lang"], F.lit("python")).alias("lang")
    )
    own = own.where("source != ''").groupBy("id").agg(F.min(F.struct("source", "lang", "primitive", "summary")).alias("n")).select("id", "n.*")
    js = F.col("lang") == "javascript"
    lexed = lambda which, lex: own.where(which).select("id", F.explode(lex("source")).alias("t")).select("id", "t.*")
    found = _qualified(_python_functions(lexed(~js, _lex_python)).union(_javascript_functions(lexed(js, _lex_javascript))))
    found = found.withColumn("n_functions", F.count("*").over(Window.partitionBy("id"))).join(own, "id")
    cut = lambda start, stop: F.substring("source", start + 1, stop - start)
    raw = cut(F.col("doc.at"), F.col("doc.upto"))
    star = F.regexp_replace(F.regexp_replace(raw, r"^/\*+|\*+/$", ""), r"(?m)^[ \t]*\*+", "")
    doc = F.when(js, star).otherwise(_docstring(F.when(~js, raw)))
    alone = (F.col("primitive") == "Procedure") & (F.col("n_functions") == 1) & F.col("doc").isNull()
    found = found.select("id", "name", "qualified", description(F.when(alone, F.col("summary")).otherwise(doc)).alias("description"), *([cut(F.col("start"), F.col("stop")).alias("code")] if with_code else []))
    out = ["id as node_id", "qualified as func_name", "description", *(["code"] if with_code else [])]
    return found.where(worthwhile(F.col("description"), F.col("name"))).selectExpr(*out).distinct()
