"""Markup residue: HTML, Markdown, wiki and LaTeX chapters to clean text that keeps its structure.

Method: wrapper induction.  Every page becomes a DOM tree: HTML containers nest, and hold blocks
(headings, lists, tables, code, formulas, paragraphs) of items and rows.  Two aggregations count over all pages of a host how many hold a node
of that label and text; nodes that at least half of the pages hold are the host's template.  They
are left out where simple tree matching aligns them with their like in a reference page; varying
slots are content.  The reference pages of a host are two holders of each such node, so that every
template node can be aligned on every page.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.skew import spread_lookup
from barloom.plans.storage import write_table

KINDS = ("html", "markdown", "wiki", "latex")
#: Distinct pages that a template node stands on at least.
LEAST_PAGES = 3
#: The most characters of all reference pages, and the most hosts, that are broadcast (beyond it they are joined).
BROADCAST_CHARS = 32_000_000
BROADCAST_HOSTS = 50_000

#: Element names of HTML.
_TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr "
    "html i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p param picture pre progress q "
    "rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr "
    "track tt u ul var video wbr nowiki ref".split()
)
_BREAKS = frozenset("p br tr table ul ol blockquote hr tbody thead dl dd dt".split())
_CONTAINERS = frozenset("div section article header footer main aside nav figure form details fieldset dialog".split())
#: LaTeX commands without an argument that count by themselves.
_BARE_COMMANDS = frozenset("item maketitle tableofcontents newpage clearpage noindent centering LaTeX TeX ldots dots quad qquad hline par bfseries itshape smallskip medskip bigskip".split())

# Three surrogates stand for a cut-out object while lines are read; no text from a table holds one.
_SURROGATE = re.compile("[\ud800-\udfff]")
_MARK = re.compile("[\ud800-\udbff][\udc00-\udfff]{2}")
_START = re.compile(r"[<\\${}`~\[]")
_FENCE = re.compile(r"(`{3,}|~{3,})([^`\n]*)(?:\n|\Z)")
_SPAN = re.compile(r"(`+)(?!`)((?:(?!\n[ \t]*\n)[\s\S])+?)(?<!`)\1(?!`)")
_COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)")
_RAW_HTML = re.compile(r"<(pre|code|script|style|textarea|nowiki)\b[^<>]*>([\s\S]*?)</\1\s*>", re.I)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)((?:\s+(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)/?>")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_ENV = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math)\}([\s\S]*?)\\end\{\1\}")
_PAREN_MATH = re.compile(r"\\\(([\s\S]+?)\\\)|\\\[([\s\S]+?)\\\]")
_DOLLARS = re.compile(r"\$\$([\s\S]+?)\$\$")
_DOLLAR = re.compile(r"\$(?![\s$])((?:[^$\\\n]|\\.)+?)(?<![\s\\])\$(?!\d)")
_WIKI_TABLE = re.compile(r"\{\|([^\n]*)\n([\s\S]*?)^[ \t]*\|\}", re.M)
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])*)(\{)?")
_LINK_WIKI = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_LINK_LABEL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)[ \t]+([^\]\n]+)\]")

_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$")
_LIST = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_QUOTE = re.compile(r" {0,3}>[ \t]?(.*)$")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]*\S")
_BLOCKY = re.compile(r"[ \t]*(?:[#>=+*|\[\\-]|\d{1,9}[.)][ \t])")

_EMPHASIS = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])((?:[^*\n]|\n(?!\n))+?)(?<![\s\\*])\1(?![*\w])|(?<![\w\\_])(_{1,3})(?![\s_])([^_\n]+?)(?<![\s\\_])\3(?![\w_])|(?<![~\\])~~(?![\s~])([^~\n]+?)(?<!\s)~~(?!~)")
_LINK_MD = re.compile(r"(!?)\[([^\[\]\n]*)\]\(\s*<?[^()\s]*(?:\([^()\s]*\))?[^()\s]*>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?\s*\)")
_LINK_REF = re.compile(r"(!?)\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_BOLD_WIKI = re.compile(r"(?<!')'''(?!')(.+?)(?<!')'''(?!')")
_ITALIC_WIKI = re.compile(r"(?<!')''(?!')(.+?)(?<!')''(?!')")
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_INLINE = re.compile(r"[*_~\[&']")


class Page:
    """One item while it is read: its kinds, cut-out objects and blocks ``(label, text, children)``."""

    __slots__ = ("kinds", "objects", "blocks", "stack")

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.objects: list[tuple[str, str]] = []
        self.blocks: list[tuple] = []
        self.stack: list[tuple[str, list]] = [("page", self.blocks)]  # open containers
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.isascii():
            text = _SURROGATE.sub("\ufffd", text)
        self._read(self._cut(text))

    def _object(self, kind: str, text: str) -> str:
        i = len(self.objects)
        self.objects.append((kind, text))
        return chr(0xD800 + (i >> 20)) + chr(0xDC00 + (i >> 10 & 1023)) + chr(0xDC00 + (i & 1023))

    def _at(self, mark: str) -> tuple[str, str]:
        """The object that the first three characters stand for."""
        return self.objects[(ord(mark[0]) - 0xD800 << 20) + (ord(mark[1]) - 0xDC00 << 10) + ord(mark[2]) - 0xDC00]

    # objects whose content is not read as markup, and tags and commands

    def _cut(self, text: str) -> str:
        out, at, kinds = [], 0, self.kinds
        pairs: dict[int, int] | None = None  # of single braces, made when the first command asks
        ends: dict[int, str] = {}  # closing braces of commands, and what stands for them
        for m in _START.finditer(text):
            pos = m.start()
            if pos < at:
                continue
            c, got, end = text[pos], None, pos
            if c == "}":
                if pos in ends:
                    got, end = ends.pop(pos), pos + 1
            elif c == "`" or c == "~":
                line = text.rfind("\n", 0, pos) + 1
                f = _FENCE.match(text, pos) if text[line:pos].strip(" \t>") == "" else None
                if f:
                    close = re.compile(r"^[ \t>]*" + re.escape(f[1][0]) + "{" + str(len(f[1])) + r",}[ \t]*$", re.M).search(text, f.end())
                    body = text[f.end() : close.start() if close else len(text)]
                    end = close.end() if close else len(text)
                    kinds.add("markdown")
                    got = "\n" + self._object("code", body.rstrip("\n")) + "\n"
                elif c == "`":
                    s = _SPAN.match(text, pos)
                    if s:
                        kinds.add("markdown")
                        got, end = self._object("span", s[2].strip()), s.end()
            elif c == "<":
                x = _COMMENT.match(text, pos)
                if x:
                    kinds.add("html")
                    got, end = "", x.end()
                else:
                    x = _RAW_HTML.match(text, pos)
                    if x:
                        tag, body = x[1].lower(), x[2]
                        kinds.add("wiki" if tag == "nowiki" else "html")
                        end = x.end()
                        if tag in ("script", "style"):
                            got = ""
                        else:
                            block = tag == "pre" or tag == "textarea"
                            got = self._object("code" if block else "span", html.unescape(re.sub(r"</?(?:code|span|b|i)\b[^<>]*>", "", body)).strip("\n"))
                            got = f"\n{got}\n" if block else got
                    else:
                        x = _TAG.match(text, pos)
                        if x and x[1].lower() in _TAGS:
                            kinds.add("html")
                            got, end = self._tag(x), x.end()
                        elif (x := _AUTOLINK.match(text, pos)) is not None:
                            kinds.add("markdown")
                            got, end = x[1], x.end()
            elif c == "\\":
                if pairs is None and "{" in text:
                    pairs = _brace_pairs(text)
                got, end = self._latex(text, pos, pairs or {}, ends)
            elif c == "$":
                x = _DOLLARS.match(text, pos)
                if x:
                    kinds.add("latex")
                    got, end = self._object("display", x[1].strip()), x.end()
                elif x := _DOLLAR.match(text, pos):
                    kinds.add("latex")
                    got, end = self._object("math", x[1].strip()), x.end()
            elif c == "{":
                if text.startswith("{{", pos):
                    end = self._braces(text, pos)
                    if end:
                        kinds.add("wiki")
                        got = ""
                elif x := _WIKI_TABLE.match(text, pos):
                    kinds.add("wiki")
                    got, end = "\n" + self._object("table", x[2]) + "\n", x.end()
            elif x := _LINK_WIKI.match(text, pos):
                kinds.add("wiki")
                got, end = x[1].split("|")[-1], x.end()
            elif x := _LINK_LABEL.match(text, pos):
                kinds.add("wiki")
                got, end = x[2], x.end()
            if got is not None:
                out.append(text[at:pos])
                out.append(got)
                at = end
        out.append(text[at:])
        return "".join(out)

    @staticmethod
    def _braces(text: str, pos: int) -> int:
        """Behind the template that begins at ``pos``; 0 if it has no name or no end."""
        if not re.compile(r"\{\{\s*[#:\w]").match(text, pos):
            return 0
        depth, i = 0, pos
        for m in re.compile(r"\{\{|\}\}").finditer(text, pos):
            depth += 1 if m[0] == "{{" else -1
            i = m.end()
            if depth == 0:
                return i
        return 0

    def _tag(self, m: re.Match) -> str:
        tag = m[1].lower()
        closing = m[0][1] == "/"
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            return "\n" if closing else "\n\n" + self._object("heading", tag[1])
        if tag == "li":
            return "" if closing else "\n" + self._object("item", "-")
        if tag in ("td", "th"):
            return "" if closing else self._object("cell", "")
        if tag in _CONTAINERS:
            return "\n" + self._object("close" if closing else "open", tag) + "\n"
        return "\n" if tag in _BREAKS else ""

    def _latex(self, text: str, pos: int, pairs: dict[int, int], ends: dict[int, str]) -> tuple[str | None, int]:
        x = _ENV.match(text, pos)
        if x:
            self.kinds.add("latex")
            code = x[1].startswith(("verb", "lst", "mint"))
            return "\n" + self._object("code" if code else "display", x[2].strip("\n") if code else x[2].strip()) + "\n", x.end()
        x = _PAREN_MATH.match(text, pos)
        if x:
            self.kinds.add("latex")
            return self._object("math" if x[1] else "display", (x[1] or x[2]).strip()), x.end()
        x = _COMMAND.match(text, pos)
        if not x or not (x[3] or x[1] in _BARE_COMMANDS):
            return None, pos
        before = text[pos - 1 : pos]
        if before and (before.isalnum() or before in "\\:") and not x[3]:
            return None, pos
        self.kinds.add("latex")
        name, end = x[1], x.end()
        if name in ("begin", "end"):
            close = text.find("}", end)
            return "\n", close + 1 if close >= 0 else end
        if name == "item":
            return "\n" + self._object("item", "-"), x.end(1)
        if name in ("cite", "label", "ref", "citep", "citet", "pageref", "usepackage", "documentclass", "bibliographystyle", "input"):
            close = text.find("}", end)
            return "", close + 1 if close >= 0 else end
        if not x[3]:
            return "", end
        close = pairs.get(end - 1)
        if close is None:
            return "", end
        levels = {"part": "1", "chapter": "1", "section": "2", "subsection": "3", "subsubsection": "4", "paragraph": "5"}
        ends[close] = "\n\n" if name in levels else ""
        return "\n\n" + self._object("heading", levels[name]) if name in levels else "", end

    # lines to blocks

    def _read(self, text: str) -> None:
        kinds, add = self.kinds, self._add
        lines = text.split("\n")
        paragraph: list[str] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            i += 1
            if not line or line.isspace():
                add("p", paragraph)
                paragraph = []
                continue
            if not _BLOCKY.match(line):
                head = line.lstrip()
                if "\ud800" <= head[0] <= "\udbff" and self._at(head)[0] in _LINE_OBJECTS:
                    add("p", paragraph)
                    paragraph = []
                    self._object_line(line.strip())
                else:
                    paragraph.append(line)
                continue
            m = _QUOTE.match(line)
            if m:
                kinds.add("markdown")
                line = m[1]
                if not _BLOCKY.match(line):
                    paragraph.append(line)
                    continue
            if m := _ATX.match(line):
                if m[2]:
                    kinds.add("markdown")
                    add("p", paragraph)
                    paragraph = []
                    self._put((f"h{len(m[1])}", self._inline(m[2]), ()))
                    continue
            elif m := _WIKI_HEAD.match(line):
                kinds.add("wiki")
                add("p", paragraph)
                paragraph = []
                self._put((f"h{len(m[1])}", self._inline(m[2]), ()))
                continue
            elif m := _LIST.match(line):
                kinds.add("markdown")
                add("p", paragraph)
                paragraph = []
                mark = "-" if m[2] in "-*+" else m[2].replace(")", ".")
                self._list_item(mark, len(m[1].expandtabs(4)) // 2, m[3])
                continue
            elif paragraph and (m := _SETEXT.match(line)):
                kinds.add("markdown")
                title = paragraph.pop()
                add("p", paragraph)
                paragraph = []
                self._put(("h1" if m[1][0] == "=" else "h2", self._inline(title.strip()), ()))
                continue
            elif _DEFINITION.match(line):
                kinds.add("markdown")
                continue
            if "|" in line and i < n and "|" in lines[i] and "-" in lines[i] and _DELIMITER.match(lines[i]) and _cells(line) == _cells(lines[i]):
                kinds.add("markdown")
                add("p", paragraph)
                paragraph = []
                rows = [line]
                i += 1
                while i < n and "|" in lines[i]:
                    rows.append(lines[i])
                    i += 1
                self._put(("table", "", tuple(("tr", " | ".join(self._inline(c.strip()) for c in _split_row(r)), ()) for r in rows)))
                continue
            if re.match(r" {0,3}(?:-[ \t]*){3,}$", line):  # a rule
                add("p", paragraph)
                paragraph = []
                continue
            paragraph.append(line)
        add("p", paragraph)

    def _add(self, label: str, lines: list[str]) -> None:
        if lines:
            text = self._inline("\n".join(lines)).strip()
            if text:
                self._put((label, text, ()))

    def _put(self, block: tuple) -> None:
        self.stack[-1][1].append(block)

    def _list_item(self, mark: str, depth: int, text: str) -> None:
        node = ("li", self._inline(text.strip()), (mark, depth))
        here = self.stack[-1][1]
        if here and here[-1][0] == "list":
            here[-1][2].append(node)
        else:
            here.append(("list", "", [node]))

    def _object_line(self, line: str) -> None:
        kind, text = self._at(line)
        rest = line[3:]
        if kind == "open":
            inner: list = []
            self._put((text, "", inner))
            self.stack.append((text, inner))
            return
        if kind == "close":
            names = [x for x, _ in self.stack]
            if text in names:  # what is still open inside ends here too
                del self.stack[len(names) - 1 - names[::-1].index(text) :]
            return
        if kind == "heading":
            title = self._inline(rest).strip()
            if title:
                self._put((f"h{text}", title, ()))
            return
        if kind == "item":
            self._list_item("-", 0, rest)
            return
        if kind == "cell":
            cells = [self._inline(c).strip() for c in self._by_cell(rest)]
            self._put(("table", "", (("tr", " | ".join(cells), ()),)))
            return
        if kind == "table":
            rows = []
            for part in re.split(r"(?m)^[ \t]*\|-.*$", text):
                cells = []
                for x in part.split("\n"):
                    x = x.strip()
                    if x.startswith("|+"):
                        cells.append(x[2:])
                    elif x[:1] in ("|", "!"):
                        cells += re.split(r"\|\||!!", x[1:])
                if cells:
                    rows.append(("tr", " | ".join(self._inline(c.strip()) for c in cells), ()))
            self._put(("table", "", tuple(rows)))
        else:
            self._put((kind, text, ()))
        if rest.strip():
            self._add("p", [rest.strip()])

    def _by_cell(self, text: str) -> list[str]:
        out, at = [], 0
        for m in _MARK.finditer(text):
            if self._at(m[0])[0] == "cell":
                out.append(text[at : m.start()])
                at = m.end()
        return [*out, text[at:]]

    def _inline(self, text: str) -> str:
        kinds = self.kinds
        if _INLINE.search(text):
            if "[" in text:
                text, n = _LINK_MD.subn(r"\2", text)
                text, k = _LINK_REF.subn(r"\2", text)
                if n or k:
                    kinds.add("markdown")
            if "''" in text:
                text, n = _BOLD_WIKI.subn(r"\1", text)
                if n:
                    kinds.add("wiki")
                    text = _ITALIC_WIKI.sub(r"\1", text)
            if "*" in text or "_" in text or "~~" in text:
                text, n = _EMPHASIS.subn(lambda m: m[2] or m[4] or m[5], text)
                if n:
                    kinds.add("markdown")
                    text = _EMPHASIS.sub(lambda m: m[2] or m[4] or m[5], text)
            if "&" in text:
                text = _REFERENCE.sub(self._reference, text)
        if not text.isascii():
            text = _MARK.sub(self._restore, text)
        return text

    def _reference(self, m: re.Match) -> str:
        if m[3]:
            if m[3] + ";" not in html5:
                return m[0]
        elif not 0 < (int(m[1]) if m[1] else int(m[2], 16)) < 0x110000:
            return m[0]
        self.kinds.add("html")
        return html.unescape(m[0])

    def _restore(self, m: re.Match) -> str:
        kind, text = self._at(m[0])
        return {"math": f"${text}$", "display": f"$${text}$$", "span": f"`{text}`", "code": f"\n```\n{text}\n```\n", "cell": " | ", "item": "\n- "}.get(kind, "")


_LINE_OBJECTS = frozenset(("heading", "item", "code", "table", "display", "cell", "open", "close"))


def _brace_pairs(text: str) -> dict[int, int]:
    """The closing brace of each opening one that has one."""
    pairs, stack = {}, []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _split_row(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") else line
    return re.split(r"(?<!\\)\|", line)


def _cells(line: str) -> int:
    return len(_split_row(line))


def render(blocks: list[tuple]) -> str:
    """Clean text: headings with #, list items with their mark, code fenced, formulas in dollars, cells with a bar."""
    out = []
    for label, text, more in blocks:
        if label in _CONTAINERS:
            inner = render(more)
            if inner:
                out.append(inner)
        elif label[0] == "h" and len(label) == 2:
            out.append("#" * int(label[1]) + " " + text)
        elif label == "list":
            out.append("\n".join("  " * li[2][1] + li[2][0] + " " + li[1] for li in more))
        elif label == "table":
            out.append("\n".join(tr[1] for tr in more))
        elif label == "code":
            out.append(f"```\n{text}\n```")
        elif label == "display":
            out.append(f"$${text}$$")
        else:
            out.append(text)
    return "\n\n".join(out)


# template


def _tree(blocks) -> tuple:
    """The page's DOM: nodes (label, text, children)."""
    node = lambda b: (b[0], b[1], tuple(map(node, b[2])) if b[0] in _CONTAINERS else tuple((c[0], c[1], ()) for c in b[2]))
    return ("page", "", tuple(map(node, blocks)))


def _size(tree: tuple) -> int:
    return 1 + sum(map(_size, tree[2]))


def simple_tree_matching(a: tuple, b: tuple) -> tuple[int, list[tuple[tuple, tuple]]]:
    """Size of the largest order-preserving match of two trees of equal root label, with its pairs of node paths.

    Equal texts weigh more than shape, so that a constant node is paired with its like.  Children
    that are equal and occur once on either side are paired first where their order agrees; only
    the stretches between such anchors are matched by dynamic programming.
    """
    if a[0] != b[0]:
        return 0, []
    if a == b:
        return _size(a) + 3 * _texts(a), list(_same(a))
    total, found = 1, []
    for i0, i1, j0, j1 in _stretches(a[2], b[2]):
        if (i1, j1) == (i0 + 1, j0 + 1):
            w, pairs = simple_tree_matching(a[2][i0], b[2][j0])
            cells = [(i0, j0, w + 3 * (w > 0 and a[2][i0][1] == b[2][j0][1] != ""), pairs)] if w else []
        else:
            cells = _align(a[2], b[2], i0, i1, j0, j1)
        for i, j, w, pairs in cells:
            total += w
            found.append(((i,), (j,)))
            found += [((i, *p), (j, *q)) for p, q in pairs]
    return total, found


def _texts(tree: tuple) -> int:
    return sum((c[1] != "") + _texts(c) for c in tree[2])


def _same(tree: tuple):
    for i, c in enumerate(tree[2]):
        yield (i,), (i,)
        for p, q in _same(c):
            yield (i, *p), (i, *q)


def _stretches(a: tuple, b: tuple):
    """Ranges (i0, i1, j0, j1) of children to be matched with each other; an anchor is a range of one."""
    n, m = len(a), len(b)
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        yield lead, lead + 1, lead, lead + 1
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    count_a, count_b = Counter(a[lead : n - tail]), Counter(b[lead : m - tail])
    place = {y: j for j, y in enumerate(b[lead : m - tail], lead) if count_b[y] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a[lead : n - tail], lead) if count_a[x] == 1 and x in place]
    # the longest run of pairs that rises on both sides
    tops, last, back = [], [], {}
    for i, j in pairs:
        k = bisect_left(tops, j)
        back[i, j] = last[k - 1] if k else None
        tops[k:k + 1], last[k:k + 1] = [j], [(i, j)]
    chain, at = [], last[-1] if last else None
    while at:
        chain.append(at)
        at = back[at]
    i0, j0 = lead, lead
    for i, j in [*reversed(chain), (n - tail, m - tail)]:
        if i > i0 and j > j0:
            yield i0, i, j0, j
        if i < n - tail:
            yield i, i + 1, j, j + 1
        i0, j0 = i + 1, j + 1
    for k in range(tail, 0, -1):
        yield n - k, n - k + 1, m - k, m - k + 1


def _align(a: tuple, b: tuple, i0: int, i1: int, j0: int, j1: int) -> list[tuple]:
    """The heaviest order-preserving pairs (i, j, weight, pairs below) of two stretches of children."""
    n, m = i1 - i0, j1 - j0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        x, row, above = a[i0 + i - 1], best[i], best[i - 1]
        for j in range(1, m + 1):
            y, w = b[j0 + j - 1], 0
            if x[0] == y[0]:
                w, pairs = simple_tree_matching(x, y)
                w += 3 * (x[1] == y[1] != "")
                sub[i, j] = (w, pairs)
            row[j] = max(above[j], row[j - 1], above[j - 1] + w)
    out, i, j = [], n, m
    while i and j:
        w, pairs = sub.get((i, j), (0, []))
        if w and best[i][j] == best[i - 1][j - 1] + w:
            out.append((i0 + i - 1, j0 + j - 1, w, pairs))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _node(tree: tuple, path: tuple) -> tuple:
    for p in path:
        tree = tree[2][p]
    return tree


def texts_of(tree: tuple) -> set[tuple[str, str]]:
    return {x for b in tree[2] for x in ({(b[0], b[1])} if b[1] else set()) | texts_of(b)}


def _slots_out(tree: tuple, constant: set[tuple[str, str]], path: tuple = ()) -> tuple[tuple, dict]:
    """The tree without the nodes that neither are constant nor hold a constant one: those are varying slots.  With the paths of what is kept."""
    kept, where = [], {}
    for i, c in enumerate(tree[2]):
        sub, below = _slots_out(c, constant, (*path, i))
        if sub[2] or c[:2] in constant:
            k = len(kept)
            kept.append(sub)
            where[(k,)] = (*path, i)
            where.update({(k, *q): w for q, w in below.items()})
    return (tree[0], tree[1] if tree[:2] in constant else "", tuple(kept)), where


def node_key(label: str, text: str) -> int:
    """64 bits of a node's label and text."""
    return int.from_bytes(hashlib.blake2b(f"{label}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def template_nodes(blocks: list[tuple], references: list[tuple], constant: set[tuple[str, str]]) -> set[tuple]:
    """Paths of the nodes that are ``constant`` (label, text) on the host and stand at the aligned place of a reference."""
    tree = _tree(blocks)
    mine = texts_of(tree) & constant
    out: set[tuple] = set()
    if not mine:
        return out
    small, where = _slots_out(tree, mine)
    for ref, texts in references:
        if ref == tree or mine.isdisjoint(texts):  # a page doesn't vouch for itself
            continue
        other, _ = _slots_out(ref, mine)
        for p, q in simple_tree_matching(small, other)[1]:
            x, y = _node(small, p), _node(other, q)
            if x[1] and x[:2] == y[:2]:
                out.add(where[p])
    return out


def strip_template(blocks: list[tuple], constant: set[tuple], at: tuple = ()) -> list[tuple]:
    if not constant:
        return blocks
    out = []
    for i, b in enumerate(blocks):
        path = (*at, i)
        if path in constant:
            continue
        if b[0] in _CONTAINERS:
            out.append((b[0], b[1], strip_template(b[2], constant, path)))
        elif b[2] and b[0] in ("list", "table"):
            kept = [c for j, c in enumerate(b[2]) if (*path, j) not in constant]
            if kept:
                out.append((b[0], b[1], kept))
        else:
            out.append(b)
    return out


def _templates(pages: DataFrame) -> DataFrame:
    """``__host, __nodes, __refs`` of each host with a template: keys of its nodes, and two holders of each of them.

    Pages of equal tree count as one page.  A host has at most twice as many template nodes as a page has nodes on average.
    """

    def read(batches):
        for b in batches:
            trees = [_tree(Page(t).blocks) for t in b.column(1).to_pylist()]
            page = [node_key("page", repr(t)) for t in trees]
            nodes = [sorted({node_key(*x) for x in texts_of(t)}) for t in trees]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(page, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], ["__host", "digest", "page", "nodes"])

    digest = F.xxhash64("__text")
    read_ = pages.select("__host", "__text", digest.alias("digest")).mapInArrow(read, "__host string, digest bigint, page bigint, nodes array<bigint>")
    one = write_table(read_.groupBy("__host", "page").agg(F.min("digest").alias("digest"), F.first("nodes").alias("nodes")), "pages")
    total = one.groupBy("__host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    on = F.struct("page", "digest")
    counts = one.select("__host", on.alias("on"), F.explode("nodes").alias("node")).groupBy("__host", "node").agg(F.count("*").alias("c"), F.min("on").alias("lo"), F.max("on").alias("hi"))
    often = spread_lookup(counts.where(F.col("c") >= LEAST_PAGES), total, ["__host"], F.col("node")).where(F.col("c") * 2 >= F.col("n"))
    found = often.groupBy("__host").agg(F.collect_set("node").alias("__nodes"), F.array_union(F.collect_set("lo.digest"), F.collect_set("hi.digest")).alias("holders"))
    found = write_table(found, "constant")
    wanted = found.select("__host", F.explode("holders").alias("digest")).distinct()
    texts = spread_lookup(pages.withColumn("digest", digest), wanted, ["__host", "digest"], F.col("digest"), "left_semi").select("__host", "digest", "__text").distinct()
    return found.join(texts.groupBy("__host").agg(F.collect_list("__text").alias("__refs")), "__host").select("__host", "__nodes", "__refs")


_SCHEMA = "markups array<string>, n_template int, clean string"


def clean_markup(items: DataFrame, keys: list[str], host: str, text: str, *, with_text: bool = True) -> DataFrame:
    """``keys, markups, n_template, clean``: the markup kinds of each item and its clean text.

    ``markups`` holds html, markdown, wiki and latex, each if the item's own text has a construct of
    it; what code and formulas show doesn't count.  ``n_template`` counts nodes left out because at
    least half of the pages of the item's ``host`` hold them (null hosts have no template).  Null and empty
    texts give no kinds and a null or empty clean text; repeated rows repeat.
    """
    src = items.select(*keys, F.col(host).cast("string").alias("__host"), F.col(text).cast("string").alias("__text"))
    hosts = write_table(_templates(src.where("__host is not null and __text != ''").select("__host", "__text")), "templates")
    spark = items.sparkSession
    chars = F.aggregate("__refs", F.lit(0), lambda a, t: a + F.length(t)) + 8 * F.size("__nodes")
    held = hosts.select(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    if held.chars <= BROADCAST_CHARS and held.n <= BROADCAST_HOSTS:
        shared = spark.sparkContext.broadcast({r["__host"]: (r["__refs"], r["__nodes"]) for r in hosts.collect()})
    else:
        shared = None
        src = spread_lookup(src, hosts, ["__host"], F.xxhash64(*keys), "left").select(*keys, "__host", "__text", "__refs", "__nodes")

    def run(batches):
        known: dict[str, tuple[list[tuple], set]] = {}

        def references(h, given):
            if h not in known:
                if shared is None and len(known) > 200:
                    known.clear()
                texts, nodes = shared.value.get(h, ([], [])) if shared is not None else given
                trees = [_tree(Page(t).blocks) for t in texts or []]
                refs, nodes = [(t, texts_of(t)) for t in trees], set(nodes or [])
                known[h] = refs, {x for _, held in refs for x in held if node_key(*x) in nodes}
            return known[h]

        for batch in batches:
            k = len(keys)
            hosts, texts = batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()
            given = list(zip(batch.column(k + 2).to_pylist(), batch.column(k + 3).to_pylist())) if shared is None else [None] * len(hosts)
            kinds, counts, clean = [], [], []
            for h, t, g in zip(hosts, texts, given):
                if not t:
                    kinds.append([])
                    counts.append(0)
                    clean.append(t)
                    continue
                page = Page(t)
                constant = template_nodes(page.blocks, *references(h, g)) if h is not None else set()
                kinds.append(sorted(page.kinds))
                counts.append(len(constant))
                clean.append(render(strip_template(page.blocks, constant)) if with_text else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.int32()), pa.array(clean, pa.string())], [*keys, "markups", "n_template", "clean"])

    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(run, f"{schema}, {_SCHEMA}")
