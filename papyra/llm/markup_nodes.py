"""A tolerant reader of HTML, Markdown, wiki and LaTeX: everything that could be markup, nested into a tree.

Each form is read in one pass over the text: patterns whose parts exclude their own delimiters, and pairs of marks joined by
a pointer or a stack, so that time grows in proportion to the text, whatever is left open. Nothing recurs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

M = re.M
#: element names of HTML, JATS and wiki pages (fixed values)
NAMES = set("a abbr article aside b big blockquote body br caption center cite code dd del dfn div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd label li link main mark math meta nav nowiki ol p pre q ref references s samp section small span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var wbr xref italic bold sec title monospace inline-formula disp-formula list list-item".split())
#: elements and environments whose content is shown as it stands, is a formula, or isn't shown (fixed values)
CODE_ELEMENTS, MATH_ELEMENTS, DROPPED_ELEMENTS, EMPTY_ELEMENTS = {"pre", "code", "tt", "nowiki", "syntaxhighlight", "source"}, {"math"}, {"script", "style", "ref"}, {"br", "hr", "img", "wbr", "meta", "link"}
CODE_ENVIRONMENTS, MATH_ENVIRONMENTS = {"verbatim", "lstlisting", "minted"}, {"equation", "align", "gather", "eqnarray", "displaymath", "multline", "math"}
#: forms that one pattern finds: kind, pattern, group of the content, opaque or not
SINGLE: list[tuple[str, re.Pattern, int, bool]] = [
    ("code span", re.compile(r"(?<!`)(`)(?!`)([^`\n]+)`(?!`)"), 2, True),
    ("tex group", re.compile(r"\{\\(?:it|bf|em|tt|rm|sc|sl|sf|itshape|bfseries|scshape|ttfamily|small|large|Large)\b[ \t]*([^{}]*)\}"), 1, False),
    ("wiki template", re.compile(r"\{\{[^{}]*\}\}"), 0, True),
    ("wiki link", re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]"), 1, False),
    ("wiki web link", re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]*))?\]"), 1, False),
    ("image", re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n()]*\")?\)"), 1, False),
    ("link", re.compile(r"(?<!\[)\[([^\[\]\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n()]*\")?\)"), 1, False),
    ("reference link", re.compile(r"(?<![\]\[\\])\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]"), 1, False),
    ("definition", re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*$", M), 0, True),
    ("web address", re.compile(r"<((?:https?|ftp)://[^\s<>]+)>"), 1, True),
    ("heading", re.compile(r"^[ ]{0,3}#{1,6}[ \t]+(\S[^\n]*)$", M), 1, False),
    ("underlined", re.compile(r"^([^\s\n][^\n]*)\n(?:={3,}|-{3,})[ \t]*$", M), 1, False),
    ("wiki heading", re.compile(r"^={2,6}([^=\n][^\n]*)$", M), 1, False),
    ("quote", re.compile(r"^[ ]{0,3}>+[ \t]+(\S[^\n]*)$", M), 1, False),
    ("item", re.compile(r"^[ \t]*(?:[-+*]|\*{1,4}|#{1,4}(?=[ \t]*\[))[ \t]+(\S[^\n]*)$", M), 1, False),
    ("tex sign", re.compile(r"\\[%&_#${}]|\\[\"'`^~=.](?:\{\w\}|\w)|(?<=\w)~(?=\\(?:ref|cite|eqref))"), 0, True),
    ("reference", re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"), 0, True),
]
#: pairs of marks: kind, opening, closing, whether the first closing-like mark must close, where the content ends at the latest
PAIRS: list[tuple[str, str, str, str | None, str, bool]] = [
    ("comment", r"<!--", r"-->", None, "text", True),
    ("tex display", r"\$\$(?=[^$])", r"(?<=[^$])\$\$", None, "text", True),
    ("tex display", r"\\\[", r"\\\]", None, "text", True),
    ("tex inline", r"\\\(", r"\\\)", None, "text", True),
    ("tex inline", r"(?<![\\$\w])\$(?=[^\s$])", r"(?<=[^\s\\$])\$(?!\$)", r"\$", "line", True),
    ("tex quotes", r"(?<!`)``(?=[^\s`])", r"''(?!')", None, "paragraph", False),
    ("wiki table", r"^\{\|", r"^\|\}", None, "text", False),
    ("bold", r"\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*", None, "paragraph", False),
    ("bold", r"(?<!\w)__(?=[^\s_])", r"(?<=[^\s_])__(?!\w)", None, "line", False),
    ("struck", r"~~(?=[^\s~])", r"(?<=[^\s~])~~", None, "line", False),
    ("wiki bold", r"'''(?=[^\s'])", r"'''", None, "line", False),
    ("wiki italic", r"(?<!['\w`])''(?=[^\s'])", r"''(?!')", None, "line", False),
    ("italic", r"(?<![\w*\\])\*(?=[^\s*])", r"(?<=[^\s*])\*(?![\w*])", r"\*", "line", False),
    ("italic", r"(?<![\w_\\])_(?=[^\s_])", r"(?<=[^\s_])_(?![\w_])", r"_", "line", False),
]
_PAIRS = [(k, re.compile(o, M), re.compile(c, M), re.compile(a) if a else None, end, opaque) for k, o, c, a, end, opaque in PAIRS]
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\s[^<>]*)?)(/?)>")
_FENCE = re.compile(r"^(```|~~~)([^\n`]*)$", M)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{(\w+\*?)\}")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\[\]\n]*\])*)")
_BRACE = re.compile(r"\\[\\{}]|[{}]")
_RULE_ROW = re.compile(r"\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*")
KINDS = {k: i for i, k in enumerate(dict.fromkeys([*(f[0] for f in SINGLE), *(p[0] for p in PAIRS), "html code", "html math", "html drop", "fence", "tex code", "tex environment", "tex command", "pipe table", "element", "tag"]))}


@dataclass
class Node:
    kind: str
    start: int
    end: int
    inner: tuple[int, int]
    opaque: bool
    name: str = ""
    attributes: str = ""
    args: list[tuple[int, int]] = field(default_factory=list)
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    place: int = 0  # among the parent's children
    depth: int = 0
    odds: float = 0.0
    markup: bool = False
    within: bool = False  # some ancestor is opaque


def _paired(text: str, breaks: dict[str, list[int]]) -> Iterator[Node]:
    for kind, opening, closing, alike, limit, opaque in _PAIRS:
        ends = [(m.start(), m.end()) for m in closing.finditer(text)]
        if not ends:
            continue
        starts = [s for s, _ in ends]
        every = [m.start() for m in alike.finditer(text)] if alike else None
        at = 0
        for m in opening.finditer(text):
            if m.start() < at:
                continue
            k = bisect_left(starts, m.end())
            if k == len(ends):
                break
            s, e = ends[k]
            if s == m.end():  # nothing between the marks
                continue
            stops = breaks[limit]
            b = bisect_left(stops, m.end())
            if b < len(stops) and stops[b] < s:
                continue
            if every is not None and every[bisect_left(every, m.end())] != s:
                continue
            at = e
            yield Node(kind, m.start(), e, (m.end(), s), opaque)


def _elements(text: str) -> Iterator[Node]:
    """Elements with their content, and tags that stay alone. An element shown as it stands hides the tags within."""
    stack: list[re.Match] = []
    open_: dict[str, int] = {}
    for m in _TAG.finditer(text):
        closing, name, attributes, empty = m.group(1), m.group(2).lower(), m.group(3) or "", m.group(4)
        if closing:
            if not open_.get(name):
                yield Node("tag", m.start(), m.end(), (m.end(), m.end()), False, name, attributes)
                continue
            while True:
                o = stack.pop()
                own = o.group(2).lower()
                open_[own] -= 1
                if own == name:
                    break
                yield Node("tag", o.start(), o.end(), (o.end(), o.end()), False, own, o.group(3) or "")
            kind = "html code" if name in CODE_ELEMENTS else "html math" if name in MATH_ELEMENTS else "html drop" if name in DROPPED_ELEMENTS else "element"
            yield Node(kind, o.start(), m.end(), (o.end(), m.start()), kind != "element", name, o.group(3) or "")
        elif empty or attributes.rstrip().endswith("/") or name in EMPTY_ELEMENTS:
            yield Node("tag", m.start(), m.end(), (m.end(), m.end()), False, name, attributes.rstrip(" /"))
        else:
            stack.append(m)
            open_[name] = open_.get(name, 0) + 1
    for o in stack:
        yield Node("tag", o.start(), o.end(), (o.end(), o.end()), False, o.group(2).lower(), o.group(3) or "")


def _fences(text: str) -> Iterator[Node]:
    opened = None
    for m in _FENCE.finditer(text):
        if opened is None:
            opened = m
        elif m.group(1) == opened.group(1) and not m.group(2).strip():
            lo, hi = min(opened.end() + 1, m.start()), max(opened.end(), m.start() - 1)
            yield Node("fence", opened.start(), m.end(), (lo, max(lo, hi)), True)
            opened = None


def _braces(text: str) -> dict[int, int]:
    """Place of each opening brace -> place of its closing one; escaped braces don't count."""
    out, stack = {}, []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            stack.append(m.start())
        elif m.group() == "}" and stack:
            out[stack.pop()] = m.start()
    return out


def _tex(text: str, most_args: int = 4) -> Iterator[Node]:
    if "\\" not in text:
        return
    braces = _braces(text)
    stack: dict[str, list[re.Match]] = {}
    for m in _ENVIRONMENT.finditer(text):
        name = m.group(2)
        if m.group(1) == "begin":
            stack.setdefault(name, []).append(m)
        elif stack.get(name):
            o = stack[name].pop()
            plain, lo = name.rstrip("*"), o.end()
            kind = "tex code" if plain in CODE_ENVIRONMENTS else "tex display" if plain in MATH_ENVIRONMENTS else "tex environment"
            # columns and options of a table or float stand right behind its beginning
            while kind == "tex environment" and lo < m.start() and text[lo] in "{[":
                hi = braces.get(lo, -1) if text[lo] == "{" else text.find("]", lo, lo + 200)
                if not lo < hi < m.start():
                    break
                lo = hi + 1
            yield Node(kind, o.start(), m.end(), (lo, m.start()), kind != "tex environment", name)
    for m in _COMMAND.finditer(text):
        if m.group(1) in ("begin", "end"):
            continue
        at, args = m.end(), []
        while len(args) < most_args and at < len(text) and text[at] == "{" and at in braces:
            args.append((at + 1, braces[at]))
            at = braces[at] + 1
        inner = (args[0][0], args[-1][1]) if args else (at, at)
        yield Node("tex command", m.start(), at, inner, False, m.group(1), args=args)


def _tables(text: str) -> Iterator[Node]:
    """Rows between bars under a row of dashes."""
    if "|" not in text:
        return
    at, rows = 0, []
    for line in text.split("\n"):
        rows.append((at, line))
        at += len(line) + 1
    k = 1
    while k < len(rows):
        head, rule = rows[k - 1][1].strip(), rows[k][1]
        if head.startswith("|") and head.endswith("|") and len(head) > 1 and "-" in rule and _RULE_ROW.fullmatch(rule):
            end = k + 1
            while end < len(rows) and rows[end][1].lstrip().startswith("|"):
                end += 1
            lo, hi = rows[k - 1][0], rows[end - 1][0] + len(rows[end - 1][1])
            yield Node("pipe table", lo, hi, (lo, hi), False)
            k = end
        k += 1


def _singles(text: str) -> Iterator[Node]:
    for kind, pattern, group, opaque in SINGLE:
        for m in pattern.finditer(text):
            lo, hi = m.span(group) if group and m.group(group) is not None else (m.end(), m.end())
            if kind == "heading":
                hi = lo + len(text[lo:hi].rstrip(" \t#"))
            elif kind == "wiki heading":
                body = text[lo:hi].rstrip(" \t")
                shut = len(body) - len(body.rstrip("="))
                if not 2 <= shut <= 6 or not body.strip("= \t"):
                    continue
                hi = lo + len(body) - shut
            yield Node(kind, m.start(), m.end(), (lo, max(lo, hi)), opaque)


def tree(text: str) -> tuple[list[Node], list[Node]]:
    """(roots, all nodes in document order). Of two nodes that cross or take the same place the form listed first stays."""
    breaks = {"text": [], "line": [m.start() for m in re.finditer("\n", text)], "paragraph": [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]}
    nodes = [*_fences(text), *_elements(text), *_paired(text, breaks), *_tex(text), *_tables(text), *_singles(text)]
    ranked = sorted(range(len(nodes)), key=lambda i: (nodes[i].start, -nodes[i].end, i))
    roots: list[Node] = []
    stack: list[Node] = []
    kept = []
    for i in ranked:
        n = nodes[i]
        while stack and stack[-1].end <= n.start:
            stack.pop()
        if stack:
            top = stack[-1]
            lo, hi = top.inner
            if not (lo <= n.start and n.end <= hi) and not (top.opaque and top.start < n.start and n.end <= top.end):
                continue
            n.parent, n.within = top, top.within or top.opaque
        siblings = stack[-1].children if stack else roots
        n.depth, n.place = len(stack), len(siblings)
        siblings.append(n)
        kept.append(n)
        stack.append(n)
    return roots, kept


def lines_around(text: str, n: Node) -> tuple[str, str]:
    """The lines before and after the one a node begins or ends in."""
    a = text.rfind("\n", 0, n.start)
    before = text[text.rfind("\n", 0, a) + 1 : a] if a > 0 else ""
    b = text.find("\n", n.end)
    c = text.find("\n", b + 1)
    after = text[b + 1 : c if c >= 0 else len(text)] if b >= 0 else ""
    return before, after


__all__ = ["KINDS", "NAMES", "Node", "lines_around", "tree"]
