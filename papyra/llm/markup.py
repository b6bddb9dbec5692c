"""Clean text out of HTML, Markdown, wiki and LaTeX: a tree of possible markup, boosted trees over its nodes.

A tolerant reader finds everything that could be markup and nests it into a tree. Boosted trees judge each node by its kind,
name and attribute tokens, depth, the density of its subtree, its siblings and its surroundings; they are trained on texts
made by grammars, in which markup and its look-alikes are known. Decoding takes the best joint choice in which nothing within
code or a formula is markup. What is markup is then rewritten: headings, list items, code and formulas stay recognisable.
"""

from __future__ import annotations

import html
import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.boosting import BoostedTrees
from papyra.llm.markup_nodes import KINDS, NAMES, Node, lines_around, tree
from papyra.llm.markup_samples import sample
from papyra.operators.latest import latest_rows, without_superseded

BREAKS = {"p", "div", "br", "tr", "table", "ul", "ol", "section", "blockquote", "hr", "title", "sec", "dl", "dt", "dd", "article"}
#: TeX commands whose argument is not text, that head a part, or that only set the page (fixed values)
SILENT = {"cite", "citep", "citet", "citealp", "ref", "eqref", "pageref", "autoref", "label", "footnote", "includegraphics", "bibliography", "index", "vspace", "hspace", "usepackage", "documentclass", "input"}
HEADINGS = {"section", "subsection", "subsubsection", "paragraph", "chapter", "title", "part"}
LAYOUT = {"noindent", "centering", "maketitle", "newline", "newpage", "clearpage", "hline", "toprule", "midrule", "bottomrule", "par", "smallskip", "medskip", "bigskip", "item"}
#: TeX commands that stand for a sign (fixed values); Greek letters go by their Unicode names
SIGNS = {"ldots": "…", "dots": "…", "times": "×", "cdot": "·", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "sim": "∼", "to": "→", "rightarrow": "→", "infty": "∞", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "dag": "†", "S": "§", "copyright": "©", "textendash": "–", "textemdash": "—"}
POSSIBLE = r"[<>&$\\*_#`\[{|~]|''|==|^\s*[-+]\s|^---"
_POSSIBLE = re.compile(POSSIBLE, re.M)
_MATH = re.compile(r"[\\^_=+<>|{}]|\b[a-zA-Z]\b")
_COMMON = re.compile(r"\b(?:the|and|of|for|per|to|in|is|was|were|are|with)\b", re.I)
_ATTRIBUTES = re.compile(r"^(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*$")
_ATTRIBUTE_NAME = re.compile(r"(?<=\s)[\w:-]+(?=\s*=)")
_ITEM_LINE = re.compile(r"\s*(?:[-+*]|#{1,4}|\*{1,4})\s")
#: attribute names are hashed to so many features
ATTRIBUTE_TOKENS = 8
#: longest word of _COMMON, and one sign more
COMMON_REACH = 5
#: contents up to so many characters are counted where they stand, longer ones by the text's index: the counts are the same
DIRECT = 4000


@cache
def sign_of(name: str) -> str | None:
    """The sign a TeX command stands for."""
    if name in SIGNS:
        return SIGNS[name]
    plain = name.removeprefix("var")
    case = "CAPITAL" if plain[:1].isupper() else "SMALL"
    plain = {"lambda": "LAMDA"}.get(plain.lower(), plain.upper())
    try:
        return unicodedata.lookup(f"GREEK {case} LETTER {plain}")
    except KeyError:
        return None


def _few(x: float, *cuts: float) -> int:
    return sum(x > c for c in cuts)


def _name_class(n: Node) -> int:
    if n.kind in ("element", "tag", "html code", "html math", "html drop"):
        return int(n.name in NAMES or n.name.partition(":")[2] in NAMES)
    if n.kind == "tex command":
        known = 5 if n.name in SILENT or n.name in HEADINGS else 4 if n.name in LAYOUT or sign_of(n.name) else 3
        return known if n.args or known > 3 else 2
    return 6


def _counts(body: str) -> tuple[int, int, int, bool, bool, bool]:
    """Words, signs of formulas, common words, and whether there is a line end, a digit, nothing but digits."""
    return len(body.split()), len(_MATH.findall(body)), len(_COMMON.findall(body)), "\n" in body, bool(re.search(r"\d", body)), body.isdigit()


class _Index:
    """``_counts`` of any part of a text from places that are listed once, so that nested contents don't cost their length."""

    def __init__(self, text: str):
        self.text = text
        self.words, self.math, self.common, self.lines, self.digits = (array("q", (m.start() for m in p.finditer(text))) for p in (re.compile(r"\S+"), _MATH, _COMMON, re.compile("\n"), re.compile(r"\d")))
        self.numeric = array("q", (i for i, c in enumerate(text) if c.isdigit()))

    def counts(self, a: int, b: int) -> tuple[int, int, int, bool, bool, bool]:
        t = self.text
        if a >= b:
            return _counts("")
        inside = lambda places, lo, hi: bisect_left(places, hi) - bisect_left(places, lo)
        words = 1 - t[a].isspace() + inside(self.words, a + 1, b)
        # a part's ends bound words: what begins at its first sign or ends with its last one is read as it stands there
        if b - a <= 2 * COMMON_REACH:
            math, common = _counts(t[a:b])[1:3]
        else:
            last = t[b - COMMON_REACH : b]
            math = bool(_MATH.match(t[a : a + 2])) + inside(self.math, a + 1, b - 1) + bool(_MATH.match(last, COMMON_REACH - 1))
            common = bool(_COMMON.match(t[a : a + COMMON_REACH])) + inside(self.common, a + 1, b - COMMON_REACH + 1) + sum(1 for _ in _COMMON.finditer(last, 1))
        return words, math, common, inside(self.lines, a, b) > 0, inside(self.digits, a, b) > 0, inside(self.numeric, a, b) == b - a


def features(text: str, roots: list[Node], nodes: list[Node]) -> np.ndarray:
    """One row of small whole numbers for each node, told by all of its content."""
    rows = []
    index = None
    per_kind: dict[str, int] = {}
    for n in nodes:
        per_kind[n.kind] = per_kind.get(n.kind, 0) + 1
    own: dict[int, dict[str, int]] = {}
    for n in nodes:
        if n.place == 0:  # the first child counts the kinds of its parent's children
            count: dict[str, int] = {}
            for c in n.parent.children if n.parent else roots:
                count[c.kind] = count.get(c.kind, 0) + 1
            own[id(n.parent)] = count
    for n in nodes:
        a, b = n.inner
        if b - a > DIRECT:
            index = index or _Index(text)
            words, math, common, lines, digits, numeric = index.counts(a, b)
        else:
            words, math, common, lines, digits, numeric = _counts(text[a:b])
        long, edges = b - a, text[a : min(b, a + 1)] + text[max(a, b - 1) : b]
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        below = sum(c.end - c.start for c in n.children)
        siblings = n.parent.children if n.parent else roots
        left = siblings[n.place - 1] if n.place else None
        right = siblings[n.place + 1] if n.place + 1 < len(siblings) else None
        count = own[id(n.parent)]
        ratio = items = 0
        if n.kind == "underlined":
            ratio = 1 + _few((n.end - b) / max(1, long), 0.4, 0.7, 1.4, 2)
        elif n.kind in ("item", "quote"):
            up, down = lines_around(text, n)
            items = 1 + bool(_ITEM_LINE.match(up)) + bool(_ITEM_LINE.match(down)) + 3 * (not up.strip())
        elif n.kind in ("tag", "element"):
            up = text[n.start : n.start + 2]
            items = int(up.startswith("</")) + 2 * (n.end - n.start > 60)
        tokens = {zlib.crc32(x.lower().encode()) % ATTRIBUTE_TOKENS for x in _ATTRIBUTE_NAME.findall(n.attributes)} if n.attributes else ()
        rows.append((
            KINDS[n.kind], _name_class(n), _few(len(n.attributes), 0, 8, 30), int(bool(_ATTRIBUTES.match(n.attributes))), int("=" in n.attributes),
            min(n.depth, 4), _few(len(n.children), 0, 1, 4), _few(below / max(1, n.end - n.start), 0, 0.3, 0.7),
            _few(per_kind[n.kind], 1, 2, 5), _few(len(nodes), 1, 3, 8), _few(len(per_kind), 1, 2, 4),
            _few(len(siblings), 1, 2, 5), _few(count[n.kind], 1, 2, 4), _few(count[n.kind] / len(siblings), 0.3, 0.6, 0.99), _few(n.place, 0, 1, 3),
            1 + KINDS[left.kind] if left else 0, 1 + KINDS[right.kind] if right else 0, _few(n.start - left.end, 0, 3, 20, 80) if left else 5,
            _few(words, 0, 1, 3, 8, 30), _few(long, 0, 2, 10, 40, 200), ratio, items,
            int(before.isalnum()), int(after.isalnum()), int(n.start == 0 or before == "\n"), int(edges[:1].isdigit()), int(edges[:1].isspace() or edges[-1:].isspace()), int(edges[:1].isupper()),
            _few(math / max(1, words), 0, 0.3, 1), _few(common / max(1, words), 0, 0.1, 0.3), int(lines), int(n.within), int(digits), int(numeric), int(len(n.args) > 1), int(text[n.start + 1 : n.start + 3].lstrip("/")[:1].isupper()),
            *(int(k in tokens) for k in range(ATTRIBUTE_TOKENS)),
        ))
    return np.array(rows, np.int64).reshape(len(rows), 36 + ATTRIBUTE_TOKENS)


@cache
def trained(samples: int = 12_000, seed: int = 3) -> BoostedTrees:
    """Boosted trees fitted to generated texts; the same for the same arguments."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(samples):
        text, spans = sample(rng)
        roots, nodes = tree(text)
        if not nodes:
            continue
        x.append(features(text, roots, nodes))
        starts = [a for a, _ in spans]
        real: dict[int, bool] = {}
        for n in nodes:
            k = bisect_right(starts, n.start) - 1
            shut = n.parent is not None and (id(n.parent) not in real or (n.parent.opaque and real[id(n.parent)]))
            if shut:  # within code or a formula that is markup nothing is
                y.append(False)
            else:
                real[id(n)] = k >= 0 and n.start < spans[k][1]
                y.append(real[id(n)])
    return BoostedTrees(depth=5).fit(np.concatenate(x), np.array(y, float), trees=80)


def decode(nodes: list[Node]) -> None:
    """Set ``markup`` to the most likely joint choice: below an opaque node that is markup, nothing is. Parents come first."""
    gain: dict[int, float] = {}
    for n in reversed(nodes):
        literal = sum(gain[id(c)] for c in n.children)
        # log odds against "not markup": taking an opaque node excludes its children's gains
        n.markup = n.odds > (literal if n.opaque else 0)
        gain[id(n)] = max(n.odds, literal) if n.opaque else max(0.0, n.odds) + literal
    shut: set[int] = set()
    for n in nodes:
        if n.parent and (id(n.parent) in shut or (n.parent.opaque and n.parent.markup)):
            n.markup = False
            shut.add(id(n))


class _Writer:
    """Text of nodes with their markup rewritten, children before parents."""

    def __init__(self, text: str):
        self.text, self.done = text, {}
        self.count = dict.fromkeys(("pieces", "headings", "items", "code", "formulas"), 0)

    def part(self, a: int, b: int, nodes: list[Node]) -> str:
        out, at = [], a
        for n in nodes:
            if n.start < at or n.end > b:
                continue
            out += [self.text[at : n.start], self.done.get(id(n), "")]
            at = n.end
        return "".join([*out, self.text[at:b]])

    def heading(self, t: str) -> str:
        self.count["headings"] += 1
        return f"\n§ {t.strip()}\n" if t.strip() else ""

    def item(self, t: str) -> str:
        self.count["items"] += 1
        return f"• {t.strip()}"

    def node(self, n: Node) -> str:
        text, (lo, hi) = self.text, n.inner
        if not n.markup:
            return text[n.start : lo] + self.part(lo, hi, n.children) + text[hi : n.end] if n.children else text[n.start : n.end]
        self.count["pieces"] += 1
        kind, name = n.kind, n.name.rpartition(":")[2]
        if kind in ("html code", "fence", "tex code", "code span"):
            self.count["code"] += 1
            body = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", text[lo:hi])) if kind == "html code" else text[lo:hi]
            return "\n" + "\n".join("    " + x for x in body.strip("\n").split("\n")) + "\n" if "\n" in text[n.start : n.end] or kind in ("fence", "tex code") else body
        if kind in ("html math", "tex display", "tex inline"):
            self.count["formulas"] += 1
            return f"⟦{text[lo:hi].strip()}⟧"
        if kind in ("comment", "html drop", "wiki template", "definition"):
            return ""
        if kind == "web address":
            return text[lo:hi]
        if kind == "reference":
            return html.unescape(text[n.start : n.end])
        if kind == "tex sign":
            return _tex_sign(text[n.start : n.end])
        if kind == "tex command":
            return self.command(n)
        inside = self.part(lo, hi, n.children)
        if kind in ("heading", "underlined", "wiki heading"):
            return self.heading(inside)
        if kind == "item":
            return self.item(inside)
        if kind == "pipe table":
            rows = [r for r in inside.split("\n") if not re.fullmatch(r"[|:\- \t]+", r)]
            return "\n".join("\t".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows)
        if kind == "wiki table":
            cells = [x.lstrip("|!").strip() for x in inside.split("\n")[1:] if x.strip() and not x.startswith(("|-", "|+"))]
            return "\n".join("\t".join(c.strip() for c in re.split(r"\|\||!!", x)) for x in cells)
        if kind == "tex environment":
            return self.environment(name.rstrip("*"), inside)
        if kind in ("element", "tag"):
            return self.element(name, inside)
        return inside

    def command(self, n: Node) -> str:
        args = [self.part(a, b, n.children) for a, b in n.args]
        if n.name in HEADINGS:
            return self.heading(args[0] if args else "")
        if n.name in SILENT:
            return ""
        sign = sign_of(n.name)
        if sign and len(args) < 2:
            return sign + (args[0] if args else "")
        if n.name == "frac" and len(args) == 2:
            return f"{args[0]}/{args[1]}"
        if n.name == "item":
            return self.text[n.start : n.end]
        if not args:
            return "" if n.name in LAYOUT else self.text[n.start : n.end]
        return args[1] if n.name == "href" and len(args) > 1 else args[0]

    def environment(self, name: str, inside: str) -> str:
        if name in ("itemize", "enumerate", "description"):
            return "\n".join(self.item(x) for x in re.split(r"\\item\b(?:\[[^\[\]]*\])?", inside) if x.strip())
        if name in ("tabular", "tabularx", "array", "longtable"):
            rows = [r for r in re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", inside).split("\\\\") if r.strip()]
            return "\n" + "\n".join("\t".join(c.strip() for c in re.split(r"(?<!\\)&", r)) for r in rows) + "\n"
        return inside

    def element(self, name: str, inside: str) -> str:
        if re.fullmatch(r"h[1-6]", name):
            return self.heading(inside) if inside else "\n"
        if name in ("li", "list-item"):
            return "\n" + self.item(inside) + "\n" if inside else "\n• "
        if name in ("td", "th"):
            return inside.strip() + "\t"
        return f"\n{inside}\n" if name in BREAKS else inside


def _tex_sign(t: str) -> str:
    marks = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇"}
    return " " if t == "~" else t[1:] if t[1] in "%&_#${}" else unicodedata.normalize("NFC", re.sub(r"[{}]", "", t[2:]) + marks[t[1]])


def clean(text: str, model: BoostedTrees) -> tuple[str, dict[str, int]]:
    """Clean text and counts of ``pieces`` of markup, ``headings``, ``items``, ``code`` and ``formulas``."""
    w = _Writer(text)
    if not _POSSIBLE.search(text):
        return text, w.count
    roots, nodes = tree(text)
    if not nodes:
        return text, w.count
    for n, z in zip(nodes, model.log_odds(features(text, roots, nodes))):
        n.odds = float(z)
    decode(nodes)
    if not any(n.markup for n in nodes):
        return text, w.count
    for n in reversed(nodes):
        w.done[id(n)] = w.node(n)
        for c in n.children:
            w.done.pop(id(c), None)
    out = w.part(0, len(text), roots)
    if w.count["pieces"]:
        out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip()
    return out, w.count


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows: list[list] = [[] for _ in range(10)]
            for tab, i, f, ver, text in zip(*(c.to_pylist() for c in b.columns)):
                out, n = clean(text, model)
                if n["pieces"]:
                    for col, v in zip(rows, (tab, i, f, ver, out, n["pieces"], n["headings"], n["items"], n["code"], n["formulas"])):
                        col.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.string(), *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["tab", "rec_id", "field", "ver", "clean_text", "pieces", "headings", "items", "code", "formulas"])

    return run


def clean_markup(fields: DataFrame, samples: int = 12_000) -> DataFrame:
    """``(tab, rec_id, field, clean_text, pieces, headings, items, code, formulas)`` of every field that holds markup.

    ``fields``: tab, rec_id, field, text, ver. Headings become lines that start with "§ ", list items with "• "; code keeps its
    text (blocks indented), formulas their TeX between ⟦ and ⟧, table cells are split by tabs; links keep their label; comments,
    templates, citations and notes go. The model is fitted to ``samples`` generated texts. Null or blank texts, null ids and
    fields without markup give no rows; of several rows of a field the largest ``ver`` counts, so that a newer one without
    markup leaves none.
    """
    model = fields.sparkSession.sparkContext.broadcast(trained(samples))
    every = fields.select("tab", "rec_id", "field", F.col("ver").cast("timestamp_ntz").alias("ver"), "text")
    keys = ["tab", "rec_id", "field"]
    rows = without_superseded(every.where(F.col("text").rlike("(?m)" + POSSIBLE)), every, keys, "ver").select(*every.columns)
    found = rows.mapInArrow(_run(model), "tab string, rec_id string, field string, ver timestamp_ntz, clean_text string, pieces int, headings int, items int, code int, formulas int")
    return latest_rows(found, keys, "ver").drop("ver")
