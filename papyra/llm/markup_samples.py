"""Texts made by grammars of the four markup languages, among plain texts full of look-alikes: what the trees learn from.

Every piece of a sample carries whether it is markup, so that markup and look-alikes stand side by side in one text."""

from __future__ import annotations

import html.entities
import random

#: attributes by which elements are made (fixed values)
ATTRIBUTES = ["class", "id", "href", "src", "style", "title", "alt", "lang", "rel", "width", "align", "data-x"]
INLINE, BLOCK = ["b", "i", "em", "strong", "u", "sub", "sup", "span", "mark", "small", "q", "cite", "var", "kbd", "s", "abbr", "jats:italic", "font"], ["p", "div", "section", "blockquote", "h1", "h2", "h3", "h4", "center", "jats:p", "jats:title", "figure", "article"]
ENTITIES = sorted(k[:-1] for k in html.entities.html5 if k.endswith(";") and k[:-1].isalnum() and len(k) < 9)
TEXT_COMMANDS, SECTIONS, CITATIONS = ["textbf", "textit", "emph", "texttt", "textsc", "underline", "textrm", "mbox", "footnotesize"], ["section", "subsection", "subsubsection", "paragraph", "chapter", "title"], ["cite", "citep", "citet", "citealp", "ref", "eqref", "pageref", "label", "footnote", "autoref"]
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "rho", "sigma", "phi", "psi", "omega", "Gamma", "Delta", "Sigma", "Omega"]
OPERATORS = ["\\times", "\\cdot", "\\pm", "\\leq", "\\geq", "\\sim", "\\approx", "\\neq", "\\to", "+", "-", "=", "<", ">"]
COMMON = "the of and for with in a is were per to we that this on by from as not are be was at or it".split()


class Maker:
    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4))) + self.r.choice(["", "", "n", "s", "r"])

    def words(self, lo: int = 1, hi: int = 4) -> str:
        return " ".join(self.r.choice(COMMON) if self.r.random() < 0.35 else self.word() for _ in range(self.r.randint(lo, hi)))

    def phrase(self, lo: int = 1, hi: int = 4) -> str:
        """What marks are put around: words, often with numbers and stops among them."""
        out = []
        for _ in range(self.r.randint(lo, hi)):
            x = self.r.random()
            out.append(self.number() if x < 0.15 else self.r.choice(COMMON) if x < 0.45 else self.word() + "-" + self.word() if x < 0.5 else self.word())
            out[-1] += self.r.choice([".", ",", ";"]) if self.r.random() < 0.08 else ""
        return " ".join(out)

    def title(self) -> str:
        return " ".join(self.word().capitalize() for _ in range(self.r.randint(1, 4)))

    def sentence(self) -> str:
        return self.words(4, 14).capitalize() + self.r.choice(".....?!")

    def number(self) -> str:
        return self.r.choice([str(self.r.randint(0, 9)), str(self.r.randint(10, 9999)), f"{self.r.randint(0, 99)}.{self.r.randint(0, 99)}", f"{self.r.randint(1, 99)},{self.r.randint(100, 999)}"])

    def letter(self) -> str:
        return self.r.choice("abcdefghijkmnpqrstuvxyzABCKLMNPRTXY")

    def identifier(self) -> str:
        return self.r.choice(["_", "_", "_", "-", "."]).join(self.word() for _ in range(self.r.randint(2, 3)))

    def one_of(self, *makers):
        return self.r.choice(makers)()

    # ---- markup ----
    def attributes(self) -> str:
        out = ""
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            q = self.r.choice(['"', '"', "'", ""])
            out += f" {self.r.choice(ATTRIBUTES)}={q}{self.r.choice([self.word(), self.number(), 'https://' + self.word() + '.org/' + self.word()])}{q}"
        return out

    def html(self, deep: int = 0) -> str:
        inner = (lambda: self.html(deep + 1)) if deep < 2 and self.r.random() < 0.25 else (lambda: self.phrase(1, 5))
        name = self.r.choice(INLINE)
        kind = self.r.randrange(12)
        if kind < 4:
            name = name.upper() if self.r.random() < 0.1 else name
            return f"<{name}{self.attributes()}>{inner()}</{name}>"
        if kind == 4:
            name = self.r.choice(BLOCK)
            return f"<{name}{self.attributes()}>{self.sentence()}</{name}>"
        if kind == 5:
            return f"<a{self.attributes()} href=\"http://{self.word()}.net/{self.word()}\">{inner()}</a>"
        if kind == 6:
            name = self.r.choice(["ul", "ol"])
            return f"<{name}>" + "".join(f"<li>{self.words()}</li>" for _ in range(self.r.randint(1, 4))) + f"</{name}>"
        if kind == 7:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.one_of(self.number, self.words)}</td>" for _ in range(2)) + "</tr>" for _ in range(self.r.randint(1, 3))) + "</table>"
        if kind == 8:
            return self.r.choice([f"&{self.r.choice(ENTITIES)};", f"&{self.r.choice(['amp', 'lt', 'gt', 'quot', 'nbsp', 'ndash', 'mdash', 'eacute', 'rsquo'])};", f"&#{self.r.randint(33, 9000)};", f"&#x{self.r.randint(33, 9000):x};"])
        if kind == 9:
            return self.r.choice([f"<{self.r.choice(['br', 'hr', 'img', 'wbr'])}{self.attributes()}{self.r.choice(['', '/', ' /'])}>", f"<{name}>{self.words()}", f"{self.words()}</{self.r.choice(INLINE + BLOCK)}>"])
        if kind == 10:
            return f"<!--{self.r.choice([' ', ''])}{self.words()} {self.number()}{self.r.choice([' ', ''])}-->"
        return self.r.choice([f"<code>{self.identifier()}</code>", f"<pre><code>{self.identifier()} = {self.word()}({self.number()})</code></pre>", f"<tt>{self.word()}</tt>", f"<sub>{self.number()}</sub>", f"<sup>{self.number()}</sup>"])

    def item_lines(self, mark: str) -> str:
        return "\n" + "\n".join(f"{mark} {self.words(1, 7)}" for _ in range(self.r.choice([1, 2, 2, 3, 4]))) + "\n"

    def markdown(self) -> str:
        kind = self.r.randrange(17)
        body = self.phrase(1, 4)
        if kind < 3:
            m = self.r.choice(["**", "**", "*", "__", "_", "~~"])
            return f"{m}{body}{m}"
        if kind == 3:
            return f"\n{'#' * self.r.randint(1, 6)} {self.r.choice([self.title(), body])}\n"
        if kind == 4:
            raw = self.r.choice([self.html, self.markdown, self.latex])().replace("\n", " ").replace("`", "")
            return f"`{self.one_of(self.identifier, self.word, lambda: self.word() + '=' + self.number(), lambda: self.word() + '(' + self.letter() + ')', lambda: self.words(1, 2) + ' ' + raw)}`"
        if kind == 5:
            f = self.r.choice(["```", "```", "~~~"])
            return f"\n{f}{self.r.choice(['', 'py', 'sql', 'sh'])}\n{self.word()} = {self.identifier()}\n{self.word()}({self.number()})\n{f}\n"
        if kind == 6:
            return f"[{body}]({self.r.choice(['https://', 'http://', '/', '../'])}{self.word()}.{self.word()}/{self.word()})"
        if kind == 7:
            return f"![{self.r.choice([body, ''])}]({self.word()}/{self.word()}.{self.r.choice(['png', 'jpg'])})"
        if kind == 8:
            return self.r.choice([f"[{body}][{self.r.choice(['', self.word(), '1'])}]", f"\n[{self.word()}]: https://{self.word()}.org/{self.word()}\n", f"<https://{self.word()}.org/{self.word()}>"])
        if kind == 9:
            return f"\n> {self.sentence()}\n"
        if kind == 10:
            cells = self.r.randint(2, 4)
            row = lambda: "| " + " | ".join(self.one_of(self.word, self.number) for _ in range(cells)) + " |\n"
            return "\n" + row() + "|" + "---|" * cells + "\n" + row() + row()
        if kind < 13:
            return self.item_lines(self.r.choice("-*+"))
        if kind == 13:
            t = self.title()
            return f"\n{t}\n{self.r.choice('=-') * max(3, len(t) + self.r.randint(-2, 4))}\n"
        m, w = self.r.choice(["**", "__", "*", "_"]), self.r.choice([self.word(), self.r.choice(COMMON), self.word().capitalize()])
        return f"{m}{w}{self.r.choice(['', '', '', '.', ','])}{m}"

    def wiki(self) -> str:
        kind = self.r.randrange(10)
        if kind == 0:
            return f"[[{self.r.choice([self.title(), self.phrase()])}]]"
        if kind == 1:
            return f"[[{self.title()}{self.r.choice(['', ':' + self.title(), '#' + self.word()])}|{self.phrase()}]]"
        if kind < 4:
            named = lambda: self.r.choice([self.word(), f"{self.word()}={self.r.choice([self.number(), self.word()])}"])
            return self.r.choice(["", "\n"]) + "{{" + "|".join([self.words(1, 2), *(named() for _ in range(self.r.randint(0, 3)))]) + "}}"
        if kind == 4:
            return f"'''{self.phrase()}'''"
        if kind == 5:
            return f"''{self.phrase()}''"
        if kind == 6:
            m = "=" * self.r.randint(2, 4)
            return f"\n{m} {self.title()} {m}\n"
        if kind == 7:
            return "\n{| class=\"wikitable\"\n" + "".join(f"|-\n| {self.word()} || {self.number()}\n" for _ in range(self.r.randint(1, 3))) + "|}\n"
        if kind == 8:
            return self.r.choice([f"<ref{self.r.choice(['', f' name={self.word()}'])}>{self.words()} {self.number()}</ref>", f"<ref name=\"{self.word()}\" />", f"[https://{self.word()}.org/{self.word()} {self.words()}]", f"<math>{self.formula()}</math>", f"<nowiki>{self.word()}</nowiki>"])
        return f"\n{self.r.choice(['*', '**', '#'])} [[{self.title()}]] {self.words()}\n"

    def term(self) -> str:
        base = self.r.choice([self.letter(), self.letter(), f"\\{self.r.choice(GREEK)}", str(self.r.randint(0, 99)), "\\frac{%s}{%s}" % (self.letter(), self.letter()), "\\sum_{%s}" % self.letter(), f"{self.letter()}({self.letter()})", "\\log " + self.letter(), f"\\mathcal{{{self.letter()}}}"])
        return base + self.r.choice(["", "", f"_{self.letter()}", f"_{{{self.letter()}}}", f"^{self.r.randint(2, 9)}", f"^{{{self.letter()}}}"])

    def formula(self) -> str:
        return self.r.choice([self.r.choice(OPERATORS[:9]), self.term(), self.term(), *[f" {self.r.choice(OPERATORS)} ".join(self.term() for _ in range(self.r.randint(2, 3)))] * 3])

    def latex(self) -> str:
        kind = self.r.randrange(16)
        body = self.phrase(1, 4)
        if kind < 2:
            inner = f"\\{self.r.choice(TEXT_COMMANDS)}{{{self.word()}}}" if self.r.random() < 0.2 else body
            return f"\\{self.r.choice(TEXT_COMMANDS)}{{{inner}}}"
        if kind == 2:
            return f"{self.r.choice(['', chr(10)])}\\{self.r.choice(SECTIONS)}{{{self.title()}}}" + self.r.choice(["", f"\\label{{{self.word()}}}", "\n"])
        if kind < 5:
            option = self.r.choice(["", "", f"[{self.r.choice(['p.', 'see', 'pp.~', 'Ch.'])}{self.r.choice(['', '~', ' '])}{self.r.choice([self.number(), ''])}]"])
            return f"{self.r.choice(['', self.word() + '~', ' '])}\\{self.r.choice(CITATIONS)}{option}{{{self.r.choice(['', 'fig:', 'tab:', 'eq:'])}{self.word()}{self.r.choice(['', str(self.r.randint(1, 2024))])}}}"
        if kind < 9:
            near = self.r.choice(["", "", self.number()])
            return f"${self.formula()}$" + near
        if kind == 9:
            return self.r.choice([f"$${self.formula()}$$", f"\\[ {self.formula()} \\]", f"\\( {self.formula()} \\)"])
        if kind == 10:
            e = self.r.choice(["equation", "align", "equation*", "displaymath"])
            return f"\n\\begin{{{e}}}\n{self.formula()}\n\\end{{{e}}}\n"
        if kind == 11:
            e = self.r.choice(["itemize", "enumerate"])
            return f"\n\\begin{{{e}}}\n" + "".join(f"\\item {self.words()}\n" for _ in range(self.r.randint(1, 3))) + f"\\end{{{e}}}\n"
        if kind == 12:
            return self.r.choice([f"\n\\begin{{verbatim}}\n{self.identifier()} {self.number()}\n\\end{{verbatim}}\n", f"\n\\begin{{tabular}}{{{'lcr'[: self.r.randint(1, 3)]}}}\n{self.word()} & {self.number()} \\\\\n{self.word()} & {self.number()}\n\\end{{tabular}}\n", f"\n\\begin{{abstract}}\n{self.sentence()}\n\\end{{abstract}}\n"])
        if kind == 13:
            return self.r.choice([f"{{\\{self.r.choice(['it', 'bf', 'em', 'tt', 'sc'])} {body}}}", f"{self.number()}\\%", f"{self.word()} \\& {self.word()}", f"{self.word()}\\_{self.word()}", "\\" + self.r.choice("\"'`^~") + self.r.choice("aeoun") + self.word(), f"\\$ {self.number()}"])
        if kind == 14:
            return f"``{self.phrase(1, 9)}''"
        return self.r.choice([f"\\{self.r.choice(GREEK)}", "\\ldots", f"\\frac{{{self.number()}}}{{{self.number()}}}", "\\LaTeX{}"])

    # ---- what looks like it ----
    def comparison(self) -> str:
        side = lambda: self.r.choice([self.letter(), self.word(), self.number(), f"{self.number()} {self.r.choice(['kg', 'ms', 'GB', '%', 'cm', 's'])}", f"{self.letter()}{self.r.randint(0, 9)}"])
        gap = lambda: self.r.choice(["", " "])
        one = lambda sign: (lambda g: f"{side()}{g}{sign}{g}{side()}")(gap())
        lone = lambda: f"{self.r.choice('<>')}{self.r.choice(['', ' '])}{self.number()}"
        return self.r.choice([one("<"), one(">"), f"{one('<')} {self.words(1, 3)} {one('>')}", f"{self.words(1, 2)} {lone()} {self.words(1, 3)} {lone()}", f"{side()} <= {side()}", f"{side()} >> {side()}", f"{self.letter()} -> {self.letter()}", f"{self.letter()} < {self.letter()} < {self.letter()}", lone()])

    def arithmetic(self) -> str:
        times = self.r.choice([" * ", "*", " x "])
        v = lambda: self.one_of(self.number, self.letter)
        return self.r.choice([times.join(v() for _ in range(self.r.randint(2, 4))), f"{self.letter()} = {v()}{times}{v()} + {v()}", f"{self.letter()}^{self.r.randint(2, 9)} + {self.letter()}_{self.r.randint(0, 9)}", f"f({self.letter()}) = {v()}*{self.letter()} - {v()}*{v()}", f"{v()}/{v()} = {v()}", f"|{self.letter()}| + |{self.letter()}|", f"P({self.letter()} | {self.letter()})", f"{v()} * {v()} {self.word()}, {v()} * {v()} {self.word()}"])

    def price(self) -> str:
        p = lambda: f"{self.r.choice(['', '', 'US', 'A', 'CA'])}${self.number()}{self.r.choice(['', '', 'k', 'M', ' million'])}"
        return self.r.choice([p(), f"{p()} {self.words(1, 4)} {p()}", f"{p()}, {p()} and {p()}", f"{p()}-{p()}", f"{p()}/{self.word()} or {p()}", f"({p()}) {self.words(1, 2)} ({p()})"])

    def named(self) -> str:
        w = self.word
        return self.r.choice([self.identifier(), f"{w()}_{w()}_{self.number()} {self.words(1, 2)} {w()}_{w()}", f"__{w()}__.{w()}", f"_{w()}_{w()}", f"*args, **{w()}", f"C:\\{w()}\\{w()}", f"\\d+\\s*{w()}", f"{w()}@{w()}.org", f"<{w()}@{w()}.org>", f"{w().capitalize()}<{w().capitalize()}>", f"{w().capitalize()}<{self.letter().upper()}>", f"vector<{self.r.choice(['int', 'float', 'T'])}>", f"\n#include <{w()}>\n", f"#{w()}", f"C#, F# and {w()}", f"${w().upper()} and ${w().upper()}", f"{w()}.{w()}[{self.r.randint(0, 9)}]", f"{{{w()}, {w()}}}", f"{{'{w()}': {self.number()}}}", f"{w()}::{w()}", f"@{w()}", f"~/{w()}/{w()}", f"/{w()}/{w()}_{w()}"])

    def cited(self) -> str:
        w = self.word
        n = self.r.randint(1, 3000)
        return self.r.choice([f"[{n}]", f"[{n}, {n + 2}]", f"[{n}] {self.words(1, 3)} [{n + 1}]", f"[{w()} {w()}]", f"[{w()}] (see {w()})", f"[{n}] ({w()} {self.number()})", f"#{n}", f"{w()} #{n} {w()}", f"No. {n}", f"({n})", f"{w().capitalize()} ({n})", f"[sic]", f"[...]", f"*{n}", f"§ {n}", f"[{n}]({n})" if self.r.random() < 0.05 else f"[{n}] [{n + 5}]"])

    def listed(self) -> str:
        rule = self.r.choice("-=~_") * self.r.randint(3, 6)
        long = " ".join(self.sentence() for _ in range(self.r.randint(1, 2)))
        note = f"\n{self.r.choice(['*', '**', '***'])} {self.r.choice(['p', self.words(1, 2), self.letter()])} {self.r.choice(['<', '=', 'at', '<='])} {self.number()}{self.r.choice(['', '%'])}{self.r.choice(['', '.'])}\n"
        return self.r.choice([f"\n• {self.words()}\n• {self.words()}\n", f"\n{self.r.randint(1, 9)}. {self.words()}\n", f"\n{self.r.randint(1, 9)}.{self.r.randint(1, 9)} {self.title()}\n{self.sentence()}", f"\n({self.letter()}) {self.words()}\n", f"\n— {self.words()}\n", f"\n– {self.words()}\n", f"\n{long}\n{rule}\n", f"\n{long}\n\n{rule}\n", note, note])

    def signs(self) -> str:
        w = self.word
        return self.r.choice([f"{self.letter().upper()}&{self.letter().upper()}", f"{w()} & {w()}; {w()}", f"Q&A; {w()}", f"AT&T; {w()}", f"~{self.number()} {w()} and ~{self.number()}", f"{w()}'s and {w()}s' {w()}", f"{self.number()}' {self.number()}''", f"{self.number()}--{self.number()}", f"{w()} -- {w()}", f"{w()} | {w()} | {w()}", f"-{self.number()} +{self.number()}", f"{w()}* {w()} and {w()}*", f"{w()} (*) {w()} (**)", f"'{w()}' ''", f"{w()} = {w()} == {w()}", f"{self.number()}%", f"{w()}; {w()}: {w()}", f"<{self.number()}>", f"<{w()}-{self.number()}>"])

    def look_alike(self) -> str:
        return self.one_of(self.comparison, self.comparison, self.arithmetic, self.arithmetic, self.price, self.price, self.named, self.cited, self.listed, self.signs)

    def markup(self) -> str:
        return self.one_of(self.html, self.markdown, self.wiki, self.latex)


def sample(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text, and where its pieces of markup stand."""
    m = Maker(rng)
    text, spans = "", []
    share = rng.choice([0.0, 0.5, 1.0])
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
        text += m.words(0, 12) + rng.choice([" ", " ", " ", " ", " ", "", ", ", ". "])
        true = rng.random() < share
        piece = m.markup() if true else m.look_alike()
        if true:
            spans.append((len(text), len(text) + len(piece)))
        text += piece + rng.choice([" ", " ", " ", ", ", ". ", ""])
    return text + m.words(0, 8) + ".", spans
