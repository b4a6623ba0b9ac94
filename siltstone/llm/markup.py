"""Clean text and structure from HTML, Markdown, wiki and LaTeX records.

A record is read in the dialect its own marks show. Elements that keep their
structure are headings, list items, code blocks and formulas; everything a
reader isn't shown as content (front matter, comments, page heads, scripts,
styles, notes, info boxes, navigation) is dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEADING, ITEM, CODE, FORMULA = "heading", "list_item", "code_block", "formula"
ELEMENTS = (HEADING, ITEM, CODE, FORMULA)
Element = tuple[str, str]

_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


# --- formulas within running text -------------------------------------------------------------

_MATH = re.compile(
    r"(?<!\\)\$\$(?P<dd>.+?)(?<!\\)\$\$"
    r"|(?<!\\)\\\[(?P<br>.+?)\\\]"
    r"|(?<!\\)\\\((?P<pa>.+?)\\\)"
    r"|(?<![\\$\w])\$(?P<d>(?![\s$])(?:[^$\n\\]|\\.|\n(?!\s*\n))+?)(?<!\s)\$(?![\d$])",
    re.S,
)


def _formulas(text: str, out: list[Element]) -> str:
    """Report the formulas of a text and leave their sources in it."""

    def one(m: re.Match) -> str:
        src = squeeze(m[m.lastgroup])
        out.append((FORMULA, src))
        return src

    return _MATH.sub(one, text)


# --- HTML ---------------------------------------------------------------------------------------

_HIDDEN = frozenset("head script style nav header footer aside template noscript textarea iframe svg select".split())
_BOX_CLASS = re.compile(r"\b(?:infobox|admonition|footnotes?|sidebar|navbox)\b", re.I)
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li pre table tr td th blockquote dl dt dd section article br hr body html".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


_AROUND = frozenset("body main article section".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element | None] = []
        self.open: list[tuple[str, int, list[str]]] = []  # kind, place in out, text
        self.hidden: list[str] = []
        self.around: dict[str, int] = {}  # elements open outside hidden ones
        self.text: list[str] = []
        self.code = 0
        self.pre = 0

    def _flush(self) -> None:
        raw = "".join(self.text)
        self.text = []
        if not raw:
            return
        found: list[Element] = []
        plain = _formulas(raw, found) if not self.code else raw
        self.out.extend(found)
        if self.open:
            self.open[-1][2].append(plain)

    def _begin(self, kind: str) -> None:
        self._flush()
        self.out.append(None)
        self.open.append((kind, len(self.out) - 1, []))

    def _end(self, kind: str) -> None:
        self._flush()
        while self.open:
            k, at, text = self.open.pop()
            self.out[at] = (k, squeeze("".join(text)))
            if k == kind:
                break

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden == ["head"] and (tag == "body" or tag in _BLOCKS and tag != "html"):
            self.hidden.clear()  # the end tag of a page head may be left out
        if self.hidden:
            if tag not in _VOID and tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        if tag in _AROUND:
            self.around[tag] = self.around.get(tag, 0) + 1
        classes = next((v or "" for k, v in attrs if k == "class"), "")
        if tag in _HIDDEN or (tag in ("div", "table", "section") and _BOX_CLASS.search(classes)):
            self._flush()
            self.hidden.append(tag)
            return
        if self.pre and tag not in ("pre",):
            if tag == "br":
                self.text.append("\n")
            return
        if tag in ("code", "tt", "kbd", "samp"):
            self._flush()
            self.code += 1
        elif tag == "pre":
            self._begin(CODE)
            self.pre += 1
            self.code += 1
        elif tag == "li":
            if any(k == ITEM for k, _, _ in self.open) and self.open[-1][0] == ITEM:
                self._end(ITEM)  # the end tag was left out
            self._begin(ITEM)
        elif tag in ("ul", "ol"):
            self._flush()
            self.open.append(("list", len(self.out), []))
            self.out.append(None)
        elif re.fullmatch(r"h[1-6]", tag):
            self._begin(HEADING)
        elif tag in _BLOCKS:
            self._flush()
            if self.open:
                self.open[-1][2].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            elif tag in _AROUND and self.around.get(tag, 0) > 0:
                self.hidden.clear()  # what encloses a hidden element ends it
            if self.hidden or tag not in _AROUND:
                return
        if tag in _AROUND:
            self.around[tag] = max(0, self.around.get(tag, 0) - 1)
        kinds = [k for k, _, _ in self.open]
        if tag == "pre" and self.pre:
            self._end(CODE)
            self.pre -= 1
            self.code -= 1
        elif self.pre:
            return
        elif tag in ("code", "tt", "kbd", "samp") and self.code:
            self._flush()
            self.code -= 1
        elif tag == "li" and ITEM in kinds:
            last = len(kinds) - 1 - kinds[::-1].index(ITEM)
            if "list" not in kinds[last:]:
                self._end(ITEM)
        elif tag in ("ul", "ol") and "list" in kinds:
            self._end("list")
        elif re.fullmatch(r"h[1-6]", tag) and HEADING in kinds:
            self._end(HEADING)
        elif tag in _BLOCKS:
            self._flush()
            if self.open:
                self.open[-1][2].append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def from_html(text: str) -> list[Element]:
    page = _Page()
    page.feed(text)
    page.close()
    page._end("")
    return [e for e in page.out if e and e[0] in ELEMENTS]


# --- Markdown -----------------------------------------------------------------------------------

_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$")
_FRONT = re.compile(r"\A---[ \t]*\n(?:.*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
_CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[[^\[\]]*\])")
_AUTO = re.compile(r"<((?:https?|mailto|ftp):[^<>\s]+)>")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_STRONG = re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|(?<![\w])__(?=\S)(.+?)(?<=\S)__(?!\w)", re.S)
_EMPHASIS = re.compile(r"\*(?=[^\s*])(.+?)(?<=[^\s*])\*|(?<!\w)_(?=[^\s_])(.+?)(?<=[^\s_])_(?!\w)", re.S)


def _markdown_inline(text: str, out: list[Element]) -> str:
    """Plain text of a run of Markdown, its formulas reported."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    def span(m: re.Match) -> str:
        body = m[2].replace("\n", " ")
        return keep(body[1:-1] if body[:1] == body[-1:] == " " and body.strip() else body)

    def math(m: re.Match) -> str:
        src = squeeze(m[m.lastgroup])
        out.append((FORMULA, src))
        return keep(src)

    text = _CODE_SPAN.sub(span, text)
    text = _MATH.sub(math, text)
    text = _ESCAPED.sub(lambda m: keep(m[1]), text)
    text = _AUTO.sub(lambda m: keep(m[1]), text)
    text = _TAG.sub(lambda m: " " if m[0][1:3].lower() == "br" else "", text)
    while (new := _LINK.sub(lambda m: m[1], text)) != text:  # the innermost first, each round shortens the text
        text = new
    for pattern in (_STRONG, _EMPHASIS, _EMPHASIS):
        text = pattern.sub(lambda m: m[1] if m[1] is not None else m[2], text)
    text = html.unescape(text)
    while "\x00" in text:
        new = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
        if new == text:
            break
        text = new
    return squeeze(text)


def _without_comments(text: str) -> str:
    """Drop comments that aren't within fenced code."""
    out, fence = [], ""
    pending = False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if pending:
            if "-->" not in line:
                continue
            line, pending = line.split("-->", 1)[1], False
            m = None
        if fence:
            if m and m[2].startswith(fence) and not m[3].strip():
                fence = ""
            out.append(line)
            continue
        if m and not (m[2][0] == "`" and "`" in m[3]):
            fence = m[2]
            out.append(line)
            continue
        if "<!--" in line and not line.startswith(("    ", "\t")):
            line = re.sub(r"<!--.*?-->", "", line)
            if "<!--" in line:
                line, pending = line.split("<!--", 1)[0], True
        out.append(line)
    return "\n".join(out)


def _width(indent: str) -> int:
    return len(indent.expandtabs(4))


def from_markdown(text: str) -> list[Element]:
    text = _without_comments(_FRONT.sub("", text))
    lines = text.split("\n")
    out: list[Element] = []
    para: list[str] = []
    item: list[str] | None = None  # lines of the open list item
    in_list = False

    def close() -> None:
        nonlocal item
        if item is not None:
            at = len(out)
            out.append((ITEM, ""))
            out[at] = (ITEM, _markdown_inline("\n".join(item), out))
            item = None
        elif para:
            _markdown_inline("\n".join(para), out)
        para.clear()

    i, blank = 0, True
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            close()
            blank = True
            i += 1
            continue
        m = _FENCE.match(line)
        if m and not (m[2][0] == "`" and "`" in m[3]):
            close()
            body, i = [], i + 1
            while i < len(lines):
                e = _FENCE.match(lines[i])
                if e and e[2].startswith(m[2]) and not e[3].strip():
                    break
                body.append(lines[i])
                i += 1
            out.append((CODE, squeeze("\n".join(body))))
            in_list, blank = False, False
            i += 1
            continue
        b = _BULLET.match(line)
        if b and not _RULE.match(line):
            deep = _width(b[1])
            if deep < 4 or in_list:
                close()
                item, in_list, blank = [b[3]], True, False
                i += 1
                continue
        if line.startswith(("    ", "\t")) and blank and item is None:
            body = []
            while i < len(lines) and (not lines[i].strip() or lines[i].startswith(("    ", "\t"))):
                body.append(lines[i])
                i += 1
            out.append((CODE, squeeze("\n".join(body))))
            in_list, blank = False, True
            continue
        m = _ATX.match(line)
        if m and item is None or m and not line.startswith(" "):
            close()
            at = len(out)
            out.append((HEADING, ""))
            out[at] = (HEADING, _markdown_inline(m[1] or "", out))
            in_list, blank = False, True
            i += 1
            continue
        if para and item is None and _UNDER.match(line):
            head = "\n".join(para)
            para.clear()
            at = len(out)
            out.append((HEADING, ""))
            out[at] = (HEADING, _markdown_inline(head, out))
            in_list, blank = False, True
            i += 1
            continue
        if _RULE.match(line) or (not para and item is None and _DEFINITION.match(line)):
            close()
            blank = True
            i += 1
            continue
        opened = re.match(r"^\s*(\$\$|\\\[)", line)
        if opened and item is None:
            # displayed formula: may hold blank lines, ends at its delimiter
            end = "$$" if opened[1] == "$$" else "\\]"
            rest = line[opened.end() :]
            body, j = [rest], i
            while end not in body[-1] and j + 1 < len(lines):
                j += 1
                body.append(lines[j])
            if end in body[-1]:
                close()
                src, after = "\n".join(body).split(end, 1)
                out.append((FORMULA, squeeze(src)))
                if after.strip():
                    para.append(after)
                in_list, blank = False, False
                i = j + 1
                continue
        if item is not None:
            item.append(line.strip())
        else:
            if not line.startswith((" ", "\t")):
                in_list = False
            para.append(line)
        blank = False
        i += 1
    close()
    return [e for e in out if e[1] or e[0] == CODE]


# --- wiki -----------------------------------------------------------------------------------------

_WIKI_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_WIKI_MATH = re.compile(r"<math\b[^>/]*>(.*?)</math\s*>", re.S | re.I)
_REF = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_TABLE = re.compile(r"^\{\|.*?^\|\}", re.S | re.M)
_AWAY = re.compile(r"\[\[(?:category|file|image|kategorie|datei|bild|categoría|archivo|catégorie|fichier):[^\[\]]*\]\]", re.I)
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
_WIKI_LIST = re.compile(r"^([*#:;]+)[ \t]*(.*)$")


def _without_templates(text: str) -> str:
    """Drop calls of templates, however deeply they are nested; braces without a partner stay."""
    for _ in range(8):
        new = _TEMPLATE.sub("", text)
        if new == text:
            return text
        text = new
    out: list[str] = []
    opened: list[int] = []
    for part in re.split(r"(\{\{|\}\})", text):
        if part == "}}" and opened:
            del out[opened.pop() :]
            continue
        if part == "{{":
            opened.append(len(out))
        out.append(part)
    return "".join(out)


def from_wiki(text: str) -> list[Element]:
    out: list[Element] = []
    held: list[Element] = []

    def hold(kind: str, s: str) -> str:
        held.append((kind, squeeze(s)))
        return f"\x01{len(held) - 1}\x01"

    text = _COMMENT.sub("", text)
    text = _WIKI_CODE.sub(lambda m: hold(CODE, html.unescape(m[2]) if m[1].lower() == "pre" else m[2]), text)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: hold("", html.unescape(m[1])), text, flags=re.S | re.I)
    text = _WIKI_MATH.sub(lambda m: hold(FORMULA, m[1]), text)
    text = _REF.sub("", text)
    text = _without_templates(text)
    text = _AWAY.sub("", _TABLE.sub("", text))

    def inline(s: str) -> str:
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", s)
        s = re.sub(r"'{2,5}", "", s)
        s = html.unescape(_TAG.sub(lambda m: " " if m[0][1:3].lower() == "br" else "", s))

        def back(m: re.Match) -> str:
            kind, body = held[int(m[1])]
            if kind:
                out.append((kind, body))
            return "" if kind == CODE else body

        return squeeze(re.sub(r"\x01(\d+)\x01", back, s))

    for line in text.split("\n"):
        h = _WIKI_HEAD.match(line)
        li = None if h else _WIKI_LIST.match(line)
        at = len(out)
        if h:
            out.append((HEADING, ""))
            out[at] = (HEADING, inline(h[2]))
        elif li and li[1][-1] in "*#" and li[2].strip():
            out.append((ITEM, ""))
            out[at] = (ITEM, inline(li[2]))
        else:
            inline(line)
    return [e for e in out if e[1] or e[0] == CODE]


# --- LaTeX ----------------------------------------------------------------------------------------

_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(.*?)\\end\{\1\}", re.S)
_LATEX_COMMENT = re.compile(r"(?m)^[ \t]*%.*\n?|(?<!\\)%.*$")
_LATEX_MATH = re.compile(
    r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)\*?)\}(?P<env>.*?)\\end\{\1\}"
    r"|(?<!\\)\$\$(?P<dd>.+?)\$\$|\\\[(?P<br>.+?)\\\]|\\\((?P<pa>.+?)\\\)|(?<!\\)\$(?P<d>[^$]+?)(?<!\\)\$",
    re.S,
)
_LATEX_NAMES = {"textless": "<", "textgreater": ">", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "ss": "ß", "par": " ", "newline": " ", "quad": " ", "S": "§"}
_SECTION = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
_NOTES = ("footnote", "footnotetext", "marginpar", "todo", "thanks", "label", "cite", "index", "vspace", "hspace", "usepackage", "documentclass", "title", "author", "date", "input", "include", "bibliography", "bibliographystyle", "pagestyle")
_LATEX_TOKEN = re.compile(r"\\([A-Za-z]+)\*?|\\(.)|([{}])|(\x01\d+\x01)|([^\\{}\x01]+)|(.)", re.S)


def _group(s: str, at: int) -> tuple[str, int]:
    """The braced group that begins at or after `at`, and where it ends."""
    while at < len(s) and s[at].isspace():
        at += 1
    if at >= len(s) or s[at] != "{":
        return "", at
    depth, i = 0, at
    while i < len(s):
        if s[i] == "\\":
            i += 2
            continue
        depth += (s[i] == "{") - (s[i] == "}")
        i += 1
        if depth == 0:
            break
    return s[at + 1 : i - 1], i


def from_latex(text: str) -> list[Element]:
    out: list[Element] = []
    held: list[Element] = []

    def hold(kind: str, s: str) -> str:
        held.append((kind, squeeze(s)))
        return f"\x01{len(held) - 1}\x01"

    text = _VERBATIM.sub(lambda m: hold(CODE, m[2]), text)
    text = _LATEX_COMMENT.sub("", text)
    text = re.sub(r"\\begin\{comment\}.*?\\end\{comment\}", "", text, flags=re.S)
    if (b := text.find("\\begin{document}")) >= 0:
        text = text[b + len("\\begin{document}") :]
    if (e := text.find("\\end{document}")) >= 0:
        text = text[:e]
    text = re.sub(r"\\verb\*?([^A-Za-z\s*])(.*?)\1", lambda m: hold("", m[2]), text)
    text = _LATEX_MATH.sub(lambda m: hold(FORMULA, next(m[k] for k in ("env", "dd", "br", "pa", "d") if m[k] is not None)), text)
    stack: list[tuple[int, list[str]] | None] = []  # open list environments: the open item

    def put(s: str) -> None:
        for e in reversed(stack):
            if e is not None:
                e[1].append(s)
            return

    def end_item() -> None:
        if stack and stack[-1] is not None:
            at, parts = stack[-1]
            out[at] = (ITEM, squeeze("".join(parts)))
            stack[-1] = None

    def walk(s: str, write) -> None:
        at = 0
        while at < len(s):
            m = _LATEX_TOKEN.match(s, at)
            at = m.end()
            name, sign, brace, mark, plain, rest = m.groups()
            if plain is not None or rest is not None:
                t = plain or rest
                write(t.replace("~", " ").replace("``", '"').replace("''", '"').replace("---", "—").replace("--", "–") if plain else t)
            elif mark:
                kind, body = held[int(mark[1:-1])]
                if kind:
                    out.append((kind, body))
                if kind != CODE:
                    write(body)
            elif brace:
                continue
            elif sign is not None:
                write(" " if sign in "\\ \n,;:" else "" if sign in "!/-" else sign)
            elif name in _SECTION:
                if at < len(s) and s[at] == "[":
                    at = s.find("]", at) + 1 or at
                title, at = _group(s, at)
                place = len(out)
                out.append((HEADING, ""))
                parts: list[str] = []
                walk(title, parts.append)
                out[place] = (HEADING, squeeze("".join(parts)))
            elif name in ("begin", "end"):
                env, at = _group(s, at)
                if env.rstrip("*") in ("itemize", "enumerate", "description"):
                    if name == "begin":
                        stack.append(None)
                    elif stack:
                        end_item()
                        stack.pop()
                if name == "begin" and at < len(s) and s[at] == "[":
                    at = s.find("]", at) + 1 or at
            elif name == "item":
                if at < len(s) and s[at] == "[":
                    at = s.find("]", at) + 1 or at
                end_item()
                if stack:
                    out.append((ITEM, ""))
                    stack[-1] = (len(out) - 1, [])
            elif name == "href":
                _, at = _group(s, at)
                label, at = _group(s, at)
                walk(label, write)
            elif name in _NOTES:
                if at < len(s) and s[at] == "[":
                    at = s.find("]", at) + 1 or at
                _, at = _group(s, at)
            elif name in _LATEX_NAMES:
                write(_LATEX_NAMES[name])
                if s[at : at + 2] == "{}":
                    at += 2
                elif at < len(s) and s[at] == " ":
                    at += 1
            elif at < len(s) and s[at].isspace() and name not in ("emph", "textbf", "textit", "texttt", "underline"):
                at += 1

    walk(text, put)
    while stack:
        end_item()
        stack.pop()
    return [e for e in out if e[1] or e[0] == CODE]


# --- dialects ---------------------------------------------------------------------------------------

_HTML_START = re.compile(r"<(?:!doctype|html|head|body|h[1-6]|p|ul|ol|div|table|nav|section|article)\b", re.I)
_PRE_START = re.compile(r"<pre\b", re.I)
_PRE_CODE = re.compile(r"<pre[^<>]*><code\b", re.I)
_HTML_BLOCK = re.compile(r"<(?:p|ul|ol|h[1-6]|div|body)\b[^<>]*>", re.I)
_LATEX_MARK = re.compile(
    r"\\(?:documentclass|begin\{(?:document|itemize|enumerate|verbatim|lstlisting|equation|align|gather)\*?\}|(?:sub)*section\*?\{|paragraph\*?\{|(?:emph|textbf|textit|texttt|href)\{)|\\textless\{\}"
)
_WIKI_MARK = re.compile(r"^={1,6}[ \t][^\n]*[^=\s][ \t]+={1,6}[ \t]*$|\[\[[^\[\]\n]+\]\]|'''|<(?:math|ref|syntaxhighlight|nowiki)\b|^\{\{|^<pre>|^\*\* |^#[ \t][^\n]*\n#+[ \t]", re.M)
_MARKDOWN_MARK = re.compile(r"^(?:`{3,}|~{3,})|\]\(|\]\[\d|\*\*\w|^\$\$[ \t]*$|^[^\n]+\n(?:={3,}|-{3,})[ \t]*$|^\\\[", re.M)
_ANY_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[^`\n]*\n.*?(?:^ {0,3}\2[`~]*[ \t]*$|\Z)", re.S | re.M)


def dialect(text: str) -> str:
    """html, latex, wiki or markdown (also for text without markup)."""
    body = _COMMENT.sub("", text).lstrip()
    if _HTML_START.match(body):
        return "html"
    # preformatted text opens pages of HTML and of wikis alike
    if _PRE_START.match(body) and (_PRE_CODE.match(body) or _HTML_BLOCK.search(_WIKI_CODE.sub("", body))):
        return "html"
    bare = _ANY_FENCE.sub("", body)
    bare = re.sub(r"^(?: {4}|\t)[^\n]*$", "", bare, flags=re.M)
    if _LATEX_MARK.search(bare):
        return "latex"
    wiki = len(_WIKI_MARK.findall(bare))
    if wiki and wiki > len(_MARKDOWN_MARK.findall(bare)) + (2 if bare != body and _ANY_FENCE.search(body) else 0):
        return "wiki"
    return "markdown"


_READERS = {"html": from_html, "latex": from_latex, "wiki": from_wiki, "markdown": from_markdown}


def elements(text: str | None) -> Iterator[tuple[str, int, str]]:
    """(element, seq, plain) of a record, in text order."""
    if not text or text.isspace():
        return
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    seen = dict.fromkeys(ELEMENTS, 0)
    for kind, plain in _READERS[dialect(text)](text):
        if plain:
            seen[kind] += 1
            yield kind, seen[kind], plain


def structure(records: DataFrame, origin: str, key: str, text: str) -> DataFrame:
    """origin, rec_id, element, seq, plain: the structured elements of every record.

    Null, empty and unstructured texts and records without key give no rows;
    repeats count once.
    """

    def run(batches):
        for b in batches:
            ids, kinds, seqs, plains = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, seq, plain in elements(t):
                    ids.append(i)
                    kinds.append(kind)
                    seqs.append(seq)
                    plains.append(plain)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(seqs, pa.int32()), pa.array(plains, pa.string())], ["rec_id", "element", "seq", "plain"])

    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("rec_id"), text)
    return (
        rows.mapInArrow(run, "rec_id bigint, element string, seq int, plain string")
        .distinct()
        .select(F.lit(origin).alias("origin"), "rec_id", "element", "seq", "plain")
    )
