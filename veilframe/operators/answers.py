"""Answers copied from a chat page: HTML or plain text to Markdown, and Markdown to safe HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_HTML = 10 << 20  # code points
# Fixed values of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("button canvas iframe img link meta noscript script style svg template".split())
_BLOCKS = frozenset("p div section article main header footer aside nav figure figcaption details summary dl dt dd address form fieldset body html".split())
_SAFE_SCHEMES = ("", "http", "https", "mailto")
# The form of a marker, and the signs that Markdown needs escaped
_MARKER = re.compile(r"(?<![A-Za-z0-9_])OBF_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+(?![A-Za-z0-9_])", re.I)
_SIGNS = re.compile(r"[\\`*_{}\[\]<>#+.!|~-]")
_LANGUAGES = {"c#": "csharp", "c++": "cpp", "oracle": "sql", "plsql": "sql"}
_LABEL = re.compile(r"[A-Za-z][A-Za-z0-9+#.-]{0,19}")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def find(self, *tags: str) -> list["Node"]:
        """Descendants of these tags, not looking inside them; a stack keeps deep pages from recursing."""
        out, stack = [], list(reversed(self.elements()))
        while stack:
            n = stack.pop()
            if n.tag in tags:
                out.append(n)
            else:
                stack += reversed(n.elements())
        return out


class _Builder(HTMLParser):
    """A tolerant tree: an end tag closes its nearest open element, unmatched ones are ignored. Depth is bounded."""

    DEPTH = 200

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < self.DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def hidden(n: Node) -> bool:
    style = re.sub(r"\s", "", n.attrs.get("style", "").lower())
    return n.tag in _DROPPED or "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def raw_text(n: Node | str) -> str:
    if isinstance(n, str):
        return n
    if hidden(n):
        return ""
    return "\n" if n.tag == "br" else "".join(map(raw_text, n.children))


def plain_text(n: Node | str) -> str:
    return " ".join(raw_text(n).split())


def escape(text: str) -> str:
    """Backslashes before Markdown signs, outside markers."""
    out, done = [], 0
    for m in _MARKER.finditer(text):
        out += [_SIGNS.sub(r"\\\g<0>", text[done : m.start()]), m[0]]
        done = m.end()
    return "".join([*out, _SIGNS.sub(r"\\\g<0>", text[done:])])


def inline(n: Node | str) -> str:
    if isinstance(n, str):
        return escape(re.sub(r"\s+", " ", n))
    if hidden(n):
        return ""
    if n.tag == "br":
        return "\n"
    if n.tag == "code":
        body = plain_text(n)
        fence = "`" * (max((len(x) for x in re.findall("`+", body)), default=0) + 1)
        return f"{fence}{body}{fence}" if body else ""
    inner = "".join(map(inline, n.children))
    bare = inner.strip()
    if not bare:
        return inner
    wrap = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "strike": "~~", "del": "~~"}.get(n.tag)
    if wrap:
        return inner.replace(bare, f"{wrap}{bare}{wrap}", 1)
    if n.tag == "a":
        link = n.attrs.get("href", "").strip()
        scheme = link.split(":", 1)[0].lower() if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", link) else ""
        return inner.replace(bare, f"[{bare}]({link})", 1) if link and scheme in _SAFE_SCHEMES and not re.search(r"[\s()<>]", link) else inner
    return inner


def code_block(n: Node, label: str = "") -> str:
    code = (n.find("code") or [n])[0]
    named = re.search(r"(?:language|lang)-([\w+#.-]+)", " ".join(x.attrs.get("class", "") for x in (n, code)))
    language = (named[1] if named else label).lower()
    body = raw_text(code).strip("\n")
    fence = "`" * max(3, max((len(x) for x in re.findall("`+", body)), default=0) + 1)
    return f"{fence}{_LANGUAGES.get(language, language)}\n{body}\n{fence}"


def table_cells(n: Node) -> list[list[str]]:
    return [[re.sub(r"\s*\n\s*", " / ", inline_all(c)) for c in r.find("td", "th")] for r in n.find("tr")]


def table(rows: list[list[str]]) -> str:
    """Rows as a pipe table under the first one; short rows are padded."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * wide) + " |", *map(line, rows[1:])])


def inline_all(n: Node) -> str:
    return re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(map(inline, n.children))).strip()


def list_block(n: Node, depth: int = 0) -> str:
    start = n.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"\d{1,9}", start) else 1
    out = []
    for item in (c for c in n.elements() if c.tag == "li" and not hidden(c)):
        mark = f"{number}." if n.tag == "ol" else "-"
        number += 1
        own, nested = Node("li"), []
        for c in item.children:
            nested.append(c) if isinstance(c, Node) and c.tag in ("ul", "ol") else own.children.append(c)
        body = blocks(own) if any(c.tag in _BLOCKS | {"pre", "table"} for c in own.elements()) else [inline_all(own)]
        pad = "  " * depth
        text = "\n".join(x for x in body if x)
        out.append(pad + f"{mark} " + text.replace("\n", "\n" + pad + " " * (len(mark) + 1)))
        out += [list_block(x, depth + 1) for x in nested]
    return "\n".join(x for x in out if x.strip())


def metric_cards(n: Node) -> str:
    """Cards of a label and a value with a digit, two or more: a table of two columns."""
    pairs = []
    for card in n.elements():
        texts = [t for t in (plain_text(c) for c in card.children) if t]
        if len(texts) == 2 and all(len(t) <= 120 for t in texts) and re.search(r"\d", texts[1]):
            pairs.append([escape(t) for t in texts])
    return table([["Metric", "Value"], *pairs]) if len(pairs) >= 2 else ""


def blocks(n: Node) -> list[str]:
    """A node's Markdown blocks."""
    out: list[str] = []
    run: list[Node | str] = []
    rows: list[list[str]] = []

    def flush() -> None:
        if rows:
            out.append(table(rows))
            rows.clear()
        if run:
            p = Node("p")
            p.children = list(run)
            run.clear()
            if text := inline_all(p):
                out.append(text)

    for c in n.children:
        if isinstance(c, str):
            if c.strip() or run:
                if c.strip() and rows:
                    flush()
                run.append(c)
            continue
        if hidden(c):
            continue
        if c.tag == "table":  # neighbouring fragments are one table
            if run and "".join(map(raw_text, run)).strip():
                flush()
            run.clear()
            rows += table_cells(c)
            continue
        block = _block(c, out[-1] if out else "")
        if block is None:
            if rows:
                flush()
            run.append(c)
            continue
        flush()
        if c.tag == "pre" and out and _LABEL.fullmatch(out[-1]) and not block.split("\n", 1)[0].strip("`"):
            label = out.pop().lower()
            block = code_block(c, label)
        out += block if isinstance(block, list) else [block]
    flush()
    return [b for b in out if b.strip()]


def _block(c: Node, before: str) -> str | list[str] | None:
    if re.fullmatch("h[1-6]", c.tag):
        return "#" * int(c.tag[1]) + " " + inline_all(c).replace("\n", " ")
    if c.tag == "pre":
        return code_block(c)
    if c.tag in ("ul", "ol"):
        return list_block(c)
    if c.tag == "blockquote":
        return "\n".join("> " + x if x else ">" for x in "\n\n".join(blocks(c)).split("\n"))
    if c.tag == "hr":
        return "---"
    if "data-d-component" in c.attrs and (cards := metric_cards(c)):
        return cards
    return blocks(c) if c.tag in _BLOCKS or c.tag in ("tbody", "tr", "td", "li") else None


def clean_markdown(text: str) -> str:
    """No trailing space, at most one blank line in a row; fences keep theirs."""
    out, fence = [], ""
    for line in text.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if mark and (not fence or mark[1].startswith(fence)):
            fence = "" if fence else mark[1]
        elif not fence:
            line = line.rstrip()
            if not line and (not out or not out[-1]):
                continue
        out.append(line)
    return "\n".join(out).strip("\n")


def html_to_markdown(page: str | None) -> str:
    """Visible content as Markdown; empty for nulls. Pages over 10 Mi characters are an error."""
    if not page:
        return ""
    if len(page) > MAX_HTML:
        raise ValueError("the page exceeds the conversion limit")
    builder = _Builder()
    builder.feed(page.replace("\r\n", "\n").replace("\r", "\n"))
    builder.close()
    return clean_markdown("\n\n".join(blocks(builder.root)))


@F.pandas_udf(StringType())
def html_markdown(page: pd.Series) -> pd.Series:
    """As ``html_to_markdown``; null where the page is over the limit, so that it is told from an empty one."""
    return pd.Series([None if isinstance(p, str) and len(p) > MAX_HTML else html_to_markdown(p) for p in page], dtype=object)


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def plain_to_markdown(text: str | None) -> str:
    """Lines with equal numbers of tabs, two or more, become a table; a language's name over a fence joins it; fences stay."""
    out, run, fence = [], [], ""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def flush() -> None:
        if len(run) >= 2:
            out.extend(table([[c.strip().replace("|", "\\|") for c in r.split("\t")] for r in run]).split("\n"))
        else:
            out.extend(run)
        run.clear()

    for i, line in enumerate(lines):
        mark = re.match(r"(`{3,}|~{3,})", line)
        tabs = 0 if fence or mark else line.count("\t")
        if run and tabs != run[-1].count("\t"):
            flush()
        if mark and (not fence or line.startswith(fence)):
            if not fence and out and line == mark[1] and _LABEL.fullmatch(out[-1].strip()):
                language = out.pop().strip().lower()
                line += _LANGUAGES.get(language, language)
            fence = "" if fence else mark[1]
        if tabs:
            run.append(line)
        else:
            out.append(line)
    flush()
    return clean_markdown("\n".join(out))


def answer_to_markdown(plain: str | None, page: str | None) -> str:
    """The HTML copy's Markdown if it is no longer than the limit, belongs to the plain copy and holds anything; else the plain copy's."""
    squeezed = lambda s: re.sub(r"\s+", "", s or "")
    if page and plain is not None and len(page) <= MAX_HTML:
        builder = _Builder()
        builder.feed(page)
        if squeezed(raw_text(builder.root)) == squeezed(plain) and (found := html_to_markdown(page)):
            return found
    return plain_to_markdown(plain)


@F.pandas_udf(StringType())
def plain_markdown(text: pd.Series) -> pd.Series:
    return text.map(plain_to_markdown)


@F.pandas_udf(StringType())
def answer_markdown(plain: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([answer_to_markdown(a, b) for a, b in zip(plain, page, strict=True)], dtype=object)


def restored_html(markdown: str | None, mapping: dict[str, str]) -> str:
    """Markdown as safe HTML with known markers restored after parsing, so originals show literally."""
    known = {k.upper(): v for k, v in mapping.items()}
    show = lambda s: html.escape(_MARKER.sub(lambda m: known.get(m[0].upper(), m[0]), s), quote=False)
    span = lambda s: "".join(f"<code>{show(x[1:-1])}</code>" if x.startswith("`") and x.endswith("`") and len(x) > 2 else re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", show(x)) for x in re.split(r"(`[^`]+`)", s))
    out, code, para = [], None, []

    def flush() -> None:
        if para:
            out.append("<p>" + "<br>".join(map(span, para)) + "</p>")
            para.clear()

    for line in (markdown or "").split("\n"):
        if line.startswith("```"):
            if code is None:
                flush()
                code = [line[3:].strip()]
            else:
                name = html.escape(code[0])
                body = "\n".join(map(show, code[1:]))
                out.append(f'<pre class="mermaid">{body}</pre>' if name == "mermaid" else f'<pre><code class="language-{name}">{body}</code></pre>')
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6}) (.*)", line):
            flush()
            out.append(f"<h{len(m[1])}>{span(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"!\[([^\]]*)\]\([^)]*\)$", line):
            flush()
            out.append(f"<p>{show(m[1])}</p>")
        elif not line.strip():
            flush()
        else:
            para.append(line)
    flush()
    if code is not None:
        out.append(f"<pre><code>{chr(10).join(map(show, code[1:]))}</code></pre>")
    return "\n".join(out)
