"""A tolerant HTML reader: pages as trees of block elements with text leaves."""

from __future__ import annotations

import html
import re

_NAME, _STOPS, _LONG_REF = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*"), re.compile("[>\"']"), re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{8,}));?")
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
#: Elements without content; elements whose content is no markup; elements whose content is never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title head template noscript iframe object svg math canvas audio video noembed noframes datalist".split())
#: An element that ends an open one of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
#: Elements deeper than this are put beside their parents, as browsers do.
MAX_DEPTH = 512
#: Once quotes of a page have been found not to end, a tag is looked at for so many quoted values.
FEW_QUOTES = 16
_SCOPES = frozenset("table ul ol dl select body html article section div".split())


class Page:
    """Nodes in page order: parent[k] < k; node 0 is the root. text[k] is None for elements."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.text, self.linked, self.depth = [-1], ["html"], [()], [None], [0], [0]

    def add(self, parent: int, tag: str, names: tuple[str, ...], text: str | None = None, linked: int = 0) -> int:
        if self.depth[parent] >= MAX_DEPTH:
            parent = self.parent[parent]
        self.depth.append(self.depth[parent] + 1)
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def attribute_words(attrs: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display:\s*none|visibility:\s*hidden", value):
            out.append("hidden")
        elif name != "style":
            out += [w.lower() for w in _WORD.findall(value)]
    return tuple(out)


class Tags:
    """The tags of a page in order, in time linear in its length: next() gives (where it begins, where it ends, name,
    closing, attributes), name "" for comments and declarations, None at the end."""

    def __init__(self, source: str) -> None:
        self.source, self.last = source, {q: source.rfind(q) for q in "\"'"}
        self.lost = len(source)  # a tag that begins here has quotes that never end; later ones may have FEW_QUOTES

    def _end(self, at: int) -> int:
        """The > that ends a tag, quoted ones left out unless a quote never ends; -1 if there is none."""
        here, quotes = at, 0
        while at < self.lost or quotes < FEW_QUOTES:
            quotes += 1
            m = _STOPS.search(self.source, here)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = self.source.find(m[0], m.end()) if m.start() < self.last[m[0]] else -1
            if close < 0:
                break
            here = close + 1
        self.lost = min(self.lost, at)
        return self.source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            at = begin + 1
            if source.startswith("!--", at):
                end = source.find("-->", at + 3)
                return begin, end + 3 if end >= 0 else len(source), "", False, ""
            if source.startswith(("!", "?"), at):
                end = source.find(">", at)
                if end < 0:
                    return None
                return begin, end + 1, "", False, ""
            closing = source.startswith("/", at)
            name = _NAME.match(source, at + closing)
            if name:
                end = self._end(name.end())
                if end < 0:
                    return None
                return begin, end + 1, name[0].lower(), closing, source[name.end() : end]
        return None


def unescape(raw: str) -> str:
    """Character references decoded; numbers beyond any code point as the replacement character."""
    return html.unescape(_LONG_REF.sub("\ufffd", raw)) if "&" in raw else raw


class Open:
    """The open elements, with how often each name is open at all and since the last scope began."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]  # inline elements have the node of their block
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.total[tag] = self.total.get(tag, 0) + 1
        if tag in _SCOPES:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def cut(self, depth: int) -> list[str]:
        """Close all from depth on; their names."""
        gone = [tag for tag, _ in self.stack[depth:]]
        del self.stack[depth:]
        for tag in reversed(gone):
            self.total[tag] -= 1
            if tag in _SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
        return gone

    def topmost(self, names: tuple[str, ...]) -> int:
        """The depth of the topmost open element of these names; 0 if there is none."""
        return next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] in names), 0)

    def find(self, tag: str) -> int:
        return self.topmost((tag,)) if self.total.get(tag) else 0

    def find_in_scope(self, names: tuple[str, ...]) -> int:
        return self.topmost(names) if any(self.scopes[-1].get(n) for n in names) else 0

    def rename(self, depth: int, tag: str) -> None:
        """Give an open inline element a name that nothing closes."""
        old, node = self.stack[depth]
        self.stack[depth] = (tag, node)
        self.total[old] -= 1
        self.total[tag] = self.total.get(tag, 0) + 1
        scope = self.scopes[-1 - sum(t in _SCOPES for t, _ in self.stack[depth + 1 :])]
        scope[old] -= 1
        scope[tag] = scope.get(tag, 0) + 1


def parse(source: str) -> Page:
    """Unclosed, stray and misnested tags are taken as browsers would nearly take them; nothing raises, and the time is
    linear in the length: no tag is scanned and no open element walked past twice without being closed."""
    page, tags, opened = Page(), Tags(source), Open()
    stack = opened.stack
    buffer: list[str] = []
    links = linked = unseen = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.add(stack[-1][1], "#text", (), text, min(linked, len(text)))
            buffer.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            buffer.append(unescape(raw))
            if links:
                linked += len(buffer[-1].strip())

    def pop_to(depth: int) -> None:
        nonlocal links, unseen
        for tag in opened.cut(depth):
            links -= tag == "a"
            unseen -= tag in UNSEEN

    while found := tags.next(at):
        begin, end, tag, closing, attrs = found
        put(source[at:begin])
        at = end
        if not tag:
            continue
        if tag == "br":
            put(" ")
        elif closing:
            depth = opened.find(tag)
            if tag in BLOCK:
                flush()
            if depth:
                pop_to(depth)
        else:
            if tag in BLOCK:
                flush()
                depth = opened.find_in_scope(ENDS.get(tag, ()) + (("p",) if tag not in ("option", "optgroup", "button") else ()))
                if depth:
                    pop_to(depth)
            if tag == "body":
                pop_to(1)
            if tag in VOID:
                continue
            node = stack[-1][1]
            if tag in BLOCK and tag != "html":
                node = page.add(node, tag, attribute_words(attrs) if attrs.strip() else ())
            if attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if tag == "a" and links:  # links don't nest
                links -= 1
                opened.rename(opened.find("a"), "a-")
            opened.push(tag, node)
            links += tag == "a"
            unseen += tag in UNSEEN
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(source, at)
                last = source.find(">", close.end()) if close else -1
                put(source[at : close.start() if last >= 0 else len(source)])
                at = last + 1 if last >= 0 else len(source)
                if tag in BLOCK:
                    flush()
                pop_to(len(stack) - 1)
    put(source[at:])
    flush()
    return page
