"""A small page reader on the standard library parser, used inside Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "text", "_below")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self._below: list[Node] | None = None

    def elements(self) -> list[Node]:
        """All elements below this one in page order, walked once."""
        if self._below is None:
            self._below, stack = [], self.children[::-1]
            while stack:
                node = stack.pop()
                if node.tag[0] != "#":
                    self._below.append(node)
                    stack.extend(node.children[::-1])
        return self._below

    def strings(self, skip: frozenset[str] = frozenset()) -> list[str]:
        """Trimmed non-empty texts in page order, leaving out whole elements named in ``skip``."""
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag == "#text":
                text = node.text.strip()
                if text:
                    out.append(text)
            elif node.tag not in skip:
                stack.extend(reversed(node.children))
        return out

    def find(self, test) -> Node | None:
        return next((n for n in self.elements() if test(n)), None)

    def find_all(self, test) -> list[Node]:
        return [n for n in self.elements() if test(n)]

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag == "p":  # a paragraph ends where the next one starts
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_comment(self, data):
        self.open[-1].children.append(Node("#comment"))  # parts the text around it

    def handle_data(self, data):
        # adjoining pieces of text are one string
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.tag == "#text":
            last.text += data
        else:
            self.open[-1].children.append(Node("#text", text=data))


def read_page(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
