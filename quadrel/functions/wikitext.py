"""A linear scanner for wiki markup: templates, links, plain text, leads."""

from __future__ import annotations

import re
import unicodedata

_DROP = re.compile(r"<!--.*?-->|<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I)
_BREAK = re.compile(r"<br\s*/?\s*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\[(?=(?:https?:)?//)|\]|\{\||\|\}")
#: Templates whose content is kept, with the place of the parameter; dates, addresses and countries.
TEXT_TEMPLATES = {"màu chữ": 1, "color": 1, "nowrap": 0, "lang": 1, "langx": 1}
DATE_TEMPLATES = ("ngày thành lập và tuổi", "start date and age", "start date", "ngày bắt đầu", "ngày sinh", "ngày sinh và tuổi", "birth date", "birth date and age")
URL_TEMPLATES = frozenset(("url", "official website", "trang web chính thức", "website"))
COUNTRY_TEMPLATES = {"vie": "Việt Nam", "vnm": "Việt Nam"}
_NAMESPACE = re.compile(r"\s*(?:tập tin|hình|file|image|thể loại|category|wikipedia|bản mẫu|template|[a-z]{2,3})\s*:", re.I)
_CATEGORY = re.compile(r"\[\[\s*(?:thể loại|category)\s*:\s*([^\]|]+)", re.I)


class Node:
    """kind: root, template, link, url or table; text[start:end] is its markup, shown what a reader sees of it (known once it is
    closed); parts: (start, end, node or None for plain text)."""

    __slots__ = ("kind", "text", "start", "end", "parts", "shown")

    def __init__(self, kind: str, text: str, start: int):
        self.kind, self.text, self.start, self.end, self.parts, self.shown = kind, text, start, len(text), [], ""

    @property
    def source(self) -> str:
        return self.text[self.start : self.end]


class Piece:
    """What stands between two bars of a template or link."""

    __slots__ = ("text", "parts")

    def __init__(self, text: str):
        self.text, self.parts = text, []

    @property
    def source(self) -> str:
        return self.text[self.parts[0][0] : self.parts[-1][1]] if self.parts else ""

    @property
    def shown(self) -> str:
        return _joined(self.text, self.parts)


_OPEN = {"{{": "template", "[[": "link", "[": "url", "{|": "table"}
_CLOSE = {"}}": "template", "]]": "link", "]": "url", "|}": "table"}


def _joined(text: str, parts: list) -> str:
    return "".join([text[a:b] if node is None else node.shown for a, b, node in parts])


def tree(text: str) -> tuple[Node, list[Node]]:
    """(root, closed nodes by their start) of the nested marks of a text; what is never closed counts as text.

    Nothing here recurses: what a node shows is put together from its parts when it is closed."""
    root = Node("root", text, 0)
    stack, closed, at = [root], [], 0

    def close(end: int) -> None:
        node = stack.pop()
        node.end = end
        node.shown = _shown(node)
        closed.append(node)
        stack[-1].parts.append((node.start, end, node))

    while m := _MARK.search(text, at):
        if m.start() > at:
            stack[-1].parts.append((at, m.start(), None))
        at, mark = m.end(), m[0]
        if mark in _OPEN:
            stack.append(Node(_OPEN[mark], text, m.start()))
        elif len(stack) > 1 and stack[-1].kind == _CLOSE[mark]:
            close(at)
        elif mark == "]]" and stack[-1].kind == "url":  # [[a [http://b]]] and the like
            at -= 1
            close(at)
        else:
            stack[-1].parts.append((m.start(), at, None))
    if at < len(text):
        stack[-1].parts.append((at, len(text), None))
    for node in stack[1:]:
        width = 1 if node.kind == "url" else 2
        root.parts.append((node.start, node.start + width, None))
        root.parts += node.parts
    root.shown = _joined(text, root.parts)
    return root, sorted(closed, key=lambda n: n.start)


def split_bars(node: Node) -> list[Piece]:
    """The pieces between the bars of a template or link."""
    text, out = node.text, [Piece(node.text)]
    for a, b, child in node.parts:
        if child is None:
            while (bar := text.find("|", a, b)) >= 0:
                out[-1].parts.append((a, bar, None))
                out.append(Piece(text))
                a = bar + 1
            out[-1].parts.append((a, b, None))
        else:
            out[-1].parts.append((a, b, child))
    return out


def template_name(raw: str) -> str:
    name = re.sub(r"(?i)^\s*(?:template|bản mẫu|tiêu bản)\s*:", "", unicodedata.normalize("NFC", raw))
    name = re.sub(r"[_\s]+", " ", name).strip()
    return name[:1].upper() + name[1:]


def parameters(node: Node) -> tuple[str, dict[str, str], list[Piece]]:
    """(name, named parameters, the last of equal names winning, positional ones) of a template."""
    name, *rest = split_bars(node)
    named, placed = {}, []
    for piece in rest:
        head = next((piece.text[a:b] for a, b, child in piece.parts[:1] if child is None), "")
        if "=" in head:
            key, _, value = piece.source.partition("=")
            named[re.sub(r"\s+", " ", unicodedata.normalize("NFC", key)).strip().lower()] = value.strip()
        else:
            placed.append(piece)
    return template_name(name.source), named, placed


def infoboxes(text: str, prefixes: tuple[str, ...] = ("thông tin", "infobox", "hộp thông tin")) -> list[tuple[str, dict[str, str]]]:
    """(template, {parameter: markup}) of the top-level templates whose name starts with a prefix, in order.

    Names of digits are dropped; labelN with dataN becomes a parameter named by the label's text."""
    out = []
    for _, _, p in tree(_DROP.sub("", text or ""))[0].parts:
        if p is not None and p.kind == "template":
            name, named, _ = parameters(p)
            if name.lower().startswith(prefixes):
                params = {}
                for k, v in named.items():
                    m = re.fullmatch(r"(label|data)(\d+)", k)
                    if m and m[1] == "data":
                        k = plain(named.get("label" + m[2], "")).strip().lower() or k
                    elif m or k.isdigit():
                        continue
                    params[k] = v
                out.append((name, params))
    return out


def _expanded(node: Node) -> str:
    name, _, placed = parameters(node)
    low = name.lower()
    if low in TEXT_TEMPLATES:
        k = TEXT_TEMPLATES[low]
        return placed[k].shown.strip() if len(placed) > k else ""
    if low.startswith(DATE_TEMPLATES):
        return "/".join(reversed([x.shown.strip() for x in placed[:3]]))
    if low in URL_TEMPLATES:
        return placed[0].source.strip() if placed else ""
    return COUNTRY_TEMPLATES.get(low, "")


def _shown(node: Node) -> str:
    if node.kind == "template":
        return _expanded(node)
    if node.kind == "link":
        pieces = split_bars(node)
        return "" if _NAMESPACE.match(pieces[0].source) else pieces[-1].shown
    if node.kind == "url":
        return _joined(node.text, node.parts).partition(" ")[2]
    return ""


def cleaned(text: str | None) -> str:
    """Markup without comments and references, <br> as a line end."""
    return _BREAK.sub("\n", _DROP.sub("", text or ""))


def _plain(shown: str) -> str:
    shown = re.sub(r"'{2,}", "", _TAG.sub("", shown)).replace("&nbsp;", " ")
    return unicodedata.normalize("NFC", re.sub(r"[^\S\n]+", " ", shown).strip())


def plain(text: str | None) -> str:
    """Text without markup: references and unknown templates go, links show their text, <br> is a line end."""
    return _plain(tree(cleaned(text))[0].shown)


def _links(nodes: list[Node]) -> list[tuple[str, str]]:
    out = []
    for node in nodes:
        if node.kind == "link":
            pieces = split_bars(node)
            target = pieces[0].source
            if not _NAMESPACE.match(target):
                target = re.sub(r"[\s_]+", " ", target.partition("#")[0]).strip()
                if target:
                    out.append((target[:1].upper() + target[1:], pieces[-1].shown.strip()))
    return out


def links(text: str | None) -> list[tuple[str, str]]:
    """(target without fragment, first letter in upper case; shown text) of links outside namespaces, nested ones too."""
    return _links(tree(_DROP.sub("", text or ""))[1])


def external_links(text: str | None) -> list[str]:
    return [n.source[1:].split(" ")[0].rstrip("]").strip() for n in tree(_DROP.sub("", text or ""))[1] if n.kind == "url"]


def scan(text: str | None) -> dict:
    """What value parsers read of a piece of markup: text (plain), cleaned, links (targets), urls, and coord, the positional
    parameters of its first coordinate template at any depth (None without one)."""
    raw = cleaned(text)
    root, nodes = tree(raw)
    coord = None
    for n in nodes:
        if n.kind == "template" and coord is None:
            name, _, placed = parameters(n)
            coord = [p.source.strip() for p in placed] if name.lower() == "coord" else None
    urls = [n.source[1:].split(" ")[0].rstrip("]").strip() for n in nodes if n.kind == "url"]
    return {"text": _plain(root.shown), "cleaned": raw, "links": [unicodedata.normalize("NFC", t) for t, _ in _links(nodes)], "urls": urls, "coord": coord}


def categories(text: str | None) -> list[str]:
    return list(dict.fromkeys(re.sub(r"[\s_]+", " ", c).strip() for c in _CATEGORY.findall(text or "")))


def lead(text: str | None, most: int = 2000) -> str:
    """The text before the first heading, paragraphs joined by blanks, cut at a word end with an ellipsis."""
    head = re.split(r"\n==", text or "", maxsplit=1)[0]
    head = _DROP.sub("", head)
    parts = [head[a:b] for a, b, node in tree(head)[0].parts if node is None or node.kind in ("link", "url")]
    out = " ".join(plain("".join(parts)).split())
    if len(out) <= most:
        return out
    return out[:most].rsplit(" ", 1)[0].rstrip(" ,;:") + "…"
