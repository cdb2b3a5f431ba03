"""Plain text, title, links and metadata of HTML, by one pass of a tokenizing pattern."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

# comments, declarations, raw-text elements (their content is no text), then tags with quoted attributes;
# a tag that never closes is matched as far as it goes, and read as text, so no place is scanned again and again
_INSIDE = r"((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|textarea|svg)\b{_INSIDE}>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+){_INSIDE}(>?)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++))""")
_LINKED = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "form": "action", "source": "src", "embed": "src"}
_BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select table tbody td tfoot th thead title tr ul video".split())
_SPACES = re.compile(r"[ \t\r\n\f]+")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def extract(page: str, base: str = "") -> dict:
    """title, text (a line for each block), metas [(name, content)] and links [(path, url, text)] of a page."""
    lines, words, title, metas, links = [], [], [], [], []
    in_title = False
    anchor: list | None = None  # [url, where its text begins]

    def put(raw: str) -> None:
        if raw:
            text = _SPACES.sub(" ", html.unescape(raw) if "&" in raw else raw)
            (title if in_title else words).append(text)

    def line() -> None:
        nonlocal words
        if words:
            text = _SPACES.sub(" ", "".join(words)).strip()
            if text:
                lines.append(text)
            words = []

    def close_anchor() -> None:
        nonlocal anchor
        if anchor is not None:
            url, n, k = anchor
            text = "".join(words[k:]) if len(lines) == n else " ".join([*lines[n:], "".join(words)])
            links.append(("A@/href", url, _SPACES.sub(" ", text).strip()))
            anchor = None

    def resolved(url: str) -> str:
        try:
            return urljoin(base, url.strip())
        except ValueError:
            return url.strip()

    at = 0
    for m in _TOKEN.finditer(page):
        raw, inside, closing, name, rest, closed = m.groups()
        if name and not closed:
            continue
        put(page[at : m.start()])
        at = m.end()
        if raw:
            if raw.lower() == "script" and "src" in (attrs := _attributes(inside)):
                links.append(("SCRIPT@/src", resolved(attrs["src"]), ""))
            continue
        if not name:
            continue
        name = name.lower()
        if name == "title":
            line()
            in_title = not closing
            continue
        if name in _BLOCK:
            if name != "br" or words:
                line()
        if name == "a":
            close_anchor()
        if closing:
            continue
        if name in _LINKED and "=" in rest:
            attrs = _attributes(rest)
            if (url := attrs.get(_LINKED[name])) is not None:
                if name == "a":
                    anchor = [resolved(url), len(lines), len(words)]
                else:
                    links.append((f"{name.upper()}@/{_LINKED[name]}", resolved(url), attrs.get("alt", attrs.get("rel", ""))))
        elif name == "meta" and rest:
            attrs = _attributes(rest)
            if key := attrs.get("name") or attrs.get("property") or attrs.get("http-equiv") or ("charset" if "charset" in attrs else ""):
                metas.append((key, attrs.get("content", attrs.get("charset", ""))))
        elif name == "base" and "=" in rest and (url := _attributes(rest).get("href")):
            base = resolved(url)
    put(page[at:])
    close_anchor()
    line()
    return {"title": _SPACES.sub(" ", "".join(title)).strip(), "text": "\n".join(lines), "metas": metas, "links": links}
