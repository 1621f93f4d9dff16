"""HTML functions on the standard library's parser, batched through Arrow.

Trees exist only inside a batch; results are plain strings and arrays.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin as join_urls

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import FILE_URL_WORDS, JUNK_CLASSES

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
JUNK = re.compile("|".join(JUNK_CLASSES), re.IGNORECASE)


class Node:
    """An element with its attributes, children and parent; text is a child string.

    The parent is held weakly, so that a tree is freed with its root and not when cycles are looked for.
    """

    __slots__ = ("__weakref__", "_parent", "attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self._parent = name, attrs, None if parent is None else weakref.ref(parent)
        self.children: list[Node | str] = []

    @property
    def parent(self) -> Node | None:
        return None if self._parent is None else self._parent()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.name in names]

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.name in names), None)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack.extend(reversed(x.children))

    def text(self, joint: str) -> str:
        return joint.join(t for t in (s.strip() for s in self.strings()) if t)

    def remove(self, drop) -> None:
        """Drop the descendants that a predicate names."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if isinstance(c, str) or not drop(c)]
            stack.extend(c for c in node.children if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def is_junk(n: Node) -> bool:
    return bool(JUNK.search(f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}".strip()))


def without_junk(root: Node) -> Node:
    dropped = frozenset("script style noscript svg canvas iframe header footer nav aside form".split())
    root.remove(lambda n: n.name in dropped or is_junk(n))
    return root


def main_container(root: Node) -> Node:
    """The container with most text outside links, favouring those of many blocks; else article, main or body."""
    best, score = None, -1.0
    first = [n for n in root.walk() if n.name in ("article", "main") or n.attrs.get("role") == "main"]
    for n in first + root.find_all("section", "div"):
        length = len(n.text("\n"))
        if length < 400:
            continue
        links = sum(len(a.text(" ")) for a in n.find_all("a"))
        blocks = len(n.find_all("p", "h1", "h2", "h3", "h4", "li"))
        density = links / length
        value = max(length - links, 0) * (1 - min(density, 0.95)) * (1 + min(blocks, 60) / 12) * (0.25 if density > 0.55 else 1)
        if value > score:
            best, score = n, value
    return best or root.find("article") or root.find("main") or root.find("body") or root


NO_ARTICLE = frozenset("script style noscript svg canvas header footer nav aside".split())


def _article_text(root: Node) -> str:
    root.remove(lambda n: n.name in NO_ARTICLE)
    return (root.find("article") or root.find("main") or root.find("body") or root).text("\n")


def article_text(page: str | None) -> str:
    """F36. Text of the article, main or body element, one string a line."""
    return _article_text(parse(page))


def main_text(page: str | None) -> str:
    """F36. Text of the best container, one string a line."""
    return main_container(without_junk(parse(page))).text("\n")


def both_texts(page: str | None) -> tuple[str, str]:
    """F36. Article text and main text of one tree; what the first drops, the second drops too."""
    root = parse(page)
    return _article_text(root), main_container(without_junk(root)).text("\n")


def title(page: str | None) -> str:
    """P21. og:title, title or the first heading."""
    root = parse(page)
    for n in root.find_all("meta"):
        if n.attrs.get("property") == "og:title" and n.attrs.get("content"):
            return n.attrs["content"].strip()
    found = root.find("title") or root.find("h1")
    return found.text(" ") if found else ""


def outline(page: str | None) -> list[dict]:
    """G11, D7, O15. Numbered headings, paragraphs and items by number, each once."""
    seen, out = set(), []
    for n in main_container(without_junk(parse(page))).find_all("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "strong"):
        m = re.match(r"^\s*(\d{1,2})\.\s*(.+?)\s*$", " ".join(n.text(" ").split()))
        name = m[2].strip(" -:\t") if m else ""
        if name and len(name) <= 180 and (key := (int(m[1]), name.lower())) not in seen:
            seen.add(key)
            out.append({"order": key[0], "title": name})
    return sorted(out, key=lambda x: x["order"])


def file_links(page: str | None, base: str) -> list[str]:
    """G12, D8. Links and click targets that look like files, each once."""
    root, found = parse(page), []
    found += [n.attrs["href"] for n in root.find_all("a") if "href" in n.attrs]
    for n in root.walk():
        if m := re.search(r"""['"]([^'"]+)['"]""", n.attrs.get("onclick", "")):
            found.append(m[1])
    full = [join_urls(base, u) for u in found]
    return list(dict.fromkeys(u for u in full if u.startswith("http") and any(w in u.lower() for w in FILE_URL_WORDS)))


def best_of_srcset(value: str) -> str:
    """O16. The candidate of greatest width or density; of equals the greater URL."""
    best = None
    for part in value.split(","):
        tokens = part.split()
        if not tokens:
            continue
        size = 0.0
        if len(tokens) > 1:
            m = re.fullmatch(r"([0-9.]+)([wx])", tokens[1].lower())
            try:
                size = float(m[1]) * (10000.0 if m[2] == "x" else 1.0) if m else 0.0
            except ValueError:
                size = 0.0
        best = max(best or (size, tokens[0]), (size, tokens[0]))
    return best[1] if best else ""


def background_urls(style: str) -> list[str]:
    """F35."""
    return [u.strip() for u in re.findall(r"url\(\s*[\"']?([^\"')]+)[\"']?\s*\)", style or "", re.IGNORECASE) if u.strip()]


LAZY = ("src", "data-src", "data-lazy-src", "data-original", "data-url", "data-img-url")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "li")


def images(page: str | None, base: str) -> list[dict]:
    """G13, D8. Image candidates with alt, title and nearby text: page cards, img and picture elements, backgrounds."""
    root, found = parse(page), []

    def add(url: str | None, alt: str, name: str = "", nearby: str = "") -> None:
        full = join_urls(base, url.strip()) if url else ""
        if full.startswith(("http", "data:")):
            found.append({"img_url": full, "alt": alt, "title": name, "nearby_text": nearby})

    for n in root.find_all("meta"):
        if n.attrs.get("property") == "og:image":
            add(n.attrs.get("content"), "og:image")
    for n in root.find_all("meta"):
        if n.attrs.get("name") == "twitter:image":
            add(n.attrs.get("content"), "twitter:image")
    box = root.find("article") or root.find("main") or root.find("body") or root
    order = [n for n in root.walk()]
    place = {id(n): i for i, n in enumerate(order)}
    for n in box.find_all("img"):
        around = []
        up = n.parent
        while up is not None and up.name != "figure":
            up = up.parent
        if up is not None:
            around += [c.text(" ") for c in up.find_all("figcaption")[:1]] + [up.text(" ")]
        if n.parent is not None:
            around.append(n.parent.text(" "))
        before = next((x for x in reversed(order[: place[id(n)]]) if x.name in BLOCKS), None)
        after = next((x for x in order[place[id(n)] + 1 :] if x.name in BLOCKS), None)
        around += [x.text(" ") for x in (before, after) if x is not None]
        near = " ".join(" ".join(around).split())[:1200]
        alt, name = n.attrs.get("alt", "").strip(), n.attrs.get("title", "").strip()
        add(best_of_srcset(n.attrs.get("srcset") or n.attrs.get("data-srcset") or ""), alt, name, near)
        for key in LAZY:
            add(n.attrs.get(key), alt, name, near)
    for n in box.find_all("picture"):
        for s in n.find_all("source"):
            add(best_of_srcset(s.attrs.get("srcset") or s.attrs.get("data-srcset") or ""), "picture")
    for n in box.walk():
        for u in background_urls(n.attrs.get("style", "")):
            add(u, "background-image")
    return list({x["img_url"]: x for x in reversed(found)}.values())[::-1]


def _mapped(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def _mapped_with_base(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([f(a, b or "") for a, b in zip(s, base)], dtype=object)

    return run


def page_title(c: Column | str) -> Column:
    return _mapped(title, "string")(c)


def page_article_text(c: Column | str) -> Column:
    return _mapped(article_text, "string")(c)


def page_main_text(c: Column | str) -> Column:
    return _mapped(main_text, "string")(c)


def page_texts(c: Column | str) -> Column:
    """struct(article, main), each page parsed once."""

    @F.pandas_udf("struct<article:string,main:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([both_texts(page) for page in s], columns=["article", "main"])

    return run(c)


def page_outline(c: Column | str) -> Column:
    return _mapped(outline, "array<struct<order:int,title:string>>")(c)


def page_file_links(c: Column | str, base: Column | str) -> Column:
    return _mapped_with_base(file_links, "array<string>")(c, base)


def page_images(c: Column | str, base: Column | str) -> Column:
    return _mapped_with_base(images, "array<struct<img_url:string,alt:string,title:string,nearby_text:string>>")(c, base)


def srcset_best(c: Column | str) -> Column:
    """O16 as an expression: candidates as (size, URL), the greatest."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    size = lambda p: F.coalesce(F.regexp_extract(p, r"\s([0-9.]+)[wx]$", 1).try_cast("double") * F.when(p.endswith("x"), 10000.0).otherwise(1.0), F.lit(0.0))
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.struct(size(p).alias("s"), F.substring_index(p, " ", 1).alias("u"))))["u"], F.lit(""))


@F.pandas_udf(T.StringType())
def urljoin(base: pd.Series, url: pd.Series) -> pd.Series:
    """F33."""
    return pd.Series([join_urls(b or "", u or "") for b, u in zip(base, url)], dtype=object)


def unwrap_redirect(c: Column | str) -> Column:
    """F33. The target of a /url?q= link."""
    c = F.col(c) if isinstance(c, str) else c
    target = F.regexp_extract(c, r"^(?:https?://[^/]+)?/url\?(?:.*&)?q=([^&]*)", 1)
    return F.when(target != "", F.url_decode(target)).otherwise(c)


def extension_of_type(c: Column | str) -> Column:
    """F34. File extension of a content type."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    out = F
    for word, ext in (("png", ".png"), ("webp", ".webp"), ("gif", ".gif"), ("svg", ".svg"), ("jpeg", ".jpg"), ("jpg", ".jpg"), ("pdf", ".pdf")):
        out = out.when(t.contains(word), ext)
    return out.otherwise("")
