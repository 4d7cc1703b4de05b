"""HTML functions: clean text, titles, images, links and heading sections (F8, F15-F23), by one walk of the tree."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.arrow import by_rows

#: Elements and classes that are no content, classes of important images, sizes of image scores.
DROPPED = {"script", "style", "footer", "header", "nav", "menu", "sidebar", "svg"}
DROPPED_CLASSES = {"nav", "menu", "sidebar", "footer"}
IMAGE_CLASSES = {"header", "featured", "hero", "thumbnail", "main", "content"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self, clean: bool = False):
        """All below, in order, from a stack: unclosed elements nest far deeper than calls may."""
        left = self.children[::-1]
        while left:
            child = left.pop()
            if isinstance(child, str):
                yield child
            elif not (clean and (child.name in DROPPED or DROPPED_CLASSES & set(child.classes))):
                yield child
                left += child.children[::-1]

    def strings(self, clean: bool = False) -> list[str]:
        return [t for t in (s.strip() for s in self.walk(clean) if isinstance(s, str)) if t]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open = Counter()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while self.at.name != tag:
            self.open[self.at.name] -= 1
            self.at = self.at.parent
        self.open[tag] -= 1
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def dimension(value: str | None) -> int | None:
    """a number of pixels, without unit and fraction."""
    try:
        return int(float(re.sub(r"(?i)px$", "", value or "")))
    except ValueError:
        return None


def image_score(node: Node) -> int | None:
    """4 for an important class, 3 to 0 by size, 0 without sizes, None if too small."""
    if IMAGE_CLASSES & set(node.classes):
        return 4
    if not (node.attrs.get("width") and node.attrs.get("height")):
        return 0
    w, h = dimension(node.attrs["width"]), dimension(node.attrs["height"])
    if not (w and h):
        return 0
    for score, enough in ((3, w >= 2000 and h >= 1000), (2, w >= 1600 or h >= 800), (1, w >= 800 or h >= 500), (0, w >= 500 or h >= 300)):
        if enough:
            return score
    return None


def images(root: Node, url: str, most: int = 10) -> list[dict]:
    found = []
    for node in root.walk():
        if isinstance(node, Node) and node.name == "img" and "src" in node.attrs:
            src, score = urljoin(url, node.attrs["src"]), image_score(node)
            if score is not None and src.startswith(("http://", "https://")):
                found.append({"url": src, "score": score})
    return sorted(found, key=lambda i: -i["score"])[:most]


def links(root: Node, url: str) -> list[dict]:
    """text and absolute address of each link."""
    return [{"text": "".join(x for x in n.walk() if isinstance(x, str)), "href": urljoin(url, n.attrs["href"])} for n in root.walk() if isinstance(n, Node) and n.name == "a" and "href" in n.attrs]


def heading_sections(root: Node) -> list[str]:
    """F8: each heading with the text of its following siblings, up to the next heading among them."""
    out, places = [], {}
    for node in root.walk():
        if isinstance(node, Node) and node.name in HEADINGS:
            parts, siblings = [" ".join(node.strings())], node.parent.children
            if id(node) not in places:
                places |= {id(s): i for i, s in enumerate(siblings) if isinstance(s, Node)}
            for i in range(places[id(node)] + 1, len(siblings)):
                other = siblings[i]
                if isinstance(other, Node):
                    if other.name in HEADINGS:
                        break
                    parts.append(" ".join(other.strings()))
                else:
                    parts.append(other.strip())
            text = " ".join(p for p in parts if p)
            if text:
                out.append(text)
    return out


PAGE = "struct<text:string,title:string,images:array<struct<url:string,score:int>>,links:array<struct<text:string,href:string>>>"
_PAGE = pa.struct({"text": pa.string(), "title": pa.string(), "images": pa.list_(pa.struct({"url": pa.string(), "score": pa.int32()})), "links": pa.list_(pa.struct({"text": pa.string(), "href": pa.string()}))})


def read(html: str | None, url: str | None, clean: bool = True) -> dict:
    root = parse(html)
    title = next((n for n in root.walk() if isinstance(n, Node) and n.name == "title"), None)
    text = re.sub(r"\s{2,}", " ", "\n".join(root.strings(clean)))
    return {"text": text, "title": "".join(s for s in title.walk() if isinstance(s, str)) if title else "", "images": images(root, url or ""), "links": links(root, url or "")}


def page(html: Column, url: Column, clean: bool = True) -> Column:
    """Text, title, images and links of a page, parsed once, a few pages of an Arrow batch at a time."""
    return by_rows(partial(read, clean=clean), PAGE, _PAGE)(html, url)


def stripped(most: int = 50_000):
    """text of the first 2 * most characters, cut to ``most``."""

    return by_rows(lambda h: " ".join(parse((h or "")[: 2 * most]).strings())[:most], "string", pa.string())


def title(html: Column) -> Column:
    """F17 without a parser: the first title's text, empty without one."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def link_hosts(html: Column) -> Column:
    """Addresses of links without a parser."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), 1)


@F.pandas_udf(StringType())
def image_hash(url: pd.Series) -> pd.Series:
    """digest of the file's name and the address's url parameters."""
    import hashlib

    def digest(u):
        at = urlparse(u or "")
        return hashlib.md5((at.path.split("/")[-1] + "".join(parse_qs(at.query).get("url", []))).encode()).hexdigest()

    return url.map(digest)
