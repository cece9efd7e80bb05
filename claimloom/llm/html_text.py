"""HTML extraction: pages vote for generalised tag-class paths of their host, then winning paths are extracted."""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut_slim, fresh

NAME = re.compile(r"(/?)([a-z][a-z0-9:-]*)", re.IGNORECASE)
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""([a-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NUMBERS = re.compile(r"\d+")
LONG_REFERENCE = re.compile(r"&#(?:([xX])([0-9a-fA-F]{8,})|([0-9]{8,}));?")

#: HTML elements by role. What is in RAW is no text of the page.
RAW = frozenset("script style textarea title noscript iframe template svg select noframes xmp".split())
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
BOILERPLATE = frozenset("nav header footer aside form button dialog menu input fieldset object audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div article section main body aside nav".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Elements whose names never make them noise: the page itself, and what only articles use.
UNNAMED = frozenset("html body article main blockquote pre code h1 h2 h3 h4 h5 h6".split()) | MATH
#: Words in classes, ids and roles that name what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies copyright disqus footer header hidden "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related reply replies respond share sharing sidebar "
    "social sponsor sponsored subscribe subscription toolbar tooltip widget widgets contentinfo complementary search alertdialog dialog skip gdpr consent".split()
)
#: Words after which a noise word in the same name says what a page is about or has not.
TURNED = frozenset("has no with without category tag".split())
#: Paths that a page votes for.
VOTES = 3
#: What a container's text counts inside a node that is kept in spite of its name.
WEAK = 0.25


class Node:
    __slots__ = ("children", "depth", "holder", "named", "noisy", "parent", "path", "scope", "tag", "weak")

    def __init__(self, tag: str, parent: Node | None, path: int, noisy: bool, named: bool = False) -> None:
        self.depth: int = parent.depth + 1 if parent else 0
        self.scope: int = self.depth if tag in SCOPES else parent.scope if parent else 0  # depth of the nearest of SCOPES
        self.tag, self.parent, self.path, self.noisy, self.named, self.weak, self.children = tag, parent, path, noisy, named, False, []
        self.holder: Node | None = self if tag in CONTAINERS else parent and parent.holder  # the nearest container


class Paths:
    """The generalised tag-class paths of a page by number; each is known by the path above it and one step."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(0, "")]

    def number(self, above: int, step: str) -> int:
        found = self.numbers.setdefault((above, step), len(self.steps))
        if found == len(self.steps):
            self.steps.append((above, step))
        return found

    def text(self, number: int) -> str:
        steps = []
        while number:
            number, step = self.steps[number]
            steps.append(step)
        return ">".join(["", *reversed(steps)])

    def find(self, path: str) -> int | None:
        number: int | None = 0
        for step in path.split(">")[1:]:
            number = None if number is None else self.numbers.get((number, step))
        return number


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, tag in lower case, what follows the tag's name) of the page's markup, each character read once.

    Comments, declarations and RAW elements with their content have no tag. A quote that never ends does not hide the end
    of its tag, and a tag that the page's end cuts is markup."""
    at, size = 0, len(page)
    ends = dict.fromkeys("\"'", True)  # whether a further quote of this kind may follow
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        if page.startswith("!--", at):
            stop = page.find("-->", at + 3)
            at = size if stop < 0 else stop + 3
            yield begin, at, "", "", ""
            continue
        name = NAME.match(page, at)
        if not name:
            if at < size and page[at] in "!?/":
                stop = page.find(">", at)
                at = size if stop < 0 else stop + 1
                yield begin, at, "", "", ""
            continue
        at = PLAIN.match(page, name.end()).end()
        while at < size and page[at] != ">":
            stop = page.find(page[at], at + 1) if ends[page[at]] else -1
            if stop < 0:
                ends[page[at]] = False
                stop = page.find(">", at)
                at = size if stop < 0 else stop
                break
            at = PLAIN.match(page, stop + 1).end()
        rest, tag = page[name.end() : at], name[2].lower()
        at = min(at + 1, size)
        if tag in RAW and not name[1]:
            close = re.compile(rf"</{tag}(?![a-z0-9:-])", re.IGNORECASE).search(page, at)
            stop = page.find(">", close.end()) if close else -1
            at = size if stop < 0 else stop + 1
            tag = ""
        yield begin, at, name[1], tag, rest


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def noise_named(value: str) -> bool:
    """Whether a part of a name is a noise word that no word before it turns."""
    for name in value.lower().split():
        for part in re.split(r"[_-]+", name):
            if part in TURNED:
                break
            if part in NOISE:
                return True
    return False


def settle(root: Node) -> None:
    """Make named nodes noise, with what is below them, but for those that hold over half of the page's unlinked text
    while no article or main, nor what stands beside an h1, holds a tenth of it outside named nodes. Those are kept, and
    weigh less."""
    order, stack, hidden = [], [(root, False, False)], set()
    while stack:
        x, link, named = stack.pop()
        if x.noisy or x.tag == "head":
            continue
        if named or x.named:
            hidden.add(id(x))
        order.append((x, link or x.tag == "a"))
        stack.extend((c, link or x.tag == "a", named or x.named) for c in reversed(x.children) if isinstance(c, Node))
    length: dict[int, int] = {}
    free: dict[int, int] = {}
    for x, link in reversed(order):
        own = 0 if link else sum(len(c.strip()) for c in x.children if isinstance(c, str))
        length[id(x)] = own + sum(length.get(id(c), 0) for c in x.children if isinstance(c, Node))
        free[id(x)] = 0 if id(x) in hidden else own + sum(free.get(id(c), 0) for c in x.children if isinstance(c, Node))
    total, rest = length[id(root)], free[id(root)]
    held = (rest - free[id(x)] if x.tag == "h1" else free[id(x)] for x, _ in order if x.tag in ("h1", "article", "main") and free[id(x)])
    elsewhere = any(10 * n >= total for n in held)
    for x, _ in order:
        x.weak = x.parent is not None and x.parent.weak
        if x.named:
            x.noisy = elsewhere or 2 * length[id(x)] <= total
            x.weak = x.weak or not x.noisy


def decoded(text: str) -> str:
    """The text with its character references decoded; a number beyond Unicode, however long, is U+FFFD."""

    def shorter(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0") or "0"
        return f"&#{m[1] or ''}{digits};" if len(digits) <= 7 else "\ufffd"

    return html.unescape(LONG_REFERENCE.sub(shorter, text)) if "&" in text else text


def parse(page: str | None, by_name: bool = True) -> tuple[Node, Paths]:
    """The page's tree and its paths. Scripts and comments are left out, a new paragraph closes an open one, ends without a
    start are ignored, and what a cut page leaves open stays open. Paths generalise numbers and have no element ids. If not
    by_name, classes, ids and roles make no node noise. A header is the page's unless an article or main is open. Open
    nodes are kept by tag, so that no tag costs a walk."""
    root = at = Node("", None, 0, False)
    page, paths = page or "", Paths()
    last, any_named = 0, False
    opened: defaultdict[str, list[Node]] = defaultdict(list)

    def add(text: str) -> None:
        if text:
            at.children.append(decoded(text))

    def leave(node: Node) -> Node:
        """Close what is open up to the node, and it too."""
        x = at
        while x is not node.parent:
            opened[x.tag].pop()
            x = x.parent
        return x

    for begin, end, slash, tag, rest in tokens(page):
        add(page[last:begin])
        last = end
        if not tag:
            continue
        if slash:
            node = opened[tag][-1] if opened[tag] else None
            if node and not (tag in INLINE and at.scope > node.depth):
                at = leave(node)
            elif tag == "p":
                at.children.append(Node("p", at, paths.number(at.path, "p"), False))
            continue
        over = (*SIBLINGS.get(tag, ()), *(("p",) if tag in CLOSES_P else ()))
        inside = [opened[x][k] for x in over if (k := bisect.bisect_right(opened[x], at.scope, key=lambda n: n.depth)) < len(opened[x])]
        at = leave(min(inside, key=lambda n: n.depth)) if inside else at
        found = attributes(rest) if rest and not rest.isspace() else {}
        noisy = tag in BOILERPLATE and not (tag == "header" and (opened["article"] or opened["main"])) or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
        named = by_name and tag not in UNNAMED and any(noise_named(found[k]) for k in ("class", "id", "role") if k in found)
        step = ".".join([tag, *sorted({NUMBERS.sub("#", c) for c in found.get("class", "").lower().replace(">", "").split()})])
        node = Node(tag, at, paths.number(at.path, step), noisy, named)
        any_named = any_named or named
        at.children.append(node)
        if tag not in VOID and not rest.endswith("/"):
            at = node
            opened[tag].append(node)
    add(page[last:])
    if any_named:
        settle(root)
    return root, paths


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, without what is noise below it."""
    out, held = [], []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x is node or not x.noisy and x.tag != "head":
            if x.tag == "br":
                held.append(" ")
            elif x.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def nodes(root: Node) -> list[Node]:
    """All nodes outside noise, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.noisy and x.tag != "head":
            out.append(x)
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def container_scores(root: Node, paths: Paths) -> list[tuple[str, float]]:
    """(path, score) of the page's VOTES best containers. A container scores the characters of the blocks that it holds,
    less those of links, halved for each container in between; article and main count double."""
    score: dict[int, float] = {}
    kept: dict[int, Node] = {}
    for node in nodes(root):
        if node.tag in INLINE or node is root:
            continue
        own = linked = 0
        stack = [(c, False) for c in node.children]
        while stack:
            x, link = stack.pop()
            if isinstance(x, str):
                n = len(x.strip())
                own, linked = own + n, linked + n * link
            elif x.tag in INLINE and not x.noisy:
                stack.extend((c, link or x.tag == "a") for c in x.children)
        gain, up = float(own - 2 * linked) * (WEAK if node.weak else 1), node.holder
        while gain > 0.5 and up is not None:
            kept[id(up)] = up
            score[id(up)] = score.get(id(up), 0.0) + gain * (2 if up.tag in ("article", "main") else 1)
            gain /= 2
            up = up.parent.holder
    out: dict[int, float] = {}
    for k, node in kept.items():
        out[node.path] = max(out.get(node.path, 0.0), score[k])
    least = sorted(out.values(), reverse=True)[:VOTES][-1:]
    return sorted(((paths.text(path), x) for path, x in out.items() if x >= least[0]), key=lambda x: (-x[1], x[0]))[:VOTES]


def extract_text(page: str | None, path: str | None) -> str:
    """The text of the page's nodes at the path, or of its own best container where the path has no text; where nothing
    at all is left, the same without noise by name."""
    return text_at(*parse(page), path) or text_at(*parse(page, by_name=False), path)


def text_at(root: Node, paths: Paths, path: str | None) -> str:

    def at(wanted: int | None) -> list[str]:
        found, inside = [], set()
        for node in nodes(root) if wanted is not None else ():
            if id(node.parent) in inside or node.path == wanted:
                inside.add(id(node))
                if id(node.parent) not in inside:
                    found += blocks(node)
        return found

    out = at(paths.find(path)) if path else []
    if not out:
        best = container_scores(root, paths)
        out = at(paths.find(best[0][0])) if best else blocks(root)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The host in lower case without port and user; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_votes(page: Column) -> Column:
    """The page's best paths as array<struct(path, share)>, with shares of the best score."""

    @F.pandas_udf("array<struct<path:string,share:double>>")
    def udf(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            found = container_scores(*parse(p))
            out.append([{"path": path, "share": s / found[0][1]} for path, s in found])
        return pd.Series(out)

    return udf(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """pages with a column text, the main text: id, url and html columns and all others stay.

    Every page votes for its best containers; a host's path is that with the most votes (of equal ones the first
    in order). The winners are broadcast only if they are at most broadcast_hosts, else joined by host. Null and
    empty pages give empty texts; pages without a host share the empty host; repeated rows vote and stay.
    """
    pages = pages.drop("text")
    host, path, vote, votes_of, first_of = fresh(pages, "host", "path", "vote", "votes", "first")
    votes = pages.select(host_of(F.col(url_col)).alias(host), F.explode(page_votes(F.col(html_col))).alias(vote))
    sums = votes.groupBy(host, F.col(f"{vote}.path").alias(path)).agg(F.sum(f"{vote}.share").alias(votes_of))
    first = F.min(F.struct((-F.round(votes_of, 6)).alias("rank"), F.col(path).alias("path")))
    winners = cut_slim(sums.groupBy(host).agg(first.alias(first_of)).select(host, F.col(f"{first_of}.path").alias(path)))
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    joined = pages.withColumn(host, host_of(F.col(url_col))).join(winners, host, "left")

    @F.pandas_udf("string")
    def text(found: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([extract_text(p, path) for p, path in zip(found, paths, strict=True)], dtype=object)

    return joined.withColumn("text", text(F.col(html_col), F.col(path))).drop(host, path)
