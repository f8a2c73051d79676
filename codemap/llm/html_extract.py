"""Main text of web pages by wrapper induction.

1. Every page is parsed into a tree of block elements; runs of siblings with the same tag and classes, and of equal groups of such
   siblings, are one repeated node, so a tree is small however long the page is (its skeleton).
2. Pages of a host with the same possible content (copies, crawls, mirrors) are one page from here on. Each host's reference
   is its most frequent skeleton. The tree of every different page of the host is aligned to it by simple tree matching
   (matched nodes have equal keys; children are matched in order).
3. Every different page votes once for the texts of its nodes. A text that a node has in at least ``min_share`` of the
   pages that have the node, and in ``min_pages`` of them, is constant: template. Varying slots are content.
4. A page's text is what stands in its article (else its body) without template texts and without elements whose
   tag, role or class says that they are no content (menus, headers, footers, asides, notices, adverts, forms, comments). Inside an article a class or id
   only counts if it says nothing else ("ad-box", not "social-history"); headings are never judged by theirs.

Steps 1 to 3 keep only skeletons and hashes; copies and votes are merged before they are shuffled. The pages themselves are moved once,
to meet their host's template; a host with very many pages is split there by adaptive execution.
"""
from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, map_batches, rows

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong "
                   "sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object select button textarea svg math canvas audio video head title "
                    "dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class and id names that mark what is no content.
_MARKS = re.compile(
    r"(^|[^a-z])(nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-?bar|aside|footer|foot|masthead|topbar|banner|advert|adverts|advertisement|ads?|adsense|"
    r"ad-?(slot|box|unit|container|wrapper|banner)|promo|promoted|promotion|sponsor|sponsored|cookies?|consent|gdpr|notice|notification|popup|pop-?over|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommended|recommendations|read-?more|comments?|comment-?(list|section|form|area|thread)|"
    r"disqus|replies|respond|pagination|pager|paging|toolbar|skip-?link|widget|hidden|visually-hidden|sr-only|site-?header|page-?header|search-?(box|form))($|[^a-z])")
#: Inside an article a name counts only if it says nothing else: all its parts are marks or words for a kind of box.
_PARTS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar banner advert adverts advertisement ad ads adsense promo promoted promotion "
                   "sponsor sponsored cookie cookies consent gdpr notice notification popup popover modal overlay newsletter subscribe subscription signup login share sharing social related "
                   "recommended recommendations comment comments disqus replies respond pagination pager paging toolbar widget hidden visually sr only search".split())
_BOXES = frozenset("box slot unit container wrapper wrap section list area thread form block bar inner outer panel links buttons button icons posts articles stories items site page left right top bottom".split())
_OUTSIDE_MARKS = re.compile(r"(^|\s)header($|\s)")
_NEGATED = re.compile(r"\b(has|no|with|without|hide|show)-[a-z-]+")
_OTHER_ARTICLES = frozenset("comment reply related teaser promo ad advert sponsored".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
           "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Skeletons reach to this depth, because they are matched recursively: elements below share the node above them. Pages are parsed to any depth.
MAX_DEPTH = 150
#: Most siblings of a group whose repetitions are one group of the skeleton.
GROUP = 8


def _only_marks(name: str) -> bool:
    """Whether every part of a class or id name is a mark or a word for a box, and one is a mark."""
    parts = [p for p in name.split("-") if p and not p.isdigit()]
    return any(p in _PARTS for p in parts) and all(p in _PARTS or p in _BOXES for p in parts)


class Node:
    __slots__ = ("tag", "key", "children", "dropped", "article", "number", "heading", "form")

    def __init__(self, tag, key, dropped, article, heading=False, form=False):
        self.tag, self.key, self.children, self.dropped, self.article, self.number, self.heading, self.form = tag, key, [], dropped, article, 0, heading, form


class Page(HTMLParser):
    """Blocks (node, text) of a page in order, and its tree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, 0)
        self.stack, self.blocks, self.parts, self.linked, self.articles, self.mains = [self.root], [], [], 0, 0, 0
        self.link_depth, self.total = 0, 0
        self.open: Counter = Counter()  # tags on the stack
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1], text, self.linked >= 0.9 * self.total))
            self.parts, self.linked, self.total = [], 0, 0

    def handle_data(self, data):
        self.parts.append(data)
        n = len(data)
        self.total += n
        if self.link_depth:
            self.linked += n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("br", "hr"):
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if not (attrs and self._hidden(tag, attrs, self.stack[-1].article != 0)):
                self.link_depth += tag == "a"
                return
        if tag == "br":
            self.parts.append(" ")
            return
        self._flush()
        if tag in VOID:
            return
        self._imply(tag)
        up = self.stack[-1]
        names = " ".join((v or "") for k, v in attrs if k == "class") if attrs else ""
        key = tag + "." + re.sub(r"\d+", "", names).strip().lower() if names else tag
        inside = up.article
        form = up.form or tag == "form" and not inside  # a form may be the frame of the whole page: see content()
        dropped = up.dropped and tag != "main" or tag in DROPPED and not (tag == "form" and not inside) or bool(attrs) and self._hidden(tag, attrs, inside != 0)
        dropped = dropped or not inside and _OUTSIDE_MARKS.search(names.lower()) is not None
        heading = up.heading
        if tag == "header":
            heading = True  # in an article its headings stay; elsewhere nothing
            dropped = dropped or not inside
        elif heading and tag not in _HEADINGS and tag not in ("div", "hgroup"):
            dropped = True
        if not inside and not dropped:
            roles = {k: (v or "").lower() for k, v in attrs} if attrs else {}
            if tag == "article" or roles.get("itemprop") == "articlebody":
                self.articles += 1
                inside = self.articles
            elif tag == "main" or roles.get("role") == "main":
                self.mains += 1
                inside = -self.mains
        elif inside < 0 and tag == "article" and not dropped:
            self.articles += 1
            inside = self.articles
        node = Node(tag, key, dropped, inside, heading, form and not inside)
        up.children.append(node)
        self.stack.append(node)
        self.open[tag] += 1
        self.link_depth = 0 if tag not in ("li", "td") else self.link_depth

    @staticmethod
    def _hidden(tag, attrs, inside):
        """Whether an element's attributes say that it is no content; ``inside`` an article or main element, names must say nothing else."""
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return any(k == "class" and _OTHER_ARTICLES.intersection((v or "").lower().split()) for k, v in attrs)
        for k, v in attrs:
            v = (v or "").lower()
            if k in ("class", "id"):
                if tag in _HEADINGS:  # headings are named after what they say
                    continue
                names = _NEGATED.sub("", v.replace("_", "-"))
                if any(_only_marks(name) for name in names.split()) if inside else _MARKS.search(names):
                    return True
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ROLES or k == "style" and re.search(r"display\s*:\s*none", v):
                return True
        return False

    def _cut(self, at):
        """Close the elements from a place of the stack on."""
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _imply(self, tag):
        """Close what a start tag closes."""
        if tag not in INLINE and self.stack[-1].tag == "p":
            self._cut(-1)
        closes = _CLOSES.get(tag)
        if closes and any(self.open[c] for c in closes):
            scope = _SCOPES.get(tag, ("table",))
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in scope:
                    break
                if self.stack[i].tag in closes and (tag in _SCOPES or tag == "option" or self.stack[i].tag != "tr" or tag != "td"):
                    self._cut(i)
                    break

    def handle_endtag(self, tag):
        if tag in INLINE:
            if self.stack[-1].tag != tag:  # else it was opened as an element of its own, because it is hidden
                self.link_depth -= tag == "a" and self.link_depth > 0
                return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        for i in range(len(self.stack) - 1 if self.open[tag] else 0, 0, -1):
            if self.stack[i].tag == tag:
                self._flush()
                self._cut(i)
                return
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and self.stack[i].tag in ("article", "main", "section", "div", "nav", "table", "ul", "ol", "dl", "body"):
                break
        self._flush()

    def content(self) -> tuple[list, bool]:
        """The blocks that may be content, and whether they stand in an article or main element."""
        size: Counter = Counter()
        for node, text, _ in self.blocks:
            if not node.dropped and node.article:
                size[node.article] += len(text)
        articles = {a: n for a, n in size.items() if a > 0}
        if articles:
            chosen = {max(articles, key=lambda a: (articles[a], -a))}
        elif size:
            chosen = set(size)
        else:
            blocks = [b for b in self.blocks if not b[0].dropped and not (b[2] and b[0].tag == "li")]
            framed = sum(len(text) for node, text, _ in blocks if node.form)
            if 2 * framed <= sum(len(text) for _, text, _ in blocks):  # else a form is the frame of the page
                blocks = [b for b in blocks if not b[0].form]
            return blocks, False
        return [b for b in self.blocks if not b[0].dropped and b[0].article in chosen], True


def _merged(children: list) -> list[list]:
    """Siblings in groups that are one node of the skeleton: runs of equal keys, and the members of repeated groups of up to GROUP runs, merged place by place."""
    out: list[list] = []
    for child in children:
        if out and out[-1][0].key == child.key:
            out[-1].append(child)
            continue
        out.append([child])
        for p in range(2, min(GROUP, len(out) // 2) + 1):
            # a group is complete when the next one begins, with its first key; so what repeats is looked for before the new run
            if len(out) > 2 * p and all(out[-1 - i][0].key == out[-1 - i - p][0].key for i in range(1, p + 1)):
                for i in range(1, p + 1):
                    out[-1 - i - p] += out[-1 - i]
                del out[-1 - p:-1]
                break
    for p in range(2, min(GROUP, len(out) // 2) + 1):
        if all(out[-i][0].key == out[-i - p][0].key for i in range(1, p + 1)):
            for i in range(1, p + 1):
                out[-i - p] += out[-i]
            del out[-p:]
            break
    return out


def skeleton(root: Node) -> list:
    """[key, children...] with runs of equal siblings, and of equal groups of siblings, merged; numbers the nodes in preorder. Elements below MAX_DEPTH get the number of the node there."""
    count = 0

    def build(nodes, depth=0):
        nonlocal count
        for n in nodes:
            n.number = count
        count += 1
        out = [nodes[0].key]
        if depth == MAX_DEPTH:
            below = [c for n in nodes for c in n.children]
            while below:
                n = below.pop()
                n.number = nodes[0].number
                below += n.children
            return out
        for group in _merged([c for n in nodes for c in n.children]):
            out.append(build(group, depth + 1))
        return out

    return build([root])


class _Match:
    """Simple tree matching of two skeletons. Equal subtrees have one number, and a pair of numbers is scored once."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.keys, self.parts, self.sizes, self.scored = [], [], [], {}

    def intern(self, tree: list) -> int:
        parts = tuple(self.intern(t) for t in tree[1:])
        found = self.number.setdefault((tree[0], parts), len(self.keys))
        if found == len(self.keys):
            self.keys.append(tree[0])
            self.parts.append(np.array(parts, np.int64))
            self.sizes.append(1 + sum(self.sizes[p] for p in parts))
        return found

    def score(self, x: int, y: int) -> int:
        """Number of pairs of a largest matching of two trees with equal roots; 0 if the roots differ."""
        if x == y:
            return self.sizes[x]
        if self.keys[x] != self.keys[y]:
            return 0
        if (x, y) not in self.scored:
            xs, ys = self.parts[x], self.parts[y]
            at, end = self.trimmed(xs, ys)
            ends = sum(self.sizes[t] for t in xs[:at].tolist()) + sum(self.sizes[t] for t in xs[len(xs) - end:].tolist())
            xs, ys = xs[at:len(xs) - end], ys[at:len(ys) - end]
            self.scored[x, y] = 1 + ends + int(self.row(xs, ys)[-1])
        return self.scored[x, y]

    @staticmethod
    def trimmed(xs: np.ndarray, ys: np.ndarray) -> tuple[int, int]:
        """How many first and last trees are equal: some largest matching pairs them. The last ones go first: of equal matchings, the latest places are taken."""
        n = min(len(xs), len(ys))
        end = int(np.argmax(np.append((xs[len(xs) - n:] != ys[len(ys) - n:])[::-1], True)))
        n -= end
        return int(np.argmax(np.append(xs[:n] != ys[:n], True))), end

    def row(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """For every number of first ys, the score of the best order-preserving matching with xs; memory for one row."""
        best = np.zeros(len(ys) + 1, np.int64)
        if not len(xs) or not len(ys):
            return best
        kinds, place = np.unique(ys, return_inverse=True)
        scores = {x: np.array([self.score(x, y) for y in kinds.tolist()], np.int64)[place] for x in np.unique(xs).tolist()}
        for x in xs.tolist():
            best[1:] = np.maximum(best[1:], best[:-1] + scores[x])
            np.maximum.accumulate(best, out=best)
        return best

    def align(self, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
        """Places of the trees that a largest matching pairs, by halves (Hirschberg), so no table of all pairs is kept."""
        at, end = self.trimmed(xs, ys)
        pairs = [(i, i) for i in range(at)] + [(len(xs) - i, len(ys) - i) for i in range(end, 0, -1)]
        xs, ys = xs[at:len(xs) - end], ys[at:len(ys) - end]
        if not len(xs) or not len(ys):
            return pairs
        if len(xs) == 1:
            scores = [self.score(int(xs[0]), y) for y in ys.tolist()]
            j = len(scores) - 1 - int(np.argmax(scores[::-1]))
            inner = [(0, j)] if scores[j] else []
        else:
            half = len(xs) // 2
            ahead, behind = self.row(xs[:half], ys), self.row(xs[half:][::-1], ys[::-1])[::-1]
            cut = len(ys) - int(np.argmax((ahead + behind)[::-1]))
            inner = self.align(xs[:half], ys[:cut]) + [(i + half, j + cut) for i, j in self.align(xs[half:], ys[cut:])]
        return sorted(pairs + [(i + at, j + at) for i, j in inner])


def tree_match(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching of two skeletons: pairs of preorder numbers of a largest order-preserving matching."""
    match, pairs = _Match(), []
    todo = [(match.intern(a), match.intern(b), 0, 0)]
    while todo:
        x, y, at_x, at_y = todo.pop()
        if x == y:
            pairs += [(at_x + i, at_y + i) for i in range(match.sizes[x])]
        elif match.keys[x] == match.keys[y]:
            pairs.append((at_x, at_y))
            xs, ys = match.parts[x], match.parts[y]
            from_x, from_y = ([at + 1, *(at + 1 + np.cumsum([match.sizes[t] for t in parts.tolist()], dtype=np.int64)).tolist()] for at, parts in ((at_x, xs), (at_y, ys)))
            todo += [(int(xs[i]), int(ys[j]), from_x[i], from_y[j]) for i, j in match.align(xs, ys)]
    return sorted(pairs)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


class Aligner:
    """Node numbers of a page's skeleton in its host's reference; one entry for each pair of skeletons."""

    def __init__(self, limit: int = 20_000):
        self.known, self.limit = {}, limit

    def __call__(self, own: str, reference: str) -> dict[int, int]:
        if (own, reference) not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            a = json.loads(own)
            self.known[own, reference] = dict(tree_match(a, a if own == reference else json.loads(reference)))
        return self.known[own, reference]


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; null if there is none."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(authority != "", authority)


def _dump(tree: list) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


def nodes_of(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, content, skeleton, nodes, hashes) of every page with a host: digest and hashes of its possible content blocks, and its skeleton."""
    def run(batches):
        for batch in batches:
            out = []
            for h, html in rows(batch, "host", "html"):
                page = Page(html or "")
                tree = _dump(skeleton(page.root))
                placed = [(b[0].number, _hash(b[1])) for b in page.content()[0]]
                seen = sorted(set(placed))
                content = xxhash.xxh3_128_digest(np.array([x for _, x in placed], np.int64).tobytes())
                out.append({"host": h, "content": content, "skeleton": tree, "nodes": [n for n, _ in seen], "hashes": [x for _, x in seen]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("content", pa.binary()), ("skeleton", pa.string()), ("nodes", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))]))

    source = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host is not null")
    return map_batches(source, run, "host string, content binary, skeleton string, nodes array<int>, hashes array<long>")


def different(pages: DataFrame) -> DataFrame:
    """(host, skeleton, nodes, hashes), one row for all pages of a host with equal content; the smallest skeleton stands for them."""
    one = pages.groupBy("host", "content").agg(F.min(F.struct("skeleton", "nodes", "hashes")).alias("page"))
    return one.select("host", "page.skeleton", "page.nodes", "page.hashes")


def templates(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html", min_share: float = 0.9, min_pages: int = 5) -> DataFrame:
    """(host, reference, nodes, hashes): each host's reference skeleton and its constant texts."""
    seen = scratch.keep(different(nodes_of(pages, url_col, html_col)), "nodes")
    common = seen.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    reference = common.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "skeleton")).alias("best"), F.sum("n").alias("pages"))
    reference = scratch.keep(reference.select("host", F.col("best.skeleton").alias("reference"), "pages"), "reference")

    def vote(batches):
        align = Aligner()
        for batch in batches:
            votes = Counter()
            for h, own, ref, nodes, hashes in rows(batch, "host", "skeleton", "reference", "nodes", "hashes"):
                to = align(own, ref)
                placed = {(to[n], x) for n, x in zip(nodes, hashes) if n in to}
                votes.update((h, n, x) for n, x in placed)
                votes.update((h, n, -1) for n in {n for n, _ in placed})  # a page that has the node
            cols = list(zip(*votes)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(list(votes.values()), pa.int64())],
                                  names=["host", "node", "hash", "n"])

    votes = (map_batches(seen.join(reference.filter(F.col("pages") >= min_pages), "host"), vote, "host string, node int, hash long, n long")
             .groupBy("host", "node", "hash").agg(F.sum("n").alias("n")))
    votes = scratch.keep(votes.filter(F.col("n") >= min_pages), "votes")
    having = votes.filter("hash = -1").select("host", "node", F.col("n").alias("having"))
    constant = votes.filter("hash <> -1").join(having, ["host", "node"]).filter(F.col("n") >= min_share * F.col("having"))
    lists = constant.groupBy("host").agg(F.collect_list("node").alias("nodes"), F.collect_list("hash").alias("hashes"))
    return scratch.keep(lists.join(reference, "host").select("host", "reference", "nodes", "hashes"), "templates")


def page_text(html: str | None, template: tuple | None = None, align: Aligner | None = None) -> tuple[str, int]:
    """A page's main text and the number of blocks dropped as template; template: (reference, {(node, hash)})."""
    page = Page(html or "")
    blocks, _ = page.content()
    if not template:
        return " ".join(text for _, text, _ in blocks), 0
    to = (align or Aligner())(_dump(skeleton(page.root)), template[0])
    kept = [text for node, text, _ in blocks if (to.get(node.number), _hash(text)) not in template[1]]
    return " ".join(kept), len(blocks) - len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = 0.9, min_pages: int = 5) -> DataFrame:
    """(id_col, url, text, n_chars, n_template) of every row of pages.

    A null html gives an empty text; a null or unparsable url has no host and so no template. Hosts with fewer than
    min_pages different pages have none either. Repeated rows repeat, an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    found = templates(pages, scratch, url_col, html_col, min_share, min_pages)
    source = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))

    def run(batches):
        align, known = Aligner(), {}
        for batch in batches:
            texts, dropped = [], []
            for html, h, ref, nodes, hashes in rows(batch, "html", "host", "reference", "nodes", "hashes"):
                if ref is not None and h not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    known[h] = ref, set(zip(nodes, hashes))
                text, n = page_text(html, known[h] if ref is not None else None, align)
                texts.append(text)
                dropped.append(n)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lengths), pa.array(dropped, pa.int64())],
                                  names=[id_col, "url", "text", "n_chars", "n_template"])

    joined = source.join(found, "host", "left").select(id_col, "url", "html", "host", "reference", "nodes", "hashes")
    return map_batches(joined, run, f"`{id_col}` long, url string, text string, n_chars long, n_template long")
