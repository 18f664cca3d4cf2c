"""Main text of HTML pages by tag-path ratios.

A page is parsed to blocks: runs of text between block-level tags, in page order, each with its
root-to-leaf path of block-level tags and their first class, and the prior of its elements. For
every path and prior, text length and punctuation are aggregated over the blocks; both ratios are
smoothed along the page, so that a short heading between paragraphs rises and a line of a menu does
not, and fused with the share of text outside links and with the prior. A path whose score reaches
THRESHOLD of the score of the weightiest path is chosen. The deepest element with most of the chosen
text is the article; in it, and in article elements beside it, a path needs INSIDE of that score
only, as tables, captions and headings are short. Outside it chosen paths and headings stay, unless
it is an article or main element.

The prior only lowers a score. STRONG: elements whose tag, role or whole class token means a menu,
header, footer, sidebar, notice, advert, form or comments; their blocks are counted apart from others
of the same tags and class, never set the measure and have STRONG of it at most. WEAK: class tokens
with such a word beside an unknown one (`related-work`, `ad-free`), and elements named for a list of
links that hold prose: good prose in them stays. A form or named article that holds most of the page's
text is none in this sense; a label or button within the words of a paragraph is part of them; a heading is no
header, whatever its class.

Defined cases: null or empty html, and pages without content, give an empty text; unclosed tags
and truncated pages are read as far as they go, nesting of any depth in linear time and memory;
repeated rows each get their text; an empty table gives an empty result; extra columns are kept,
and columns named like the added ones replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_batches

# Element classes of HTML, and words that name boilerplate in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea select title head canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div article section main body html".split())
MARKED = frozenset("nav footer aside form button menu dialog label fieldset".split())
ALWAYS_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar breadcrumb breadcrumbs cookie cookies consent gdpr comment comments disqus replies share sharing social related recommended newsletter subscribe signup login popup modal overlay widget widgets pagination pager skip".split())
LINK_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs share sharing social pagination pager".split())
OFTEN_WORDS = frozenset("header masthead footer banner notice notices alert toolbar form search tags meta aside legal copyright".split())
CONTENT_WORDS = frozenset("article content post entry story main body text page".split())
LAYOUT_WORDS = frozenset("area bar bottom box block btn button buttons container footer global group header inner item items left link links list module outer panel posts primary right secondary section side site slot thread top unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTAINERS = frozenset("article main body div section td form".split())
WITHIN_WORDS = frozenset("button label".split())
HEADING = re.compile(r"h[1-6]")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

THRESHOLD, INSIDE, STRONG, WEAK, MOST = 0.35, 0.04, 0.01, 0.25, 0.8
PROSE, LEAST, SENTENCE = 0.7, 80, 120  # prose: share of the text outside links, characters, and characters for each mark of punctuation at most


def _token_prior(token: str) -> float:
    """Prior of one class or id token: by its words, and whether all of them are known."""
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    if any(w in ALWAYS_WORDS for w in words):
        known = ALWAYS_WORDS | OFTEN_WORDS | LAYOUT_WORDS | CONTENT_WORDS
        return STRONG if all(w in known or w.isdigit() for w in words) else WEAK
    if any(w in OFTEN_WORDS for w in words) and not any(w in CONTENT_WORDS for w in words):
        return STRONG if all(w in OFTEN_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in words) else WEAK
    return 1.0


def _of_links(token: str) -> bool:
    """Whether a token names boilerplate by words for lists of links alone."""
    return all(w in LINK_WORDS or w not in ALWAYS_WORDS | OFTEN_WORDS for w in re.split(r"[^a-z0-9]+", token))


def _prior(tag: str, attributes: str, inside: bool, in_words: bool) -> tuple[float, str, bool]:
    """Prior of an element (0: not shown at all), its class for the path, and whether words for lists of links alone
    make it STRONG. inside: in an article or main. in_words: amid the words of a paragraph."""
    prior, name = STRONG if tag in MARKED and not (in_words and tag in WITHIN_WORDS) or tag == "header" and not inside else 1.0, ""
    links = prior > STRONG
    root = tag in ("html", "body")
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if not root and (key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 0.0, name, False
        if key == "role" and value in ROLES and not root:
            prior, links = min(prior, STRONG), False
        if key in ("class", "id"):
            tokens = value.split()
            if key == "class" and tokens:
                name = "." + tokens[0]
            if tag in ("html", "body", "main"):
                continue
            for token in tokens:
                own = _token_prior(token)
                if (tag == "article" or HEADING.fullmatch(tag)) and not ALWAYS_WORDS.intersection(re.split(r"[^a-z0-9]+", token)):
                    own = 1.0
                if own <= STRONG or tag != "article":
                    prior, links = min(prior, own), links and (own > STRONG or _of_links(token))
    return prior, name, links and prior <= STRONG


class Tree:
    """Block-level elements of a page by number: parent, depth, tag, prior, path. The path of equal tags and classes below an equal path is one number."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.own, self.links, self.path = [-1], [0], [""], [1.0], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.leaf = [""]  # tag that a path ends with

    def add(self, parent: int, tag: str, name: str, prior: float, links: bool) -> int:
        key = (self.path[parent], tag + name)
        if key not in self.paths:
            self.paths[key] = len(self.leaf)
            self.leaf.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.own.append(prior)
        self.links.append(links)
        self.path.append(self.paths[key])
        return len(self.parent) - 1


def blocks(page: str) -> tuple[list[tuple[str, int, int]], Tree]:
    """(text, element, characters in links) of each block that is shown, in page order, and the elements."""
    out: list[tuple[str, int, int]] = []
    tree = Tree()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, element around or of it, not shown, a block of its own
    opened: Counter = Counter()  # by tag
    inline: list[Counter] = [Counter()]  # of inline tags since the innermost block-level one
    said: list[str] = []
    linked = skipped = at = 0

    def here() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text and not skipped:
                out.append((text, here(), linked))
            said.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal skipped
        while len(stack) > to:
            tag, _, gone, alone = stack[-1]
            if alone:
                flush()
            stack.pop()
            skipped -= gone
            opened[tag] -= 1
            if tag in BLOCK:
                inline.pop()
            else:
                inline[-1][tag] -= 1

    def close_nearest(tags: set[str] | frozenset[str], until: frozenset[str]) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                close(k)
                return True
            if stack[k][0] in until:
                return False
        return False

    def say(text: str) -> None:
        nonlocal linked
        if text and not skipped:
            if "&" in text:
                text = entities.unescape(text)
            said.append(text)
            if opened["a"]:
                linked += len(text.strip())

    size, find = len(page), TOKEN.search
    while at < size:
        m = find(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    flush()
            elif tag in BLOCK:
                close_nearest({tag}, frozenset())
            elif inline[-1][tag]:
                close_nearest({tag}, BLOCK)
            continue
        if tag in RAW:
            if tag == "head":
                continue
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            said.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img"):
                said.append(" " if tag != "wbr" else "")
            continue
        if tag in CLOSES_P and opened["p"]:
            close_nearest({"p"}, SCOPE)
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag]):
            while close_nearest(SIBLINGS[tag], SCOPE) and tag == "tr" and opened["tr"]:
                pass
        in_words = tag in WITHIN_WORDS and opened["p"] > 0 and not opened["form"] and any(x.strip() for x in said)
        prior, name, links = _prior(tag, m[3], opened["article"] + opened["main"] > 0, in_words)
        gone, element = prior == 0.0, here()
        alone = tag in BLOCK or prior <= STRONG
        if alone:
            flush()
            element = tree.add(element, tag, name, prior, links)
        if tag in BLOCK:
            inline.append(Counter())
        else:
            inline[-1][tag] += 1
        stack.append((tag, element, gone, alone))
        opened[tag] += 1
        skipped += gone
    close(0)
    flush()
    return out, tree


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(i - 1, 0)] + 4 * v + values[min(i + 1, n - 1)]) / 6 for i, v in enumerate(values)]


def _held(found: list[tuple[str, int, int]], tree: Tree, counted: list[int]) -> list[int]:
    """Sum of a number of each block, below each element; children have larger numbers than their parents."""
    held = [0] * len(tree.parent)
    for (_, element, _), n in zip(found, counted, strict=True):
        held[element] += n
    for e in range(len(held) - 1, 0, -1):
        held[tree.parent[e]] += held[e]
    return held


def main_text(page: str | None, threshold: float = THRESHOLD, inside: float = INSIDE) -> str:
    found, tree = blocks(page) if page else ([], None)
    if not found:
        return ""
    sizes, marks = [len(t) for t, _, _ in found], [len(PUNCTUATION.findall(t)) for t, _, _ in found]
    held, outside, stops = (_held(found, tree, x) for x in (sizes, [n - min(k, n) for n, (_, _, k) in zip(sizes, found, strict=True)], marks))
    prior = [1.0] * len(held)
    for e in range(1, len(held)):
        own = tree.own[e]
        if tree.tag[e] in ("form", "article") and 2 * held[e] > held[0]:
            own = 1.0
        elif tree.links[e] and held[e] >= LEAST and outside[e] >= PROSE * held[e] and held[e] <= SENTENCE * stops[e]:
            own = WEAK
        prior[e] = min(prior[tree.parent[e]], own)
    kinds: dict[tuple[int, float], int] = {}  # a path among elements of one prior
    of = [kinds.setdefault((tree.path[e], prior[e]), len(kinds)) for _, e, _ in found]
    n_kinds, likely = len(kinds), [p for _, p in kinds]
    heading = [HEADING.fullmatch(tree.leaf[path]) is not None for path, _ in kinds]
    length, points, linked, times, fused = ([0.0] * n_kinds for _ in range(5))
    for (_, _, links), p, size, n in zip(found, of, sizes, marks, strict=True):
        length[p] += size
        points[p] += n
        linked[p] += min(links, size)
        times[p] += 1
    a = _smooth([math.log1p(length[p] / times[p]) for p in of])
    b = _smooth([points[p] / times[p] for p in of])
    for p, x, y in zip(of, a, b, strict=True):
        fused[p] += x * (1 + math.log1p(y)) / times[p]
    free = [1 - linked[p] / max(1.0, length[p]) for p in range(n_kinds)]
    score = [fused[p] * likely[p] * (max(free[p], 0.5) if heading[p] else free[p]) for p in range(n_kinds)]
    weighty = max((p for p in range(n_kinds) if likely[p] > STRONG), key=lambda p: (score[p] * math.log1p(length[p]), -p), default=None)
    if weighty is None or not score[weighty]:
        return ""
    score = [min(x, STRONG * score[weighty]) if likely[p] <= STRONG else x for p, x in enumerate(score)]
    chosen = [s >= threshold * score[weighty] and s > 0 for s in score]
    held = _held(found, tree, [n * chosen[p] for n, p in zip(sizes, of, strict=True)])
    most = [e for e in range(1, len(held)) if held[e] >= MOST * held[0] and tree.tag[e] in CONTAINERS and tree.tag[e] != "body"]
    marked = [e for e in most if tree.tag[e] in ("article", "main")]
    root = max(marked or most, key=lambda e: tree.depth[e], default=0)
    beside = tree.tag[root] == "article"
    within = [e == root or beside and tree.tag[e] == "article" and tree.parent[e] == tree.parent[root] for e in range(len(held))]
    for e in range(1, len(held)):
        within[e] = within[e] or within[tree.parent[e]]
    kept = []
    for (text, e, links), p in zip(found, of, strict=True):
        if root and within[e]:
            stays = score[p] > 0 and score[p] >= inside * score[weighty]
        else:
            stays = not marked and (chosen[p] or heading[p] and likely[p] > STRONG and links < len(text))
        if stays:
            kept.append(text)
    return "\n".join(kept)


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None).astype(object)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text (the article, empty if none) and n_chars (its code points), without the html."""
    small_batches(pages.sparkSession)
    out = pages.withColumn("__text", _main_text(F.coalesce(F.col(column), F.lit(""))))
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    return out.select(*[f"`{c}`" for c in kept], F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
