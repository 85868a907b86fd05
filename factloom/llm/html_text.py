"""Main text of web pages by wrappers: union-free regular expressions inferred from a host's pages.

A page's token stream is folded into a tree of elements. Pages of one host are aligned one after
the other: where their children match, text that differs becomes a slot; where they don't, the
odd ones become optional; neighbours of one kind become a repeated group. The result, a wrapper, has
no alternatives (it is union-free), and wrappers align with wrappers in the same way. So each
task folds its own pages, and only wrappers are shuffled: no page is.

A slot keeps a sketch of its different texts, so a wrapper tells how much of each part varies from
page to page. The host's wrapper decides which part is read: from the root it goes down to the child
that holds most of the varying text, while no varying heading is left outside. In that part a page is
read by its own articles where these hold most of it, else as a whole without the blocks whose text
stands on every page. Pages without that part, and hosts with few different pages, are read by their
own articles, or as a whole.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

from factloom.llm.shared import staged

# Element names of HTML and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NEVER = frozenset("head script style title noscript template svg iframe object embed canvas audio video select option button input textarea label nav aside footer form dialog menu".split())
PART_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation topbar footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments reply replies respond disqus widget toolbar pagination pager login signup search copyright legal skip".split()
)
# Names of parts that are only told by two words; other compounds (content-with-sidebar, entry-header) name no part.
PART_COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper google-ads adsbygoogle site-header site-footer page-footer site-nav main-nav nav-bar nav-menu main-menu navigation-menu side-bar sidebar-left sidebar-right left-sidebar right-sidebar cookie-banner cookie-bar cookie-consent cookie-notice consent-banner newsletter-signup newsletter-form share-buttons share-links social-links social-share social-media related-articles related-posts related-links comment-list comment-form comments-area comments-section comment-section disqus_thread search-form search-box login-form skip-link breadcrumb-nav legal-notice".split()
)
# Words that also name blocks of an article: they count outside articles only.
OPEN_WORDS = frozenset("header notice alert search legal copyright skip login signup consent gdpr overlay legal-notice".split())
# Words that name reader comments, alone or as the first or last word of a name.
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
# Elements that may also wrap a whole page, and those that never hold an article's own text but may wrap an article.
WRAPS = frozenset("form label button".split())
ASIDE = frozenset("nav aside footer dialog menu".split())
PLAIN = frozenset("html body article main p h1".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = BLOCK - {"body", "html"}
CLOSERS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote span b i em strong a ul ol dl figure figcaption".split())
DEEPEST, MOST_KIDS, LONGEST, DENSE_CELLS = 60, 200, 120, 40_000
SKETCH, HASH_BITS = 16, 48
SHARE = 0.6  # of the varying text that a part must hold to be read alone
LEAST_PAGES = 5  # different pages a host must have before its unchanging text counts as its own


def even(text: str) -> str:
    """A text with one blank for each run of white space, and none at its ends."""
    return " ".join(text.split())


class Node:
    """An element (name, kind, children) or, with kind '#', a text."""

    __slots__ = ("name", "kind", "kids", "text", "words", "hidden", "letters")

    def __init__(self, name: str, kind: str, text: str = "", words: frozenset = frozenset(), hidden: bool = False):
        self.name, self.kind, self.text, self.words, self.hidden = name, kind, text, words, hidden
        self.kids: list[Node] = []
        self.letters = 0


def opened(name: str, raw: str) -> Node:
    """An element from its tag: its kind is its name with class, id and role, digits left out."""
    if not raw or raw.isspace():
        return Node(name, name)
    found, hidden = [], False
    for m in ATTR.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden":
            hidden = hidden or (key == "hidden" and value in ("", "hidden")) or value == "true"
        else:
            found += [f"{'@' if key in ('role', 'itemprop') else ''}{re.sub('[0-9]+', '', w)}" for w in value.split()]
    words = frozenset(w.strip("-_:").replace(".", ":") for w in found)
    if name in PLAIN:
        words = frozenset(w for w in words if w[:1] == "@")
    kind = ".".join([name, *sorted(words)])
    if len(kind) > LONGEST:
        kind = ".".join([name, *sorted(w for w in words if w in PART_WORDS or w in PART_COMPOUNDS or w[:1] == "@"), "#" + xxh3_128_hexdigest(kind)])
    return Node(name, kind, words=words, hidden=hidden)


def parsed(text: str) -> Node:
    """The tree of a page; unclosed and stray tags are put right as browsers do, roughly."""
    root = Node("", "")
    stack = [root]
    at, end = 0, len(text)
    while at < end:
        m = TOKEN.match(text, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            own = m[0]
            if own[0] != "<" or own == "<":
                last = stack[-1].kids
                if last and last[-1].kind == "#":
                    last[-1].text += own
                else:
                    last.append(Node("", "#", own))
            continue
        name = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in ("table", "button", "td", "th", "object"):
                    break
        if name in CLOSERS:
            names, stops = CLOSERS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names.split():
                    del stack[k:]
                    break
                if stack[k].name in stops:
                    break
        node = opened(name, m[3] or m[6] or "")
        stack[-1].kids.append(node)
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?|\\Z", re.I).search(text, at)
            if text[at : close.start()]:
                node.kids.append(Node("", "#", text[at : close.start()]))
            at = close.end()
        elif name not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    return root


def rank(node: Node) -> int:
    """2 for an article, 1 for a main part, else 0."""
    if node.name == "article" or "@articlebody" in node.words:
        return 2
    return int(node.name == "main" or "@main" in node.words)


def comments(node: Node) -> bool:
    """Whether an element's class or id names reader comments (comment, comment-body, user-comments)."""
    return any({w.replace("_", "-").split("-")[0], w.replace("_", "-").split("-")[-1]} & COMMENT_WORDS for w in node.words)


def hint(node: Node, inside: bool = False) -> bool:
    """Whether an element's class, id or role is the name of a part; ``inside`` an article only what names no block of it."""
    if node.name in PLAIN:
        return False
    if comments(node):
        return True
    found = [w for w in node.words if w in PART_WORDS or w in PART_COMPOUNDS or w[:1] == "@" and w[1:] in PART_ROLES]
    return any(not inside or w not in OPEN_WORDS for w in found)


def part_name(node: Node) -> str:
    """The name of an element that is named as a part: its own and those of its words that name parts; else the empty text."""
    found = sorted(w for w in node.words if w in PART_WORDS or w in PART_COMPOUNDS or w[:1] == "@" and w[1:] in PART_ROLES)
    return ".".join([node.name, *found]) if node.name in ASIDE or found and node.name not in PLAIN else ""


def unseen(node: Node) -> bool:
    """Whether nothing in an element is a text of the page, whatever it holds."""
    return node.hidden or node.name in NEVER and node.name not in WRAPS and node.name not in ASIDE


def boilerplate(node: Node) -> bool:
    """Whether an element is by its name or naming no part of an article."""
    return node.name in NEVER or node.hidden or hint(node)


def weigh(root: Node) -> None:
    """Sets the letters of each element, without those of unseen elements and of parts by element name."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.kind == "#":
            node.letters = len(even(node.text))
        elif not unseen(node):
            order.append(node)
            todo += node.kids
    for node in reversed(order):
        node.letters = sum(k.letters for k in node.kids if k.name not in ASIDE)


# A wrapper node is a list: [kind, optional, repeated, pages, letters, sketch, children, texts, shown]. The
# sketch of a text holds the least hashes of its different texts, the root's those of its pages; shown is
# the start of a text that never differs.
KIND, OPT, REP, PAGES, LETTERS, TEXT, KIDS, SEEN, SHOWN = range(9)


def own_text(text: str) -> int:
    """The hash of a text, white space made even."""
    return xxh3_64_intdigest(even(text)) >> (64 - HASH_BITS)


def distinct(sketch: list[int]) -> float:
    """About how many different hashes a sketch has met; exact while it isn't full."""
    return len(sketch) if len(sketch) < SKETCH else (SKETCH - 1) * float(1 << HASH_BITS) / max(1, sketch[-1])


def page_digest(root: Node) -> int:
    """The hash of a page's longest text outside boilerplate, by which copies and most near copies are one page."""
    longest, todo = "", [root]
    while todo:
        node = todo.pop()
        if node.kind == "#":
            longest = max(longest, node.text, key=len)
        elif not boilerplate(node):
            todo.extend(reversed(node.kids))
    return own_text(longest)


def letters(node: Node) -> int:
    """Letters of an element outside boilerplate."""
    total, todo = 0, [node]
    while todo:
        node = todo.pop()
        if node.kind == "#":
            total += len(even(node.text))
        elif not boilerplate(node):
            todo += node.kids
    return total


def wrapper_of(node: Node, depth: int = 0) -> list:
    """The wrapper of a single page, repeated neighbours folded."""
    if node.kind == "#":
        own = even(node.text)
        return ["#", 0, 0, 1, len(own), [own_text(own)], [], 1, own[:LONGEST]]
    if depth > DEEPEST:
        kids = flat(node)
    else:
        kids = [wrapper_of(k, depth + 1) for k in node.kids if k.kind != "#" or not k.text.isspace()]
    return [node.kind, 0, 0, 1, sum(k[LETTERS] for k in kids), [] if node.kind else [page_digest(node)], bounded(folded(kids), 1), 0, None]


def flat(node: Node) -> list:
    """Of a very deep tree the blocks below an element as its own children; their kinds are the paths to them, so that a block's path stays what it is."""
    out: list = []
    todo = [(k, "", "") for k in reversed(node.kids)]
    while todo:
        kid, path, block = todo.pop()
        if kid.kind != "#":
            if not excluded(kid):
                path = f"{path}/{kid.kind}" if path else kid.kind
                todo += [(k, path, path if kid.name in BLOCK else block) for k in reversed(kid.kids)]
        elif not kid.text.isspace():
            text = wrapper_of(kid)
            if not block:
                out.append(text)
            elif out and out[-1][KIND] == block and out[-1][PAGES] == 0:
                out[-1][KIDS].append(text)
            else:
                out.append([block, 0, 0, 0, 0, [], [text], 0, None])
    for own in out:
        if own[KIND] != "#":
            own[PAGES], own[LETTERS], own[KIDS] = 1, sum(k[LETTERS] for k in own[KIDS]), folded(own[KIDS])
    return out


def folded(kids: list) -> list:
    """Tandem repeats of up to three kinds become repeated groups."""
    for period in (1, 2, 3):
        out: list = []
        for kid in kids:
            out.append(kid)
            while len(out) >= 2 * period and all(out[-period + i][KIND] == out[-2 * period + i][KIND] and out[-period + i][KIND] != "#" for i in range(period)):
                later = out[-period:]
                del out[-period:]
                for i in range(period):
                    a = out[-period + i]
                    pages = max(a[PAGES], later[i][PAGES])
                    out[-period + i] = aligned(a, later[i])
                    out[-period + i][REP], out[-period + i][PAGES] = 1, pages
        kids = out
    return kids


def aligned(a: list, b: list) -> list:
    """The wrapper that covers two wrappers of one kind."""
    sketch = a[TEXT] if a[TEXT] == b[TEXT] else sorted({*a[TEXT], *b[TEXT]})[:SKETCH]
    return [a[KIND], a[OPT] | b[OPT], a[REP] | b[REP], a[PAGES] + b[PAGES], a[LETTERS] + b[LETTERS], sketch, aligned_kids(a[KIDS], b[KIDS], a[PAGES] + b[PAGES]), a[SEEN] + b[SEEN], a[SHOWN] if a[TEXT] == b[TEXT] else None]


def aligned_kids(a: list, b: list, pages: int) -> list:
    if [x[KIND] for x in a] == [x[KIND] for x in b]:
        return [aligned(x, y) for x, y in zip(a, b, strict=True)]
    out, at, upto = [], 0, 0
    for i, j in [*matched([x[KIND] for x in a], [x[KIND] for x in b]), (len(a), len(b))]:
        out += [[x[KIND], 1, *x[2:]] for x in a[at:i]] + [[x[KIND], 1, *x[2:]] for x in b[upto:j]]
        if i < len(a):
            out.append(aligned(a[i], b[j]))
        at, upto = i + 1, j + 1
    return bounded(folded(out), pages)


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Of long lists that differ in many places, one through the kinds that both have as often: the
    k-th of a kind answers the k-th, as many of them as are in order; what lies between is matched in the same way."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [(k, k) for k in range(lo)], [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inner = common(mid_a, mid_b) if len(mid_a) * len(mid_b) <= DENSE_CELLS else in_order(mid_a, mid_b)
    return [*ends[0], *((lo + i, lo + j) for i, j in inner), *ends[1]]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of short lists."""
    n, m = len(a), len(b)
    same = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same[i][j] = same[i + 1][j + 1] + 1 if a[i] == b[j] else max(same[i + 1][j], same[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif same[i + 1][j] >= same[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal kinds of long lists, increasing in both: kinds that both have equally often answer by their turns, and the longest increasing run of answers stays."""
    turns_a, turns_b = Counter(a), Counter(b)
    spots: dict[tuple[str, int], int] = {}
    met: Counter = Counter()
    for j, kind in enumerate(b):
        spots[kind, met[kind]] = j
        met[kind] += 1
    met.clear()
    ends: list[int] = []  # the least last answer of an increasing run of each length
    tails: list[tuple[int, int, tuple | None]] = []
    for i, kind in enumerate(a):
        j = spots.get((kind, met[kind])) if turns_a[kind] == turns_b[kind] else None
        met[kind] += 1
        if j is not None:
            k = bisect_left(ends, j)
            item = (i, j, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(item)
            else:
                ends[k], tails[k] = j, item
    run, item = [], tails[-1] if tails else None
    while item:
        run.append(item[:2])
        item = item[2]
    run.reverse()
    if not run:
        return []
    out, at, upto = [], 0, 0
    for i, j in [*run, (len(a), len(b))]:
        if (i - at) * (j - upto) <= DENSE_CELLS:
            out += [(at + x, upto + y) for x, y in common(a[at:i], b[upto:j])]
        else:
            out += [(at + x, upto + y) for x, y in in_order(a[at:i], b[upto:j])]
        if i < len(a):
            out.append((i, j))
        at, upto = i + 1, j + 1
    return out


def bounded(kids: list, pages: int) -> list:
    """Children of a wrapper of so many pages without a growing tail of rare kinds.

    As many as four times a page's children on average stay, and ``MOST_KIDS`` at least, so every kind that half
    of the pages have stays. Beyond that, those of the fewest pages become one optional group of each
    element name: no part of a host, nor a text of every page, is among them.
    """
    most = max(MOST_KIDS, 4 * sum(k[PAGES] for k in kids) // max(1, pages))
    if len(kids) <= most:
        return kids
    least = sorted((k[PAGES] for k in kids), reverse=True)[most // 2]
    out: list = []
    groups: dict[str, list] = {}
    for kid in kids:
        if kid[PAGES] > least or 2 * kid[PAGES] >= pages:
            out.append(kid)
            continue
        kid = [kid[KIND].split("/")[0].split(".")[0], 1, 1, *kid[PAGES:]]
        if kid[KIND] in groups:
            groups[kid[KIND]][:] = aligned(groups[kid[KIND]], kid)
        else:
            groups[kid[KIND]] = kid
            out.append(kid)
    return out


def expression(w: list) -> str:
    """A wrapper as a regular expression over tags and text slots."""
    if w[KIND] == "#":
        own = "#text" if w[SHOWN] is None else w[SHOWN]
    else:
        name = w[KIND].split(".")[0]
        own = f"<{w[KIND]}>{' '.join(expression(k) for k in w[KIDS])}</{name}>" if name else " ".join(expression(k) for k in w[KIDS])
    return f"( {own} ){'*' if w[OPT] and w[REP] else '?' if w[OPT] else '+'}" if w[OPT] or w[REP] else own


def standing(kind: str) -> Node:
    name, *found = kind.split(".")
    return Node(name, kind, words=frozenset(found))


def excluded(me: Node) -> bool:
    """Whether an element is by its name alone no part of an article."""
    return unseen(me) or me.name in ASIDE


def region_of(w: list) -> list[str] | None:
    """The path of the part that holds the varying text of a host's pages, or None.

    A text's letters weigh by its variance: different texts for each different page. Links, and
    elements named as parts with at most half of the whole, weigh nothing. From the root the path
    goes on to the child with ``SHARE`` of its parent's weight, if that is a container that most
    pages have once, and no heading that varies stands beside it. Articles whose classes differ
    count together; such a step is the element's name with a star.
    """
    pages = distinct(w[TEXT])
    if pages < LEAST_PAGES:
        return None
    weights: dict[int, float] = {}
    headings: dict[int, bool] = {}

    def weigh_up(node: list, whole: float | None, inside_heading: bool) -> float:
        if node[KIND] == "#":
            share = min(1.0, distinct(node[TEXT]) * w[PAGES] / (max(1, node[SEEN]) * pages))
            weights[id(node)] = node[LETTERS] * share
            headings[id(node)] = inside_heading and share > 0.5
            return weights[id(node)]
        me = standing(node[KIND])
        if excluded(me) or me.name == "a":
            total, head = 0.0, False
        else:
            inside_heading = inside_heading or me.name in ("h1", "h2")
            total = sum([weigh_up(k, whole, inside_heading) for k in node[KIDS]])
            head = any(headings[id(k)] for k in node[KIDS])
            if whole is not None and hint(me) and 2 * total <= whole:
                total, head = 0.0, False
        weights[id(node)], headings[id(node)] = total, head
        return total

    whole = weigh_up(w, None, False)
    weigh_up(w, whole, False)
    path: list[str] = []
    here = [w]

    def step(group: list, others: list, parent: list) -> bool:
        name = group[0][KIND].split(".")[0]
        mass, seen = sum(weights.get(id(k), 0.0) for k in group), sum(k[PAGES] for k in group)
        return (
            name not in TEXTUAL
            and mass > 0
            and mass >= SHARE * sum(weights[id(n)] for n in parent)
            and not any(k[REP] for k in group)
            and w[PAGES] <= 2 * seen
            and 10 * seen <= 11 * sum(n[PAGES] for n in parent)
            and not any(headings.get(id(k)) for k in others)
        )

    while whole > 0:
        kids = [k for n in here for k in n[KIDS]]
        for key in (lambda kind: kind, lambda kind: f"{kind.split('.')[0]}*"):
            groups: dict[str, list] = defaultdict(list)
            for k in kids:
                if k[KIND] != "#" and (key(k[KIND]) in (k[KIND], "article*", "main*")):
                    groups[key(k[KIND])].append(k)
            best = max(groups, key=lambda g: sum(weights.get(id(k), 0.0) for k in groups[g]), default=None)
            taken = {id(k) for k in groups.get(best, [])}
            if best is not None and step(groups[best], [k for k in kids if id(k) not in taken], here):
                path.append(best)
                here = groups[best]
                break
        else:
            break
    return path if path and path[-1].split(".")[0] not in ("html", "body") else None


def rule_of(w: list) -> dict:
    """From a wrapper: the part to read, paths of parts by their naming, and the texts of blocks that no page lacks or changes.

    A named part's path counts where several pages have it and it holds at most half of the host's text.
    A block's path counts only if none of its texts varies, inline elements included. Hosts with few
    different pages have no such texts, nor have hosts whose pages agree in most of their text: these
    are copies. ``once`` has the names of parts that a host of several pages has on one page only.
    """
    slots: dict[str, list] = defaultdict(list)
    held: dict[str, list] = defaultdict(lambda: [0, 0])
    named: Counter = Counter()

    def count_named(node: list) -> None:
        """Counts named parts in what isn't visited."""
        if node[KIND] != "#":
            me = standing(node[KIND])
            if part_name(me):
                named[part_name(me)] += node[PAGES]
            for k in node[KIDS]:
                count_named(k)

    def visit(node: list, path: str, block: str, some: bool) -> int:
        """Letters below that aren't boilerplate; ``some``: only some pages have the node."""
        some = some or bool(node[OPT])
        if node[KIND] == "#":
            fixed = not some and len(node[TEXT]) < SKETCH and 4 * len(node[TEXT]) * w[PAGES] <= 5 * node[SEEN]
            slots[block].append((node[TEXT] if fixed else None, node[LETTERS]))
            return node[LETTERS]
        me = standing(node[KIND])
        if part_name(me):
            named[part_name(me)] += node[PAGES]
        if excluded(me):
            for k in node[KIDS]:
                count_named(k)
            return 0
        own = f"{path}/{node[KIND]}" if path or node[KIND] else ""
        total = sum(visit(k, own, own if me.name in BLOCK or "/" in node[KIND] else block, some) for k in node[KIDS])
        if me.name in WRAPS or hint(me):
            held[own] = [held[own][0] + total, max(held[own][1], 0 if node[REP] else node[PAGES])]
        return total

    total = visit(w, "", "", False)
    several = distinct(w[TEXT]) >= LEAST_PAGES
    parts = sorted(path for path, (n, pages) in held.items() if 2 * n <= total and pages >= LEAST_PAGES and several)
    slots = {path: found for path, found in slots.items() if not any(path == part or path.startswith(part + "/") for part in parts)}
    total = sum(n for found in slots.values() for _, n in found)
    same = {path: sorted({h for text, _ in found for h in text}) for path, found in slots.items() if all(text is not None for text, _ in found)}
    if not several or 2 * sum(n for path in same for _, n in slots[path]) > total:
        same = {}
    once = sorted(name for name, pages in named.items() if pages < 2) if several else []
    return {"region": region_of(w), "parts": parts, "constant": same, "once": once}


def located(root: Node, region: list[str] | None) -> list[tuple[Node, str]]:
    """A page's elements on the wrapper's path that have text, with the paths of their parents."""
    found = [(root, "", "")] if region else []
    for step in region or []:
        found = [(k, own, f"{own}/{k.kind}") for node, _, own in found for k in node.kids if k.kind == step or step[-1] == "*" and k.kind != "#" and k.name == step[:-1]]
    return [(node, path) for node, path, _ in found if node.letters]


def below(tops: list[Node]) -> set[int]:
    """The elements under some of a page's elements, themselves included."""
    found, todo = set(), list(tops)
    while todo:
        node = todo.pop()
        if id(node) not in found:
            found.add(id(node))
            todo += node.kids
    return found


def mains_of(root: Node) -> list[Node]:
    """A page's outermost articles that have text, in order; without any, its main parts.

    Those in elements that are named as parts count only where they hold more than all other text.
    """
    found: dict[tuple[bool, int], list[Node]] = {(wide, kind): [] for wide in (False, True) for kind in (2, 1)}
    for (wide, kind), nodes in found.items():
        todo = [root]
        while todo:
            node = todo.pop()
            if node.kind == "#" or (unseen(node) if wide else boilerplate(node)):
                continue
            if rank(node) == kind and letters(node):
                nodes.append(node)
            else:
                todo.extend(reversed(node.kids))
        if nodes and (not wide or sum(n.letters for n in nodes) > letters(root)):
            return nodes
    return []


def headed(node: Node) -> bool:
    """Whether an element holds a heading of a page or an article."""
    todo = list(node.kids)
    while todo:
        node = todo.pop()
        if node.name in ("h1", "h2"):
            return True
        todo += node.kids
    return False


def main_text(text: str | None, rule: dict | None) -> str:
    """The blocks of one page, one a line.

    They are those of the articles in the part that the host's wrapper has found, if these hold most of its
    text, else of that part; where the page lacks that part, of its own articles, or of the whole page.
    An element named as a part, or a form, is read all the same where it holds most of the page's
    text, unless the host's wrapper has it as a part. In an article, elements named as parts are dropped
    where the host's wrapper shows that they recur, so a block of this page alone is read whatever
    its name; reader comments are dropped in any case, and hosts of few pages go by names.
    """
    if not text:
        return ""
    root = parsed(text)
    weigh(root)
    mains = mains_of(root)
    part = located(root, rule["region"]) if rule else []
    if part:
        inside = below([node for node, _ in part])
        mains = [node for node in mains if id(node) in inside]
        if 2 * sum(n.letters for n in mains) < sum(node.letters for node, _ in part):
            mains = []
    parts = frozenset() if mains or rule is None else frozenset(rule["parts"])
    constant = {} if mains or rule is None else rule["constant"]
    once = frozenset(rule["once"]) if mains and rule else frozenset()

    def dropped(node: Node, own: str) -> bool:
        if unseen(node):
            return True
        if once and part_name(node) in once and not comments(node):
            return False
        if node.name in ASIDE:
            return True
        if not (node.name in WRAPS or hint(node, bool(mains))) or any(node is start for start, _ in starts):
            return False
        return own in parts or 2 * node.letters <= root.letters

    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        own = even(html_lib.unescape("".join(line)))
        line.clear()
        if own:
            blocks.append(own)

    starts = [(node, "") for node in mains] or part or [(root, "")]
    todo: list = [(node, path, path) for node, path in reversed(starts)]
    while todo:
        item = todo.pop()
        if item is None:
            close()
            continue
        node, path, block = item
        if node.kind == "#":
            if not (block in constant and own_text(node.text) in constant[block]):
                line.append(node.text)
            continue
        if node.name == "br" or node.name in ("td", "th"):
            line.append(" ")
        own = f"{path}/{node.kind}" if path or node.kind else ""
        if dropped(node, own) or node.name == "header" and not headed(node) and 2 * node.letters <= root.letters:
            if node.name in BLOCK:
                close()
            continue
        if node.name in BLOCK:
            close()
            todo.append(None)
        block = own if node.name in BLOCK else block
        todo.extend((k, own, block) for k in reversed(node.kids))
    close()
    return "\n".join(blocks)


def host_of(url) -> object:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


WRAPPERS = "host string, wrapper string"


def local_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host that a task meets; wrappers leave early when there are many hosts."""
    found: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], names=["host", "wrapper"])
        found.clear()
        return batch

    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            own = wrapper_of(parsed(text.as_py()))
            found[host] = aligned(found[host], own) if host in found else own
        if len(found) > 2000:
            yield out()
    yield out()


def merged(t: pa.Table) -> pa.Table:
    """The wrapper of a group of wrappers of one host."""
    ws = sorted(t.column("wrapper").to_pylist())
    whole = json.loads(ws[0])
    for w in ws[1:]:
        whole = aligned(whole, json.loads(w))
    return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [json.dumps(whole)]})


def infer_wrappers(pages: DataFrame, *, fan_in: int = 64, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper of all pages with html. Groups of more than ``fan_in`` wrappers of a host are merged in salted parts first."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (F.col("html") != ""))
    parts = staged(rows.mapInArrow(local_wrappers, WRAPPERS), "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        salt = F.pmod(F.xxhash64("wrapper", F.lit(most)), F.lit(min(-(-most // fan_in * 2), most - 1)))
        parts = staged(parts.withColumn("_salt", salt).groupBy("host", "_salt").applyInArrow(lambda t: merged(t.select(["host", "wrapper"])), WRAPPERS), "wrappers")
    return staged(parts.groupBy("host").applyInArrow(merged, WRAPPERS), "wrappers")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives the empty text. Pages without a host in their url form one group.
    Repeated rows and null ids stay; an empty table gives an empty result; other columns are
    ignored. A page with articles is read by them, whatever its host has. Wrappers are
    joined by host: Spark broadcasts them where their size allows, else a host with many pages is
    a skewed join that is split at run time.
    """
    wrappers = infer_wrappers(pages, url_col=url_col, html_col=html_col)

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(rule_of(json.loads(w))) for w in batch.column("wrapper").to_pylist()], pa.string())], names=["host", "rule"])

    found = staged(wrappers.mapInArrow(rules, "host string, rule string"), "rules")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for text, rule in zip(batch.column("html"), batch.column("rule").to_pylist(), strict=True):
                if rule is not None and rule not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(main_text(text.as_py(), known.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.join(found, "host", "left").select("page_id", "url", "html", "rule").mapInArrow(run, schema)
