import random
from collections import defaultdict
from functools import reduce

from factloom.llm import html_text

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty".split()


def rule(pages):
    return html_text.rule_of(reduce(html_text.aligned, [html_text.wrapper_of(html_text.parsed(p)) for p in pages]))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_the_wrapper_finds_the_story_beside_cards():
    """Teasers are articles by name, the story is not: only the host's wrapper tells them apart."""
    rng = random.Random(1)
    stories = [(f"Title {k} {prose(rng, 3)}", prose(rng, 60), prose(rng, 40)) for k in range(12)]
    pages = [f"<body><div class=box><a href=/>{prose(rng, 2)}</a></div><div class=story><h1>{a}</h1><p>{b}</p><p>{c}</p></div><div class=more><article><h3>{prose(rng, 4)}</h3></article><article><h3>{prose(rng, 4)}</h3></article></div></body>" for a, b, c in stories]
    own = rule(pages)
    assert own["region"] == ["body", "div.story"]
    for page, parts in zip(pages, stories, strict=True):
        assert html_text.main_text(page, own) == "\n".join(parts)
        assert html_text.main_text(page, None) != "\n".join(parts)


def test_the_wrapper_leaves_varying_blocks_outside():
    rng = random.Random(2)
    pages = [f"<body><div class=xa><p>{prose(rng, 6)}</p></div><div class=xb><h1>T {k}</h1><p>{prose(rng, 50)}</p><p>{prose(rng, 30)} {k}</p></div><div class=xc><p>{prose(rng, 5)}</p></div></body>" for k in range(9)]
    own = rule(pages)
    got = html_text.main_text(pages[4], own)
    assert got.startswith("T 4\n") and got.endswith(" 4") and got.count("\n") == 2
    assert html_text.main_text(pages[4], None).count("\n") == 4


def test_a_heading_beside_the_text_stays():
    rng = random.Random(3)
    pages = [f"<body><div class=page><div class=top><h1>Head {k} {prose(rng, 3)}</h1></div><div class=text><p>{prose(rng, 60)}</p></div></div><div class=x><p>{prose(rng, 3)}</p></div></body>" for k in range(8)]
    own = rule(pages)
    assert own["region"] == ["body", "div.page"]
    assert html_text.main_text(pages[2], own).startswith("Head 2")


def test_pages_of_another_kind_are_read_by_themselves():
    rng = random.Random(4)
    pages = [f"<body><div class=story><h1>T{k}</h1><p>{prose(rng, 60)}</p></div></body>" for k in range(9)]
    own = rule([*pages, "<body><article><p>alone here</p></article><p>x</p></body>"])
    assert own["region"] == ["body", "div.story"]
    assert html_text.main_text("<body><article><p>alone here</p></article><p>x</p></body>", own) == "alone here"
    assert html_text.main_text("<body><p>plain</p></body>", own) == "plain"
    deep = "<div>" * 70 + "<article><p>deep down</p></article>" + "</div>" * 70
    assert html_text.main_text(deep, rule([deep.replace("down", f"down {k}") for k in range(8)])) == "deep down"


def paths(node, path=""):
    """(path, text) of all texts of a page, by brute force."""
    for k in node.kids:
        if k.kind == "#":
            if not k.text.isspace():
                yield path, html_text.even(k.text)
        else:
            yield from paths(k, f"{path}/{k.kind}")


def test_a_wrapper_counts_what_all_pages_hold():
    """Texts, letters and different texts of each path are those of the pages, however they were aligned."""
    rng = random.Random(5)

    def block(depth):
        tag = rng.choice(["div", "p", "ul", "div class=a", "b"])
        inner = "".join(block(depth - 1) for _ in range(rng.randrange(3))) if depth else ""
        return f"<{tag}>{rng.choice(WORDS) if rng.random() < 0.7 else ''}{inner}</{tag.split()[0]}>"

    for _ in range(60):
        pages = ["".join(block(2) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 9))]
        trees = [html_text.parsed(p) for p in pages]
        want = defaultdict(list)
        for t in trees:
            for path, text in paths(t):
                want[path].append(text)
        got = defaultdict(lambda: [0, 0, set()])

        def visit(node, path, got=got):
            for k in node[html_text.KIDS]:
                if k[html_text.KIND] == "#":
                    own = got[path]
                    own[0] += k[html_text.SEEN]
                    own[1] += k[html_text.LETTERS]
                    own[2] |= set(k[html_text.TEXT])
                else:
                    visit(k, f"{path}/{k[html_text.KIND]}")

        visit(reduce(html_text.aligned, [html_text.wrapper_of(t) for t in trees]), "")
        assert {p: (n, letters, h) for p, (n, letters, h) in got.items()} == {p: (len(x), sum(map(len, x)), {html_text.own_text(t) for t in x}) for p, x in want.items()}


def test_many_different_children_change_nothing():
    """Blocks of 260 kinds on every page, some pages lack a few: the unchanging one goes, all others stay in order."""
    rng = random.Random(6)
    for n in (20, 150, 260, 900):
        pages, wants = [], []
        for k in range(7):
            here = [j for j in range(n) if j != n // 3 and not (k and j % 50 == k)]
            words = {j: f"{prose(rng, 5)} {k} {j}" for j in here}
            body = "".join("<div class=own><p>Our house rules</p></div>" if j == n // 3 else f"<div class=k{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{'z' * (j // 676)}><p>{words[j]}</p></div>" for j in range(n) if j == n // 3 or j in words)
            pages.append(f"<body>{body}</body>")
            wants.append("\n".join(words[j] for j in here))
        own = rule(pages)
        assert [html_text.main_text(p, own) for p in pages] == wants, n


def test_depth_changes_nothing():
    rng = random.Random(7)
    for depth in (5, 62, 80, 300):
        texts = [f"{prose(rng, 40)} {k}" for k in range(6)]
        pages = ["<body>" + "<div>" * depth + f"<div class=own>Our house rules</div><p>{t} <b>bold {k}</b></p>" + "</div>" * depth + "</body>" for k, t in enumerate(texts)]
        own = rule(pages)
        assert [html_text.main_text(p, own) for p in pages] == [f"{t} bold {k}" for k, t in enumerate(texts)], depth


def test_reader_comments_in_an_article_go():
    rng = random.Random(8)
    page = "<body><article><h1>T{0}</h1><p>{1}</p><div class=comment><p>first {0}</p></div><div class='comment-body'>second {0}</div><section class=user-comments><p>third {0}</p></section><ul class=comments-list><li>fourth {0}</li></ul></article></body>"
    for n in (3, 9):
        texts = [prose(rng, 40) for _ in range(n)]
        pages = [page.format(k, t) for k, t in enumerate(texts)]
        own = rule(pages)
        assert [html_text.main_text(p, own) for p in pages] == [f"T{k}\n{t}" for k, t in enumerate(texts)]


def test_named_blocks_of_one_page_stay_and_those_that_recur_go():
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(8)]
    odd = {2: "<aside>A note of this page</aside>", 3: "<div class=menu>Soup and bread</div>", 4: "<div class='related'>Related work is this</div>"}
    pages = [f"<body><article><h1>T{k}</h1>{odd.get(k, '')}<p>{t}</p><div class='share x{k}'>Share this {k}</div></article></body>" for k, t in enumerate(texts)]
    own = rule(pages)
    want = {2: "A note of this page\n", 3: "Soup and bread\n", 4: "Related work is this\n"}
    assert [html_text.main_text(p, own) for p in pages] == [f"T{k}\n{want.get(k, '')}{t}" for k, t in enumerate(texts)]
    assert html_text.main_text(pages[3], None) == f"T3\n{texts[3]}"


def test_generated_pages_equal_their_articles():
    """Hosts of random layout whose articles are known: what the templates say on every page, and named parts, go; all else stays."""
    rng = random.Random(10)
    for host in range(12):
        wrap = rng.choice(["div class=story", "article", "section class=body-text", "main"])
        top, low = prose(rng, 6), prose(rng, 4)
        pages, wants = [], []
        for k in range(rng.randrange(6, 14)):
            blocks = [f"{prose(rng, rng.randrange(8, 40))} {host} {k} {j}" for j in range(rng.randrange(2, 9))]
            inner = "".join(f"<{t}>{b}</{t}>" for b, t in ((b, rng.choice(["p", "blockquote", "h2", "div class=q"])) for b in blocks))
            side = "".join(f"<li><a href=/{j}>{prose(rng, 2)}</a></li>" for j in range(4))
            pages.append(f"<body><nav>{side}</nav><div class=xt><p>{top}</p></div><{wrap}><h1>T {host} {k}</h1>{inner}</{wrap.split()[0]}><div class=sidebar><ul>{side}</ul></div><div class=xl><p>{low}</p></div></body>")
            wants.append("\n".join([f"T {host} {k}", *blocks]))
        own = rule(pages)
        assert [html_text.main_text(p, own) for p in pages] == wants, wrap


def test_places_in_order_are_equal_and_increasing():
    rng = random.Random(11)
    for _ in range(40):
        a = [rng.choice("abcdefgh") * rng.randrange(1, 60) for _ in range(rng.randrange(300, 500))]
        b = [x for x in a if rng.random() < 0.9]
        for _ in range(20):
            b.insert(rng.randrange(len(b)), "new")
        found = html_text.matched(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        assert len(found) > 0.7 * len(b)
