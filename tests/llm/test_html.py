from functools import reduce

from factloom.llm import html_text


def texts(pages):
    """The texts of pages of one host, without Spark."""
    rule = html_text.rule_of(reduce(html_text.aligned, [html_text.wrapper_of(html_text.parsed(p)) for p in pages]))
    return [html_text.main_text(p, rule) for p in pages]


def test_texts_that_differ_late_are_not_constant():
    start = "The same beginning " * 10
    got = texts([f"<div><p>{start}{k} ends otherwise</p></div>" for k in range(6)])
    assert got == [f"{start}{k} ends otherwise" for k in range(6)]


def test_a_fixed_paragraph_takes_no_others_along():
    got = texts([f"<div><h1>T{k}</h1><p>fixed</p><h2>S{k}</h2><p>one {k} of several words</p><p>two <b>more</b> {k}</p></div><div class=low><p>Our house</p></div>" for k in range(6)])
    assert got == [f"T{k}\nfixed\nS{k}\none {k} of several words\ntwo more {k}" for k in range(6)]


def test_copies_keep_their_text():
    page = "<div class=ad>{}</div><div><h1>Title</h1><p>All of the text</p></div>"
    assert texts([page.format(k) for k in range(8)]) == ["Title\nAll of the text"] * 8
    near = "<div><h1>Title</h1><p>All of the long text that the copies have</p><p>changed {}</p></div>"
    assert texts([near.format(k) for k in range(8)])[3] == "Title\nAll of the long text that the copies have\nchanged 3"


def test_unchanging_text_of_different_pages_goes():
    got = texts([f"<div class=top><p>Welcome</p></div><div><p>{'word ' * 9}{k}</p></div><p class=x>Bye</p>" for k in range(6)])
    assert got == [f"{'word ' * 9}{k}" for k in range(6)]
    assert texts([f"<div class=top><p>Welcome</p></div><div><p>{'word ' * 9}{k}</p></div>" for k in range(4)])[0].startswith("Welcome")


def test_articles_of_many_classes_are_read_alone():
    page = "<div>outside {0}</div><article class='post tag-{1}'><h1>T{0}</h1><p>text {0}</p></article><p>below {0}</p>"
    assert texts([page.format(k, chr(97 + k)) for k in range(12)]) == [f"T{k}\ntext {k}" for k in range(12)]


def test_all_articles_of_a_page_are_read():
    page = "<main>" + "".join(f"<article class='c{c}'><p>{c} {'word ' * n}end</p></article>" for c, n in zip("abcdef", (90, 1, 1, 1, 1, 1))) + "</main>"
    assert [line[0] for line in texts([page])[0].split("\n")] == list("abcdef")


def test_wrappers_of_many_kinds_lose_nothing():
    kinds = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(260)]
    page = "<div>" + "".join(f"<div class='{c}x'>{c}</div>" for c in kinds) + "</div>"
    w = html_text.wrapper_of(html_text.parsed(page))
    w = html_text.aligned(w, html_text.wrapper_of(html_text.parsed("<div><i>one</i>" + page[5:])))
    assert w[html_text.LETTERS] == sum(k[html_text.LETTERS] for k in w[html_text.KIDS][0][html_text.KIDS]) == 4 * 260 + 3
    assert len(w[html_text.KIDS][0][html_text.KIDS]) == 261  # what each page has stays apart
    rare = ["<div>" + "".join(f"<div class='{c}{k // 26 * 'z'}{chr(97 + k % 26)}'>{c}</div><p>x</p>" for c in kinds[:20]) + "<b>all</b></div>" for k in range(60)]
    w = reduce(html_text.aligned, [html_text.wrapper_of(html_text.parsed(p)) for p in rare])
    assert len(w[html_text.KIDS][0][html_text.KIDS]) <= 200  # 1,200 kinds of one page each
    assert w[html_text.LETTERS] == 60 * (20 * 3 + 3) and ["b", 0, 0, 60] in [k[:4] for k in w[html_text.KIDS][0][html_text.KIDS]]
    assert texts([page] * 6) == ["\n".join(kinds)] * 6


ARTICLE = "<h1>Title {0}</h1><p>The text of page {0}</p>"


def test_part_words_count_as_whole_names_only():
    for name in ("content-with-sidebar", "has-sidebar", "site-search-results"):
        page = f"<div class='{name}' id=layout><div class=ad>Buy</div>{ARTICLE}</div>"
        assert texts([page.format(k) for k in range(6)]) == [f"Title {k}\nThe text of page {k}" for k in range(6)]
    page = "<article><div class='entry-header'><h1>T</h1></div><section class='legal-analysis'><p>law</p></section><ul id='search-results'><li>found</ul><div class=notice>mind</div><div class=ad>Buy</div><header><div><h2>Sub</h2></div></header></article>"
    assert texts([page]) == ["T\nlaw\nfound\nmind\nSub"]


def test_named_wrappers_of_whole_pages_are_read():
    for tag in ("<form>{}</form>", "<div class=sidebar>{}</div>", "<form><article>{}</article><p>x</p></form>", "<aside><article>{}</article></aside>"):
        page = tag.format(ARTICLE) + "<div class=ad>Buy</div><nav>Home</nav>"
        assert texts([page.format(k) for k in range(6)]) == [f"Title {k}\nThe text of page {k}" for k in range(6)]


def test_parts_of_a_host_go_even_where_they_are_long():
    page = "<div class=body>{}</div><div class=comments>{}</div>"
    pages = [page.format(f"a long enough text of page {k} " * 4, "chat " * (60 if k == 3 else 1)) for k in range(8)]
    assert texts(pages)[3] == ("a long enough text of page 3 " * 4).strip()
