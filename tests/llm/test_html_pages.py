"""Names, comments, deep and broken pages; whole-page labels against all labellings."""

import itertools
import time

import pytest

from signalbook.llm import html_extract as h

TEXT = "The council met on Tuesday to discuss the budget."


def article(inner):
    return f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{TEXT}</p>{inner}</article><footer>Imprint</footer></body>"


@pytest.mark.parametrize("inner, kept", [
    ('<p class="share-price">The price rose by ten percent.</p>', "The price rose by ten percent."),
    ('<h2 id="social-policy">Social policy</h2>', "Social policy"),
    ('<section id="menu"><p>Soup, fish and a dessert of plums.</p></section>', "Soup, fish and a dessert of plums."),
    ("<h2>References</h2><ul><li><a href=x>Budget report</a></li><li><a href=y>Council minutes</a></li></ul>", "References\nBudget report\nCouncil minutes"),
    ('<div class="ad-slot">Buy the best things here today.</div>', None),
    ('<div class="share-buttons"><a>Share this</a></div>', None),
    ('<div class="post-comments"><p>Nice one, I must say it.</p></div>', None),
    ('<div class="newsletter"><p>Get our letter in your mail every single day.</p></div>', None),
])
def test_names_inside_an_article(inner, kept):
    assert h.main_text(article(inner)) == f"Title\n{TEXT}" + (f"\n{kept}" if kept else "")


@pytest.mark.parametrize("name", ["class=comments", "id=comments", "class='comment-list'", "class='user-comments wide'", "class=replies"])
@pytest.mark.parametrize("times", [1, 2, 9])
def test_comments_of_any_share_are_out(name, times):
    said = "<p>The first thing that a reader says about all of it.</p>" * times
    assert h.main_text(f"<body><article><p>{TEXT}</p></article><div {name}>{said}</div></body>") == TEXT
    assert h.main_text(f"<body><article><p>{TEXT}</p><div {name}>{said}</div></article></body>") == TEXT
    assert h.main_text(f"<body><div><p>{TEXT}</p></div><div {name}>{said}</div></body>") == TEXT


def test_names_that_describe_a_page_are_no_parts():
    assert h.main_text(f"<body class='has-sidebar comments-open'><div id=comments><article><p>{TEXT}</p></article></div></body>") == TEXT


def test_a_text_without_competition_is_kept():
    assert h.main_text("<p>One.</p>") == "One."
    assert h.main_text("One") == "One"
    assert h.main_text("<nav>One</nav>") == ""


LONG = {
    "unclosed": "<div>a" * 20000, "nested": "<div>" * 20000 + TEXT, "quotes": '<a "' * 20000, "open quote": '<a ">' * 20001,
    "end tags": "<div>" * 20000 + "</p></li></x>" * 20000, "paragraphs": "<p>a b c." * 20000, "lists": "<ul><li>a" * 10000,
    "tables": "<table><tr><td>x" * 7000, "cdata": "<svg>" + "<![CDATA[" * 20000, "comments": "<!--" * 20000, "attributes": "<a " + "x=' " * 20000 + ">t",
    "spaces": "<a " + " " * 100000 + "x", "svg": "<svg><p>a" * 20000, "links": "<a href=x>a " * 20000, "lower than": "<" * 80000, "scripts": "<svg>" + "<script>" * 20000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_long_pages_take_linear_time(name):
    def seconds(page):
        start = time.process_time()
        assert isinstance(h.main_text(page), str)
        return time.process_time() - start

    assert seconds(LONG[name]) < 5  # some tenths of a second; minutes before


def cost(page, chosen):
    blocks, nodes = h.blocks_of(page)
    texts = [b.text() for b in blocks]
    whole = h.Page.of(blocks, nodes, texts)
    total, last = 0.0, {}
    for i, b in enumerate(blocks):
        lose, keep = h.label_costs(b, texts[i], whole)
        total += keep if chosen[i] else lose
        if i and chosen[i] != chosen[i - 1]:
            total += 1.0 / max(1, h._distance(blocks[i - 1].node, b.node))
        sibling = last.get(id(b.node.parent))
        if sibling is not None and sibling < i - 1 and chosen[i] != chosen[sibling]:
            total += 0.5
        last[id(b.node.parent)] = i
    return total, "\n".join(t for t, c in zip(texts, chosen) if c)


@pytest.mark.parametrize("page", [
    article("<p>Short.</p><ul><li><a>one</a><li>two three</ul><div class=menu><a>More</a></div>"),
    f"<div><p>{TEXT}</p><p>x</p></div><div class=sidebar><p>Read more.</p><a>here</a></div><p>By us</p><div><a>a</a><p>{TEXT}</p></div>",
    "<div>one</div><div><a>two</a></div><div>three four five six.</div><span>seven</span><table><tr><td>8<td>9 10.</table>",
    f"<main><h2>A</h2><p>{TEXT}</p><form><p>Name</p></form><p><a>Next page</a></p></main><p>{TEXT}</p>",
])
def test_whole_page_labels_cost_least(page):
    """No labelling of all blocks costs less than the one that is given out."""
    n = len(h.blocks_of(page)[0])
    best = min(cost(page, c)[0] for c in itertools.product((False, True), repeat=n))
    given = {text: total for total, text in (cost(page, c) for c in itertools.product((False, True), repeat=n)) if text == h.main_text(page)}
    assert min(given.values()) == pytest.approx(best)
