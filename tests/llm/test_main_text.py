"""Main text: against a naive version on random trees, on the parts that must stay or go, and on tags that never close."""

import random
import time

import pytest

from pathloom.llm import htmltext

RNG = random.Random(3)


def sentence(n):
    return " ".join(RNG.choice(["then", "onre,", "thing", "of", "haea", "&amp;", "ntion"]) for _ in range(n)) + "."


def random_tree(depth):
    """(tag, class, linked, children or text)"""
    if depth == 0 or RNG.random() < 0.3:
        return (RNG.choice(["p", "p", "p", "h2", "blockquote", "pre"]), RNG.choice(["", "", "lead", "ad"]), RNG.random() < 0.15, sentence(RNG.randrange(1, 40)))
    return (RNG.choice(["div", "section", "article", "div"]), RNG.choice(["", "", "", "sidebar", "body", "user-comments", "ad-slot", "has-sidebar", "elementor-widget", "widget-text", "related-posts"]), False, [random_tree(depth - 1) for _ in range(RNG.randrange(1, 5))])


def rendered(tree):
    tag, name, linked, inner = tree
    inside = "".join(map(rendered, inner)) if isinstance(inner, list) else f"<a href='/x'>{inner}</a>" if linked else inner
    return f"<{tag}{f' class={name}' if name else ''}>{inside}</{tag}>"


class Naive:
    """The same rules, each looked up afresh: walks up and down the tree for every question."""

    def __init__(self, tree, up=None, seen=None):
        self.tag, self.name, self.linked, inner = tree
        self.up, self.leaf = up, not isinstance(inner, list)
        self.text = inner.replace("&amp;", "&") if self.leaf else ""
        self.memory = {}
        self.children = [] if self.leaf else [Naive(x, self) for x in inner]

    def above(self):
        return [self.up, *self.up.above()] if self.up else []

    def below(self):
        return [self, *(y for x in self.children for y in x.below())]

    def leaves(self):
        return [x for x in self.below() if x.leaf]

    def article(self):
        found = [x for x in [self, *self.above()] if x.tag == "article" and not x.bad()]
        return found[-1] if found else None

    def root(self):
        return self.above()[-1] if self.up else self

    def named(self):
        """The name speaks against this part: whether, and whether it always counts."""
        alone = self.tag in htmltext.INNER or self.tag == "article"
        if self.name == "ad" or (not alone and self.name in ("user-comments", "ad-slot")):
            return True, True
        return self.name == "sidebar" or (not alone and self.name in ("elementor-widget", "related-posts")), False

    def plain(self):
        return [x for x in self.leaves() if not x.linked and x.text]

    def common(self):
        """Half of the page's unlinked text, but for what is certain to go, stands in parts of this name."""
        going = lambda x: any(y.named() == (True, True) for y in [x, *x.above()])
        whole = sum(len(x.text) for x in self.root().plain() if not going(x))
        parts = [x for x in self.root().below() if x.name == self.name and x.named()[0] and not any(y.name == self.name and y.named()[0] for y in x.above()) and not going(x)]
        return 2 * sum(len(x.text) for p in parts for x in p.plain()) >= whole > 0

    def bad(self):
        if "bad" not in self.memory:
            self.memory["bad"] = self.is_bad()
        return self.memory["bad"]

    def is_bad(self):
        if self.up and self.up.bad():
            return True
        against, always = self.named()
        inside = bool(self.up) and self.up.article() is not None
        if not against or (self.tag == "article" and not inside):
            return False
        rich = inside and sum(len(x.text) >= htmltext.LONG for x in self.plain()) >= 2 and self.density() < 0.25
        return always or not (rich or self.common())

    def chars(self):
        return sum(len(x.text) for x in self.leaves())

    def density(self):
        return sum(len(x.text) for x in self.leaves() if x.linked) / max(1, self.chars())

    def score(self):
        total = float(htmltext.BONUS.get(self.tag, 0))
        for x in self.leaves():
            points = 0 if x.bad() or x.linked else 1 + x.text.count(",") + min(len(x.text) / 100, 3 + len(x.text) / 1000)
            chain = x.above() if x.tag in htmltext.INNER else [x, *x.above()]
            if self in chain[: htmltext.LEVELS]:
                total += points / (chain.index(self) + 1)
        return total

    def scored(self):
        return not self.bad() and any(self in (x.above() if x.tag in htmltext.INNER else [x, *x.above()])[: htmltext.LEVELS] for x in self.leaves())


def naive_text(tree):
    root = Naive(tree)
    nodes = root.below()
    scored = [x for x in nodes if x.scored()]
    if not scored:
        kept = [root] if not root.leaves()[0].bad() else []
    else:
        worth = {id(x): x.score() * (1 - x.density()) for x in scored}
        best = None
        for leaf in root.leaves():  # the first met of equals, as points go up
            for x in leaf.above() if leaf.tag in htmltext.INNER else [leaf, *leaf.above()]:
                if id(x) in worth and (best is None or worth[id(x)] > worth[id(best)] + 1e-12):
                    best = x
        whole = best.article() or best
        kept = [whole] + [c for c in scored if c.up is whole.up and c is not whole and c.tag in ("article", "div", "section", "blockquote") and worth[id(c)] >= max(htmltext.BONUS.get(c.tag, 0) + 2, worth[id(best)] / 5)]
        if whole.article() is None and whole.up:
            for c in whole.up.children:
                if not c.bad() and c.chars():
                    heading = any(x.tag in ("h1", "h2") and not x.bad() and x.up is c for x in c.leaves())
                    if (c.tag in htmltext.PARAGRAPH_LIKE and c.density() <= 0.5) or (c.density() < 0.25 and (c.chars() >= htmltext.LONG * len(c.leaves()) or (heading and nodes.index(c) < nodes.index(whole)))):
                        kept.append(c)
    lists = lambda x: x.tag in htmltext.LISTS and x not in kept and len(x.leaves()) > 1 and x.density() > 0.5
    return " ".join(x.text for x in root.leaves() if not x.bad() and any(k in [x, *x.above()] for k in kept) and not (x.linked and any(map(lists, [x, *x.above()]))))


def test_equals_the_naive_version():
    kept = 0
    for _ in range(400):
        tree = ("body", "", False, [random_tree(4) for _ in range(RNG.randrange(1, 4))])
        got = htmltext.main_text(rendered(tree))
        assert got == naive_text(tree), rendered(tree)
        kept += bool(got)
    assert kept > 200


LONG = "<p>" + "Some long sentence, of the article, that goes on and on until it is long enough. " * 2 + "</p>"
TEXT = ("Some long sentence, of the article, that goes on and on until it is long enough. " * 2).strip()
BODY = "<p>One, two and three, as is said.</p>" * 3


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<article><p title="5" 6">Text</p></article>', "Text"),
        ("<article><div class='article-header'><h1>Head</h1></div><p>Body, text.</p></article>", "Head Body, text."),
        ("<article><p class='notice-of-award'>Award, text</p><p>More</p></article>", "Award, text More"),
        ("<article><p>Long text, here, is.</p><p><a href=x>One link paragraph</a></p></article>", "Long text, here, is. One link paragraph"),
        ("<article><p>Sum <math><mi>x</mi></math> and <object>more</object>.</p></article>", "Sum x and more."),
        ("<body><div class='post-header'><h1>T</h1></div><div class='post-body'><p>One, two.</p><p>Three</p></div><div class='post-comments'><p>Nice</p></div><div class='share'>x</div></body>", "T One, two. Three"),
        ("<article><h1>H</h1><p>lead</p><div>" + "<p>Long, long, long, text.</p>" * 20 + "</div></article>", "H lead" + " Long, long, long, text." * 20),
        ("<body><h1>H</h1><p>lead</p><div>" + "<p>Long, long, long, text.</p>" * 20 + "</div></body>", "H lead" + " Long, long, long, text." * 20),
        ("<form><article><p>In a form, text</p></article><button>b</button><select><option>o</select></form>", "In a form, text"),
        ("<body><article><p>Text, here.</p><ul class=related><li><a href=x>Other</a><li><a href=y>Page</a></ul></article></body>", "Text, here."),
        ("<body><article><p>Text, here.</p><ul><li><a href=x>Other</a><li><a href=y>Page</a></ul></article></body>", "Text, here."),
        ("<main><article><p>Text, here.</p></article><section id=comments><article class=comment><p>Nice, nice, nice.</p></article></section></main>", "Text, here."),
        ("<article><p>a&nbsp;b &lt;c&gt;\n\t d&#x41;</p></article>", "a b <c> dA"),
        ("<nav>menu<article><p>Text, here.</p></article>", "menu Text, here."),
        ("<script>if (a<b) '</p>'</script><article><p>x</p><script>never closed", "x"),
    ],
)
def test_parts_that_stay_or_go(page, expected):
    got = htmltext.main_text(page)
    assert got == expected or (page.startswith("<nav>") and got == "Text, here.")


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "elementor-widget", "elementor-element elementor-widget elementor-widget-text", "with-comments", "layout sidebar-right", "post social-share-enabled"])
def test_a_name_takes_no_article_away(name):
    for page in (f'<body><div class="{name}"><h1>Head</h1>{LONG * 3}</div></body>', f'<body><nav>menu</nav><div class="{name}"><div><h1>Head</h1></div><div>{LONG * 3}</div></div><div class="ad">Buy</div></body>'):
        assert htmltext.main_text(page) == " ".join(["Head"] + [TEXT] * 3)
    parts = "".join(f'<div class="{name}">{LONG}</div>' for _ in range(4))
    assert htmltext.main_text(f"<body><main><h1>Head</h1>{parts}</main></body>") == " ".join(["Head"] + [TEXT] * 4)


@pytest.mark.parametrize("name", ['class="widget-text"', 'class="social-history"', 'id="related-work"', 'id="related"', 'class="discussion"', 'id="social-media"', 'class="has-ads"'])
def test_a_section_of_the_article_stays(name):
    assert htmltext.main_text(f"<article><h1>Head</h1>{LONG}<section {name}>{LONG * 2}</section>{LONG}</article>") == " ".join(["Head"] + [TEXT] * 4)
    assert htmltext.main_text(f"<article><h1>Head</h1><div {name}>{LONG * 3}</div></article>") == " ".join(["Head"] + [TEXT] * 3)


@pytest.mark.parametrize("name", ["ad", "ad-slot", "user-comments", "comment-list", "sidebar", "newsletter-signup", "share-buttons", "related-posts", "cookie-notice", "widget-area", "advertisement"])
def test_parts_beside_the_article_go(name):
    other = "<p>Short, one.</p>" if name in ("ad", "sidebar") else "<p>Some other words, as many as it takes to be a paragraph of eighty characters.</p>"
    assert htmltext.main_text(f"<body><div class='{name}'>{other}</div><article><h1>Head</h1>{LONG * 3}<div class='{name}'>{other}</div></article><div class='{name}'>{other}</div></body>") == " ".join(["Head"] + [TEXT] * 3)


@pytest.mark.parametrize("unit", ["<div class='sidebar'>x", "<div class='x-sidebar a-widget'><p>x", "<button>x", "<div>x", '<a "', '<a x="', "<!", "<?", "<a ", "<blockquote><p>x", "<div></section>", "<script>", "<ul><li>x", '<p title="5" 6">T', "<form>", "<!--", "&", "<", "<table><tr><td>x", "<section class='a-b'>x</div>"])
def test_time_follows_the_length(unit):
    began = time.process_time()
    htmltext.main_text(unit * 50_000)
    assert time.process_time() - began < 4


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", BODY, "t", 5)] * 2 + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id or 0, r.text) for r in htmltext.extract(pages.select("page_id", "url", "html"), ["page_id", "url"]).collect())
    assert [g[0] for g in got] == [0, 1, 1] and got[0][1] == "" and got[1][1] == got[2][1] == " ".join(["One, two and three, as is said."] * 3)
