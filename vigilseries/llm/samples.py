"""Labelled pages for the block classifier: a small table made for this purpose. Blocks of the main
text start with ``+``, all others with ``-``."""

import random

_LONG = "long line of words that tells the reader what happened where and when and why it did"
_MID = "a short remark with some words"

LABELLED = [
    # article element with menus, an advert and a footer around it
    f"<html><head><title>t</title></head><body><nav><ul><li><a>-Home</a></li><li><a>-World news</a></li>"
    f"<li><a>-Sports</a></li><li><a>-Contact</a></li></ul></nav><div class='ad'>-Buy one {_MID}.</div>"
    f"<article><h1>+Title of the story</h1><p><b>+First words.<br><p>+{_LONG} {_LONG}.</p><p>+Short.</p>"
    f"<p>+{_LONG}.</p><p>+{_MID}.</p></article><footer>-Copyright of the house {_MID}</footer></body>",
    # the same without text worth the name
    "<body><nav><a>-One</a><a>-Two</a></nav><article><h1>+Note</h1><p>+Yes.</p></article>"
    "<footer>-All rights reserved</footer>",
    # main element, side bar, form, comments inside of it
    f"<body><header><h1><a>-The Daily</a></h1><p>-News for all {_MID}</p></header><main><h2>+A headline</h2>"
    f"<p>+{_LONG} {_LONG} {_LONG}.</p><ul><li>+first point {_MID}</li><li>+second point</li></ul>"
    f"<p>+{_MID} <a>with a link</a>.</p><blockquote><p>+{_LONG}</p></blockquote>"
    f"<div class='comments'><h3>-Comments</h3><p>-{_LONG} {_LONG}.</p><p>-I agree</p></div></main>"
    f"<aside><h3>-Most read</h3><p>-{_LONG}</p><ul><li><a>-Read this too</a></li></ul></aside>"
    f"<form><p>-Your name</p><p>-Sign up to {_MID} {_MID}</p></form><footer><p>-{_LONG}</p></footer></body>",
    # header inside of an article, lists of links, shares, related stories
    f"<body><div id='menu'><p>-Menu</p></div><article><header><h1>+Name of it</h1><p>+By somebody</p></header>"
    f"<p>+{_LONG}.</p><div class='share-buttons'><p>-Share it</p></div><pre>+code = 1</pre>"
    f"<table><tr><td>+cell one</td><td>+cell two</td></tr></table><h2>+Part two</h2><p>+{_LONG} {_LONG}</p>"
    f"<p>+<a>A line that is a link</a></p><section class='related-posts'><p>-{_LONG}</p><p><a>-More</a></p>"
    f"</section></article><div class='cookie-notice'><p>-We use {_LONG}</p></div></body>",
    # plain divisions: only words and links tell
    f"<body><div><a>-Start</a> <a>-Shop</a> <a>-Help</a></div><div>-Menu</div><h1>+What happened today</h1>"
    f"<div>+{_LONG} {_LONG} {_LONG}.</div><div>+{_LONG} {_LONG}.</div><div>+{_MID}.</div>"
    f"<div>+{_LONG} {_LONG}.</div><div><a>-Previous page</a> <a>-next page</a></div><div>-Copyright 2020</div></body>",
    f"<body><ul><li><a>-Start</a></li><li><a>-Shop</a></li></ul><p>+{_LONG} {_LONG}.</p><p>+{_LONG} {_LONG}"
    f" {_LONG}.</p><p>+{_MID} and {_MID} more.</p><p>+{_LONG} {_LONG}.</p><ul><li><a>-Imprint</a></li><li><a>-Terms</a></li></ul>",
    f"<body><p><a>-Log in</a></p><h2>+Some title here</h2><p>+{_LONG} {_LONG} {_LONG}.</p><p>+{_LONG}.</p>"
    f"<p>-All rights reserved.</p></body>",
    f"<body><p>+{_LONG} {_LONG}.</p></body>",
    f"<body><div class='sidebar'><p>-{_LONG} {_LONG}</p><p>-{_LONG}</p></div><p>+{_LONG} {_LONG} {_LONG}.</p>"
    f"<div class='newsletter'><p>-{_LONG} {_LONG}</p></div><p>+{_LONG} {_LONG}.</p><div class='footer'>"
    f"<p>-{_LONG}</p><p>-{_MID}</p></div></body>",
    # an article whose parts are short, and one with furniture of many words
    f"<body><nav><p>-{_LONG}</p></nav><article><h1>+One</h1><p>+Two.</p><p>+Three four.</p><p>+Five.</p></article>"
    f"<aside>-{_LONG} {_LONG}</aside><footer>-{_LONG} {_LONG}</footer></body>",
    f"<body><article><p>+{_LONG}</p><nav><a>-next</a></nav><aside>-{_LONG} {_LONG}</aside><p>+{_MID}</p>"
    f"<footer><p>-{_MID}</p></footer><form>-{_LONG}</form><p>+End.</p></article><p>-Outside of it {_LONG} {_LONG}</p>"
    f"<p>-Elsewhere</p></body>",
    f"<body><p>-{_LONG} {_LONG} before the story</p><article><h1>+Story</h1><p>+{_LONG}</p></article>"
    f"<div>-{_LONG} after it</div><div><a>-{_MID}</a></div></body>",
]


class _Writer:
    """Parts of a page, of lengths and shapes that vary with its number."""

    def __init__(self, number: int) -> None:
        self.rng = random.Random(number)

    def words(self, least: int, most: int) -> str:
        return " ".join(["word"] * self.rng.randint(least, most))

    def links(self, mark: str) -> str:
        many = [f"<a>{mark}{self.words(1, 4)}</a>" for _ in range(self.rng.randint(1, 6))]
        shape = self.rng.choice(["<div>{}</div>", "<p>{}</p>", "<ul><li>{}</li></ul>"])
        if self.rng.random() < 0.5:  # a block each
            return "".join(shape.format(link) for link in many)
        between = self.rng.choice([" ", " | ", f" {self.words(1, 1)} "])
        return shape.format(between.join(many))

    def paragraph(self, mark: str) -> str:
        body = mark + self.words(*self.rng.choice([(2, 5), (4, 15), (15, 50), (50, 150), (150, 400)]))
        if self.rng.random() < 0.3 and len(body) > 40:  # a link of at most a fifth of it
            body += f" <a>{self.words(1, body.count(' ') // 5)}</a> {self.words(1, 3)}"
        return self.rng.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(body)

    def mixture(self, mark: str, link_mark: str, most: int) -> str:
        parts, since = [], 0
        for _ in range(self.rng.randint(2, most)):
            parts.append(self.paragraph(mark))
            since += 1
            if since > 1 and self.rng.random() < 0.3:
                parts.append(self.links(link_mark))
                since = 0
        return "".join(parts)


def plain_page(number: int) -> str:
    """A page without tags or names that tell anything: menus, lists of links and links between the
    paragraphs are dropped, a title and paragraphs of any length, some with links in them, are kept."""
    w = _Writer(number)
    label = f"<p>-{w.words(1, 3)}</p>"  # between lists of links
    top = w.links("-") + (label + w.links("-") if w.rng.random() < 0.6 else "")
    title = f"<h1>+{w.words(2, 12)}</h1>" if w.rng.random() < 0.8 else ""
    # The last paragraph is a whole sentence: a line of a few words there may as well be a notice.
    last = f"<p>+{w.words(8, 60)}</p>"
    bottom = "".join(w.links("-") for _ in range(w.rng.randint(0, 2)))
    return f"<body>{top}{title}{w.mixture('+', '-', 10)}{last}{bottom}</body>"


def story_page(number: int) -> str:
    """A page that says where its story is: all of it is kept, links and short lines too, but for what
    is set apart in it; nothing else is, however long."""
    w = _Writer(number)
    tag = w.rng.choice(["article", "main"])
    apart = w.rng.choice(["aside", "nav", "form", "footer"])
    inner = f"<{apart}>{w.mixture('-', '-', 3)}</{apart}>" if w.rng.random() < 0.5 else ""
    story = f"<h1>+{w.words(1, 12)}</h1>{w.mixture('+', '+', 5)}{inner}{w.mixture('+', '+', 3)}"
    return f"<body>{w.mixture('-', '-', 4)}<{tag}>{story}</{tag}>{w.mixture('-', '-', 4)}</body>"


PLAIN_PAGES, STORY_PAGES = 60, 60
LABELLED += [plain_page(k) for k in range(PLAIN_PAGES)] + [story_page(k) for k in range(STORY_PAGES)]
