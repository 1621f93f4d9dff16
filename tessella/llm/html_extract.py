"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and words. Every token has a weight that is
learnt from labelled pages. A word's is its log-odds of standing in the main text,
the sum of what the elements say that it stands in: their tags, the words of their
class, id and role, and whether the page has a main element elsewhere. A tag's
weight is below zero and the less so the oftener main text stands around it. One
linear scan finds the contiguous region with the largest sum, and the words of the
region that score above zero are the page's text.

A run of tokens without a word that scores above zero is one token of the scan, with
their sum but no less than ``-ISLAND``, so that an advert inside an article costs
the region something and doesn't part it, however long it is.

No class name or element is dropped by itself; only what no browser shows as text
(``RAW``) never counts. Reading is linear in the page, whatever is left open.

Edge cases: a null or empty page gives an empty text, as does a page without a word
that scores above zero. Unclosed and stray tags, cut-off markup and unknown tags are
read as browsers do. Very long pages are read whole. Equal sums take the first
region. Repeated rows are extracted each on its own; an empty table gives no rows.
Extra columns pass through, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bound_batches

# Elements whose whole content is dropped.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title head".split())
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements inside a line; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements that an end tag of a paragraph or line element does not close.
SCOPES = frozenset("html body div section article main nav header footer aside form menu dialog fieldset table ul ol dl td li blockquote figure".split())
# Openings of class names that tell of a page's state and not of an element's content.
STATE = re.compile(r"(?:has|with|without|no|is|js)[-_]", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title|head)\b[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL | re.ASCII,
)
_CLOSE = {n: re.compile(f"</{n}", re.IGNORECASE | re.ASCII) for n in "script style noscript template iframe svg textarea title head".split()}
_MARKS = re.compile(r"""(?:\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))|((?<=\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none)""", re.IGNORECASE | re.ASCII)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RIGHTS = re.compile(r"\s*(?:©|&copy;|copyright\b)", re.IGNORECASE)
#: The whole heading, with a count before or behind.
_TALK = re.compile(r"\W*(?:\d+\s+)?(?:(?:readers?'?s?|user|your)\s+)?(?:comments?|responses?|replies|leave a (?:comment|reply)|join the (?:discussion|conversation))\W*(?:\d+\W*)?\Z", re.IGNORECASE)
_BAR = re.compile("[|»›•·]")
#: A block of few words at a time between bars or dots.
_BARS = re.compile(r"\s*[^|»›•·]{1,30}(?:\s[|»›•·]\s[^|»›•·]{1,30}){2,}\s*\Z")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Features of a page's text besides those of its elements.
OUTSIDE, RIGHTS, TALK, LINKS, BARS, BIAS = "outside the main element", "rights", "after a heading of comments", "links alone", "words between bars", "any word"
#: A feature of a first heading in the head of an article.
TITLE = "title of an article"


class Context:
    """An open element: its features, and the element it stands in."""

    __slots__ = ("features", "link", "name", "parent", "raw", "talk", "weight")

    #: ``features`` are those that no element around has, ``weight`` is the sum of all.
    def __init__(self, name: str, parent: Context | None, features: list[str], weight: float, raw: bool):
        self.name, self.parent, self.features, self.weight, self.raw, self.talk = name, parent, features, weight, raw, False
        self.link = name == "a" or parent is not None and parent.link

    def all_features(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out += at.features
            at = at.parent
        return out


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    """The tag, unless it is a link's, and ``.part`` for the parts of each word of class, id and role, ``=part`` too where it is the whole word."""
    out = [] if name == "a" else [name]
    if attributes and name not in ("html", "body"):
        for x in _MARKS.finditer(attributes):
            if x[4]:
                out.append("hidden")
                continue
            for w in (x[1] or x[2] or x[3] or "").split():
                if not STATE.match(w):
                    parts = [p.lower() for p in _PARTS.findall(w)]
                    out += ["." + p for p in parts] + ["=" + p for p in parts if len(parts) == 1]
    return tuple(out)


@dataclass
class Token:
    """A tag (``name``) or a piece of text: where it stands, whether it follows a heading of comments, in how many main elements, and whether its block is links alone or words between bars."""

    name: str
    text: str
    context: Context
    talk: bool = False
    main: int = 0
    links: bool = False
    bars: bool = False


def tokens(page: str, weight: Callable[[str], float] = lambda f: 0.0, bias: float = 1.0) -> Iterator[Token]:
    """Tags and pieces of text in page order.

    A main element is an article or main element (or role) whose paragraphs the weights, with ``bias``, hold for text.
    """
    root = context = Context("", None, [], 0.0, False)
    stack: list[tuple[Context, bool]] = []
    open_at: dict[str, list[int]] = {}
    known: set[str] = set()
    scopes: list[int] = []
    unclosed: set[str] = set()
    main = at = 0
    heading: list[Token] | None = None

    def pop() -> None:
        nonlocal context, main
        x, is_main = stack.pop()
        open_at[x.name].pop()
        if scopes and scopes[-1] == len(stack):
            scopes.pop()
        main -= is_main
        known.difference_update(x.features)
        context = x.parent or root

    def text_of(piece: str) -> Iterator[Token]:
        if not context.raw:
            t = Token("", piece, context, context.talk, main)
            if heading is not None:
                heading.append(t)
            yield t

    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            yield from text_of(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            found = None if name in unclosed else _CLOSE[name].search(page, at)
            if found is None:
                unclosed.add(name)
                if name == "head":
                    continue
                at = len(page)
            else:
                close = page.find(">", found.end())
                at = len(page) if close < 0 else close + 1
            yield Token(f"<{name}>", "", context, main=main)
            continue
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            yield Token(f"</{name}>", "", context, main=main)
            if name in _HEADINGS and heading is not None:
                if _TALK.match("".join(t.text for t in heading)[:200]):
                    # The heading is talk and what follows beside it.
                    for t in heading:
                        t.talk = True
                    (context.parent if context.name == name else context).talk = True
                heading = None
            depth = open_at[name][-1] if open_at.get(name) else -1
            if depth >= 0 and (name in SCOPES or not scopes or scopes[-1] <= depth):
                while len(stack) > depth:
                    pop()
            continue
        yield Token(f"<{name}>", "", context, main=main)
        if name in VOID:
            continue
        if name in ("p", "li", "td", "dd", "dt", "option") and stack:
            while stack and stack[-1][0].name == "p":
                pop()
            if name != "p" and stack and stack[-1][0].name == name:
                pop()
        elif name not in INLINE:
            while stack and stack[-1][0].name == "p":
                pop()
        features = features_of(name, m[4])
        if name == "h1" and "header" in known and "article" in known:
            features += (TITLE,)
        new = [f for f in dict.fromkeys(features) if f not in known]
        known.update(new)
        child = Context(name, context, new, context.weight + sum(map(weight, new)), context.raw or name in RAW)
        child.talk = context.talk
        landmark = name in ("article", "main") or (".main" in features and re.search(r"(?:^|\s)role\s*=\s*[\"']?main\b", m[4], re.IGNORECASE) is not None)
        landmark = landmark and not child.raw and bias + child.weight + ("p" not in known and weight("p")) > 0
        open_at.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append((child, landmark))
        context, main = child, main + landmark
        if name in _HEADINGS:
            heading = []
    if at < len(page):
        yield from text_of(page[at:])


def read(page: str, weight: Callable[[str], float] = lambda f: 0.0, bias: float = 1.0) -> list[Token]:
    """The tokens, with the pieces marked whose block is links alone, or words between bars."""
    seen = list(tokens(page, weight, bias))
    block: list[Token] = []

    def close() -> None:
        if block and all(t.context.link for t in block):
            for t in block:
                t.links = True
        if len(block) < 40 and any(_BAR.search(t.text) for t in block) and _BARS.match("".join(t.text for t in block)):
            for t in block:
                t.bars = True
        block.clear()

    for t in seen:
        if t.name:
            if t.name.strip("</>") not in INLINE:
                close()
        elif not t.text.isspace():
            block.append(t)
    close()
    return seen


def _words(piece: str) -> list[str]:
    return html.unescape(piece).split()


def _extras(t: Token, outside: bool) -> list[str]:
    return [OUTSIDE] * (outside and not t.main) + [RIGHTS] * (not t.main and _RIGHTS.match(t.text) is not None) + [TALK] * t.talk + [LINKS] * t.links + [BARS] * (t.bars and not t.main)


@dataclass(frozen=True)
class Weights:
    """Weights of the features of words and of tags."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, feature: str) -> float:
        return self.words.get(feature, 0.0)

    @property
    def bias(self) -> float:
        return self.words.get(BIAS, 0.0)

    def read(self, page: str) -> tuple[list[Token], list[float]]:
        """The page's tokens, and of each its score a word, or the tag's.

        Text outside the main element counts as such if the element holds a share of
        the page's text that one would expect of it.
        """
        seen = read(page, self.word, self.bias)
        plain = [self.bias + t.context.weight + sum(self.words.get(f, 0.0) for f in _extras(t, False)) if not t.name else self.tags.get(t.name, UNKNOWN_TAG) for t in seen]
        size = [len(t.text.split()) if not t.name and s > 0 else 0 for t, s in zip(seen, plain)]
        inside = sum(n for t, n in zip(seen, size) if t.main)
        if any(t.main for t in seen) and inside * LEAST_SHARE >= sum(size) - inside:
            out = self.words.get(OUTSIDE, 0.0)
            plain = [s + out if not t.name and not t.main else s for t, s in zip(seen, plain)]
        return seen, plain


#: Weight of a tag that no labelled page has.
UNKNOWN_TAG = -0.1
#: The most that a run without main text takes from a region.
ISLAND = 2.0
#: A main element has a third of the text beside it at least.
LEAST_SHARE = 3


#: A feature of fewer labelled pages is as good as unknown.
LEAST_PAGES = 5


def fit_logistic(rows: Counter[tuple[frozenset[str], bool]], ridge: float = 0.02, steps: int = 20) -> dict[str, float]:
    """Weights of the features by ridge-penalised logistic regression on counted rows."""
    names = sorted({f for (fs, _) in rows for f in fs})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    y, n = np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((fs, label), count) in enumerate(sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))):
        x[i, [place[f] for f in fs]] = 1
        x[i, -1] = 1
        y[i], n[i] = label, count
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * b)
    return dict(zip([*names, BIAS], b.tolist()))


def fit_weights(labelled: Iterable[tuple[str, str]]) -> Weights:
    """Weights from (page, main text) pairs.

    A word counts as main text if it is the next one of that text's words. Word
    weights are fitted twice: which elements are main follows from the first.
    """
    labelled = list(labelled)
    weights = Weights({}, {})
    for known in (False, True):
        rows: Counter[tuple[frozenset[str], bool]] = Counter()
        good: Counter[str] = Counter()
        bad: Counter[str] = Counter()
        seen_in: Counter[str] = Counter()
        for page, text in labelled:
            left = text.split()[::-1]
            seen = read(page, weights.word, weights.bias) if known else read(page)
            has_main = known and any(t.main for t in seen)
            flags = []
            seen_in.update({f for t in seen if not t.name for f in [*t.context.all_features(), *_extras(t, has_main)]})
            for t in seen:
                if t.name:
                    flags.append((t.name, False))
                    continue
                features = frozenset(t.context.all_features() + _extras(t, has_main))
                for w in _words(t.text):
                    hit = bool(left) and left[-1] == w
                    if hit:
                        left.pop()
                    flags.append(("", hit))
                    rows[features, hit] += 1
            hits = [i for i, (_, f) in enumerate(flags) if f]
            first, last = (hits[0], hits[-1]) if hits else (0, -1)
            for i, (name, _) in enumerate(flags):
                if name:
                    (good if first < i < last else bad)[name] += 1
        odds = {n: np.log((good[n] + 0.5) / (bad[n] + 0.5)) for n in good | bad}
        common: Counter[tuple[frozenset[str], bool]] = Counter()
        for (features, hit), n in rows.items():
            common[frozenset(f for f in features if seen_in[f] >= min(LEAST_PAGES, len(labelled) / 4)), hit] += n
        weights = Weights(fit_logistic(common), {n: float(min(-0.02, 0.05 * (o - 4))) for n, o in odds.items()})
    return weights


# Elements that hold no running text of the article.
BESIDE = "nav header footer aside form menu dialog button fieldset".split()
# Words that name parts of a page which are not its article, each with what such a part says.
NOT_ARTICLE = {
    "menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager skip topbar": "Home News Topics All pages",
    "header masthead banner": "The daily site with its slogan",
    "footer copyright imprint colophon contentinfo": "Terms of the publisher",
    "sidebar aside widget complementary": "Most read this week",
    "cookie cookies consent gdpr notice notification alert overlay modal popup": "We store data on this device. Accept?",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola": "Buy the best shoes today, cheap or good.",
    "share sharing social follow": "Tell your friends about it",
    "related recommended recommendation recommendations teaser teasers": "Ten more stories that you may like",
    "comment comments reply replies respond responses disqus discussion": "I like it, said a reader. Me too!",
    "newsletter subscribe subscription signup login search": "Your address, please. Send",
}
# Of these words, those that name such a part whatever word stands beside them.
DECIDED = frozenset("nav navbar breadcrumb breadcrumbs pagination footer sidebar cookie cookies consent gdpr ad ads advert adverts advertisement sponsor sponsored promo promotion outbrain taboola comment comments disqus newsletter".split())
# Parts that name a box around any content.
BOXES = "area bar block bottom box button buttons card container global group inner item items label links list panel row slot wrap wrapper zone".split()
# Words that name parts of an article.
OF_ARTICLE = "entry post article content story body text page title headline lead intro summary chapter paragraph quote caption figure byline table note main hentry".split()


def labelled_pages() -> list[tuple[str, str]]:
    """The labelled pages: some whole ones, and one for each word that names a part, by rule."""
    a, b = "The first part of the text has a number of words,", "and here it ends, after a second one."
    out = list(WHOLE_PAGES)
    blocks = ("<p>{}</p>", "{}", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<dl><dd>{}</dd></dl>", "<span>{}</span>")

    def once(i: int) -> str:
        return "x" + "".join("abcdefghij"[int(k)] for k in str(i))

    def add(i: int, inner: str, kept: str) -> None:
        h = f"<h{i % 6 + 1}>A title</h{i % 6 + 1}>"
        body = f"{h}<p>{a} <a href=/l>a link</a> too</p>{inner}{blocks[i % len(blocks)].format(b)}"
        links = "<p><a href=/m>A line of links,</a></p><ul><li><a href=/n>one more</a></li></ul>"
        text = f"A title {a} a link too {kept} {b}"
        named = f"{OF_ARTICLE[i % len(OF_ARTICLE)]}-{OF_ARTICLE[(i + 3) % len(OF_ARTICLE)]}"
        out.append((f"<body><nav><a href=/>Home</a></nav><article>{body}{links}</article><div>Beside it</div><footer>Bye</footer></body>", f"{text} A line of links, one more"))
        out.append((f"<body><ul><li><a href=/>Home</a></li></ul><div>{body}</div><p><a href=/o>Go on</a></p></body>", text))
        out.append((f"<body><p><a href=/>Home</a></p><div class='{named}'>{body}</div><ul><li><a href=/o>Go on</a></li></ul></body>", text))
        out.append((f"<body><a href=/>Home</a>{body}<h3>Comments</h3><div><p>So it is.</p></div><p>© the house</p></body>", text))

    i = 0
    for names, says in NOT_ARTICLE.items():
        for w in names.split():
            for k in range(5):
                box = BOXES[(7 * k + i) % len(BOXES)]
                add(i + k, f"<div {('class', 'id')[k % 2]}='{(w, w, f'{w}-{box}', f'{w}_{box}', f'{box}-{w}')[k]}'>{blocks[(i + k) % 3].format(says)}</div>", "")
            # Beside a word that names no box, a word of several meanings names a part of the article; one that is decided doesn't.
            if w in DECIDED:
                for k in range(6):
                    part = (OF_ARTICLE[(5 * k + i) % len(OF_ARTICLE)], once(i), f"{once(i)}-{i}")[k // 2]
                    add(i + k, f"<div class='{(f'{part}-{w}', f'{w}-{part}')[k % 2]}'>{blocks[(i + k) % 3].format(says)}</div>", "")
            else:
                add(i, f"<div class='{w}-{once(i)}'>{blocks[i % 3].format('What it says on that.')}</div>", "What it says on that.")
            if w in ("header", "banner", "notice"):
                for part in OF_ARTICLE:
                    add(i, f"<div class='{part}-{w}'><p>What it says there.</p></div>", "What it says there.")
            i += 1
    for tag in BESIDE:
        for says in ("Home News Topics", "Some words of another kind, not of the text."):
            add(i, f"<{tag}>{blocks[i % 3].format(says)}</{tag}>", "")
            i += 1
    for k, how in enumerate(("hidden", "aria-hidden='true'", "style='display:none'", "style='color: red; display: none'", "hidden class=more", "style=display:none")):
        add(k, f"<div {how}>{blocks[k % 3].format('Nobody sees these words.')}</div>", "")
        title, body = f"Title {once(k)} of it", f"{a} {b}"
        byline = ("<p class='byline'>By someone</p>", "<span>By someone</span>", "<time>In May</time>")[k % 3]
        out.append((f"<body><header><h1>The site</h1></header><article><header><h1>{title}</h1>{byline}</header><p>{a}</p><p>{b}</p></article><footer>Bye</footer></body>", f"{title} {body}"))
        bars = (" | ", " · ", " » ", " • ")[k % 4].join(("Home", "About us", "Contact", "Terms"))
        out.append((f"<body><{'p div'.split()[k % 2]}>{bars}</{'p div'.split()[k % 2]}><div><h1>A title</h1><p>{a}</p><p>{b}</p></div><p>{bars}</p></body>", f"A title {body}"))
    for w in [*OF_ARTICLE, *BOXES]:
        add(i, f"<div class='{w}'>{blocks[i % len(blocks)].format('Some words of it.')}</div>", "Some words of it.")
        i += 1
    return out


# Labelled pages, (page, main text).
WHOLE_PAGES: tuple[tuple[str, str], ...] = (
    (
        "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        "<article><h1>A title here</h1><p>The first part has some words.</p><p>The <b>second</b> one has <a href='/c'>more</a>.</p>"
        "<p><a href='/d'>A line of links stands here</a></p><ul><li><a href='/e'>and one</a></li></ul></article>"
        "<footer>Rights of someone</footer></body></html>",
        "A title here The first part has some words. The second one has more. A line of links stands here and one",
    ),
    (
        "<body><div class='menu'><a href='/1'>One</a> <a href='/2'>Two</a></div><div><h2>Heading</h2><p>Long running text stands here and goes on for a while.</p>"
        "<ul><li>first point</li><li>second point</li></ul><p>Closing words.</p></div><div class='footer'>contact us</div></body>",
        "Heading Long running text stands here and goes on for a while. first point second point Closing words.",
    ),
    (
        "<body><header><h1>Site</h1></header><main><p>Only this is the text of the page, all of it.</p><aside>See also</aside><p>And this.</p>"
        "<header>Head of a part</header><nav>On this page</nav><p>More of it.</p><dialog>Are you sure?</dialog><menu><li>Open</li></menu></main>"
        "<form><p><label>Name</label><input><button>Send</button></p></form><div>Made with love</div><p>All pages</p><div><p>Some more words that are not of it.</p></div></body>",
        "Only this is the text of the page, all of it. And this. More of it.",
    ),
    (
        "<body><ul><li><a href='/x'>Start</a></li><li><a href='/y'>About</a></li></ul><p>Text without any landmark, but with a number of words in it.</p>"
        "<blockquote>Quoted words.</blockquote><table><tr><td>a cell</td></tr></table><p>It has <a href='/z'>a link</a> too.</p><p><a href='/p'>Previous</a> <a href='/n'>Next</a></p></body>",
        "Text without any landmark, but with a number of words in it. Quoted words. a cell It has a link too.",
    ),
    (
        "<body><article class='post'><header class='entry-header'><h1>Its title</h1><p>By someone</p></header><div class='entry-content'><p>What the article says, at some length.</p></div>"
        "<footer class='entry-footer'>Posted in things</footer></article><section class='comments'><article><p>A reader says so.</p></article></section>"
        "<div hidden><p>Nobody sees it.</p></div></body>",
        "Its title By someone What the article says, at some length.",
    ),
    (
        "<body><div><h1>A title</h1><p>A page without any class, and with a talk below.</p><h3>2 Comments</h3><div><p>I like it, said a reader.</p></div><p>So do I.</p></div>"
        "<p>© 2020 by its makers, all of it</p></body>",
        "A title A page without any class, and with a talk below.",
    ),
    (
        "<body><article><p>Text and then.</p><form><p>Your name</p><fieldset>Yes</fieldset></form><aside><p>Also read this one.</p></aside><nav><a href=/>Up</a></nav>"
        "<footer><p>Filed under things</p></footer><p>It goes on.</p><h2>Comments</h2><p>First!</p></article><p>Copyright of the house</p><div><form><p>Name</p></form></div></body>",
        "Text and then. It goes on.",
    ),
    (
        "<body><header><p>The site</p></header><div><p>Words of the page, not in any main element.</p></div><aside><p>Beside it</p></aside><form><p>Ask us</p></form>"
        "<nav><p>Go on</p></nav><footer><p>Bye</p></footer><menu><li>Do</li></menu><dialog><p>Sure?</p></dialog><button>Go</button><fieldset>No</fieldset></body>",
        "Words of the page, not in any main element.",
    ),
)


@cache
def default_weights() -> Weights:
    return fit_weights(labelled_pages())


def best_region(weights: Sequence[float]) -> tuple[int, int]:
    """First contiguous region with the largest sum above zero, by one scan; (0, 0) where there is none."""
    best = total = 0.0
    start = 0
    region = (0, 0)
    for i, w in enumerate(weights):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, region = total, (start, i + 1)
    return region


def scanned(seen: list[Token], scores: list[float]) -> tuple[list[float], list[int]]:
    """Weights of what the scan sees, pieces of main text and the runs between them, and where each begins."""
    weights, starts = [], []
    island = None
    for i, (t, s) in enumerate(zip(seen, scores)):
        n = 1 if t.name else len(t.text.split())
        if not t.name and s > 0 and n:
            weights.append(s * n)
            starts.append(i)
            island = None
        elif island is None:
            island = len(weights)
            weights.append(max(-ISLAND, s * n))
            starts.append(i)
        else:
            weights[island] = max(-ISLAND, weights[island] + s * n)
    return weights, [*starts, len(seen)]


def extract_text(page: str | None, weights: Weights | None = None) -> str:
    """The running text of the best region: white space in a block as one space, blocks joined by one."""
    if not page:
        return ""
    seen, scores = (default_weights() if weights is None else weights).read(page)
    tokens_, starts = scanned(seen, scores)
    first, end = best_region(tokens_)
    out = []
    for i in range(starts[first], starts[end]):
        t = seen[i]
        if t.name:
            if t.name.strip("</>") not in INLINE:
                out.append(" ")
        elif scores[i] > 0:
            out.append(html.unescape(t.text))
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch], column: str, weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract_text(v.as_py(), weights) for v in batch.column(column)]
        keep = [i for i, n in enumerate(batch.schema.names) if n != column]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=[batch.schema.names[i] for i in keep] + ["text", "n_chars"],
        )


def extract_pages(df: DataFrame, column: str = "html", weights: Weights | None = None) -> DataFrame:
    """``df`` without the html column, plus text and n_chars (code points)."""
    weights = default_weights() if weights is None else weights
    df = df.drop(*[c for c in df.columns if c.lower() in ("text", "n_chars") and c != column])
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return bound_batches(df).mapInArrow(lambda it: _extract(it, column, weights), schema)
