"""Main-text extraction from HTML by block rules in two passes.

A page becomes a list of blocks: text between block-level tags, with its length, its share of characters in
links and its share of stop words. The first pass labels a block good, bad, near (long enough to be
text, but not sure), odd (as long, without stop words and links) or short. The second pass gives near blocks, and then short ones, the label of the nearest
decided neighbours: those of the same container first, then those of the same article, then any outside of articles.

Elements that are boilerplate by their name or class (menus, forms, reader comments, ...) are out from the start, and say nothing about
their neighbours. A class name that says more than that (``content-with-sidebar``) and a form don't make boilerplate of what holds
half of the page's text or an article, and such a name says nothing within an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more not of on one or out
    she so than that the their there they this to up was we were what when which who will with would you
    au aux avec ce ces cette comme dans de des du elle elles en est et être il ils la le les leur lui mais même ne nous on ou où par pas plus pour
    qu que qui sa se ses si son sont sur un une vous
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch
    nur oder sein sich sie sind so über um und von vor war wie wird zu zum zur
    al como con cuando de del desde el ella en entre era es esta este fue ha hasta la las le lo los más me mi muy no o para pero por porque que
    se ser si sin sobre son su sus también un una y ya
    anche che chi ci con cui da dal dalla degli dei del della delle di dove e è era fra già gli ha hanno i il io la le lei lo loro ma mi nel nella non o per perché più
    questa questo quella quello se si sono su sul sulla tra tutti un una
    ao aos até com como da das do dos ela ele em entre era essa esse esta este eu foi isso já mais mas mesmo muito na não nas nem no nos o os ou para pela pelo por quando que
    se sem seu sua também tem um uma
    aan al als bij dan dat de deze die dit door een en er geen had heeft het hij hoe ik in is je kan maar meer met naar niet nog nu of om onder ook op over te tot uit van voor
    waar was wat we wel werd wordt ze zich zij zijn zo
    а без более бы был была были было быть в вам вас весь во вот все всего вы где да для до его ее её если есть еще ещё же за здесь и из или им их к как ко когда кто ли либо
    между меня мне может мы на над надо наш не него нее ней нет ни них но ну о об однако он она они оно от очень по под при с со так также такой там те тем то того тоже той
    только том ты у уже хотя чего чей чем что чтобы чье чья эта эти это этого этой этом этот
    """.split()
)
# Names of HTML elements.
#: Raw text, which without an end tag goes on to the end of the page; other elements whose content is left out; those of them that can close themselves.
RAW = ("script", "style", "textarea", "title")
SKIPPED = frozenset(["noscript", "template", "svg", "math", "iframe", "object", "select", "button", "canvas", "audio", "video"])
FOREIGN = frozenset(["svg", "math"])
BOILERPLATE = frozenset(["nav", "footer", "aside", "menu", "dialog"])
CONTENT = frozenset(["article", "main"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ITEMS = frozenset(["li", "td", "th", "dd", "dt", "option"])
BLOCKS = HEADINGS | BOILERPLATE | CONTENT | ITEMS | frozenset(
    "address blockquote body caption center details dir div dl fieldset figcaption figure form head header hgroup hr html legend ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Parts of the names in class, id or role attributes. A name with one of HINTS marks boilerplate, surely so if its other words are of RESTS or
# PLACES (site-footer, but not footer-design) or a short prefix; one of WEAK does so
# alone or before words of RESTS only (social, social-links, but not social-science); names that begin with one of ABOUT say something else.
HINTS = frozenset(
    """
    ad ads advert advertisement advertising breadcrumb breadcrumbs combx comment comments commentlist consent contentinfo cookie cookies copyright disqus disclaimer
    footer masthead menu modal nav navbar navigation newsletter outbrain pagination pager popup promo promoted shoutbox sidebar sidebars signup skyscraper sponsor sponsored
    taboola toolbar
    """.split()
)
WEAK = frozenset("banner notice notices notification promotion recommended related replies reply respond share sharing social subscribe subscription widget widgets".split())
RESTS = WEAK | frozenset(
    "area article articles bar block body box button buttons container content form group header heading icon icons inner item items link links list media message news outer panel post posts row section stories story text title top bottom wrap wrapper".split()
)
PLACES = frozenset(
    "page site main global primary secondary first second third last left right upper lower inline sticky fixed floating horizontal vertical mobile desktop small large big native google dfp wrap outer user reader module unit slot zone".split()
)
ABOUT = frozenset("has is no not with without hide show open close".split())
COMMENT = frozenset(["comment", "comments", "reply", "replies"])
# Marks that end a sentence in some script.
SENTENCE_ENDS = re.compile(r"[.!?…。！？｡।؟۔։။።]")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.05, 0.12
LINKS_MOST = 0.3
#: Characters a sentence end at most, where stop words can't tell.
SENTENCE_MOST = 300

# attributes as HTML has them: a quote inside an unquoted value or a name is an ordinary character
_ATTRIBUTES = r"(?:[\s/]+|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)?|=)*+>"
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRIBUTES + r"(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRIBUTES + r"|[^>]*(?:>|\Z))",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD_EDGE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SPLIT_HINT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    links: int  # characters in links
    forced: bool  # boilerplate by its element or by a sure name
    maybe: tuple[int, ...]  # numbers of the open elements that a name or a form makes boilerplate, unless they hold most of the page
    content: int  # number of the innermost content element, 0 outside
    container: int  # number of the innermost block element but paragraphs
    kind: str  # heading, item (of a list or table) or empty
    label: str = ""


def names_boilerplate(name: str) -> int:
    """Whether one name of a class, id or role attribute marks boilerplate: 0 no, 1 perhaps, 2 surely."""
    words = [w.lower() for w in _SPLIT_HINT.split(name) if w]
    if not words or words[0] in ABOUT:
        return 0
    hints = [k for k, w in enumerate(words) if w in HINTS]
    if hints:
        others = [w for k, w in enumerate(words) if w not in HINTS and w not in RESTS and w not in PLACES and not (k < hints[0] and len(w) <= 3)]
        return 1 if others else 2
    return 2 if words[0] in WEAK and all(w in RESTS or w in PLACES for w in words[1:]) else 0


def names_comment(name: str) -> bool:
    """Whether one name says that the element is a reader's comment."""
    return next((w.lower() for w in _SPLIT_HINT.split(name) if w), "") in COMMENT


def marks(attrs: str) -> tuple[int, bool, bool]:
    """What class, id or role say (as names_boilerplate() does), whether the element is hidden, and whether it is a comment."""
    named, hidden, comment = 0, False, False
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or ""
        if key in ("class", "id", "role"):
            names = value.strip("\"'").split()
            named = max([named, *map(names_boilerplate, names)])
            comment = comment or any(map(names_comment, names))
        elif key == "hidden" or key == "aria-hidden" and value.strip("\"'").lower() == "true" or key == "style" and _UNSEEN.search(value):
            hidden = True
    return named, hidden, comment


def skipped(tags: list[re.Match[str]]) -> dict[int, int]:
    """Where SKIPPED elements begin and end; one without its end tag inside its parent isn't there, so nothing after it is lost."""
    spans: dict[int, int] = {}
    if not any((m["name"] or "").lower() in SKIPPED for m in tags):
        return spans
    open_tags: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    for m in tags:
        name = (m["name"] or "").lower()
        if name not in SKIPPED and (name not in BLOCKS or name in ("p", "hr")):
            continue
        if not m["end"]:
            if not (name in FOREIGN and m["attrs"].endswith("/>")):
                open_tags.append((name, m.start()))
                count[name] = count.get(name, 0) + 1
        elif count.get(name):
            while True:
                other, start = open_tags.pop()
                count[other] -= 1
                if other == name:
                    break
            if name in SKIPPED:
                spans[start] = m.end()
    return spans


@dataclass
class _Open:
    """An open element, with what it has from those around it."""

    name: str
    bad: bool  # by elements
    named: bool  # by sure names only, which an article within says nothing to
    maybe: tuple[int, ...]
    content: int
    container: int


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    blocks: list[Block] = []
    stack = [_Open("", False, False, (), 0, 0)]
    opened: dict[str, int] = {}  # how many of a name are open
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = False
    kind = ""
    contents = containers = 0
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html.unescape("".join(link_parts)).split()))
                x = stack[-1]
                blocks.append(Block(text, links, x.bad or x.named, x.maybe, x.content, x.container, kind or ("item" if x.name in ITEMS else "")))
            parts.clear()
            link_parts.clear()

    def close() -> None:
        opened[stack.pop().name] -= 1

    tags = list(_TAG.finditer(page))
    spans = skipped(tags)
    for m in tags:
        if m.start() < at:
            continue  # in a skipped element
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                link_parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in SKIPPED:
            at = spans.get(m.start(), at)
            continue
        end = m["end"] == "/"
        if name == "a":
            in_link = not end
            continue
        attrs = m["attrs"]
        named, hidden, comment = marks(attrs) if not end and len(attrs) > 1 and name not in ("html", "body") else (0, False, False)
        marked = named > 0 or hidden
        if name not in BLOCKS and not marked and not opened.get(name):
            continue
        flush()
        in_link = False
        kind = "heading" if not end and name in HEADINGS else ""
        if end:
            if opened.get(name):
                while stack[-1].name != name:
                    close()
                close()
        elif name not in VOID and name not in ("p", "hr") or marked and name == "p":
            if name in ITEMS and stack[-1].name == name:
                close()
            x = stack[-1]
            containers += 1
            own = _Open(name, x.bad, x.named, x.maybe, x.content, x.container if name == "p" or name in HEADINGS else containers)
            if name in CONTENT:
                contents += 1
                own.content = contents
                # what a wrapper's names say goes no further, unless the article's own say so too
                own.named, own.maybe = x.named and named > 0 or named == 2, ()
            else:
                own.named = x.named or named == 2
                if (named == 1 or name == "form") and not x.content:
                    own.maybe = (*x.maybe[:7], containers)
            # a page's header is boilerplate, an article's header isn't
            own.bad = x.bad or hidden or comment and name == "article" or name in BOILERPLATE or name == "form" and x.content > 0 or name == "header" and not own.content
            stack.append(own)
            opened[name] = opened.get(name, 0) + 1
        elif name == "p" and stack[-1].name == "p":
            close()  # a marked paragraph without its end
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            link_parts.append(page[at:])
    flush()
    settle(blocks)
    return blocks


def settle(blocks: list[Block]) -> None:
    """Decides which doubtful elements are boilerplate: those that hold less than half of the text that no sure sign takes out."""
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        if not b.forced:
            n = len(b.text) - b.links
            total += n
            for k in b.maybe:
                held[k] = held.get(k, 0) + n
    for b in blocks:
        b.forced = b.forced or any(2 * held.get(k, 0) < total for k in b.maybe)


def size(text: str) -> int:
    """Characters, of which those of scripts with a sign for a syllable or a word count as three."""
    return len(text) if text.isascii() else len(text) + 2 * sum("\u2e80" <= c <= "\ud7a3" or c >= "\U00020000" for c in text)


def stop_words(text: str) -> tuple[int, int]:
    """Stop words, and all words."""
    words = _WORD_EDGE.findall(text)
    return sum(w.lower() in STOP_WORDS for w in words), len(words)


def first_pass(b: Block, known: bool = True) -> str:
    """known: whether the page's language is one of the stop words'; otherwise the density of sentence ends stands in for theirs."""
    n = size(b.text)
    if b.forced:
        return "out"
    if b.links > LINKS_MOST * len(b.text):
        # a link in an article's running text is text, a list of them may be a menu
        return "bad" if not b.content or b.kind == "item" else "short"
    if "©" in b.text and n < LENGTH_HIGH and not b.content:
        return "bad"
    if n < LENGTH_LOW:
        return "bad" if b.links and not b.content else "short"
    if known:
        stops, words = stop_words(b.text)
        share = stops / max(1, words)
    else:
        share = STOP_HIGH if len(SENTENCE_ENDS.findall(b.text)) * SENTENCE_MOST >= n else 0.0
    if share >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    if share >= STOP_LOW or b.content:
        return "near"
    return "bad" if b.links else "odd"


def language_known(blocks: list[Block]) -> bool:
    """Whether stop words occur in the page's longer blocks as they do in a language that they are from."""
    counts = [stop_words(b.text) for b in blocks if not b.forced and size(b.text) >= LENGTH_LOW]
    return sum(s for s, _ in counts) >= STOP_HIGH * sum(n for _, n in counts) > 0


def nearest(blocks: list[Block], step: int) -> list[tuple[int, int, int]]:
    """For each block the nearest decided one to one side: in its container, in its content element, and outside of these (-1: none)."""
    found = [(-1, -1, -1)] * len(blocks)
    containers: dict[int, int] = {}
    contents: dict[int, int] = {}
    for i in range(len(blocks)) if step < 0 else range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        found[i] = containers.get(b.container, -1), contents.get(b.content, -1), contents.get(0, -1)
        if b.label in ("good", "bad"):
            containers[b.container] = contents[b.content] = i
    return found


def second_pass(blocks: list[Block]) -> None:
    """Labels near blocks and then short ones by their decided neighbours; blocks that are out decide nothing."""
    for kind in ("near", "short"):
        before, after = nearest(blocks, -1), nearest(blocks, 1)
        anything = any(b.label == "good" for b in blocks)
        labels = []
        for i, b in enumerate(blocks):
            if b.label != kind:
                labels.append(b.label)
                continue
            left, right = next(((x, y) for x, y in zip(before[i][: 2 if b.content else 3], after[i], strict=False) if x >= 0 or y >= 0), (-1, -1))
            if b.content and (kind == "near" or left < 0 or right < 0):
                labels.append("good")  # an article's text is out only as a short piece between two menus
            elif left < 0 and right < 0:
                # a short block is text only where no other is
                labels.append("good" if kind == "near" or not anything and any(map(str.isalnum, b.text)) else "bad")
            elif left < 0 or right < 0:
                labels.append(blocks[max(left, right)].label)
            elif blocks[left].label == blocks[right].label:
                labels.append(blocks[left].label)
            elif kind == "near" or b.kind == "heading" and blocks[right].label == "good":
                labels.append("good")
            elif i - left != right - i:
                labels.append(blocks[left if i - left < right - i else right].label)
            else:
                labels.append("good" if b.content else "bad")
        for b, label in zip(blocks, labels, strict=True):
            b.label = label
        if kind == "near":
            # text without links and stop words goes with its container
            good = {b.container for b in blocks if b.label == "good"}
            for b in blocks:
                if b.label == "odd":
                    b.label = "good" if b.container in good or not good else "bad"


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by a space; empty for null, empty and boilerplate-only pages."""
    blocks = blocks_of(page or "")
    known = language_known(blocks)
    for b in blocks:
        b.label = first_pass(b, known)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract_columns(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points), replacing columns of these names.

    Null html counts as empty and gives an empty text. Repeated rows get equal values; an empty table gives
    an empty result; other columns pass through, whatever their names.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    schema = pages.select(kept).limit(0).withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, page = batch.columns
            texts = [main_text(x) for x in page.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
