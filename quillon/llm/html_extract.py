"""Main text of web pages by two-pass block rules (operator 5).

The page is cut into blocks at block elements. First pass: stop-word density, length and link density
classify blocks. What a block's containers are is a prior: within an article or main element the
thresholds are lower; menus, headers, footers, sidebars, adverts and comments go. Second pass: short
ambiguous blocks inherit the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import quiet_threads

SHORT_BLOCK, LONG_BLOCK = 70, 200
LINKED, LINKED_LIST = 0.2, 0.6
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.12, 0.22
#: How much more text than is found elsewhere an article within a form or a boilerplate's name must have.
NAMED_WEIGHT = 4

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its
    more no not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nos notre nous ou où par pas pour qu que qui sa se ses si son sont sur ta te tes ton tu un une vos votre vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im in ist ja kein man mich mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    al algo como con cual cuando del desde donde el ella ellos en era es esa ese eso esta este esto fue ha hay la las le les lo los más me mi muy ni no nos o otro para pero por porque que quien se ser si sin sobre son su sus también te tu un una uno y ya yo""".split()
)
# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title svg math iframe object canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("html head body div section article main nav header footer aside form menu dialog ul ol dl table figure details blockquote fieldset center address hgroup".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption pre hr figcaption summary legend option thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name boilerplate.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert
    alertdialog popup modal overlay dialog newsletter subscribe subscription signup login signin nav navbar navigation menu menubar breadcrumb breadcrumbs
    masthead footer contentinfo sidebar complementary widget related recommended share sharing social comment comments commentlist disqus respond reply
    replies pagination pager copyright toolbar search form""".split()
)
# Of these, words that an article's own parts may bear as well,
DOUBTFUL = frozenset("notice notices alert overlay related share sharing social search form copyright respond reply replies widget banner promotion".split())
# And words within which not even an article element is the page's own.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense promo sponsor sponsored comment comments commentlist disqus related recommended replies".split())
# Words that go with those above without changing what they name.
FILLERS = frozenset(
    """site page main post entry article content top bottom left right primary secondary global inner outer wrap wrapper container area box bar block list
    lists item items link links button buttons section group panel module row col text title body posts articles stories header head thread icons""".split()
)

# A tag's attributes up to its end: quotes count where a value begins. No part can give back what it took.
REST = re.compile(r"""(?:[\s/]++|(?:=|[^\s/>=])[^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+(?![^\s/=>])""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    state: str  # by its containers, see State
    heading: bool
    place: int  # number of the innermost container


class State:
    """What the containers of a block say. BAD is a verdict, the others are priors."""

    FREE, MAIN, BAD = "free", "main", "bad"
    NAMED = "named"  # in a form, or in what a class, id or role calls boilerplate
    NAMED_MAIN = "named main"  # in an article or main element within such


def boilerplate_words(value: str) -> set[str]:
    """Words of NAMES by which a class, id or role as a whole names boilerplate: with FILLERS alone beside them."""
    out: set[str] = set()
    for token in value.split():
        parts = {p.lower() for p in PART.findall(token)}
        if parts <= NAMES | FILLERS:
            out |= parts & NAMES
            if parts & {"header", "head"} and parts & {"site", "page", "top", "global"}:
                out.add("header")
    return out


def attributes(attrs: str) -> tuple[bool, bool, set[str]]:
    """Whether an element is hidden, whether its role is the main part, and the boilerplate that it names."""
    hidden, main, words = False, False, set()
    if not attrs or attrs.isspace():
        return hidden, main, words
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), html.unescape(value.strip("\"'")).strip()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "role" and value.lower() in ("main", "article"):
            main = True
        elif key in ("class", "id", "role"):
            words |= boilerplate_words(value)
    return hidden, main, words


def within(state: str, name: str, attrs: str) -> str:
    """The state within an element of this name and attributes, itself in the given state."""
    if state == State.BAD or name in ("html", "body"):
        return state
    hidden, main, words = attributes(attrs)
    if hidden or name in BOILERPLATE:
        return State.BAD
    if name in MAIN or main:
        if words & FOREIGN - DOUBTFUL:
            return State.BAD
        return State.MAIN if state in (State.FREE, State.MAIN) else State.NAMED_MAIN
    inside = state in (State.MAIN, State.NAMED_MAIN)
    if name in ("header", "head") and not inside:
        return State.BAD
    if inside:
        words -= DOUBTFUL | {"header"}
    if words & FOREIGN:
        return State.BAD
    if words or name == "form":
        return State.BAD if inside else State.NAMED
    return state


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order. Time grows with the page's length, whatever its markup."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, str, int]] = []  # open containers with the state that holds within and their numbers
    opened: dict[str, int] = {}  # how many of each name are on the stack
    endless: set[str] = set()  # hidden elements that are not closed any more
    state, own, heading, link, linked, place, places = State.FREE, None, False, False, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, own or state, heading, place))
        parts, linked = [], 0

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith(("<!", "<?"), start)):  # no tag ends any more
            start = n
        if start > at:
            parts.append(page[at:start])
            if link:
                linked += start - at
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) if not page.startswith(("<!-->", "<!--->"), start) else page.find(">", start) - 2
            at = n if end < 0 else end + 3
            continue
        found = NAME.match(page, start)
        if found is None:
            if page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        closing, name, end = page[start + 1] == "/", found[1].lower(), REST.match(page, found.end())
        if end is None:  # nothing ends this tag: it is text
            parts.append(page[start:])
            break
        attrs, at = end[0][:-1], end.end()
        empty = attrs.rstrip().endswith("/")
        if name in HIDDEN:
            if not closing and not empty and name not in endless:
                stop = re.compile(rf"</{name}\b[^>]*+>", re.I).search(page, at)
                if stop is None:
                    endless.add(name)
                at = stop.end() if stop else (n if name in ("script", "style", "title", "textarea") else at)
            parts.append(" ")
            continue
        if name == "a":
            link = not closing
            continue
        if name not in BLOCKS:
            if name in ("br", "td", "th", "img", "input"):
                parts.append(" ")
            continue
        flush()
        link = False
        own, heading = None, name in HEADINGS and not closing
        if name not in CONTAINERS:
            if not closing:
                own = within(state, name, attrs)
            continue
        if closing:
            if opened.get(name):
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            state, place = stack[-1][1:] if stack else (State.FREE, 0)
        elif not empty:
            places += 1
            state, place = within(state, name, attrs), places
            stack.append((name, state, place))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def by_density(block: Block) -> bool | None:
    """True: main text, False: boilerplate, None: ambiguous; by link density, length and stop-word density alone."""
    density = min(1.0, block.linked / len(block.text))
    if density > LINKED_LIST:
        return False
    if len(block.text) < SHORT_BLOCK or block.heading:
        return False if density > LINKED else None
    share = stop_share(block.text)
    if share >= MANY_STOP_WORDS:
        return True
    if share >= FEW_STOP_WORDS and len(block.text) >= LONG_BLOCK:
        return True
    return None if share >= FEW_STOP_WORDS else False


def in_article(block: Block) -> bool | None:
    """by_density() with the lower thresholds of a block in an article: only many links make it doubtful."""
    density = min(1.0, block.linked / len(block.text))
    if density > LINKED_LIST:
        return None if len(block.text) < SHORT_BLOCK else False
    return True if len(block.text) >= SHORT_BLOCK or stop_share(block.text) >= FEW_STOP_WORDS else None


def first_pass(found: list[Block], main: str | None) -> list[bool | None]:
    """Labels of all blocks. main: the state that marks the article's blocks, if the page has one."""
    labels = [False if b.state == State.BAD or (main and b.state != main) else in_article(b) if main else by_density(b) for b in found]
    run: list[int] = []
    for i in range(len(found) + 1):  # three linked blocks in a row or more are a menu, in an article too
        if i < len(found) and found[i].linked > LINKED_LIST * len(found[i].text):
            run.append(i)
            continue
        if len(run) > 2:
            for j in run:
                labels[j] = False
        run = []
    return labels


def second_pass(found: list[Block], labels: list[bool | None], main: str | None) -> list[bool]:
    """Ambiguous blocks take the label of both decided neighbours, or of the nearer; a heading that of the next.

    Of two as near, that of the same container counts, else the block goes. On a page with an article
    the article's own blocks are the neighbours; there a block without links stays if any of both does.
    """
    counted = [i for i, b in enumerate(found) if not main or b.state == main]
    before: list[tuple[int, bool | None]] = []
    last: tuple[int, bool | None] = (-1, None)
    for i in counted:
        if labels[i] is not None:
            last = (i, labels[i])
        before.append(last)
    after: list[tuple[int, bool | None]] = []
    last = (-1, None)
    for i in reversed(counted):
        if labels[i] is not None:
            last = (i, labels[i])
        after.append(last)
    after.reverse()
    out = [bool(x) for x in labels]
    for i, (b, left), (a, right) in zip(counted, before, after):
        if labels[i] is None:
            if left is None and right is None:
                out[i] = True
            elif left is None or right is None or left == right:
                out[i] = bool(right if left is None else left)
            elif found[i].heading:
                out[i] = bool(right)
            elif main and not found[i].linked:
                out[i] = True
            else:
                label = left if i - b < a - i else right
                if i - b == a - i:
                    same = [x for x, j in ((left, b), (right, a)) if found[j].place == found[i].place]
                    label = same[0] if len(same) == 1 else False
                out[i] = bool(label)
    return out


def prose(found: list[Block], state: str) -> int:
    """Characters of the blocks in a state that are main text by density alone."""
    return sum(len(b.text) for b in found if b.state == state and by_density(b))


def main_text(page: str | None) -> str:
    """The main text of a page, a block on each line. Null, empty, or nothing but boilerplate: ''.

    An article or main element is a prior: its blocks have lower thresholds and those about it go, unless
    density finds more main text about it than its blocks have characters, as about a teaser; then
    density alone decides for all. One that stands in a form or a container of a boilerplate's name
    counts if the page has no other. A page without any main text is read again as if forms and names
    said nothing.
    """
    found = blocks(page or "")
    around = prose(found, State.FREE)
    for main, weight in ((State.MAIN, 1), (State.NAMED_MAIN, NAMED_WEIGHT)):
        size = sum(len(b.text) for b in found if b.state == main)
        if size >= max(1, around * weight):
            return kept(found, main)
        if size:
            break
    free = [replace(b, state=State.BAD) if b.state in (State.NAMED, State.NAMED_MAIN) else b for b in found]
    return kept(free, None) or kept(found, None)


def kept(found: list[Block], main: str | None) -> str:
    labels = first_pass(found, main)
    if not main:
        free = [i for i, b in enumerate(found) if b.state != State.BAD]
        if not any(labels[i] is not None for i in free):  # nothing but short blocks, none decided
            for i in free:
                labels[i] = True
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, labels, main)) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from its whole html.

    Null html is empty; its text is the empty string. Repeated rows give repeated results; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
