"""Main text of web pages: a conditional random field over the leaf blocks of the document tree.

A leaf block is the text between two tags of block elements. Its features are the elements above it
(names, words of class, id and role) and the shape of its text; the field labels each block of a
page, and the blocks labelled as text are joined. It is trained on the labelled pages below, in
which ``data-main`` marks the elements that hold main text.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Rows, small_batches
from plumbline.llm.crf import Model, train

#: Elements by kind (fixed values of the HTML standard).
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul head noscript button textarea label legend iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the value set ends open elements of the key.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "head", "title", "option", "optgroup", "button", "label", "legend", "iframe", "noscript"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: Elements whose content is no text of the page, with their end tags. Without an end tag, script and
#: style go on to the end of the page; of the others only the start tag is skipped.
RAW = {
    name: re.compile(rf"</{name}(?![^\s/>])", re.I)
    for name in ("script", "style", "template", "svg", "iframe", "noembed", "noframes")
}
NAME = re.compile(r"[^\s/>]*")
#: What ends a tag or begins a quoted value in it.
SPECIAL = re.compile(r"[>\"']")
MARKS = re.compile(r"\b(class|id|role|itemprop|data-main|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("above", "own", "main", "link", "parts", "text")

    def __init__(self, element: Element):
        self.above, self.own, self.main = element.above, element.own, element.main
        self.link, self.parts, self.text = 0, [], ""


class Element:
    """An open element. ``above`` are the names and marks of those around it and its own, shared where nothing is new."""

    __slots__ = ("name", "above", "own", "main", "head")

    def __init__(self, name: str, above: frozenset[str], own: str, main: bool, head: bool):
        self.name, self.above, self.own, self.main, self.head = name, above, own, main, head


class Ends:
    """Where tags end. Positions are asked in rising order; every part of the page is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[int, int] = {}
        self.asked = (0, -1)

    def after(self, at: int) -> int:
        """Place of the ``>`` of a tag that begins before ``at``, or -1: quoted values are skipped."""
        page, start = self.page, at
        path = []
        end = -1
        first = True
        while True:
            if first and self.asked[0] <= at <= self.asked[1]:
                place = self.asked[1]
            else:
                found = SPECIAL.search(page, at)
                place = found.start() if found else len(page)
                if first:
                    self.asked = (start, place)
            first = False
            if place == len(page):
                break
            if place in self.known:
                end = self.known[place]
                break
            if page[place] == ">":
                end = place
                break
            path.append(place)
            at = page.find(page[place], place + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(path, end))
        return end


class Tree:
    """The open elements of a page and the blocks found so far."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack = [Element("", frozenset(), "", False, False)]
        #: Number of open elements by name: all, and those inside each open block element.
        self.open: dict[str, int] = {}
        self.inside: list[dict[str, int] | None] = [None]
        self.blocks: list[Block] = []
        self.current: Block | None = None

    def text(self, raw: str) -> None:
        if self.stack[-1].head:
            return
        if self.current is None:
            if not raw.strip():
                return
            self.current = Block(self.stack[-1])
            self.blocks.append(self.current)
        text = html.unescape(raw)
        self.current.parts.append(text)
        if self.open.get("a"):
            self.current.link += len(text)

    def push(self, name: str, attributes: str) -> None:
        top = self.stack[-1]
        marks, main = marks_of(attributes) if attributes else ((), False)
        above, own = top.above, top.own
        if name in BLOCKS or marks:
            own = name
            if marks or name not in above:
                new = {name, *marks}
                if self.known is not None:
                    new &= self.known
                above = above if new <= above else above | new
        self.stack.append(Element(name, above, own, top.main or main, top.head or name in ("head", "title")))
        self.open[name] = self.open.get(name, 0) + 1
        if name in BLOCKS:
            self.inside.append(None)
        else:
            inside = self.inside[-1]
            if inside is None:
                inside = self.inside[-1] = {}
            inside[name] = inside.get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop().name
        self.open[name] -= 1
        if name in BLOCKS:
            self.inside.pop()
        else:
            self.inside[-1][name] -= 1
        return name

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.current is not None:
                self.current.parts.append(" ")
            return
        if name in BLOCKS:
            self.current = None
            while True:
                top = self.stack[-1].name
                ends = name in CLOSED_BY.get(top, ())
                in_line = top and top not in BLOCKS and self.open.get("p") and name in CLOSED_BY["p"]
                if not ends and not in_line:
                    break
                self.pop()
        if name not in VOID and not closes_itself(attributes):
            self.push(name, attributes)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.current = None
        if (self.open if name in BLOCKS else self.inside[-1] or {}).get(name):
            while self.pop() != name:
                pass


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks with text, in page order. Unclosed and misnested elements end with what holds them.

    Of names and marks of elements only those in ``known`` are kept, if given. The page is read once from left to
    right, so the time is in proportion to its length whatever is unclosed.
    """
    tree = Tree(known)
    ends = Ends(page)
    unclosed: set[str] = set()
    text_from = at = 0
    while (at := page.find("<", at)) >= 0:
        begin = at
        mark = page[at + 1 : at + 2]
        name = ""
        if mark.isalpha() and mark.isascii() or mark == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha():
            end = ends.after(at + 1)
            if end < 0:
                at += 1
                continue
            at = end + 1
            body = page[begin + (2 if mark == "/" else 1) : end]
            name = NAME.match(body).group()
            attributes, name = body[len(name) :], name.lower()
        elif mark in ("!", "?", "/"):
            close = "-->" if page.startswith("<!--", at) else "]]>" if page[at : at + 9].upper() == "<![CDATA[" else ">"
            end = page.find(close, at + (4 if close == "-->" else 2))
            if end < 0 and close == ">":
                break  # Without a ">" there is no other tag.
            at = len(page) if end < 0 else end + len(close)
        else:
            at += 1
            continue
        if begin > text_from:
            tree.text(page[text_from:begin])
        text_from = at
        if not name:
            continue
        if mark == "/":
            tree.end(name)
        elif name in RAW:
            if name in unclosed or name == "svg" and closes_itself(attributes):
                continue
            last = RAW[name].search(page, at)
            end = page.find(">", last.end()) if last else -1
            if end >= 0:
                text_from = at = end + 1
            elif name in ("script", "style"):
                text_from = at = len(page)
            else:
                unclosed.add(name)
        else:
            tree.start(name, attributes)
    if text_from < len(page):
        tree.text(page[text_from:])
    for block in tree.blocks:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in tree.blocks if b.text]


def closes_itself(attributes: str) -> bool:
    """Whether a slash at the end of a tag belongs to it and not to a value without quotes."""
    if not attributes.endswith("/"):
        return False
    value = attributes[-2000:].split()[-1].partition("=")[2]
    return not value or value[0] in "\"'"


def marks_of(attributes: str) -> tuple[tuple[str, ...], bool]:
    marks, main = [], False
    for key, *values in MARKS.findall(attributes):
        if key.lower() == "data-main":
            main = True
        elif key.lower() == "hidden":
            marks.append(".hidden")
        else:
            marks += (f".{w.lower()}" for w in WORDS.findall("".join(values)))
    return tuple(marks), main


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for place, block in enumerate(blocks):
        text = block.text
        share = block.link / max(len(text), 1)
        own = {f"in {name}" for name in block.above}
        own.add(f"own {block.own}")
        own.add(f"length {min(len(text).bit_length(), 8)}")
        own.add(f"links {min(int(share * 4), 3)}")
        own.add("ends" if text[-1] in ".!?\"'”»" else "open")
        if text[0] == "©":
            own.add("copyright")
        if place == 0:
            own.add("first")
        out.append(sorted(own))
    return out


#: Labelled pages. Words are of no language: only elements and shapes are learned from.
SHORT, LINE = "Alo mira", "Alo mira tenu soba kelo wani."
LONG = "Alo mira tenu soba kelo wani, rado pesi lumo. Tika vero sanu delo mira, kuno bati. Wani lumo soba."
MENU = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Alo", "Mira", "Tenu soba"))
LABELLED = (
    f"<body><nav><ul>{MENU}</ul></nav><div class=ad>{LINE}</div><article data-main><h1>{SHORT}</h1><p>{LONG}</p><p>{LINE}</p>"
    f"<p>{SHORT}</p></article><footer>© alo.example · {LINE}</footer></body>",
    f"<body><header><h1>{SHORT}</h1><p>{LINE}</p></header><main><article data-main><h2>{LINE}</h2><p>{LONG}</p>"
    f"<ul><li>{LINE}</li><li>{SHORT}</li></ul><p>{LONG}</p></article></main><aside><h3>{SHORT}</h3><p>{LONG}</p></aside>"
    f"<footer><p>{LONG}</p></footer></body>",
    f"<body><div class=header>{SHORT}</div><div id=menu><ul>{MENU}</ul></div><div class=content data-main><p>{LONG}</p>"
    f"<blockquote>{LINE}</blockquote><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p><ul>{MENU}</ul></div>"
    f"<div class=footer>© {LINE}</div></body>",
    f"<body><div class=cookie-notice><p>{LONG}</p><button>{SHORT}</button></div><div class=nav>{MENU}</div><main data-main>"
    f"<h1>{SHORT}</h1><p>{LONG}</p><table><tr><td>{SHORT}</td><td>{LINE}</td></tr></table><pre>{LINE}</pre></main>"
    f"<section class=comments><h2>{SHORT}</h2><p>{LONG}</p><div class=comment><p>{LINE}</p></div></section></body>",
    f"<body><div role=banner><p>{LINE}</p></div><article><div class=breadcrumb>{SHORT}</div><div data-main><h1>{SHORT}</h1>"
    f"<p>{LONG}</p><p>{LONG}</p></div><div class=advert><p>{LONG}</p></div><div data-main><p>{LONG}</p></div>"
    f"<aside class=related><p>{LINE}</p></aside><form><label>{SHORT}</label><p>{LINE}</p><button>{SHORT}</button></form>"
    f"<div class=share>{MENU}</div></article><footer>{LINE}</footer></body>",
    f"<body><ul>{MENU}</ul><div id=main><div class=post data-main><h2>{LINE}</h2><p>{LONG}</p><p>{LINE}</p><p>{LONG}</p></div>"
    f"<div id=comments><h3>{SHORT}</h3><ol><li><p>{LONG}</p></li><li><p>{LINE}</p></li></ol></div></div>"
    f"<div id=footer><p>{LINE}</p></div></body>",
    f"<body><div class='notice alert'><p>{LONG}</p></div><div class=banner>{LINE}</div><p data-main>{LONG}</p>"
    f"<p data-main>{LONG}</p><div class=subscribe><p>{LINE}</p></div><div class=widget><p>{LONG}</p></div>"
    f"<div class=promo><p>{LINE}</p></div></body>",
    f"<body><header class=top><nav>{MENU}</nav></header><section data-main><h2>{SHORT}</h2><p>{LINE}</p><p>{LONG}</p>"
    f"<dl><dt>{SHORT}</dt><dd>{LINE}</dd></dl><figure><figcaption>{LINE}</figcaption></figure></section>"
    f"<div class='ads sponsored'><p>{LONG}</p></div><noscript><p>{LINE}</p></noscript>"
    f"<div class=disqus><div class=reply><p>{LONG}</p></div></div><div class=copyright>© {SHORT}</div></body>",
    f"<body><nav>{MENU}</nav><article data-main><h1>{SHORT}</h1><p><b>{LONG}<br><p>{LONG}</p><p>{LINE}</p></article>"
    f"<div class=comment-list><article class=comment><p>{LONG}</p></article></div><footer><div>{LINE}</div></footer></body>",
    f"<body><nav>{MENU}</nav><main><h1 data-main>{SHORT}</h1><p data-main>{LONG}</p><ul data-main><li>{SHORT}</li><li>Alo</li></ul>"
    f"<p data-main>{LINE}</p><ol data-main><li>{SHORT}</li><li>{LINE}</li><li>Mira</li></ol></main><aside><p>{LONG}</p></aside>"
    f"<footer><p>{LINE}</p></footer></body>",
    f"<body><div class=cookies><p>{LINE}</p></div><div class=popup><p>{LINE}</p></div><main><div class=article-body data-main>"
    f"<p>{LONG}</p><p>{LONG}</p></div><div class=newsletter><form><p>{LINE}</p><select><option>{SHORT}</option></select>"
    f"</form></div><div class=social>{MENU}</div></main><div class=bottom>{LINE}</div></body>",
    f"<body><div class=zor><div class=mip><ul>{MENU}</ul></div><div class=lat data-main><h1>{SHORT}</h1><p>{LONG}</p><p>{LINE}</p>"
    f"<p>{LONG}</p></div><div class=related><ul>{MENU}</ul></div></div><div class=footer><p>{LINE}</p></div></body>",
    f"<body><p data-main>{LINE}</p><p data-main>{LONG}</p><h2 data-main>{SHORT}</h2><p data-main>{LINE}</p><p data-main>{LONG}</p></body>",
    f"<body><center data-main><p>{LONG}</p><p>{LINE}</p></center><center>{MENU}</center></body>",
    f"<body><div role=navigation>{MENU}</div><div role=main data-main><h1>{SHORT}</h1><ol><li>{LINE}</li><li>{LINE}</li></ol><p>{LINE}</p>"
    f"</div><div role=complementary><p>{LONG}</p></div><div role=contentinfo>© {SHORT}</div></body>",
    f"<body><div id=kel><div id=vun data-main><p>{LINE}</p><pre>{SHORT}</pre><p>{LONG}</p><div><p>{LINE}</p></div></div>"
    f"<div id=sidebar><h3>{SHORT}</h3><p>{LINE}</p></div></div></body>",
    f"<body><div class=masthead>{SHORT}</div><div class=pum><div data-main><div><div><p>{LINE}</p><p>{LINE}</p></div></div></div></div>"
    f"<div class=comments><div><p>{LINE}</p></div></div></body>",
    # Main text in elements whose names say nothing.
    *(
        f"<body><div class=header>{SHORT}</div><div class=nav>{MENU}</div><div class={word} data-main><h1>{SHORT}</h1>{body}</div>"
        f"<div class=footer>{LINE}</div></body>"
        for word, body in (
            ("kol", f"<p>{LINE}</p><p>{LONG}</p><p>{LINE}</p>"),
            ("vet", f"<p>{LONG}</p><pre>{SHORT}</pre><p>{LINE}</p>"),
            ("sam", f"<div><p>{LINE}</p></div><div><p>{LINE}</p></div>"),
            ("dun", f"<h2>{SHORT}</h2><p>{LINE}</p><h2>{SHORT}</h2><p>{LINE}</p><ul><li>{LINE}</li><li>{SHORT}</li></ul>"),
            ("rif", f"{LINE}<br>{LONG}<div>{LINE}</div>"),
        )
    ),
)


@functools.lru_cache(maxsize=4)
def fitted(pages: tuple[str, ...] = LABELLED) -> Model:
    trees = [leaf_blocks(page) for page in pages]
    answers = [["text" if b.main else "other" for b in blocks] for blocks in trees]
    return train([features(b) for b in trees], answers, ("other", "text"))


def known_names(model: Model) -> frozenset[str]:
    """Names and marks that the model has weights for; the others don't count."""
    return frozenset(f[3:] for f in model.features if f.startswith("in "))


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
PAGES_AT_ONCE = 256


def extract_text(
    pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: page_id, url, text (empty if there is none), n_chars.

    White space inside a block is one space, blocks are joined by one. A null or empty page has no
    text; a page of plain text is one block. Rows are taken on their own, so repeats come back.
    """
    model = model or fitted()
    known = known_names(model)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                trees = [leaf_blocks(page.as_py() or "", known) for page in part.column("html")]
                labels = model.decode([features(blocks) for blocks in trees])
                out = Rows(EXTRACTED)
                for page_id, url, blocks, own in zip(
                    part.column("page_id").to_pylist(), part.column("url").to_pylist(), trees, labels, strict=True
                ):
                    text = " ".join(b.text for b, label in zip(blocks, own.tolist(), strict=True) if label)
                    out.add(page_id, url, text, len(text))
                yield from out.take()

    picked = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
    )
    return picked.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
