"""HTML extraction by consensus host paths.

Every page scores its containers: the words of the blocks below them that are neither boilerplate nor mostly links. It
votes for one generalised path of tags and classes (digits as ``#``): the semantic container (article, main) that
holds half of the words or more, else the deepest container that holds nine tenths. Votes are summed per host in Spark; each
page is then extracted again from all containers at its host's winning path, in page order, or from those at its own
choice's path, if the winning path is missing, holds no prose, or holds less prose than a choice of another layout: one
that does not enclose the winners, or a semantic one.

Prose beside the containers stays, semantic ones too, unless its path is a template of the host: on a tenth of its pages or more, and
with words that repeat (half as many different texts as blocks, or fewer). A form or an element whose names mark boilerplate, but that
holds nine tenths of the page's prose (comments aside), is the page itself and stays if it has PAGE_WORDS, a heading or article inside,
or is a form without controls. Inline elements with such names go only where they are all of a block.

Defined cases: a null or empty html has an empty text; a page without blocks has an empty text; a very long page is read
whole; a null url belongs to the empty host; ties between paths go to the deeper, then the lexically smaller one; repeated rows
each count and stay; null page_ids stay; an empty table gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, slices
from .urls import host_of

#: Element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head script style noscript template iframe object svg math canvas nav footer aside form button select textarea dialog menu title audio video map".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("html body div article section main td center blockquote figure details".split())
SEMANTIC = {"article", "main"}
CLOSES_P = BLOCK - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
#: Words of class, id or role names that mark boilerplate.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar toolbar pagination pager comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "search searchform contentinfo complementary copyright skip hidden".split()
)
#: Of these, marks of reader comments; marks that count only before a generic part, or at the name's end.
COMMENTS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion"}
WEAK = {"share", "sharing", "social", "search", "widget"}
#: Parts of names that say nothing of what an element holds; a mark counts if only these follow it.
GENERIC = set(
    "area bar block box button buttons container form icon icons inner outer item items link links list section this title wrap wrapper "
    "author avatar body content date details holder label main media message meta metadata panel post posts region row slot space text thread trail unit zone column columns "
    "articles products reading stories policy left right top bottom middle primary secondary first second last one two three desktop mobile sticky fixed global site".split()
)
LAYOUT = {"has", "with", "no", "without", "layout"}
#: Words that an element marked as boilerplate must hold to be taken for the page itself, if nothing in it says that it is.
PAGE_WORDS = 30
OWN = {"entry", "post", "article", "content", "section", "story", "page"}
#: Elements that only a text of its own holds, and controls that make a form one.
TITLES, CONTROLS = {"h1", "article", "main"}, {"input", "textarea", "select", "button"}
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(names: str, top: bool, marks: set[str] = MARKS) -> bool:
    """Whether class, id or role names mark boilerplate: in one of them a mark is the last part that says anything (``main-nav-wrapper``,
    but not ``menu-ideas`` or ``comments-open``). What follows a word of layout (``content-with-sidebar``) doesn't count; outside an
    article (top) a header marks too, unless it is a text's own."""
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        parts = parts[: next((i for i, p in enumerate(parts) if p in LAYOUT), len(parts))]
        if not parts:
            continue
        said = [p for p in parts if p not in GENERIC and len(p) > 1] or parts[:1]
        strong = said[-1] in marks and said[-1] not in WEAK
        weak = parts[0] in WEAK & marks and (len(parts) == 1 or parts[-1] in GENERIC | WEAK) or parts[-1] in WEAK & marks - {"widget"}
        if strong or weak or "".join(parts) in marks or top and "header" in parts and not OWN & set(parts):
            return True
    return False


class Layout:
    """The elements and text blocks of a page. An element: (parent, tag, path hash, label, depth). A block: (element,
    text); link_words has its words inside links."""

    def __init__(self, elements: list, blocks: list, link_words: list[int]):
        self.elements: list[tuple[int, str, int, str, int]] = elements
        self.blocks: list[tuple[int, str]] = blocks
        self.link_words = link_words

    def pack(self) -> bytes:
        """The elements that hold text, without their labels, and the blocks, compressed."""
        used = [False] * len(self.elements)
        for at, _ in self.blocks:
            while at >= 0 and not used[at]:
                used[at] = True
                at = self.elements[at][0]
        place = {-1: -1}
        for i, there in enumerate(used):
            if there:
                place[i] = len(place) - 1
        kept = [(place[e[0]], e[1], e[2], "", e[4]) for e, there in zip(self.elements, used, strict=True) if there]
        held = json.dumps((kept, [(place[at], text) for at, text in self.blocks], self.link_words), separators=(",", ":"))
        return zstandard.ZstdCompressor(level=1).compress(held.encode())

    @classmethod
    def unpack(cls, raw: bytes) -> Layout:
        return cls(*json.loads(zstandard.ZstdDecompressor().decompress(raw)))

    def prose(self, block: int) -> bool:
        """Whether at most half of a block's words are inside links."""
        return 2 * self.link_words[block] <= len(self.blocks[block][1].split())

    def masses(self) -> list[int]:
        """The words of prose below each element."""
        out = [0] * len(self.elements)
        for i, (at, text) in enumerate(self.blocks):
            if at >= 0 and self.prose(i):
                out[at] += len(text.split())
        for i in range(len(out) - 1, -1, -1):  # parents come first
            if self.elements[i][0] >= 0:
                out[self.elements[i][0]] += out[i]
        return out

    def choice(self, mass: list[int] | None = None) -> int:
        """The element that this page votes for, or -1."""
        mass = self.masses() if mass is None else mass
        total = sum(m for m, e in zip(mass, self.elements, strict=True) if e[0] < 0)
        if not total:
            return -1
        fits = [i for i, e in enumerate(self.elements) if e[1] in SEMANTIC and 2 * mass[i] >= total]
        fits = fits or [i for i, e in enumerate(self.elements) if e[1] in CONTAINER and 10 * mass[i] >= 9 * total]
        return max(fits, key=lambda i: (self.elements[i][4], mass[i], -i), default=-1)

    def path(self, at: int) -> str:
        labels = []
        while at >= 0:
            labels.append(self.elements[at][3])
            at = self.elements[at][0]
        return "/".join(reversed(labels))

    def inside(self, wanted: int | None) -> list[bool]:
        """By block: whether it is at or below the elements of a path (None: of the whole page)."""
        inside = [False] * len(self.elements)
        for i, e in enumerate(self.elements):
            inside[i] = e[2] == wanted or e[0] >= 0 and inside[e[0]]
        return [wanted is None or i >= 0 and inside[i] for i, _ in self.blocks]

    def beside(self, wanted: int) -> list[int]:
        """The blocks of prose outside the elements of a path."""
        return [i for i, within in enumerate(self.inside(wanted)) if not within and self.prose(i)]

    def block_path(self, block: int) -> int:
        at = self.blocks[block][0]
        return self.elements[at][2] if at >= 0 else 0

    def encloses(self, at: int, wanted: int) -> bool:
        """Whether all elements of the path lie below an element."""
        below = [False] * len(self.elements)
        for i, e in enumerate(self.elements):
            below[i] = e[0] >= 0 and (e[0] == at or below[e[0]])
        return all(below[i] for i, e in enumerate(self.elements) if e[2] == wanted)

    def target(self, wanted: int | None) -> int | None:
        """The path to extract (None: the whole page). Elements of one path have one depth, so none lies in another. A choice
        that encloses the winners is narrowed by its host's vote, unless the page itself marks it as its article."""
        mass = self.masses()
        at = self.choice(mass)
        if at < 0:
            return None
        own = self.elements[at][2]
        won = sum(m for m, e in zip(mass, self.elements, strict=True) if e[2] == wanted)
        chosen = sum(m for m, e in zip(mass, self.elements, strict=True) if e[2] == own)
        other = won < chosen and (self.elements[at][1] in SEMANTIC or not self.encloses(at, wanted))
        return own if not won or other else wanted

    def extract(self, wanted: int | None, template: set[int] | None = None) -> str:
        """The text, in page order; with the host's templates, prose beside its containers that is none of them stays, but for
        what lies at a winning path that the page's own choice overrules."""
        path = self.target(wanted)
        keep = self.inside(path)
        if path is not None and template is not None:
            overruled = self.inside(wanted) if wanted is not None and path != wanted else [False] * len(keep)
            for i in self.beside(path):
                keep[i] = self.block_path(i) not in template and not overruled[i]
        return "\n".join(t for (_, t), kept in zip(self.blocks, keep, strict=True) if kept)


class Page(Layout, HTMLParser):
    """A page read from its html. Blocks of doubtful elements (forms, marked names) wait for _settle."""

    def __init__(self, html: str):
        Layout.__init__(self, [], [], [])
        HTMLParser.__init__(self, convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, bool]] = []  # tag, element, dropped, doubtful element, inline with a mark
        self.doubtful: list[int] = []  # by doubtful element: the one around it
        self.solid: list[bool] = []  # by doubtful element: whether a short one may be the page too
        self.doubts: list[int] = []  # by block: its doubtful element, or -1
        self.parts: list[str] = []
        self.doubt = -1
        self.linked = 0
        self.anchors = 0
        self.named = 0  # open inline elements whose names mark boilerplate
        self.plain = False  # whether the block has words outside of those
        self.open: Counter[str] = Counter()
        self.feed(html)
        self.close()
        self._flush()
        self._settle()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and self.plain:
                self.blocks.append((self.stack[-1][1] if self.stack else -1, text))
                self.link_words.append(self.linked)
                self.doubts.append(self.doubt)
            self.parts = []
        self.linked, self.plain = 0, False

    def _settle(self) -> None:
        """Drop the blocks of doubtful elements, unless such an element holds (almost) all prose."""
        if not self.doubtful:
            return
        words = [len(t.split()) if self.prose(i) else 0 for i, (_, t) in enumerate(self.blocks)]
        held, total = [0] * len(self.doubtful), sum(words)
        for at, n in zip(self.doubts, words, strict=True):
            if at >= 0:
                held[at] += n
        for at in range(len(held) - 1, -1, -1):  # outer ones come first
            if self.doubtful[at] >= 0:
                held[self.doubtful[at]] += held[at]
        stays = []
        for around, n, solid in zip(self.doubtful, held, self.solid, strict=True):
            stays.append((around < 0 or stays[around]) and n > 0 and (solid or n >= PAGE_WORDS) and 10 * n >= 9 * total)
        kept = [i for i, at in enumerate(self.doubts) if at < 0 or stays[at]]
        self.blocks, self.link_words = [self.blocks[i] for i in kept], [self.link_words[i] for i in kept]

    def _told(self, solid: bool, doubt: int | None = None) -> None:
        """Note that a text's own title is inside doubtful elements, or that a control is inside the form around it."""
        at = (self.stack[-1][3] if self.stack else -1) if doubt is None else doubt
        while at >= 0:
            self.solid[at] = solid
            at = self.doubtful[at]

    def _pop(self, size: int) -> None:
        if any(entry[0] in BLOCK for entry in self.stack[size:]):
            self._flush()
        for tag, _, _, _, named in self.stack[size:]:
            self.open[tag] -= 1
            self.anchors -= tag == "a"
            self.named -= named
        del self.stack[size:]

    def _close_open(self, tags: set[str], limits: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self._pop(i)
                return
            if tag in limits:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in CLOSES_P and self.open["p"]:
            self._close_open({"p"}, CLOSES_P - {"p"})
        if tag in CLOSED_BY:
            self._close_open(CLOSED_BY[tag], LIMITS[tag])
        if tag in BLOCK:
            self._flush()
        given = {k: v or "" for k, v in attrs}
        if tag in CONTROLS and given.get("type", "").lower() != "hidden":
            self._told(False)
        if tag in VOID:
            return
        parent, dropped, doubt = self.stack[-1][1:4] if self.stack else (-1, False, -1)
        named = False
        if not dropped and tag not in ("html", "body"):
            dropped = tag in DROPPED and tag != "form" or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))
            top, names = not any(self.open[t] for t in SEMANTIC), f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}"
            dropped = dropped or tag in BLOCK and (tag == "header" and top or _marked(names, False, COMMENTS))
            if not dropped and (tag == "form" or _marked(names, top)):
                if tag in BLOCK:
                    self.doubtful.append(doubt)
                    self.solid.append(tag == "form")
                    doubt = len(self.doubtful) - 1
                else:
                    named = True
            if tag in TITLES and not dropped:
                self._told(True, doubt)
        label = tag + "".join("." + c for c in sorted({_DIGITS.sub("#", c) for c in given.get("class", "").split()}))
        if tag in BLOCK or parent < 0:
            above, depth = (self.elements[parent][2], self.elements[parent][4] + 1) if parent >= 0 else (0, 0)
            self.elements.append((parent, tag, xxh64_intdigest(f"{above}/{label}") >> 1, label, depth))
            parent = len(self.elements) - 1
        self.anchors += tag == "a"
        self.open[tag] += 1
        self.named += named
        self.stack.append((tag, parent, dropped, doubt, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if self.stack[i][0] in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.parts.append(data)
        self.plain = self.plain or not self.named and not data.isspace()
        self.doubt = self.stack[-1][3] if self.stack else -1
        if self.anchors:
            self.linked += len(data.split())


_VOTE = "array<struct<beside:boolean,path:string,path_hash:bigint,depth:int,words_hash:bigint>>"
_READ = f"page_id bigint, url string, host string, found {_VOTE}, page binary"


def read(pages: DataFrame) -> DataFrame:
    """Each page parsed once: what it votes for, and its layout. ``found`` has the path that it votes for, and (beside) those of each
    block of prose outside, with a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("beside", pa.bool_()), ("path", pa.string()), ("path_hash", pa.int64()), ("depth", pa.int32()), ("words_hash", pa.int64())]))
        for batch in slices(batches, 64):
            found, held = [], []
            for html in batch.column(3).to_pylist():
                page, votes = Page(html or ""), []
                if (at := page.choice()) >= 0:
                    wanted = page.elements[at][2]
                    votes.append((False, page.path(at), wanted, page.elements[at][4], 0))
                    votes += [(True, "", page.block_path(i), 0, xxh64_intdigest(page.blocks[i][1].encode("utf-8", "surrogatepass")) >> 1) for i in page.beside(wanted)]
                found.append([dict(zip(("beside", "path", "path_hash", "depth", "words_hash"), v, strict=True)) for v in votes])
                held.append(page.pack())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind), pa.array(held, pa.binary())], names=["page_id", "url", "host", "found", "page"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(run, _READ)


def winners(parsed: DataFrame) -> DataFrame:
    """The winning path of each host, and its template paths: at most ten times the blocks of a page, on average."""
    votes = parsed.select("host", F.explode("found").alias("vote")).select("host", "vote.*")
    counted = votes.groupBy("host", "beside", "path_hash", "words_hash").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max("depth").alias("depth"))
    counted = counted.groupBy("host", "beside", "path_hash").agg(F.sum("n").alias("votes"), F.count("*").alias("texts"), F.min("path").alias("path"), F.max("depth").alias("depth"))
    counted = materialise(counted, "html-votes")
    ranked = F.struct((-F.col("votes")).alias("v"), (-F.col("depth")).alias("d"), F.col("path").alias("p"), F.col("path_hash").alias("path_hash"), F.col("votes").alias("votes"))
    won = counted.where("not beside").groupBy("host").agg(F.min(ranked).alias("best"), F.sum("votes").alias("pages"))
    often = counted.where("beside and votes >= 2 and 2 * texts <= votes").join(won.select("host", "pages"), "host").where("10 * votes >= pages")
    often = often.groupBy("host").agg(F.collect_list("path_hash").alias("template"))
    return won.join(often, "host", "left").select("host", "best.path_hash", F.col("best.p").alias("path"), "best.votes", "template")


def extract(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text and n_chars. Pages are parsed once, into a written table of layouts (text without markup)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            given = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            texts = [Layout.unpack(page).extract(wanted, set(template or ())) for page, wanted, template in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    parsed = materialise(read(pages), "html-pages")
    # written, so that its size is known before the plan is made: a table of few hosts is broadcast and no page is shuffled
    won = materialise(winners(parsed).select("host", "path_hash", "template"), "html-winners")
    rows = parsed.join(won, "host", "left").select("page_id", "url", "page", "path_hash", "template")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
