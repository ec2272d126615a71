"""HTML extraction: the main text of a page by text-to-tag ratios.

The standard library's parser streams events. Block elements end lines; each line has its characters of text, its
tags and the elements around it. The ratio of the two is smoothed by a Gaussian over neighbouring lines, and lines
above a threshold form the content cluster. Outside the articles of a page (or main), a smoothed ratio counts by PRIOR.
Smoothing ends at the borders of articles; without any, lines outside the main region that reached the threshold only
because the region borders on them leave the cluster.
Menus, adverts, forms and the like are cleaned out of the cluster. The elements that hold its lines are the content
region, and every other line of them stays, short ones too; without articles, so do the lines between cluster lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spread of the Gaussian, in lines; share of the content cluster's mass that the main region holds, without articles.
SIGMA, HELD = 1.0, 0.75
#: Weight of the smoothed ratio of a line outside the articles, or outside main on a page without articles.
PRIOR = 0.5
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
_DROP = frozenset("aside button datalist dialog embed fieldset footer form head iframe label legend math menu nav noscript object script select style svg template textarea title".split())
_ENDS_P = _BLOCK - {"br", "option", "optgroup", "html", "head", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "legend"}
#: An opening tag closes an open one of the same set, up to the nearest element of the second set.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: Words in class, id and role that mark what is not content.
_HINTS = frozenset("ad ads adv advert advertisement advertising adverts adsense alert alertdialog banner breadcrumb breadcrumbs byline comment commentary commentlist comments complementary consent contentinfo cookie cookies copyright dialog dialogue discussion disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription survey teaser toolbar tracking warning widget widgets".split())
#: Words that mark a frame around the page, whatever else its class says.
_FRAMES = frozenset("container grid has layout no page with without wrap wrapper".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CONTENT = ("article", "main")
_CONTAINERS = ("div", "section", "td", "body", "html", "center", "blockquote", "table")
#: Elements whose text no browser shows as text of the page; it has no part in the ratios.
_UNSEEN = frozenset("datalist head iframe math noscript object script style svg template title".split())


_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Open elements that an opening tag may close: the nearest of the first set, unless one of the second set is nearer.
_SCOPES = {"p": (frozenset({"p"}), frozenset(("table", "td", "th", "button", "object")))} | {tag: (frozenset(own), frozenset(stop)) for tag, (own, stop) in _SIBLINGS.items()}


class _Element:
    """What its ancestors decide is kept with each element, so that no tag or line walks up to the root."""

    __slots__ = ("tag", "parent", "hinted", "dropped", "mute", "holds", "depth", "mass", "size", "near", "unseen", "within", "outer", "container", "kept")

    def __init__(self, tag: str, parent: _Element | None, hinted: bool):
        self.tag, self.parent, self.hinted, self.holds, self.mass, self.size = tag, parent, hinted, False, 0.0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = tag in _DROP
        #: Inside an inline element that is left out: its text never reaches a line.
        self.mute = bool(parent) and (parent.mute or tag not in _BLOCK and (self.dropped or hinted))
        self.unseen = tag in _UNSEEN or bool(parent) and parent.unseen
        self.within = tag in _CONTENT or bool(parent) and parent.within
        #: The outermost article and main around, and the nearest element that can be a region (None: the page).
        self.outer = tuple(o or (self if tag == t else None) for o, t in zip(parent.outer if parent else (None, None), _CONTENT, strict=True))
        self.container = self if tag in _CONTAINERS else parent.container if parent else None
        near = parent.near if parent else {}
        if tag in _SCOPE_TAGS:
            near = dict(near)
            for group, (own, stop) in _SCOPES.items():
                if tag in stop:
                    near.pop(group, None)
                elif tag in own:
                    near[group] = self
        self.near = near
        self.kept: dict[bool, bool] = {}


_SCOPE_TAGS = frozenset().union(*(own | stop for own, stop in _SCOPES.values()))


class Lines(HTMLParser):
    """Collects (text, tags, element) lines of a page, in time linear in its length whatever is left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, False)
        self.elements = [self.at]
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, _Element]] = []
        self.text: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.at))
            self.tags = 0
        self.text = []

    def _leave(self, last: _Element) -> None:
        """Closes all elements up to ``last``."""
        while True:
            e, self.at = self.at, self.at.parent
            self.open[e.tag] -= 1
            if e is last:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        for group in ("p" if tag in _ENDS_P else None, tag if tag in _SIBLINGS else None):
            if group and (last := self.at.near.get(group)):
                self._leave(last)
        if tag in _VOID:
            return
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        found = set(_SPLIT.split(_CAMEL.sub(" ", marks).lower())) if marks and tag not in ("html", "body", "main") else set()
        if tag in _CONTENT and not self.at.outer[0]:
            x = self.at
            while x.parent and not x.holds:  # what is above one that holds, holds too
                x.holds, x = True, x.parent
        self.at = _Element(tag, self.at, bool(found & _HINTS) and not found & _FRAMES)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.elements.append(self.at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if self.open.get(tag):
            e = self.at
            while e.tag != tag:
                e = e.parent
            self._leave(e)

    def handle_data(self, data: str) -> None:
        if not self.at.mute:
            self.text.append(data)

    def finish(self) -> list[tuple[str, int, _Element]]:
        rest = self.rawdata
        if rest.startswith("<"):  # a tag that the end cuts off is no text
            self.rawdata = ""
        self.close()
        self._end_line()
        return self.lines


def _around(e: _Element) -> Iterator[_Element]:
    while e.parent:
        yield e
        e = e.parent


def _kept(e: _Element) -> bool:
    """Not inside an element that is left out. A header inside an article keeps its headings. Hints do not count on
    an element that holds an article or main element, unless that stands in an article itself."""
    heading, path, ok = False, [], True
    for x in _around(e):
        heading |= x.tag in _HEADS
        if heading in x.kept:
            ok = x.kept[heading]
            break
        path.append((x, heading))
        if x.dropped or x.hinted and not x.holds or x.tag == "header" and not (heading and x.within):
            ok = False
            break
    for x, h in path:
        x.kept[h] = ok
    return ok


def _inside(e: _Element, regions: set[int], known: dict[int, bool]) -> bool:
    """Whether the element or one around it is a region; ``known`` remembers the elements passed."""
    path, found = [], False
    for x in _around(e):
        if id(x) in known:
            found = known[id(x)]
            break
        path.append(x)
        if id(x) in regions:
            found = True
            break
    known.update((id(x), found) for x in path)
    return found


def smoothed(values: list[float], sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbours, with the weights at the ends scaled up."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    v = np.asarray(values, float)
    pad = lambda x: np.convolve(x, kernel)[reach : reach + len(v)]
    return pad(v) / pad(np.ones(len(v)))


def _smoothed_apart(values: list[float], parts: list, sigma: float) -> np.ndarray:
    """Smoothing that ends where the part changes, so that a long text lends nothing to the menu or advert beside it."""
    cuts = [0, *(i for i in range(1, len(parts)) if parts[i] is not parts[i - 1]), len(parts)]
    return np.concatenate([smoothed(values[a:b], sigma) for a, b in zip(cuts, cuts[1:])])


def _cluster(lines: list[tuple[str, int, _Element]], anchors: list, kept: list[bool], sigma: float) -> tuple[list[int], float]:
    """Positions of the kept lines whose smoothed ratio reaches the threshold, and the threshold. ``anchors``: the article or main
    around each line, smoothed apart; where there are any, the ratios of other lines count by PRIOR."""
    ratio = _smoothed_apart(_ratios(lines), anchors, sigma)
    threshold = min(float(ratio.std()), float(ratio.mean()))
    if any(anchors):
        ratio = np.where([bool(x) for x in anchors], ratio, PRIOR * ratio)
    return [i for i, r in enumerate(ratio) if kept[i] and r >= threshold], threshold


def _ratios(lines: list[tuple[str, int, _Element]]) -> list[float]:
    return [len(text) / max(1, tags) for text, tags, _ in lines]


def _main(elements: list[_Element], lines: list[tuple[str, int, _Element]], kept: list[bool], cluster: list[int]) -> _Element | None:
    """The deepest element that can be a region and holds HELD of the cluster's characters. Sets each element's mass, its cluster
    lines' characters, and size, those of all its kept lines."""
    for x in elements:
        x.mass, x.size = 0, 0
    for i in cluster:
        lines[i][2].mass += len(lines[i][0])
    for (text, _, e), k in zip(lines, kept, strict=True):
        e.size += len(text) if k else 0
    for x in reversed(elements):  # children come after their parents
        if x.parent:
            x.parent.mass, x.parent.size = x.parent.mass + x.mass, x.parent.size + x.size
    total = sum(len(lines[i][0]) for i in cluster)
    main = max((x for x in elements if x.parent and x.mass >= HELD * total), key=lambda x: x.depth, default=None)
    return main and main.container


def extract(html: str, sigma: float = SIGMA) -> str:
    """The main text: lines of the content region, in page order, joined by one space. Empty if there is none."""
    parser = Lines()
    parser.feed(html)
    lines = [x for x in parser.finish() if not x[2].unseen]
    kept = [_kept(e) for _, _, e in lines]
    if not any(kept):
        return ""
    for tag in range(len(_CONTENT)):  # main only where no article has kept lines
        anchors = [e.outer[tag] if k else None for (_, _, e), k in zip(lines, kept, strict=True)]
        if any(anchors):
            break
    cluster, threshold = _cluster(lines, anchors, kept, sigma)
    if not cluster:  # all of it is cleaned out: what is left is clustered by itself
        own = [i for i, k in enumerate(kept) if k]
        found, threshold = _cluster([lines[i] for i in own], [anchors[i] for i in own], [True] * len(own), sigma)
        cluster = [own[j] for j in found]
    known: dict[int, bool] = {}
    if any(anchors[i] for i in cluster):
        regions = {id(anchors[i]): anchors[i] for i in cluster if anchors[i]}
        holders: set[int] = set()
        for a in regions.values():
            for x in _around(a):
                if id(x) in holders:
                    break
                holders.add(id(x))
        own, region_ids = set(cluster), set(regions)
        for i in cluster:
            if not anchors[i] and (c := lines[i][2].container) and id(c) not in holders:
                region_ids.add(id(c))  # with the short lines there; an element around an article too is no region
        return " ".join(text for i, (text, _, e) in enumerate(lines) if kept[i] and (i in own or _inside(e, region_ids, known)))
    main = _main(parser.elements, lines, kept, cluster)
    inside = [main is not None and _inside(e, {id(main)}, known) for _, _, e in lines]
    known = {}
    plain = _ratios(lines)
    apart = np.maximum(_smoothed_apart(plain, inside, sigma), plain)
    cluster = [i for i in cluster if inside[i] or main is None or apart[i] >= threshold]
    _main(parser.elements, lines, kept, cluster)  # the masses without the lines that only bordered on the region
    region_ids, own = {id(main)}, set(range(cluster[0], cluster[-1] + 1))
    around = {id(x) for x in _around(main)} if main else set()
    for i in cluster:  # other blocks that are cluster lines mostly stay with their short lines, too
        if (c := lines[i][2].container) and id(c) not in around and c.mass >= HELD * c.size:
            region_ids.add(id(c))
    return " ".join(text for i, (text, _, e) in enumerate(lines) if kept[i] and (main is None or i in own or _inside(e, region_ids, known)))


def _extracted(batches: Iterator[pa.RecordBatch], sigma: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x or "", sigma) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars, one row per input row. Null or empty html: empty text; repeated rows repeat; an empty table gives no rows. Narrow: no shuffle; pages
    are parsed one by one, in Arrow batches."""
    d = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return d.mapInArrow(partial(_extracted, sigma=sigma), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
