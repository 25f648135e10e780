"""Main-text extraction by tag-path ratios.

A page is read as blocks: runs of text between block-level tags, each with its path from the root (tag
names with their class and role). For every path of a page the text length, punctuation marks, blocks and
linked characters are added up. A path's text ratio (characters per block) and punctuation ratio
are smoothed over all paths of the page by how much of the path they share, fused by
multiplication, multiplied by the path's share of unlinked text, and compared with a threshold. Blocks on
chosen paths are the article, so a short paragraph is kept with the long ones beside it. Headings, list
items, table cells and captions are short by nature and stay where their neighbours on the path
tree are chosen.

Elements that are never article text (scripts, form controls, navigation, asides, footers) take no part;
formulas do, without their source notation.
A class, id or role that names a menu, notice, advert, comment section or the like lowers the ratio
of what is inside, less so if the name has other words too. It does not
if the element holds most of the page's text, and no more inside a `main` or the article with most text.
A form lowers it like a name, wherever it stands, but hardly if it is around most of the page's text or around
the marked article, as on pages that are one form.
Where the page marks its article (`article`, `main`, role=main), paths inside it weigh more; the mark
alone neither keeps nor drops a path.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import table
from tunetable.session import ship_package

#: Share of the mean fused ratio that a path needs.
THRESHOLD = 0.35
#: Linked share of a path's characters above which neighbours do not keep it: it is a list of links.
LINKED = 0.6
#: Factor on the fused ratio of paths inside the marked article.
MARKED = 2.0
#: Factor on the fused ratio of paths inside forms and elements that are named as another part of the page, and
#: inside forms around the page and elements whose name has such a word beside others.
NAMED, MIXED = 0.05, 0.7

RESULT = "page_id long, url string, text string, n_chars long"

#: Element kinds of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre search section select summary table tbody td "
    "template tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An opening tag ends open elements of these kinds, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
NEVER = frozenset(
    "script style noscript template nav footer aside button select dialog menu head title "
    "textarea iframe svg object audio video canvas noembed noframes xmp datalist search "
    "annotation annotation-xml".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
CELLS = frozenset("td th tr tbody thead tfoot table".split())
#: Text on these paths, and in paragraphs right inside those that are no cells, goes with its neighbours.
PLACED = HEADINGS | CELLS | frozenset("li ul ol menu dl dt dd caption figcaption figure pre".split())
#: Words in class, id or role that mark other parts of a page.
OTHER_PART = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments commentlist consent contentinfo cookie cookies copyright dialog discussion disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "paging pagination popup promo promoted promotion related reply replies respond rightcol search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets "
    "complementary alert alertdialog topbar navlinks menubar feedback".split()
)

#: Those for what readers wrote, which can be most of a page.
TALK = frozenset(
    "comment comments commentlist discussion disqus feedback reply replies respond".split()
)
#: Words that say where or how a part stands; beside a listed word they name nothing else.
SHAPES = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content form group "
    "head header holder inner item items left link links list module outer panel posts right row "
    "section side slot stories text title top unit wrap wrapper".split()
)
#: A class that starts with one of these describes a whole page, not a part of it.
NEGATED = frozenset("has no not with without".split())
#: Weights of paths by how far they are apart; exp(-27.3 ** 2) is 0 as a double.
REACH = 28
WEIGHTS = [math.exp(-apart * apart) if apart < REACH else 0.0 for apart in range(REACH + 2)]

_OPEN = re.compile(
    r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.DOTALL
)
_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_TAG = re.compile(r"</?[a-zA-Z]")
#: An end tag without a name is a comment up to its ">".
_BOGUS = re.compile(r"</[^a-zA-Z]")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(
    r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.IGNORECASE,
)
_PART = re.compile(r"[a-z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡]")


class Path:
    """A node of the tree of all paths of a page; equal paths are the same node, at any depth."""

    __slots__ = ("label", "above", "size", "heads", "below")

    def __init__(self, label: str = "", above: Path | None = None):
        self.label, self.above = label, above
        self.size: int = above.size + 1 if above else 0
        #: whether a heading holds it
        self.heads: bool = bool(above and above.heads) or _tag(label) in HEADINGS
        self.below: dict[str, Path] = {}

    def child(self, label: str) -> Path:
        found = self.below.get(label)
        if found is None:
            found = self.below[label] = Path(label, self)
        return found

    def line(self, most: int) -> list[Path]:
        """At most so many nodes that end here, the outermost first."""
        out, node = [], self
        while node and len(out) < most:
            out.append(node)
            node = node.above
        return out[::-1]


@dataclass
class Element:
    name: str
    path: Path
    never: bool
    article: int
    link: bool
    zone: int


@dataclass
class Zone:
    """An element whose name or mark weighs on what it holds; the first one is the page."""

    parent: int
    factor: float = 1.0
    mark: str = ""
    talk: bool = False
    form: bool = False
    #: Characters of unlinked text inside.
    size: int = 0


@dataclass
class Block:
    """`article` is the length of the path of the mark that holds the block, 0 if there is none."""

    path: Path
    article: int
    #: (text, zone, linked)
    parts: list[tuple[str, int, bool]] = field(default_factory=list)
    factor: float = 1.0
    linked: int = 0

    @property
    def key(self) -> tuple:
        return self.path, self.factor


def _named(name: str) -> tuple[float, bool]:
    """The factor of a class, id or role, and whether it names what readers wrote."""
    parts = _PART.findall(name)
    if OTHER_PART.isdisjoint(parts) or parts[0] in NEGATED or parts[-1] == "free":
        return 1.0, False
    alone = all(part in OTHER_PART or part in SHAPES or part.isdigit() for part in parts)
    return (NAMED if alone else MIXED), alone and not TALK.isdisjoint(parts)


def _element(
    name: str, attributes: str, parent: Element | None, zones: list[Zone], page: Path
) -> Element:
    never = name in NEVER
    label, role = name, ""
    factor, talk = MIXED if name == "form" else 1.0, False
    if attributes and not never:
        for found in _ATTRIBUTE.finditer(attributes):
            key = found[1].lower()
            value = (found[2] or found[3] or found[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                never = True
            elif key in ("class", "id", "role") and value:
                if key != "id":  # an id is one element's, so it would give it a path of its own
                    label += "." + " ".join(value.split())
                role = value if key == "role" else role
                # ids of headings are made from their words
                if name not in ("html", "body") and not (key == "id" and name in HEADINGS):
                    for token in value.split():
                        least, said = _named(token)
                        factor, talk = min(factor, least), talk or said
    inside = parent.article if parent else 0
    if name == "header" and not inside:
        never = True
    never = never or bool(parent and parent.never)
    zone = parent.zone if parent else 0
    mark = "main" if role == "main" else name if name in ("article", "main") else ""
    if mark and not never:
        zones.append(Zone(zone, mark=mark))
        zone = len(zones) - 1
    if factor < 1 and not never:
        zones.append(Zone(zone, factor, talk=talk, form=name == "form"))
        zone = len(zones) - 1
    path = parent.path if parent else page
    if name in BLOCK:
        path = path.child(label)
    return Element(
        name,
        path,
        never,
        inside or (max(path.size, 1) if mark else 0),
        name == "a" or bool(parent and parent.link and name not in BLOCK),
        zone,
    )


def blocks_of(page: str) -> tuple[list[Block], list[Zone]]:
    """The text blocks of a page in order, without elements that are never article text, and its zones.

    Unclosed and stray tags, missing end tags and a page that stops within a tag are tolerated.
    """
    out: list[Block] = []
    zones = [Zone(0)]
    root = Path()
    stack: list[Element] = []
    current: Block | None = None
    at, size = 0, len(page)
    quoted = True
    opened: dict[str, int] = {}

    def top() -> Element | None:
        return stack[-1] if stack else None

    def close(kinds, stops) -> None:
        if not any(opened.get(kind) for kind in kinds):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].name in kinds:
                for element in stack[depth:]:
                    opened[element.name] -= 1
                del stack[depth:]
                return
            if stack[depth].name in stops:
                return

    while at < size:
        tag = page.find("<", at)
        text_end = size if tag < 0 else tag
        if text_end > at:
            above = top()
            if not (above and above.never):
                if current is None:
                    current = Block(above.path if above else root, above.article if above else 0)
                    out.append(current)
                part = (above.zone, above.link) if above else (0, False)
                current.parts.append((page[at:text_end], *part))
        if tag < 0:
            break
        if page.startswith("<!--", tag):
            ended = _COMMENT_END.search(page, tag + 2)
            at = ended.end() if ended else size
            continue
        if page.startswith(("<!", "<?"), tag) or _BOGUS.match(page, tag):
            end = page.find(">", tag)
            at = size if end < 0 else end + 1
            continue
        found = _CLOSE.match(page, tag)
        if found:
            at = found.end()
            name = found[1].lower()
            if name in BLOCK:
                current = None
            if name != "html":
                close({name}, () if name in BLOCK else BLOCK)
            continue
        found = _OPEN.match(page, tag) if quoted else _PLAIN.match(page, tag)
        if found is None and quoted:
            # a quote is never closed from here on
            found = _PLAIN.match(page, tag)
            quoted = found is None
        if found is None:
            if _TAG.match(page, tag):
                break  # the page stops within a tag
            above = top()
            if not (above and above.never) and current is not None:
                current.parts.append(("<", above.zone if above else 0, False))
            at = tag + 1
            continue
        at = found.end()
        name, attributes = found[1].lower(), found[2]
        if name in BLOCK:
            current = None
        if name == "br":
            if current is not None:
                current.parts.append(("\n", stack[-1].zone if stack else 0, False))
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[\\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                break
            shut = page.find(">", end.start())
            at = size if shut < 0 else shut + 1
            continue
        if name in CLOSES_P:
            close({"p"}, BLOCK - {"p"})
        if name in IMPLIED:
            kinds, stops = IMPLIED[name]
            close(kinds, stops)
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append(_element(name, attributes, top(), zones, root))
            opened[name] = opened.get(name, 0) + 1
    return out, zones


def zone_factors(blocks: list[Block], zones: list[Zone]) -> list[float]:
    """What each zone's text is weighed with."""
    for block in blocks:
        for piece, zone, link in block.parts:
            if not link:
                zones[zone].size += len("".join(piece.split()))
    marked = [0] * len(zones)
    for at in range(len(zones) - 1, 0, -1):
        zones[zones[at].parent].size += zones[at].size
    within, articles = [False] * len(zones), 0
    for at, zone in enumerate(zones[1:], 1):
        within[at] = within[zone.parent] or zones[zone.parent].mark == "article"
        articles += zone.size if zone.mark == "article" and not within[at] else 0
    trusted = [z.mark == "main" or z.mark == "article" and 2 * z.size > articles for z in zones]
    outer = [False] * len(zones)
    for at, zone in enumerate(zones[1:], 1):
        outer[at] = outer[zone.parent] or trusted[zone.parent]
        if trusted[at] and not outer[at]:
            marked[at] = zone.size
    for at in range(len(zones) - 1, 0, -1):
        marked[zones[at].parent] += marked[at]
    factors = [1.0] * len(zones)
    for at, zone in enumerate(zones[1:], 1):
        most = 2 * zone.size >= zones[0].size and not zone.talk
        # the article that the page marks is not elsewhere
        most = most and not outer[at] and not trusted[zone.parent] and marked[at] == marked[0]
        factor = zone.factor
        if zone.form and 2 * zone.size < zones[0].size and not marked[at]:
            factor = NAMED
        if not trusted[at]:
            factors[at] = min(factors[zone.parent], 1.0 if most else factor)
    return factors


def text_of(block: Block, factors: list[float]) -> str:
    """The text of a block, which takes the factor of most of it; other parts named in its line go."""
    sizes: dict[float, int] = {}
    for piece, zone, _ in block.parts:
        sizes[factors[zone]] = sizes.get(factors[zone], 0) + len(piece.strip())
    block.factor = max(sizes, key=lambda factor: (sizes[factor], factor))
    kept = [part for part in block.parts if factors[part[1]] >= MIXED * block.factor]
    block.linked = sum(len(piece) for piece, _, link in kept if link)
    return " ".join(html.unescape("".join(piece for piece, _, _ in kept)).split())


def _smoothed(
    paths: list[Path], rows: list[tuple[float, float]], factors: list[float]
) -> list[tuple[float, float]]:
    """Per path the mean of all rows, weighted by their factor (1 for its own) and exp(-apart ** 2).

    `apart` is the longer of two paths less what they share. Rows are added up per node of the tree and
    length of their path. A path adds at each of its nodes what sharing one more label adds to
    the weight of the rows below it, so the work grows with the paths, not with their pairs.
    """
    below: dict[Path, dict[int, list[float]]] = {}
    for path, (text, marks), factor in zip(paths, rows, factors):
        for node in path.line(REACH):
            sums = below.setdefault(node, {}).setdefault(path.size, [0.0, 0.0, 0.0])
            sums[0] += factor
            sums[1] += factor * text
            sums[2] += factor * marks
    out = []
    for path, (text, marks), factor in zip(paths, rows, factors):
        own = 1.0 - factor
        total = [own, own * text, own * marks]
        for node in path.line(REACH):
            for size, sums in below[node].items():
                apart = max(path.size, size) - node.size
                weight = WEIGHTS[apart] - (WEIGHTS[apart + 1] if node.size else 0.0)
                for k in range(3):
                    total[k] += weight * sums[k]
        out.append((total[1] / total[0], total[2] / total[0]))
    return out


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _place(path: Path) -> Path | None:
    """The part of the path above a heading, list, table or caption; None for other paths."""
    node = path
    while node.above:
        tag = _tag(node.label)
        if tag == "p" and node.size > 1:
            tag = _tag(node.above.label)
            if tag in CELLS:
                break
        if tag not in PLACED:
            break
        node = node.above
    return None if node is path else node


def _neighbours(paths: list[Path], marks: list[int], chosen: set[int]) -> set[int]:
    """Headings, list items, cells and captions beside chosen paths, and bare paragraphs inside one.

    A wrapper that holds nothing else counts as part of what it wraps. A heading also goes with text that
    is one container further down, or anywhere below it in the marked article.
    """
    places = [_place(path) for path in paths]
    solid: set[Path] = set()
    for path, place in zip(paths, places):
        node = path if place is None else None
        while node and node not in solid:
            solid.add(node)
            node = node.above
    at = []
    for node in places:
        while node and node.above and node not in solid:
            node = node.above
        at.append(node)
    own, beside, below, walked = set(), set(), set(), set()
    for i in chosen:
        path = paths[i]
        own.add(path)
        beside.update(path.line(2))
        below.update(path.line(3))
        node = path if marks[i] else None
        while node and node.size >= marks[i] and node not in walked:
            walked.add(node)
            node = node.above
        if places[i] is not None and _tag(path.label) not in CELLS:
            beside.add(at[i])
            below.add(at[i])
    below |= walked
    out = set()
    for i, path in enumerate(paths):
        if places[i] is None:
            if path.label == "p" and path.above in own:
                out.add(i)
        else:
            node, heads = path, False
            while node is not places[i]:
                heads = heads or _tag(node.label) in HEADINGS
                node = node.above
            named = at[i].size < places[i].size  # of the site, not of a text
            named = named and _tag(at[i].label) in ("", "html", "body")
            near = below if heads and not named else beside
            if at[i] in near:
                out.add(i)
    return out


def content_paths(blocks: list[tuple[Block, str]], threshold: float = THRESHOLD) -> set[tuple]:
    """Keys of the paths whose smoothed and fused text and punctuation ratios reach the threshold.

    Headings, list items and the like are added beside them. If all text of the page is linked, nothing
    but the mark tells its paths apart. Other parts of the page count by their factor in the mean and
    in what neighbours lend.
    """
    sums: dict[tuple, list[float]] = {}
    marked: dict[tuple, int] = {}
    for block, text in blocks:
        row = sums.setdefault(block.key, [0, 0, 0, 0])
        row[0] += len(text)
        row[1] += len(_PUNCTUATION.findall(text))
        row[2] += 1
        row[3] += min(block.linked, len(text))
        marked[block.key] = block.article
    keys = list(sums)
    paths = [path for path, _ in keys]
    raw = [(sums[p][0] / sums[p][2], sums[p][1] / sums[p][2]) for p in keys]
    smooth = _smoothed(paths, raw, [factor for _, factor in keys])
    fused = [text * (1 + marks) for text, marks in smooth]
    linked = [sums[p][3] / sums[p][0] for p in keys]
    prior = [p[1] * (MARKED if marked[p] else 1.0) for p in keys]
    fused = [f * (1 - share) * w for f, share, w in zip(fused, linked, prior)]
    chars = sum(w * sums[p][0] for w, p in zip(prior, keys))
    mean = sum(f * w * sums[p][0] for f, w, p in zip(fused, prior, keys)) / chars if chars else 0
    if not mean:
        return {p for p in keys if marked[p]}
    chosen = {i for i, f in enumerate(fused) if f > 0 and f >= threshold * mean}
    added = _neighbours(paths, [marked[p] for p in keys], chosen)
    least = MIXED * max(keys[i][1] for i in chosen)
    chosen |= {
        i
        for i in added
        if keys[i][1] >= least
        and (linked[i] <= LINKED or paths[i].heads)
    }
    return {keys[i] for i in chosen}


def extract(page: str) -> str:
    """The article of a page: its blocks in page order, joined by newlines."""
    found, zones = blocks_of(page)
    factors = zone_factors(found, zones)
    blocks = [(block, text) for block in found if (text := text_of(block, factors))]
    chosen = content_paths(blocks)
    return "\n".join(text for block, text in blocks if block.key in chosen)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`; a null html gives an empty text."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    batch["url"],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, RESULT)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
