"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path, and each page is compared with its nearest neighbours on both sides: the lines of
both pages are aligned by longest common subsequence, and shared lines are template, so they go.  A neighbour that shares nearly all
lines is a copy of the page and says nothing about the template; the next one is taken.  For this, lines weigh by how few different pages of
the host have them, so long menus make no copies.  Pages in a row that are copies of the page before form a run; where the nearest pages
of a side are copies, the far end of the run and the pages beyond it are looked at, however long the run is.

Lines come from the markup: block elements end a line; end tags that may be left out are added by the markup's rules.  Scripts, styles and
the like have no lines.  The markup knows what alignment cannot: lines in elements that are never main text (menus, headers, footers,
sidebars, forms, notices, adverts, readers' comments) go although no neighbour shares them.  Every other line is aligned.  Where a page names
its main part (article, main), a shared line inside it is a quote until TEMPLATE_SHARE of the host's different pages, and TELLING at least, have it.

Pages are parsed twice: once for the line hashes, which are all that meets the neighbours, and once for the texts, which move
once, compressed, to their verdict.

Defined results: a null html has no lines and an empty text; a null or relative url belongs to the host ""; pages with equal
url follow one another by a hash; the only page of a host shares no line; repeated rows keep a row each; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.llm.common import in_order, per_text, written

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
SPACE = re.compile(r"\s+")

# Elements and class names by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "math", "select", "canvas"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
# Words of a class or id, split at - and _: it names chrome if one word does and the others only say where or what box it is.
READER_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond related recommended recommendations".split())
CHROME_WORDS = READER_WORDS | set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login "
    "search share sharing social pagination pager toolbar widget copyright legal".split()
)
# inside the main part: without those that also name a subject
INNER_WORDS = CHROME_WORDS - set("search social legal copyright alert overlay modal login signup header widget toolbar masthead menu".split())
PLACE_WORDS = set(
    "site page top bottom left right main global primary secondary inner outer article post user reader google native text box bar bars block blocks banner section area container wrapper wrap list item items "
    "link links button buttons icon icons form widget slot unit row col column panel module thread count title heading message messages desktop mobile".split()
)
# Fixed values of the markup's rules for end tags that may be left out: what a start tag ends, and what it does not reach through.
BLOCKS = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
LISTS, TABLES = {"ul", "ol", "menu"}, {"table"}
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, TABLES | {"tr"}), "th": ({"td", "th"}, TABLES | {"tr"}), "tr": ({"tr"}, TABLES),
    "thead": ({"thead", "tbody", "tfoot"}, TABLES), "tbody": ({"thead", "tbody", "tfoot"}, TABLES), "tfoot": ({"thead", "tbody", "tfoot"}, TABLES),
}
P_BARRIERS = {"button", "td", "th", "caption", "table", "object", "article", "div", "section", "main", "li", "body"}
PLAIN, IN_MAIN, IN_CHROME = 0, 1, 2
COPY_SHARE = 0.8  # neighbours with so much of the weight of the lines shared are copies
COMMON = 4  # lines of one in so many of a host's different pages weigh less
REACH = 3  # nearest neighbours looked at on each side, before the end of a run of copies
BEYOND = 3  # pages looked at after the end of a run
PIECE = 4096  # pages in which the ends of runs are found together
TEMPLATE_SHARE = 0.5  # of a host's different pages: so many have a template line of the main part
TELLING = 4  # pages that a host needs before that share says anything
RUN = 256  # pages of a piece of a host
DIRECT = 1 << 25  # bits of an alignment that is traced back from one table


def names_chrome(value: str, words: set[str]) -> bool:
    """Whether a class or id names a part that is never main text."""
    parts = [x for x in re.split(r"[-_]+", value.lower()) if x]
    return any(x in words for x in parts) and all(x in words or x in PLACE_WORDS or x.isdigit() for x in parts)


def chrome_element(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element starts a part that is never main text."""
    if name in CHROME and not (in_main and name == "header"):  # an article's header holds its heading
        return True
    if not attributes or name in ("html", "body"):
        return False
    words = READER_WORDS if name in MAIN else INNER_WORDS if in_main else CHROME_WORDS
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and any(names_chrome(x, words) for x in value.split()):
            return True
        if key == "role" and value.lower() in CHROME_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=[\s=/]|$)|display:\s*none", attributes, re.I))


class Open:
    """The open elements of a page; how many are chrome or main, and where each name is, without searching them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.bad: list[bool] = []
        self.where: dict[str, list[int]] = {}
        self.chrome = self.inside = 0

    def push(self, name: str, bad: bool) -> None:
        self.where.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.bad.append(bad)
        self.chrome += bad
        self.inside += name in MAIN

    def last(self, names) -> int:
        return max((w[-1] for n in names if (w := self.where.get(n))), default=-1)

    def cut(self, at: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.names) > at:
            name = self.names.pop()
            self.where[name].pop()
            self.chrome -= self.bad.pop()
            self.inside -= name in MAIN

    def starts(self, name: str) -> None:
        """Ends what a start tag ends by itself."""
        if name in BLOCKS and (at := self.last(("p",))) > self.last(P_BARRIERS):
            self.cut(at)
        if name in ENDS:
            ended, through = ENDS[name]
            if (at := self.last(ended)) > self.last(through):
                self.cut(at)

    def ends(self, name: str) -> None:
        if (at := self.last((name,))) >= 0:
            self.cut(at)


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """Lines in page order with where they stand; a line is the text of a block with single blanks."""
    lines: list[tuple[str, int]] = []
    part: list[str] = []
    opened = Open()
    html = html or ""
    at = 0

    def end_line() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(part))).strip()
        part.clear()
        if text:
            lines.append((text, IN_CHROME if opened.chrome else IN_MAIN if opened.inside else PLAIN))

    while at < len(html):
        m = MARKUP.search(html, at)
        part.append(html[at : m.start() if m else len(html)])
        if m is None:
            break
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            end_line()
        if m["end"]:
            opened.ends(name)
        elif name in RAW:  # raw text up to its end tag
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            opened.starts(name)
            if name not in VOID:
                opened.push(name, chrome_element(name, m["rest"], opened.inside > 0))
    end_line()
    return lines


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of ``a`` a longest common subsequence with ``b`` holds.

    Equal starts and ends come off first; the rest is aligned a word of bits at a time.
    """
    shared = np.zeros(len(a), bool)

    def equal_run(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        return int(np.argmin(np.append(x[:n] == y[:n], False)))

    head = equal_run(a, b)
    tail = equal_run(a[head:][::-1], b[head:][::-1])
    shared[:head] = True
    shared[len(a) - tail :] = True
    shared[head : len(a) - tail] = _aligned(a[head : len(a) - tail], b[head : len(b) - tail])
    return shared


def _rows(a: list[int], where: dict[int, int], width: int) -> Iterator[int]:
    """The bit rows of the alignment table: after i lines of ``a``, a zero at j says that line j of ``b`` makes the longest one longer."""
    full = (1 << width) - 1
    row = full
    yield row
    for x in a:
        if met := row & where.get(x, 0):
            row = (row + met | row - met) & full
        yield row


def _bits(b: list[int]) -> dict[int, int]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out = {}
    for x, js in places.items():
        bits = bytearray(js[-1] // 8 + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest alignment of ``a`` with each start of ``b``."""
    row = 0
    for row in _rows(a, _bits(b), len(b)):  # noqa: B007
        pass
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lines of ``a`` in a longest common subsequence: a word of bits at a time, and cut in two while the table is too large to keep."""
    out, todo = np.zeros(len(a), bool), [(0, len(a), 0, len(b))]
    a_list, b_list = a.tolist(), b.tolist()
    while todo:
        lo, hi, left, right = todo.pop()
        # lines that only one side has are in no alignment
        there = set(b_list[left:right])
        at = [i for i in range(lo, hi) if a_list[i] in there]
        there = {a_list[i] for i in at}
        x, y = [a_list[i] for i in at], [v for v in b_list[left:right] if v in there]
        if not x:
            continue
        if len(x) == 1 or len(x) * len(y) <= DIRECT:
            rows = list(_rows(x, _bits(y), len(y)))
            j = len(y)
            for i in range(len(x), 0, -1):
                j = (~rows[i] & ((1 << j) - 1)).bit_length()  # 1 + the last line that makes it longer
                if not j:
                    break
                if rows[i - 1] >> (j - 1) & 1:  # not without line i: the two are a pair
                    out[at[i - 1]] = True
                    j -= 1
            continue
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        places = [j for j in range(left, right) if b_list[j] in there]
        border = places[cut] if cut < len(places) else right
        todo += [(lo, at[half], left, border), (at[half], hi, border, right)]
    return out


def shared_lines(a: np.ndarray, a_weights: np.ndarray, b: np.ndarray, b_weights: np.ndarray) -> np.ndarray | None:
    """Which lines of ``a`` also ``b`` has; None if the two are copies."""
    shared = common_lines(a, b)
    return shared if a_weights[shared].sum() < COPY_SHARE * max(a_weights.sum(), b_weights.sum(), 1e-9) else None


def weights(page: dict, pages: int) -> np.ndarray:
    """Weights of lines: the more of the host's different pages have a line, the less it tells about copies.

    Lines of one page in COMMON or fewer weigh alike, for copies of one page may be many: a menu of a small section weighs like text.
    """
    return np.minimum(np.log((pages + 1) / counts_of(page)), np.log(COMMON))


def counts_of(page: dict) -> np.ndarray:
    """How many different pages of the host have each line; 1 for lines that few have."""
    counts = np.ones(len(page["hashes"]))
    for x in page["often"] or ():
        counts[x["at"]] = x["n"]
    return counts


def template_lines(own: dict, sides: list[list[dict]], pages: int) -> np.ndarray:
    """Which lines the nearest neighbour on some side shares, copies of the page aside; a page has ``hashes``, ``main`` and ``often``.

    In the main part they are quotes, not template, until most pages of the host have them.
    """
    a, w = np.array(own["hashes"], np.int64), weights(own, pages)
    gone = np.zeros(len(a), bool)
    for side in sides:
        for other in side:
            shared = shared_lines(a, w, np.array(other["hashes"], np.int64), weights(other, pages))
            if shared is not None:
                gone |= shared
                break
    quoted = np.array(own["main"], bool) & (counts_of(own) < max(TELLING, TEMPLATE_SHARE * pages))
    return gone & ~quoted


def copies(own: dict, other: dict, pages: int) -> bool:
    """Whether two pages of a host are copies."""
    a, b = (np.array(x["hashes"], np.int64) for x in (own, other))
    return shared_lines(a, weights(own, pages), b, weights(other, pages)) is None


def outline(html: str | None) -> tuple[list[int], list[bool]]:
    """Hashes of the lines outside chrome, and whether they are in the main part."""
    lines = [(t, p) for t, p in lines_of(html) if p != IN_CHROME]
    return [line_hash(t) for t, _ in lines], [p == IN_MAIN for _, p in lines]


def packed(html: str | None) -> tuple[int, bytes]:
    """The number of all lines and the texts of those outside chrome, compressed: texts are what moves."""
    lines = lines_of(html)
    return len(lines), zlib.compress("\n".join(t for t, p in lines if p != IN_CHROME).encode("utf-8", "surrogatepass"))


def common_lines_of_hosts(outlines: DataFrame) -> DataFrame:
    """(host, pages, common): the different pages of a host (by their lines), and its lines that one page in COMMON has, with their pages.

    That is at most COMMON times the lines of a mean page.
    """
    site = F.xxhash64("host").alias("site")
    different = outlines.select("host", site, F.xxhash64("hashes").alias("page"), "hashes").groupBy("host", "site", "page").agg(F.first("hashes").alias("hashes"))
    different = written(different, "page-different")
    sizes = different.groupBy("host", "site").agg(F.count("*").cast("int").alias("pages"))
    often = different.select("site", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("site", "line").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    lists = often.join(sizes, "site").filter(F.col("n") * COMMON >= F.col("pages")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("line", "n"))).alias("common"))
    return sizes.join(lists, "host", "left").select("host", "pages", "common")


def counted(numbered: DataFrame, hosts: DataFrame) -> DataFrame:
    """(key, host, rank, page, pages): ``page`` has the line hashes, whether they are in the main part, and for common lines their place and number of pages."""
    at = F.transform("hashes", lambda h, i: F.struct(i.alias("at"), F.try_element_at("common", h).alias("n")))
    often = F.when(F.col("common").isNotNull(), F.filter(at, lambda x: x["n"].isNotNull()))
    return numbered.join(hosts, "host").select("key", "host", "rank", F.struct("hashes", "main", often.alias("often")).alias("page"), "pages")


def run_ends(numbered: DataFrame) -> DataFrame:
    """(rank, host, begin, end): the run of copies that holds the page, ``end`` being the rank after it.

    Runs of any length; ends are found by piece, and between pieces from one row for each.
    """
    before = numbered.select((F.col("rank") + 1).alias("rank"), F.col("host").alias("b_host"), F.col("page").alias("b_page"))
    pair = F.when(F.col("host") == F.col("b_host"), F.col("b_page"))
    met = numbered.join(before, "rank", "left").select("rank", "host", "page", pair.alias("b_page"), "pages")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = []
            for own, other, pages in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                copy.append(other is not None and (own["hashes"] == other["hashes"] or copies(own, other, pages)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(copy, pa.bool_())], names=["rank", "host", "copy"])

    flags = written(met.mapInArrow(compare, "rank bigint, host string, copy boolean"), "page-copies").withColumn("piece", F.floor(F.col("rank") / PIECE))
    start = F.when(~F.col("copy"), F.col("rank"))
    up, down = (W.partitionBy("piece").orderBy(o) for o in (F.col("rank"), F.col("rank").desc()))
    inside = flags.select(
        "rank", "host", "piece", F.max(start).over(up.rowsBetween(W.unboundedPreceding, 0)).alias("begin"), F.min(start).over(down.rowsBetween(W.unboundedPreceding, -1)).alias("end")
    )
    pieces = flags.groupBy("piece").agg(F.max(start).alias("last"), F.min(start).alias("first"), (F.max("rank") + 1).alias("top"))
    up, down = (W.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("piece"), F.col("piece").desc()))
    around = pieces.select("piece", F.max("last").over(up).alias("last"), F.coalesce(F.min("first").over(down), F.max("top").over(down), "top").alias("first"))
    return inside.join(around, "piece").select("rank", "host", F.coalesce("begin", "last").alias("begin"), F.coalesce("end", "first").alias("end"))


def beyond_runs(numbered: DataFrame) -> DataFrame:
    """(rank, far_before, far_after) of pages in runs longer than REACH: the page at the end of the run on that side and the next ones of the host."""
    ends = run_ends(numbered).filter(F.col("end") - F.col("begin") > REACH)
    runs = ends.filter("rank = begin").select("host", "begin", "end")
    places = [F.struct(F.lit(0).alias("side"), F.lit(k).alias("step"), (F.col("begin") - k).alias("rank")) for k in range(BEYOND + 1)]
    places += [F.struct(F.lit(1).alias("side"), F.lit(k).alias("step"), (F.col("end") - 1 + k).alias("rank")) for k in range(BEYOND + 1)]
    found = runs.select("host", "begin", F.explode(F.array(*places)).alias("p")).select("host", "begin", "p.*").join(numbered.select("host", "rank", "page"), ["host", "rank"])
    each = found.groupBy("begin").agg(F.array_sort(F.collect_list(F.struct("side", "step", "page"))).alias("all"))
    side = lambda k: F.transform(F.filter("all", lambda x: x["side"] == k), lambda x: x["page"])
    return ends.select("rank", "begin").join(each.select("begin", side(0).alias("far_before"), side(1).alias("far_after")), "begin").drop("begin")


def nearest(pages: DataFrame) -> DataFrame:
    """(key, page, before, after, pages): the lines of a page, those of the next pages of the host by URL path, and the different pages of the host.

    All pages are numbered in one order, and neighbours are looked up in runs of pages with a margin,
    so a host with a third of all pages spreads over tasks.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.encode(F.coalesce(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), F.lit("")), "utf-8")
    placed = written(pages.select("key", "hashes", "main", host.alias("host"), path.alias("path")), "page-outlines")
    ordered = in_order(placed, ["host", "path", "key"], "page-order").drop("path")
    numbered = written(counted(ordered, common_lines_of_hosts(placed)), "page-counts")
    home = F.floor(F.col("rank") / RUN)
    copies = F.array_distinct(F.array(home, F.floor((F.col("rank") - REACH) / RUN), F.floor((F.col("rank") + REACH) / RUN)))
    spread = numbered.select("key", "host", "rank", "page", "pages", home.alias("home"), F.explode(copies).alias("run"))
    w = W.partitionBy("run").orderBy("rank")

    def side(move) -> Column:
        return F.array_compact(F.array(*[F.when(move("host", k).over(w) == F.col("host"), move("page", k).over(w)) for k in range(1, REACH + 1)]))

    around = spread.select("key", "rank", "page", "pages", "home", "run", side(F.lag).alias("before"), side(F.lead).alias("after")).filter("run = home")
    met = around.join(beyond_runs(numbered), "rank", "left")
    both = lambda near, far: F.when(F.col(far).isNull(), F.col(near)).otherwise(F.concat(near, far)).alias(near)
    return met.select("key", "page", both("before", "far_before"), both("after", "far_after"), "pages")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the id, url, text, n_chars, n_lines, n_template_lines."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("body"))
    source = source.withColumn("key", F.xxhash64(F.col("id").cast("string"), "url", "body"))  # equal rows share their verdict
    outlines = per_text(source, ["key", "url"], "body", outline, "hashes array<bigint>, main array<boolean>").dropDuplicates(["key"])
    around = nearest(outlines)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            gone = [template_lines(page, [before, after], pages).tolist() for page, before, after, pages in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.bool_()))], names=["verdict_key", "gone"])

    verdicts = around.mapInArrow(align, "verdict_key bigint, gone array<boolean>")
    texts = per_text(source, ["id", "url", "key"], "body", packed, "n_lines bigint, texts binary")
    met = texts.join(verdicts, F.col("key") == F.col("verdict_key"), "left").select("id", "url", "n_lines", "texts", "gone")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, template = [], []
            for data, gone in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                lines = zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n") if gone else []
                texts.append(" ".join(x for x, g in zip(lines, gone, strict=True) if not g))
                template.append(sum(gone))
            chars = [len(x) for x in texts]
            made = [pa.array(texts, pa.string()), pa.array(chars, pa.int64()), batch.column(2), pa.array(template, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[id_col, "url", "text", "n_chars", "n_lines", "n_template_lines"])

    kind = source.schema["id"].dataType.simpleString()
    return met.mapInArrow(assemble, f"`{id_col}` {kind}, url string, text string, n_chars bigint, n_lines bigint, n_template_lines bigint")
