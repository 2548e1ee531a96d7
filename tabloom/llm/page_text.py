"""Main text of web pages, by differencing each page with the page of its host whose URL is nearest.

Equal pages of a host count once, at the first of their paths. These distinct pages are put in order
of host and path, where the nearest path of every page stands next to it. Neighbours that have
almost all lines in common are a run of near copies, which would delete each other's text; of the
nearest pages before and after its run the one with the longer common path is a page's partner (a
tie goes to the one before). A run that fills its host has no such pages: there the next pages inside
the run stand in. The text lines of both
are aligned by longest common subsequence and lines they share are deleted: they belong to the
site. Lines the page itself marks as its article are kept also when shared, since pages of a site
quote the same passages; lines in menus, footers, forms, adverts, comments and the like are dropped
by their marks. So differencing decides on lines that carry no mark, beside an article as well.
A page whose marks decide every line gets its text where it is parsed; of the others the lines that
may stay travel as one compressed value, and neighbours meet as hashes of lines.

Defined results: null or empty html gives an empty text; a page without a host, or alone on its
host, has no partner and only loses marked lines; rows with null or repeated ids and urls give a
row each; an empty table gives no rows; only the named columns are read. A hot host is ordered over
many ranges, so its pages never meet in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, table, written

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("script style noscript template head title iframe object svg canvas select button textarea".split())
CHROME = set("nav footer aside form menu dialog".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|legal|masthead|menu|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|"
    r"related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|replies|disqus)(?:$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
SPACES = re.compile(r"\s+")
PLAIN, ARTICLE, SITE = 0, 1, 2
#: Share of the distinct lines of the longer of two pages that near copies have in common.
NEAR_COPY = 0.8


class _Lines(HTMLParser):
    """Text blocks of a page in order, each with its mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, unseen, site, article
        self.places: dict[str, list[int]] = {}  # of the open tags of each name
        self.parts: list[str] = []
        self.lines: list[tuple[str, int]] = []

    def _end_block(self):
        text = SPACES.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            _, _, site, article = self.open[-1] if self.open else ("", False, False, False)
            self.lines.append((text, SITE if site else ARTICLE if article else PLAIN))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_block()
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # their end tags may be left out
                self._close(tag, {"table", "ul", "ol", "dl", "div", "section", "article", "main", "td"} - {tag})
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs}
        _, unseen, site, article = self.open[-1] if self.open else ("", False, False, False)
        mark = MARKED.search(named.get("class", "") + " " + named.get("id", "")) or named.get("role", "").lower() in ROLES
        own_article = tag in ("article", "main") or named.get("role", "").lower() in ("main", "article")
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", ""))
        site = site or tag in CHROME or (tag == "header" and not article) or (bool(mark) and not own_article and tag not in ("html", "body"))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, unseen or tag in UNSEEN or bool(hidden), site, (article or own_article) and not site))

    def _close(self, tag, stop=frozenset()):
        """Ends the last open ``tag`` and all inside it, unless a tag of ``stop`` opened after it."""
        last = {t: held[-1] for t in (tag, *stop) if (held := self.places.get(t))}
        if tag in last and last[tag] == max(last.values()):
            while len(self.open) > last[tag]:
                self.places[self.open.pop()[0]].pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_block()
        self._close(tag, {"article", "main", "body"} - {tag} if tag not in ("body", "html") else frozenset())

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)


def lines_of(page: str | None) -> list[tuple[str, int]]:
    parser = _Lines()
    parser.feed(page or "")
    parser.close()
    parser._end_block()
    return parser.lines


def _host_and_path(url: str | None) -> tuple[str, list[str]]:
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip())
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.lower(), [x for x in path.split("/") if x]


LINES = "key struct<key:bigint,url:string>, host string, path array<string>, prints array<bigint>, text string, lines binary"


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the hashes of its lines, and its text if marks decide every line; else, compressed,
    ``[place, mark, line]`` of the lines that are not the site's."""
    import zstandard
    from xxhash import xxh3_64_intdigest

    packed = zstandard.ZstdCompressor()
    for batch in batches:
        prints, texts, lines = [], [], []
        for html in batch.column(1).to_pylist():
            found = lines_of(html)
            prints.append([xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found])
            left = [(i, m, t) for i, (t, m) in enumerate(found) if m != SITE]
            marked = all(m == ARTICLE for _, m, _ in left)
            texts.append("\n".join(t for _, _, t in left) if marked else None)
            lines.append(None if marked else packed.compress(json.dumps(left).encode()))
        places = [_host_and_path(x["url"]) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.list_(pa.string())),
                pa.array(prints, pa.list_(pa.int64())), pa.array(texts, pa.string()), pa.array(lines, pa.binary()),
            ],
            ["key", "host", "path", "prints", "text", "lines"],
        )


def _rows(a: list[int], b: list[int], start: int = 0) -> Iterator[int]:
    """Bit-parallel LCS lengths: bit j of the row after a[i] is 0 where the common length grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence of ``a`` and ``b``. Time grows with
    the product of the lengths over the machine's word; memory is bounded by halving."""
    number: dict = {}
    x, y = [number.setdefault(t, len(number)) for t in a], [number.setdefault(t, len(number)) for t in b]
    out: set[int] = set()
    work = [(0, len(x), 0, len(y))]
    while work:
        i0, i1, j0, j1 = work.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.add(i0)
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            out.add(i1 - 1)
            i1, j1 = i1 - 1, j1 - 1
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n == 1:
            if x[i0] in y[j0:j1]:
                out.add(i0)
            continue
        if n * m > 1 << 26:
            half = n // 2
            *_, top = _rows(x[i0 : i0 + half], y[j0:j1])
            *_, low = _rows(x[i0 + half : i1][::-1], y[j0:j1][::-1])
            up, best, cut = sum(1 for j in range(m) if not low >> j & 1), -1, 0
            down = 0
            for j in range(m + 1):  # top's length of y[:j] and low's of y[j:]
                if down + up > best:
                    best, cut = down + up, j
                if j < m:
                    down += not top >> j & 1
                    up -= not low >> (m - 1 - j) & 1
            work += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
            continue
        rows = list(_rows(x[i0:i1], y[j0:j1]))
        i, j = n - 1, m - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:  # not grown at b[j]
                j -= 1
            elif i and not rows[i - 1] >> j & 1:  # grown there already without a[i]
                i -= 1
            else:
                out.add(i0 + i)
                i, j = i - 1, j - 1
    return out


def main_text(lines: list[tuple[int, int, str]], prints: list[int], partner: list[int] | None) -> str:
    """The lines ``(place, mark, text)`` that stay."""
    both = shared(prints, partner) if partner else set()
    return "\n".join(t for i, m, t in lines if m == ARTICLE or i not in both)


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpacked = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for row in batch.select(["path", "lines", "prints", "near"]).to_pylist():
            best, partner = -1, None
            for near in row["near"]:
                if _common(near["path"], row["path"]) > best:
                    best, partner = _common(near["path"], row["path"]), near["prints"]
            texts.append(main_text(json.loads(unpacked.decompress(row["lines"])), row["prints"], partner))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])


def _partners(distinct: DataFrame) -> DataFrame:
    """``(same, path, prints, near)`` of the distinct pages that are ``open``, with lines to decide: up to
    two pages that may be a page's partner. All pages take part in the order and its runs."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing takes time by line, not by byte
    keys = ["host", "path", "same"]
    ordered = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the written order numbers the pages: ranges by part, rows by their place in it
    numbered = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "page-order")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    offsets = sizes.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    placed = numbered.join(offsets, "part").withColumn("id", F.col("id") + F.col("shift")).drop("shift").repartition(n, "id")
    # a run begins where the page before is of another host or no near copy
    sent = placed.select("id", F.struct("host", "path", "prints").alias("page"))
    paired = placed.join(sent.select((F.col("id") + 1).alias("id"), F.col("page").alias("before")), "id", "left")
    opens = F.col("before").isNull() | (F.col("before.host") != F.col("host"))
    longer = F.greatest(F.size(F.array_distinct("prints")), F.size(F.array_distinct("before.prints")))
    unlike = F.size(F.array_intersect("prints", "before.prints")) < NEAR_COPY * longer
    marked = paired.select("id", "part", F.when(opens | unlike, F.struct("id", opens.alias("opens"))).alias("start"))
    marked = written(marked, "page-runs")
    # where its run began and the next begins: in its own part, or in the nearest part with a beginning
    ends = marked.groupBy("part").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    ends = ends.select("part", F.max("high").over(earlier).alias("high"), F.min("low").over(later).alias("low"))
    inside = Window.partitionBy("part").orderBy("id")
    runs = marked.join(ends, "part").select(
        "id",
        F.coalesce(F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "high").alias("run"),
        F.coalesce(F.min("start").over(inside.rowsBetween(1, Window.unboundedFollowing)), "low").alias("next"),
    )
    before = F.when(~F.col("run.opens"), F.col("run.id") - 1)
    after = F.when(~F.col("next.opens"), F.col("next.id"))
    alone = before.isNull() & after.isNull()
    wanted = runs.select(
        "id",
        F.when(alone & (F.col("id") > F.col("run.id")), F.col("id") - 1).otherwise(before).alias("left"),
        F.when(alone & F.coalesce(F.col("id") + 1 < F.col("next.id"), F.lit(True)), F.col("id") + 1).otherwise(after).alias("right"),
    )
    near = F.filter(F.array("before", "after"), lambda x: x.isNotNull() & (F.col("host") != ""))
    return (
        placed.filter("open").join(wanted, "id")
        .join(sent.select(F.col("id").alias("left"), F.col("page").alias("before")), "left", "left")
        .join(sent.select(F.col("id").alias("right"), F.col("page").alias("after")), "right", "left")
        .select("same", "path", "prints", near.alias("near"))
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` for every page."""
    rows = pages.select(F.struct(as_long(key).alias("key"), F.col(f"`{url}`").cast("string").alias("url")).alias("key"), F.col(f"`{html}`").cast("string").alias("html"))
    parsed = rows.mapInArrow(_parsed, LINES)
    same = F.md5(F.concat_ws(",", "host", F.array_join(F.col("prints").cast("array<string>"), ",")))
    kept = written(parsed.withColumn("same", same), "page-lines")
    page = F.min(F.struct("host", "path", "prints")).alias("page")
    distinct = kept.groupBy("same").agg(page, F.max(F.col("lines").isNotNull()).alias("open")).select("same", "page.*", "open")
    met = kept.filter("lines IS NOT NULL").select("key", "same", "lines").join(_partners(distinct), "same")
    done = met.select("key", "path", "lines", "prints", "near").mapInArrow(_extracted, "key struct<key:bigint,url:string>, text string")
    done = kept.filter("lines IS NULL").select("key", "text").union(done)
    return done.select("key.*", "text", F.length("text").cast("long").alias("n_chars"))


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")
