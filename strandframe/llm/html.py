"""Main text of web pages: nearest-URL page differencing.

The distinct pages of a host are put in order of their URL path and query; each is paired with the page before and the
page after it. The text lines of a page are aligned with each neighbour's by longest common subsequence, and shared
lines are deleted: they are the site's, not the article's. Two rules keep mirrored articles whole:

- A neighbour that shares most of the page's main text (MIRROR of its characters; MIRROR_PLAIN in a page without a main
  element, whose frame counts as text) is a mirror, and deletes nothing.
- Inside <article> or <main> a line is deleted only if both neighbours share it; elsewhere one is enough.

As a help that needs no neighbour, elements and class names mark menus, headers, footers, forms, adverts and the like.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import words
from strandframe.session import cut, drop_cut

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "math", "object", "canvas"}
FRAME = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "header", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A class or id that is one of these words, or ends in one, marks what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "popup", "promo", "promotion", "related", "replies", "reply",
    "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Words that mark it at the start of a compound as well (comment-list; but not header-image).
LEADS = MARKS - {"banner", "form", "header", "modal", "notification", "overlay", "promotion", "reply", "skip", "subscription", "toolbar", "widget"}
#: Landmark roles outside the main text.
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
PARTS = re.compile(r"[a-z]+")
#: Shares of the main text's characters from which a neighbour is a mirror.
MIRROR = 0.5
MIRROR_PLAIN = 0.9
#: Bytes of a line's hash: two lines of a pair of pages are taken for equal by chance with odds of lines^2 / 2^48.
HASH = 6


def _marked(attributes: str) -> bool:
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return False
    for m in ATTRIBUTE.finditer(low):
        value = m[2] or m[3] or m[4] or ""
        if m[1] in ("class", "id"):
            for token in value.split():
                parts = PARTS.findall(token)
                if parts and (parts[-1] in MARKS or parts[0] in LEADS):
                    return True
        elif m[1] == "role" and any(token in ROLES for token in value.split()):
            return True
    return False


def lines(page: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(line, in the main element, in the page's frame) in page order, and whether there is a main element.

    Linear in the page: a tag whose quotes never close ends at its first ``>``, as do all tags after it; without any the
    rest is text. An end tag closes nothing beyond the nearest open main or frame element.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, main, frame
    places: dict[str, list[int]] = {}  # where each element is open in the stack
    walls: list[int] = []  # where main and frame elements are
    main = frame = has_main = broken = False
    at, n = 0, len(page)

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, main, frame))
            text.clear()

    def close(k):
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        while walls and walls[-1] >= k:
            walls.pop()

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text.append(page[at:])
            break
        if begin > at:
            text.append(page[at:begin])
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        second = page[at + 1 : at + 2]
        if second in ("!", "?"):
            end = page.find(">", at)
            if end >= 0:
                at = end + 1
                continue
            text.append(page[at:])
            break
        name = NAME.match(page, at + 1)
        if not name:
            text.append("<")
            at += 1
            continue
        m = None if broken else TAG.match(page, at)
        if m:
            closing, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:
            broken = True
            end = page.find(">", name.end())
            if end < 0:
                text.append(page[at:])
                break
            closing, tag, attributes, at = name[1], name[2].lower(), page[name.end() : end], end + 1
        if tag not in INLINE:
            flush()
        if closing:
            where = places.get(tag)
            if where and (not walls or where[-1] >= walls[-1]):
                close(where[-1])
            now_main, now_frame = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if (now_main, now_frame) != (main, frame):
                flush()
                main, frame = now_main, now_frame
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = _ends[tag].search(page, at)
                at = end.end() if end else n
        elif tag not in VOID and not (attributes.endswith("/") and tag not in INLINE):
            if tag == "p" and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            now_main, now_frame = main, frame
            wall = False
            if tag in MAIN:
                now_main = has_main = wall = True
            elif tag in FRAME and not (tag == "header" and main) or tag not in ("body", "html") and _marked(attributes):
                now_frame, wall = True, tag in FRAME
            if (now_main, now_frame) != (main, frame):
                flush()
                main, frame = now_main, now_frame
            if wall:
                walls.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, main, frame))
    flush()
    return out, has_main


_ends = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b`` (Hunt and Szymanski: time by matches)."""
    n, m, head = len(a), len(b), 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out = {*range(head), *range(n - tail, n)}
    where: dict = {}
    for j in range(m - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, n - tail):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def deletions(own: list, sizes: list[int], others: list[list]) -> list[int]:
    """Places in ``own`` that the neighbours' lines delete. sizes: characters of a line of the main text, negative ones
    inside a main element, 0 for the frame."""
    total, votes = sum(map(abs, sizes)), {}
    mirror = (MIRROR if any(s < 0 for s in sizes) else MIRROR_PLAIN) * total
    for other in others:
        both = [k for k in shared(own, other) if sizes[k]]
        if sum(abs(sizes[k]) for k in both) < mirror:
            for k in both:
                votes[k] = votes.get(k, 0) + 1
    return sorted(k for k, count in votes.items() if count > 1 or sizes[k] > 0)


def _hash(line: str) -> bytes:
    return xxhash.xxh3_64_digest(line.encode("utf-8", "surrogatepass"))[:HASH]


def _unhash(blob: bytes) -> list[bytes]:
    return [blob[k : k + HASH] for k in range(0, len(blob), HASH)]


FRAMES = "k1 long, k2 long, host string, path string, lines binary, sizes array<int>"


def _frames(batches):
    """Of each page its host and path, the hashes of its lines, and their part in the main text (see ``deletions``)."""
    for batch in batches:
        hosts, paths, hashes, sizes = [], [], [], []
        for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            host, path = split_url(url)
            found, has_main = lines(page)
            hosts.append(host)
            paths.append(path)
            hashes.append(b"".join([_hash(line) for line, _, _ in found]))
            sizes.append([0 if frame or has_main and not main else -len(line) if main else len(line) for line, main, frame in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], [x.split()[0] for x in FRAMES.split(", ")])


def _bodies(batches):
    """Of each page the lines of its main text, before the alignment's deletions."""
    for batch in batches:
        bodies = []
        for page in batch.column(4).to_pylist():
            found, has_main = lines(page)
            bodies.append([line for line, main, frame in found if not frame and (main or not has_main)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(bodies, pa.list_(pa.string()))], ["k1", "k2", "page_id", "url", "body"])


def split_url(url: str) -> tuple[str, str]:
    """Host, and path with query, without what names the same page: scheme, www., fragment, last slash and .html."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    rest, mark, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host = host.lower().removeprefix("www.")
    return host, "/" + re.sub(r"(/|\.html?|/index\.html?)$", "", path) + mark + query


def neighbours(frames: DataFrame) -> DataFrame:
    """(k1, k2, near): for each distinct page of a host the keys of the pages before and after it, in order of path, query
    and key. Range-partitioned: a host with a third of all pages is dealt to many tasks, and the partitions' ends (one
    small row each) are joined over."""
    spark = frames.sparkSession
    units = frames.filter("host != ''").select("host", "path", "k1", "k2").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(units.repartitionByRange(parts, "host", "path", "k1", "k2").withColumn("part", F.spark_partition_id()))
    ranged = ranged.withColumn("own", F.struct("host", "path", "k1", "k2"))
    ends = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("own").alias("first"), F.max("own").alias("last")).collect())  # a row a partition
    around = [(p, tuple(ends[k - 1][2]) if k else None, tuple(ends[k + 1][1]) if k + 1 < len(ends) else None) for k, (p, _, _) in enumerate(ends)]
    one = "struct<host:string,path:string,k1:bigint,k2:bigint>"
    around = spark.createDataFrame(around, f"part int, last {one}, next {one}")
    w = Window.partitionBy("part").orderBy("host", "path", "k1", "k2")
    joined = ranged.join(F.broadcast(around), "part")
    sides = (F.coalesce(F.lag("own").over(w), "last"), F.coalesce(F.lead("own").over(w), "next"))
    joined = joined.select("host", "k1", "k2", F.array_compact(F.array(*sides)).alias("near"))
    return joined.select("k1", "k2", F.filter("near", lambda x: x["host"] == F.col("host")).alias("near")).filter(F.size("near") > 0)


def _aligned(batches):
    """Of each page which lines of its main text, counted from 0, the alignment with its neighbours deletes."""
    for batch in batches:
        drops = []
        for blob, sizes, others in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
            body = {k: j for j, k in enumerate(k for k, size in enumerate(sizes) if size)}
            drops.append([body[k] for k in deletions(_unhash(blob), sizes, [_unhash(x) for x in others])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drops, pa.list_(pa.int32()))], ["k1", "k2", "drop"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", align: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_deleted of each row; n_deleted: lines that the alignment deleted.

    Null and empty pages have an empty text. Pages without a host (null or empty urls) are compared with none, as is a
    host's only page. Repeated rows give a row each, with one text; null ids stay null. An empty table gives an empty one.
    align: False leaves the alignment out, for comparison.

    Pages are known by 128 bits of hashes of url and html, so equal pages are aligned once. Pages are parsed twice: for
    the alignment, which needs hashes and lengths of lines only, and for the texts. The deletions are joined to those;
    where their table is small, Spark broadcasts it (under its own size limit) and no text is shuffled.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    named, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    source = source.select(F.xxhash64(named, page).alias("k1"), F.xxhash64(page, named, F.lit(1)).alias("k2"), "page_id", "url", named.alias("named"), page.alias("page"))
    bodies = source.select("k1", "k2", "page_id", "url", "page").mapInArrow(words.freeing(_bodies), "k1 long, k2 long, page_id long, url string, body array<string>")
    if not align:
        text = F.array_join("body", " ")
        return bodies.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_deleted"))
    frames = cut(source.select("k1", "k2", "named", "page").mapInArrow(words.freeing(_frames), FRAMES))
    pairs = neighbours(frames).select("k1", "k2", F.explode("near").alias("n")).select("k1", "k2", F.col("n.k1").alias("n1"), F.col("n.k2").alias("n2"))
    once = frames.select("k1", "k2", "lines", "sizes").dropDuplicates(["k1", "k2"])
    others = once.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("lines").alias("other"))
    # a page is the neighbour of two at most, and has two: no key is hot
    seen = pairs.join(others, ["n1", "n2"]).groupBy("k1", "k2").agg(F.collect_list("other").alias("others"))
    both = once.join(seen, ["k1", "k2"]).select("k1", "k2", "lines", "sizes", "others")
    drops = cut(both.mapInArrow(words.freeing(_aligned), "k1 long, k2 long, drop array<int>").filter(F.size("drop") > 0))
    drop_cut(frames)
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    text = F.array_join(F.filter("body", lambda _, k: ~F.array_contains(gone, k)), " ")
    return bodies.join(drops, ["k1", "k2"], "left").select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size(gone).cast("long").alias("n_deleted"))
