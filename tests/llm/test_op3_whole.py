"""Page differencing against a brute-force twin, its part in the result, linear parsing, and attributes as they stand."""

import collections
import html as escapes
import random
import re
import time

import pytest

from strandframe.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"


def in_common(a, b):
    """Places in a of a longest common subsequence, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def twin(pages):
    """{url: text} of pages made by ``made``: (url, [(line, 'main' | 'frame' | 'plain')])."""
    hosts = collections.defaultdict(list)
    for url, lines in pages:
        hosts[url.split("/")[2]].append((url, lines))
    out = {}
    for own in hosts.values():
        own.sort()
        for k, (url, lines) in enumerate(own):
            has_main = any(kind == "main" for _, kind in lines)
            body = {i for i, (_, kind) in enumerate(lines) if kind == ("main" if has_main else "plain")}
            size = sum(len(lines[i][0]) for i in body)
            votes = collections.Counter()
            for other in (k - 1, k + 1):
                if 0 <= other < len(own):
                    gone = [i for i in in_common([x for x, _ in lines], [x for x, _ in own[other][1]]) if i in body]
                    if sum(len(lines[i][0]) for i in gone) < (html.MIRROR if has_main else html.MIRROR_PLAIN) * size:
                        votes.update(gone)
            out[url] = " ".join(lines[i][0] for i in sorted(body) if votes[i] < (2 if has_main else 1))
    return out


def made(lines):
    tags = {"main": "<article><p>{}</p></article>", "frame": "<nav>{}</nav>", "plain": "<div>{}</div>"}
    return "<html><body>" + "".join(tags[kind].format(escapes.escape(x)) for x, kind in lines) + "</body></html>"


def test_extract_is_its_twin(spark):
    rng = random.Random(6)
    pages = []
    for host in range(5):
        frames = [f"frame {k} of host {host} & more" for k in range(12)]
        site = [f"said on every page {k} of {host}" for k in range(3)]
        for n in range(1 + 6 * host):
            kind = rng.choice(("main", "plain"))
            own = [(f"own line {n} {host} {k} " + "x" * rng.randrange(1, 60), kind) for k in range(rng.randrange(1, 6))]
            lines = [(f, "frame") for f in frames if rng.random() < 0.7] + own[:1] + [(s, kind) for s in site if rng.random() < 0.7] + own[1:]
            pages.append((f"http://h{host}/{n:03d}?id={n % 3}", lines))
            if rng.random() < 0.2:  # a mirror beside it
                pages.append((f"http://h{host}/{n:03d}m", lines))
    table = spark.createDataFrame([(k, url, made(lines)) for k, (url, lines) in enumerate(pages)], "page_id long, url string, html string")
    want = twin(pages)
    rows = html.extract(table).collect()
    assert len(rows) == len(pages) and {r.url: r.text for r in rows} == want
    assert any(r.n_deleted for r in rows)
    mirrored = [r for r in rows if re.search("m$", r.url)]
    assert mirrored and all(r.text for r in mirrored)


def test_alignment_decides_on_the_pages_given(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_, without = ({r.page_id: r.text for r in html.extract(pages, align=a).collect()} for a in (True, False))
    changed = [k for k in with_ if with_[k] != without[k]]
    assert changed and len(changed) < len(with_) / 50
    assert all(0 < len(with_[k]) < len(without[k]) for k in changed)


@pytest.mark.parametrize("piece", ['<a "', "<a ='\"", "<!", '<p class="x', "< ", '<a href=">', "<div>", "</div>", "<b><article><div></b>", "&amp", "<script>"])
def test_a_megabyte_of_anything_is_parsed_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html.lines(page)
    assert time.process_time() - began < 8
    assert html.lines("<p>before</p>" + page)[0][0][0] == "before"


def test_only_real_attributes_mark():
    text = lambda x: " ".join(line for line, main, frame in html.lines(f"<article>{x}</article>")[0] if not frame)
    assert text('<a href="/read?id=share">the report</a>') == "the report"
    assert text('<p data-id="menu">a</p><p title="class=ad">b</p><div class="header-image-caption">c</div>') == "a b c"
    assert text('<div class="x comment-list">no</div><div id=sidebar>no</div><div role="navigation">no</div><div class="site-header">no</div>yes') == "yes"
    assert text("<header><h1>Title</h1></header>body<footer>no</footer>") == "Title body"
    assert text("1 < 2 &lt; 3<br>a <b>b</b>c") == "1 < 2 < 3 a bc"


def test_repeated_rows_nulls_and_very_long_pages(spark):
    long = "<main>" + "<p>word word</p>" * 40_000 + "</main>"
    rows = [(1, "http://h/a", "<p>x</p>"), (1, "http://h/a", "<p>x</p>"), (None, None, None), (2, "", "<p>y</p>"), (3, "http://h/b", long)]
    got = html.extract(spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, host string, k1 int")).collect()
    assert collections.Counter((r.page_id, r.n_chars) for r in got) == {(1, 1): 2, (None, 0): 1, (2, 1): 1, (3, 40_000 * 10 - 1): 1}
