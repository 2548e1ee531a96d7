"""Page text: marks, alignment against a plain table of lengths, pages by nearest URL."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tabloom.llm import page_text


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(30))] for _ in range(2))
        got = sorted(page_text.shared(a, b))
        assert len(got) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_halving_gives_the_same_length(monkeypatch):
    rng = random.Random(4)
    a, b = ([rng.choice("abcdefgh") for _ in range(9000)] for _ in range(2))
    assert len(a) * len(b) > 1 << 26
    got = sorted(page_text.shared(a, b))
    *_, row = page_text._rows([ord(x) for x in a], [ord(x) for x in b])
    assert len(got) == len(b) - row.bit_count()


def test_badly_nested_html_takes_linear_time():
    start = time.monotonic()
    deep = "".join(f"<article><b{i % 50}><span>" for i in range(20_000)) + "word" + "</i></p></td></div>" * 20_000
    assert page_text.lines_of(deep) == [("word", page_text.ARTICLE)]
    assert time.monotonic() - start < 10
    # an end tag does not reach past the article that stands inside its element
    assert page_text.lines_of("<div><article>a</div>b</article>c") == [("a", page_text.ARTICLE), ("b", page_text.ARTICLE), ("c", page_text.PLAIN)]


def test_texts_of_the_given_pages(spark, sf_dir):
    """Every page against the same rules with whole lists of lines and a plain search for the partner."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    # without the marks of an article, and so that differencing decides
    bare = [(i, u, re.sub(r"<(/?)(article|main|header|footer|nav|aside|form)\b[^>]*>", r"<\1div>", h or "")) for i, u, h in rows]
    for given in (rows, bare, [*rows, *[(10_000 + i, u, h) for i, u, h in bare]]):
        got = {r.key: (r.text, r.n_chars) for r in page_text.extract(spark.createDataFrame(given, "page_id long, url string, html string").withColumn("lines", F.lit(1))).collect()}
        assert got == {k: (t, len(t)) for k, t in plain_texts(given).items()}


def plain_texts(rows):
    pages = {}
    for key, url, html in rows:
        host, path = page_text._host_and_path(url)
        pages[key] = (host, path, page_text.lines_of(html))
    firsts = {}
    for host, path, lines in pages.values():
        same = (host, tuple(t for t, _ in lines))
        firsts[same] = min(firsts.get(same, path), path)
    texts = {}
    for host in {h for h, _ in firsts}:
        ordered = sorted(((p, s[1]) for s, p in firsts.items() if s[0] == host), key=lambda x: x[0])
        runs = []
        for p, lines in ordered:
            alike = runs and len(set(lines) & set(runs[-1][-1][1])) >= page_text.NEAR_COPY * max(len(set(lines)), len(set(runs[-1][-1][1])))
            if alike:
                runs[-1].append((p, lines))
            else:
                runs.append([(p, lines)])
        for r, run in enumerate(runs):
            for i, (p, lines) in enumerate(run):
                near = [runs[r - 1][-1]] if r else []
                near += [runs[r + 1][0]] if r + 1 < len(runs) else []
                if len(runs) == 1:
                    near = run[i - 1 : i] if i else []
                    near += run[i + 1 : i + 2]
                best = max(near, key=lambda x: page_text._common(x[0], p), default=None) if host else None
                texts[host, lines] = page_text.shared(list(lines), list(best[1])) if best else set()
    return {
        k: "\n".join(t for i, (t, m) in enumerate(lines) if m == page_text.ARTICLE or m == page_text.PLAIN and i not in texts[host, tuple(t for t, _ in lines)])
        for k, (host, _, lines) in pages.items()
    }


def page(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def test_pages(spark):
    rows = [
        (1, "http://a.org/x/1", page("Home", "one &amp;  story", "Contact")), (2, "http://a.org/x/2", page("Home", "another story", "Contact")),
        (3, "http://b.org/y", "<nav>menu</nav><article><h1>T</h1><p>kept<br>line<p>next</article><div class='comments'>no</div><footer>f</footer>"),
        (3, "http://b.org/y", "<nav>menu</nav><article><h1>T</h1><p>kept<br>line<p>next</article><div class='comments'>no</div><footer>f</footer>"),
        (4, None, None), (None, "http://c.org", ""), (5, "http://c.org/z", "<script>var t='</p>'</script><p>only &lt;b&gt;"),
    ]
    got = sorted((str(r.key), r.text, r.n_chars) for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [("1", "one & story"), ("2", "another story"), ("3", "T\nkept line\nnext"), ("3", "T\nkept line\nnext"), ("4", ""), ("5", "only <b>"), ("None", "")]
    assert got == [(k, t, len(t)) for k, t in want]
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unmarked_body_beside_a_marked_teaser(spark):
    html = "<div><p>Menu</p></div><article><p>Read also</p></article><div class='content'><p>{}</p><p>{}</p></div>"
    rows = [(i, f"http://a.org/{i}", html.format(f"story {i}", f"end {i}")) for i in range(2)]
    got = {r.key: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Read also\nstory {i}\nend {i}" for i in range(2)}


def test_copies_and_near_copies_get_the_text_of_their_page(spark):
    story = [f"line {i} of the story" for i in range(12)]
    rows = [(i, f"http://a.org/b/{i}", page("Home", *story, "Contact")) for i in range(4)]
    rows += [(i, f"http://a.org/c/{i}", page("Home", *story, f"seen {i} times", "Contact")) for i in range(4, 7)]
    rows += [(9, "http://a.org/z", page("Home", "another story", "Contact")), (10, "http://b.org/1", page("Home", "alone"))]
    got = {r.key: r.text.split("\n") for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: story for i in range(4)} | {i: [*story, f"seen {i} times"] for i in range(4, 7)} | {9: ["another story"], 10: ["Home", "alone"]}
