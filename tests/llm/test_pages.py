"""Main text of pages, and the suffix arrays against brute force."""

import random
import time

import numpy as np

from lyrascope.llm import html_suffix

PAGE = (
    '<html><body class="has-sidebar"><nav><a>Home</a></nav><div id="cookie-notice">We use cookies</div>'
    "<main><h1>T &amp; x</h1><p>One<br>two \t <b>th</b>ree<script>var x='</p>';</script>"
    '<aside>side</aside><p>Four &lt; <div class="ad">buy</div>five<form>f<input></form></main>'
    '<section class="comments"><article class="comment"><p>nice</p></article></section>'
    "<footer>f</footer></body></html>"
)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return {r["page_id"]: r for r in html_suffix.extract(df).collect()}


def test_article_without_its_surroundings(spark):
    got = texts(spark, [(1, "http://a.b/c", PAGE, "clash"), (2, None, None, None), (3, "x", "", None)])
    assert got[1]["text"] == "T & x\n\nOne two three\n\nFour <\n\nfive"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0


def test_boilerplate_of_pages_that_mark_no_article(spark):
    foot = "all rights of this host are kept by its owners for ever"
    rows = [
        (i, "https://h.example/p", f"<body><p>{' '.join(f'w{i}x{k}' for k in range(30))}<p>{foot}", None)
        for i in range(5)
    ]
    rows.append((9, "https://other.example/", f"<body><p>{foot}", None))
    got = texts(spark, rows)
    for i in range(5):
        assert foot not in got[i]["text"] and got[i]["text"].startswith(f"w{i}x0 ")
    assert got[9]["text"] == foot


def test_copied_pages_stay_whole(spark):
    body = "<body><p>" + " ".join(f"w{k}" for k in range(50))
    got = texts(spark, [(i, "http://h/", body, None) for i in range(3)])
    assert all(r["n_chars"] > 100 and r["n_repeated_words"] == 50 for r in got.values())


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_suffix.extract(df).count() == 0


def test_pages_of_runs_against_all_windows():
    rng = random.Random(2)
    for run in (1, 3, 4, 8):
        streams = [[rng.choice("ab") for _ in range(rng.randint(0, 24))] for _ in range(6)]
        where = {}
        for i, stream in enumerate(streams):
            for k in range(len(stream) - run + 1):
                where.setdefault(tuple(stream[k : k + run]), set()).add(i)
        expected = [
            len(where[tuple(stream[k : k + run])]) if k + run <= len(stream) else 0
            for stream in streams
            for k in range(len(stream))
        ]
        words = [w for stream in streams for w in stream]
        page = np.repeat(np.arange(6), [len(s) for s in streams])
        assert html_suffix.distinct_pages(words, page, run).tolist() == expected


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_short_text_below_a_long_menu(spark):
    rows = [
        (h * 10 + i, f"http://h{h}/{i}", f"<p>{words_of(h, 60)}</p><p>{words_of(1000 + h * 10 + i, 25)}", None)
        for h in range(12)
        for i in range(6)
    ]
    got = texts(spark, rows)
    for h in range(12):
        for i in range(6):
            assert got[h * 10 + i]["text"] == words_of(1000 + h * 10 + i, 25)


def test_repeated_line_in_marked_articles(spark):
    line, quoted = words_of(1, 15), words_of(2, 15)
    rows = [
        (i, "http://h/", f"<article><p>{words_of(50 + i, 80)}<p>{line}{f'<p>{quoted}' if i % 3 == 0 else ''}", None)
        for i in range(20)
    ]
    got = texts(spark, rows)
    for i in range(20):
        kept = [words_of(50 + i, 80)] + [quoted] * (i % 3 == 0)
        assert got[i]["text"] == "\n\n".join(kept)


def hosts_with_menus():
    rng = random.Random(5)
    rows = []
    for i in range(240):
        host = "hot" if i % 2 else f"h{i % 14}"
        own = "".join(f"<p>{words_of((host, k).__repr__(), 14)}" for k in range(5) if rng.random() < 0.55)
        rows.append((i, f"http://{host}/{i}", f"<div>{own}</div><p>{words_of(9000 + i, 40)}", None))
    return rows


def test_result_does_not_depend_on_partitions(spark, monkeypatch):
    rows = hosts_with_menus()
    where, totals = {}, {}
    for _, url, source, _ in rows:
        host = url.split("/")[2]
        totals[host] = totals.get(host, 0) + 1
        stream = [w for b in html_suffix.blocks_of(source).blocks for w in b.split(" ")]
        for run in {tuple(stream[k : k + 8]) for k in range(len(stream) - 7)}:
            where[host, run] = where.get((host, run), 0) + 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    results = []
    for partitions, size in ((2, 4 << 20), (60, 4 << 20), (3, 2000)):
        monkeypatch.setattr(html_suffix, "SHARD_BYTES", size)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            results.append({r["page_id"]: r["text"] for r in html_suffix.extract(df).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    for i, url, source, _ in rows:
        host, page = url.split("/")[2], html_suffix.blocks_of(source)
        stream = [w for b in page.blocks for w in b.split(" ")]
        flags = np.zeros(len(stream), bool)
        for k in range(len(stream) - 7):
            n = where[host, tuple(stream[k : k + 8])]
            if 2 * n > totals[host] and n >= html_suffix.LEAST_PAGES:
                flags[k : k + 8] = True
        assert results[0][i] == html_suffix.main_text(page, flags)[0]


def test_unclosed_markup_is_read_in_linear_time():
    for piece in ("<p>x ", '<a href="x>', "<a '\"> ", "<!", "<p <p ", '<a "<a" ', "</script", "<script>", "<"):
        started = time.process_time()
        html_suffix.blocks_of(piece * ((1 << 20) // len(piece)))
        assert time.process_time() - started < 10
    assert html_suffix.blocks_of('a<b c="d>e</b>f').blocks == ["aef"]
