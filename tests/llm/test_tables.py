"""Pages, vectors, URLs and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import ann, graph, oracles, pages, queries, toxicity, url_rules

SF = "/root/testdata/sf0.001"


# ---- pages


def test_articles_of_the_table(spark):
    import html

    got = {r.page_id: r for r in queries.op1_main_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        a = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", a))
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>a  b\n c</p><p>d &amp; e&#33;</p>", "a b c\nd & e!"),
        ("<article><h1>T</h1><header><p>by x</header><p>one<div class='share-bar'>s</div><p>two<footer>f</footer></article><p>after", "T\nby x\none\ntwo"),
        ("<main><nav>n</nav><p>m</main><aside>a</aside>", "m"),
        ("<body class='has-sidebar'><div id=sidebar>s</div><div class='post-content'><p>c</p></div><div class='comments'><article>r</article></div>", "c"),
        ("<article><p>x<script>var a = '<p>no</p>';</script>y</p><!-- <p>no</p> --><form><p>f</form></article>", "xy"),
        ("<article>a<br>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>", "a b\nc\nd\ne\nf"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut <a hre", "cut"),
        ("<ARTICLE><P>upper</P></ARTICLE><DIV>no</DIV>", "upper"),
        ("<nav><ul><li><a href='x'>menu</a></ul></nav><div class=ad>buy</div><article><p hidden>h</p><p>z</article>", "z"),
        ('<article><p title="a > b">q</article>', "q"),
    ],
)
def test_layouts(page, text):
    assert pages.chosen(pages.blocks(page), None, 8) == text


def test_hosts_repeated_runs_are_removed(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choices("lorem ipsum dolor sit amet elit sed do magna aliqua enim minim".split(), k=n)) + f" {rng.random()}"
    chrome = "<div>Welcome to our site where everything is about trains and their tracks</div>"
    rows = []
    for k in range(12):
        host = "a.example" if k < 8 else f"b{k}.example"
        rows.append((k, f"http://{host}/{k}", f"<body>{chrome}<div>{(w := words(40))}</div><div><a href=x>one two</a></div></body>", w))
    rows.append((99, None, None, ""))
    rows.append((7, rows[7][1], rows[7][2], rows[7][3]))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "host", "got", "page_key", "runs")})
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for k, _, _, w in rows:
        own = w if k < 8 or k == 99 else "Welcome to our site where everything is about trains and their tracks\n" + w
        assert got[k].text == own and got[k].n_chars == len(own), k
    assert pages.extract(df).count() == len(rows) and pages.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    """Equal html under other ids and addresses of a host covers nothing; what a third page shares is still removed."""
    chrome = "<div>Welcome to our site where everything is about trains and their tracks</div>"
    body = f"<body>{chrome}<div>{' '.join(f'word{k}' for k in range(30))}</div></body>"
    other = f"<body>{chrome}<div>{' '.join(f'else{k}' for k in range(30))}</div></body>"
    rows = [(1, "http://a.example/x", body), (2, "http://a.example/x?utm_source=y", body), (3, "http://a.example/z", other)]
    rows += [(4, "http://b.example/x", body), (5, "http://b.example/y", body)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = " ".join(f"word{k}" for k in range(30))
    assert got[1] == got[2] == text and got[3] == " ".join(f"else{k}" for k in range(30))
    assert got[4] == got[5] == "Welcome to our site where everything is about trains and their tracks\n" + text


def test_content_around_articles(spark):
    """Text in main and named containers stays beside articles; there, too, what a host repeats goes, but not in articles."""
    notice = "Trains of this line run every hour from early morning until late at night"
    own = lambda k, n=20: " ".join(f"own{k}x{i}" for i in range(n))
    rows = [
        ("<main><h1>T</h1><article><p>one two</article></main>", "T\none two"),
        (f"<main><p>{own(1)}</main><article><p>teaser</article>", f"{own(1)}\nteaser"),
        (f"<div class=content><p>{own(2)}</div><article><p>teaser</article><p>open", f"{own(2)}\nteaser"),
        (f"<main><p>{notice}</p><p>{own(3)}</main>", own(3)),
        (f"<div class=content><p>{notice}</p><p>{own(4)}</div>", own(4)),
        (f"<article><p>{notice}</p><p>{own(5)}</article>", f"{notice}\n{own(5)}"),
        (f"<article><p>{notice}</p><p>{own(6)}</article>", f"{notice}\n{own(6)}"),
    ]
    # equal places in the page: a notice in <main> of a second page, one in the container of a third
    rows += [(f"<main><p>{notice}</p><p>{own(7)}</main>", own(7)), (f"<div class=content><p>{notice}</p><p>{own(8)}</div>", own(8))]
    df = spark.createDataFrame([(k, f"http://a.example/{k}", h) for k, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert [got[k] for k in range(len(rows))] == [t for _, t in rows]


def test_suffixes_are_the_runs():
    """Equal keys are exactly equal runs of the same host."""
    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, 300).astype(np.uint64)
    keys = pages.suffixes(t, "h", 8)
    for i in range(0, 290, 7):
        for j in range(0, 290, 11):
            assert (keys[i] == keys[j]) == bool((t[i : i + 8] == t[j : j + 8]).all())
    assert keys[0] != pages.suffixes(t, "g", 8)[0] and len(pages.suffixes(t[:7], "h", 8)) == 0


def test_covered_runs_are_those_of_a_suffix_array(spark):
    """Against whole suffix arrays: sorted suffixes of a host's pages, neighbours of another page, common prefixes of any length."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(5)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (9, 14, 40)]
    rows = []
    for k in range(30):
        parts = [" ".join(rng.choices(words, k=rng.randrange(3, 30))) for _ in range(3)] + rng.sample(shared, 2)
        rng.shuffle(parts)
        rows.append((k, f"http://h{k % 3}.example/{k}", "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(30, rows[0][1], rows[0][2]), (31, "http://h1.example/z", "<article>" + rows[1][2] + "</article>" + rows[1][2])]
    got = {r.page_id: r.n_repeated for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), report=True).collect()}
    for host in range(3):
        own = {k: pages.stream(pages.blocks(h)).tolist() for k, u, h in rows if f"//h{host}." in u and k != 30}
        array = sorted((t[i:], k, i) for k, t in own.items() for i in range(len(t)))
        covered = {k: set() for k in own}
        for x in range(len(array)):
            for step in (1, -1):  # outward until the common prefix is too short
                y, least = x + step, 10**9
                while 0 <= y < len(array) and least >= 8:
                    a, b = array[y - step][0], array[y][0]
                    least = min(least, next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))))
                    if least >= 8 and array[y][1] != array[x][1]:
                        covered[array[x][1]] |= set(range(array[x][2], array[x][2] + least))
                    y += step
        assert {k: len(v) for k, v in covered.items()} == {k: got[k] for k in own}
    assert got[30] == got[0]


@pytest.mark.parametrize("name, stays", [("ad-hoc", True), ("related-work", True), ("sharing-economy", True), ("ad-box", False), ("related-posts", False), ("share", False), ("googleAd", False), ("comments_list", False)])
def test_names_in_articles(name, stays):
    assert pages.chosen(pages.blocks(f"<article><p>a</p><div class='x {name}'>b</div></article>"), None, 8) == ("a\nb" if stays else "a")


def test_deep_pages_take_time_by_length():
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        pages.blocks("<div>" * n + "x</b></i>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


def test_very_long_page():
    p = "<article>" + "<p>word word</p>" * 50_000 + "<div " * 1000
    assert len(pages.chosen(pages.blocks(p), None, 8)) == 50_000 * 10 - 1


# ---- vectors


def slow_nearest(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            s = sorted((-float(ann.cosine(a, b[None, :])[0]), i) for i, b in ok if i != q)
            out[q] = s[:k]
    return out


def test_nearest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = slow_nearest(rows), {}
    for r in queries.op3_nearest(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    score = {(q, i): -s for q, found in slow_nearest(rows, len(rows)).items() for s, i in found}
    hit = total = 0
    for q, found in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert all(r.score == score[q, r.vec_id] for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in mine} & {i for _, i in found})
        total += len(found)
    assert hit / total >= 0.9


def test_nearest_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [1.0, None, 0.0]), (9, [1.0]), (None, [1.0, 0.0, 0.0]), (50, [0.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "score": F.lit(3)})
    got = ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 100), (0, 3), (0, 11), (100, 0), (100, 1), (100, 2), (100, 3), (100, 11)]
    assert [r.score for r in got[:3]] == [1.0, 1.0, 1.0] and got[4].score == -1.0
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("rows, asked", [(16384, 4096), (40, 3)])
def test_cells(spark, monkeypatch, rows, asked):
    """Codes dealt as many small cells give what one cell a code gives; a third of the rows are one vector, under few ids."""
    rng = np.random.default_rng(8)
    x = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 16)).astype(np.float32))] + [(200 + k // 4, [0.5] * 16) for k in range(100)]
    monkeypatch.setattr(ann, "ROW_BLOCK", rows)
    monkeypatch.setattr(ann, "QUERY_BLOCK", asked)
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0, tables=4, probes=32).collect())
    want = []
    for q, v in x:
        if q % 50 == 0:
            found = sorted((-float(ann.cosine(np.array(v), np.array([w]))[0]), i) for i, w in x if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert got == sorted(want)


def test_small_tables_are_whole(spark):
    """With the production parameters, tables of a few vectors give every query its k nearest, or all there are."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 6, 10, 30):
        rows = [(50 * k if k < 3 else k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 64)).astype(np.float32))]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
        for q, v in rows[:3]:
            mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            assert len(mine) == min(5, n - 1), n
            exact = sorted((-float(ann.cosine(np.array(v), np.array([w]))[0]), i) for i, w in rows if i != q)
            if n <= 6:
                assert [(i, -s) for s, i in exact[:5]] == [(i, s) for _, i, s in mine]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(20, 50)).astype(np.float32)
    r = ann.Rotations(50)
    assert np.allclose(np.linalg.norm(r.turn(x, 0), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert (r.probes(x, 1)[:, :, 0] == r.codes(x)).all()


# ---- URLs

URLS = [None, "", "nonsense", "http://", "http://COM/", "http://a.com", "http://a.com/x", "http://xcom/", "https://www.example.com/en/1", "https://m.Example.com/en/1?x", "https://example.com/en", "https://example.com/en/", "http://example.com/fr/", "ftp://q.net/es/9#t", "q.net/es/9", "http://q.net/fr/", "http://net/fr/", "http://q.net/de/?u=http://a.com/", "http://a.com./x", "http://a.com:80/x", "http://www.www.example.com/en/", "http://a\x01com/x", "x://a.com/en/://b.net/es/"]


def slow_judge(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


@pytest.mark.parametrize("parts, most", [("1", 100_000), ("5", 100_000), ("5", -1)])
def test_rules(spark, monkeypatch, parts, most):
    monkeypatch.setattr(url_rules, "MAX_SENT", most)
    rules = [*queries.URL_RULES, ("org", "/", "block"), ("a.org", "/", "allow"), ("a.org", "/b/", "block"), ("a.org", "/b/c/", "allow"), ("a.org", "/b/", "block")]
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['', 'x.', 'www.', 'a.', 'b.a.'])}{rng.choice(['a.org', 'org', 'example.com', 'net', 'b.net'])}{rng.choice(['/b/', '/b/c/d', '/', '/en/', '/es/', ''])}" for _ in range(300)]
    urls += ["http://hot.com/en/"] * 100
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("z") for c in ("k", "o", "salt", "stack", "part", "rule", "carry")})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r for r in url_rules.judge(df, url_rules.rules_frame(spark, rules)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == slow_judge(u, rules), u


def test_rules_odd(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_rules.rules_frame(spark, queries.URL_RULES).limit(0)
    assert url_rules.judge(df, none, default="block").first()["verdict"] == "block"
    assert url_rules.judge(df.limit(0), url_rules.rules_frame(spark, queries.URL_RULES)).count() == 0
    loose = url_rules.rules_frame(spark, [("a.com", None, "block"), (None, "/", "block"), ("com", "/", None)])
    assert tuple(url_rules.judge(df, loose).select("rule", "verdict").first()) == ("a.com", "block")


# ---- components


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    p = {x: x for ab in links for x in ab}

    def get(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = get(a), get(b)
        p[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: get(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == docs.columns
        left = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < left.count() <= docs.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert set(docs.columns) < set(last.columns)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.copy) for r in whole.collect()) == sorted((r.doc_id, r.copy) for r in last.collect())
    assert math.isfinite(whole.count())


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_pipeline_against_plain_rules(spark):
    """The whole pipeline against each stage's rule applied to plain rows."""
    import pyarrow as pa

    from .test_documents import jaccard_of, roots, slow_hits, slow_targets, slow_windows

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(rows)
    ids = [d for d, score in zip(ids, model.score(pa.array([rows[d].text for d in ids]))) if score < 0.3]
    alike = [(i, j) for i in range(len(ids)) for j in range(i) if jaccard_of(rows[ids[i]].text, rows[ids[j]].text) >= 0.8]
    ids = [ids[k] for k in sorted(set(roots(len(ids), alike)))]
    windows = slow_windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    ids = [d for d in ids if not slow_hits(rows[d].text, windows)[1]]
    got = corpus_pipeline.run(spark, SF).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", rows[d].text or "")) for d in ids}
    total, taken, copies = {}, {}, {}
    for d in ids:
        total[rows[d].source] = total.get(rows[d].source, 0) + size[d]
    want = slow_targets(total)
    for r in got:
        assert r.doc_id in size and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) and r.n_chars == len(r.text)
        copies.setdefault(r.doc_id, []).append(r.copy)
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        private = re.findall(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) 555-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|AKIA\w{16}|[0-9a-f]{40}", rows[r.doc_id].text)
        assert not any(x in r.text for x in private) and (private or re.search(r"\d{13}|[=:]", rows[r.doc_id].text) or r.text == rows[r.doc_id].text)
    for d in ids:
        rate, n = want[rows[d].source] / max(total[rows[d].source], 1), sorted(copies.get(d, []))
        assert n == list(range(1, len(n) + 1)) and (not size[d] or math.floor(rate + 1e-9) <= len(n) <= math.ceil(rate - 1e-9))


def test_pipeline_on_odd_rows(spark):
    """Null ids, texts and sources, blank, very long and repeated rows, and columns with names that stages use themselves."""
    from .test_documents import ODD, SCHEMA

    names = ("hits", "score", "node", "n", "bands", "root", "doc", "text_key", "own", "unit", "source_size", "target", "rewritten", "later", "key", "row")
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in names}).withColumn("n_chars", F.length("text").cast("long"))
    left, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
        counts.append(left.count())
    assert counts[0] == len(ODD) and counts[1:] == [6, 6, 6]
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5, 7, 8] and all(r.score == "x" for r in left.collect())
    mixed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.filter("length(text) > 100000").count() >= 1


# ---- SQL


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.oracle_sql()[name]})")
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))
