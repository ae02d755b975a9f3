"""Secret scan, HTML extraction, token counts, toxicity, URL filter and nearest neighbours."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.llm import main_text, nearest, secret_scan, token_counts, toxicity, url_filter

BASE = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def test_base_secrets_equal_brute_force(spark, tmp_path, documents):
    hexes = "0123456789abcdef" * 2
    texts = [None, "", f"é😂 Token = '{hexes}' x", "token=token:abcdefgh", "token=abc secret=abcdef", f"AKIA{'B' * 16}AKIA{'C' * 20}", "AKIAAKIA123", f"x{hexes}", f"password={hexes} api-key: zzzzzz API_KEY:zzzzzz", "line\npasswd='a/b+c=d'" * 300]
    documents(*enumerate(texts), (0, None)).write.parquet(f"{tmp_path}/documents.parquet")
    out = secret_scan.query(spark, str(tmp_path)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [spans.count(k + ":") for k in ("assign", "access", "hex")]


def test_weak_parts_need_their_complement(documents):
    texts = ["user=anna", "user=anna password=abcdefgh", "user=anna" + " x" * 150 + " password=abcdefgh", "pass: qwertyu at https://db.example.org", "login=bob pass: qwertyu at https://db.example.org"]
    out = {r.doc_id: [secret_scan.KINDS[s.kind] for s in sorted(r.linked)] for r in secret_scan.secret_spans(documents(*enumerate(texts))).collect()}
    assert out == {0: [], 1: ["weak_access"], 2: [], 3: [], 4: ["weak_access", "weak_secret"]}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href="/">Home</a></header><div class="cookie-notice">We use cookies, and more of them.</div>
<div id="sidebar"><p>The writer, who is well known, has written long texts about this and that for many years.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> words.<p>Short.</p><div class="ad"><p>Buy now, it is cheap, and will be there tomorrow, too.</p></div>
<script>var x = "</p>";</script><!-- a > b --><ul><li>One</li><li>Two</li></ul>{}<p>Last words &lt;here&gt;.</p></article>
<form><p>Your name, and address, please</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text_leaves_boilerplate(spark):
    comments = '<section class="comments"><p>I think this is a wonderful text, thank you, dear writer.</p></section>'
    expected = "Title & more\nFirst paragraph, with bold words.\nShort.\nOne\nTwo\nLast words <here>."
    pages = [(1, "u", PAGE.format(comments)), (2, "u", None), (3, None, ""), (None, "u", "<p"), (4, "u", "<p>" + "word, and more. " * 20000), (1, "u", PAGE.format("").replace("</article>", "")[:-30])]
    out = main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    by = [(r.page_id, r.text) for r in out]
    assert (1, expected) in by and sum(t == expected for _, t in by) == 2
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == 6
    assert dict(by)[2] == "" and dict(by)[4].startswith("word, and") and len(dict(by)[4]) == 319999


@pytest.mark.parametrize("given", ['class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden place"', 'data-hidden="display:none"', "hidden=until-found", 'data-style="display:none"'])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_elements_that_are_not_hidden_keep_their_text(element, given):
    text = "A paragraph, which is long enough, and stands in the page."
    assert main_text.main_text(f"<body><{element} {given}><p>{text}</p></{element}></body>") == text


@pytest.mark.parametrize("given", ["hidden", 'hidden=""', "class=a HIDDEN id=b", 'aria-hidden="true"', "style='color:red; display : none'", "style=visibility:hidden"])
def test_hidden_elements_are_no_text(given):
    assert main_text.main_text(f"<article><p>Seen, and read.</p><div {given}><p>A paragraph, which is long enough.</p></div></article>") == "Seen, and read."


@pytest.mark.parametrize("start", ["<body>", "", "<div>", "<b>So:</b> ", "So: "])
def test_a_head_without_end_ends_at_the_body(start):
    page = f"<html><head><meta charset=utf-8><title>T</title><script>x</script>\n{start}<article><p>A paragraph, which is long enough.</p></article>"
    assert main_text.main_text(page).endswith("A paragraph, which is long enough.")
    assert "T" not in main_text.main_text(page)


@pytest.mark.parametrize("start", ['<article class="post type-post tag-linux tag-search">', '<div class="content has-sidebar">', '<div class="responsive no-comments with-nav">', '<main class="sidebar">', '<div class="sidebar-left"><article>', '<div class="ads"><div><main>', '<main><div class="post menu"><article class="menu">'])
def test_names_of_layouts_and_topics_are_no_boilerplate(start):
    ends = "".join(f"</{tag.split()[0]}>" for tag in start.strip("<>").split("><")[::-1])
    page = f'<body>{start}<h2>Title</h2><p>A paragraph, which is long enough, and stands in the page.</p><p>Short one, too.</p>{ends}<div class="sidebar"><p>Other words, which are not read.</p></div></body>'
    assert main_text.main_text(page) == "Title\nA paragraph, which is long enough, and stands in the page.\nShort one, too."


@pytest.mark.parametrize("name", ["ad", "main-nav", "site-header", "cookie-notice", "related-posts", "comments", "widget-2", "post_tags", "tag-cloud", "share-buttons"])
def test_lists_of_other_articles_stay_boilerplate(name):
    words = "A paragraph, which is long enough, and stands in the page. " * 4
    other = f'<div class="{name}"><article class="comment"><p>Other words, which are not read.</p></article></div>'
    for page in (f"<article><p>{words}</p></article>{other}", f"<main><p>{words}</p>{other}</main>", f"<article><p>{words}</p>{other}</article>"):
        assert main_text.main_text(page) == words.strip()


_SENTENCES = " ".join(f"<p>Sentence {n} of the article, which is long enough to count, says something.</p>" for n in range(8))


@pytest.mark.parametrize("page", ["<form id='aspnetForm'><article>{}</article></form>", "<form id='aspnetForm'><div id='content'>{}</div></form>", "<aside><main>{}</main></aside>"])
def test_forms_around_the_page_hold_its_article(page):
    menu = "<form class='x'><label>Name</label> Subscribe here</form><aside>Other things, read too.</aside>"
    text = main_text.main_text("<body>" + page.format(_SENTENCES) + menu + "</body>")
    assert text.count("Sentence") == 8 and "Subscribe" not in text and "Other things" not in text


def test_quotes_open_values_only():
    page = "<article><p title=it's>" + _SENTENCES.replace("<p>", "<p title=it's>") + "</article>"
    assert main_text.main_text(page).count("Sentence") == 8
    assert main_text.main_text("<article>" + _SENTENCES + "<p data-x='a > b' title = \"c > d\">Last one, of enough words to count.</p></article>").endswith("\nLast one, of enough words to count.")


@pytest.mark.parametrize("part", ["<a '", '<a "', "<a =\"", "<!", "</script", "<a b=c "])
def test_open_tags_are_read_once(part):
    started = time.perf_counter()
    main_text.main_text("<script>" * (part == "</script") + part * 200_000)
    assert time.perf_counter() - started < 10


def test_minimum_cut_equals_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(150):
        count = int(draw.integers(1, 9))
        odds = draw.normal(0, 2, count).tolist()
        edges = [(a, b, float(draw.exponential(1.0))) for a in range(count) for b in range(a + 1, count) if draw.random() < 0.5]

        def cost(label):
            return sum(-o if x else 0.0 for o, x in zip(odds, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([bool(n >> i & 1) for i in range(count)]) for n in range(1 << count))
        assert cost(main_text.minimum_cut(odds, edges)) == pytest.approx(best)


def test_multipart_credentials_are_linked(documents):
    bare = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    akia = "AKIA" + "B" * 16
    texts = [
        f"{akia}\naws_secret_access_key = {bare}\n\"endpoint\": \"db1\"",
        "DB_USER=anna\nDB_PASS=qwertyu\nDB_HOST = db1",
        f"AWS_ACCESS_KEY_ID=abcdef {bare} host = db1",
        f"{akia} {bare} \"Server\" : 'db1'",
        f"{akia} {bare}",
        f"user=anna {bare}",
        f"{akia} {'aA1' * 10} https://db1.example.org",
        "user=" + "a" * 250 + " password=abcdefgh",
        "spring.datasource.username: anna, spring.datasource.secretAccessKey: 'abcdef' https://db1.example.org",
        "superuser=anna bypass=qwertyu https://db1.example.org",
    ]
    out = {r.doc_id: [secret_scan.KINDS[s.kind] for s in sorted(r.linked)] for r in secret_scan.secret_spans(documents(*enumerate(texts))).collect()}
    pair = ["weak_access", "weak_secret"]
    assert out == {0: ["weak_secret"], 1: pair, 2: ["weak_access", "bare"], 3: ["bare"], 4: [], 5: [], 6: [], 7: ["weak_access"], 8: pair, 9: []}


def test_token_counts_equal_the_library(documents, words, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = np.random.default_rng(4)
    signs = [" ", "  ", "\n", "\t", "▁", "a", "the", "é", "字", "😂", "<s>", "\x00"]
    texts = [None, "", " " * 900, "a" * 400, words(4000), words(30), *("".join(draw.choice(signs, 40)) for _ in range(300))]
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        out = token_counts.token_counts(documents(*enumerate(texts), (None, "a b")), path).collect()
        assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in out} == {n: (len(model.encode(t or "")), len((t or "").encode())) for n, t in enumerate(texts)} | {None: (2, 3)}
        assert next(r.over_limit for r in out if r.doc_id == 4) == (len(model.encode(texts[4])) > 4096)


def test_chunk_maps_compose_in_any_grouping(words):
    import public_tokenizers

    counts = token_counts.WordCounts(token_counts.Transducer.of_model(public_tokenizers.path("piece_bpe_32k.model")))
    text = token_counts.MARK + words(200).replace(" ", token_counts.MARK)
    a, b, c, d = (counts.chunk_map(text[n : n + 313]) for n in range(0, 1252, 313))
    f = counts.compose
    assert f(f(f(a, b), c), d) == f(f(a, b), f(c, d)) == f(a, f(b, f(c, d)))


def labelled(documents, words, n=400):
    return documents(*[(i, words(30) + (" you idiot" if i % 5 == 0 else "") + " end") for i in range(n)])


def test_toxicity_on_held_out_rows(spark, documents, words):
    docs = labelled(documents, words)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    extra = documents((900, None), (901, ""), (None, "idiot"), (0, "idiot"))
    out = toxicity.toxicity(docs.unionByName(extra).withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1


def test_swapped_terms_move_scores_less(spark, documents, words):
    """A group is named in toxic rows alone; the penalty takes its weight away."""
    docs = documents(*[(i, words(20) + (" muslims" if i % 4 == 0 else "") + (" scum" if i % 8 == 0 else "")) for i in range(600)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    texts = documents((1, "the muslims were here"), (2, "the buddhists were here"))

    def gap(fairness):
        rows = {r.doc_id: r.score for r in toxicity.score(texts, *toxicity.fit(docs, labels, fairness=fairness)).collect()}
        return abs(rows[1] - rows[2])

    assert gap(0.0) > 0.5 > 0.2 > gap(100.0)


def test_toxicity_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(documents((1, "a")), labels).collect()] == [0.5]
    assert toxicity.toxicity(documents(), labels).count() == 0


def test_url_rules(spark):
    urls = {
        1: ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
        4: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        5: ("http://example.com", "example.com", "", None, None),
        6: (None, "", "", None, None),
        7: ("no scheme/com/", "", "", None, None),
        8: ("a://b://c.com/", "b:", "//c.com/", None, None),
        9: ("http://example.com?p=/en/", "example.com", "", None, None),
    }
    pages = spark.createDataFrame([(n, u[0], None) for n, u in urls.items()] + [(1, urls[1][0], "x")], "page_id long, url string, html string")
    out = url_filter.filter_urls(pages).collect()
    assert len(out) == 10
    for r in out:
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert url_filter.filter_urls(pages.where("page_id < 0")).count() == 0


def test_trees_learn_from_ruled_urls(spark):
    rows = [(n, f"http://s{n % 9}.net/{'es' if n % 2 else 'en'}/{n}") for n in range(300)] + [(n, f"http://s{n % 9}.com/de/{n}/a/b/c-d") for n in range(300, 600)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    assert len(out) == 150 and sum(r.verdict == "block" for r in out) > 100


def test_rare_labels_and_hot_urls_are_sampled(spark, monkeypatch):
    seen = []

    class Trees(url_filter.GBTClassifier):
        def fit(self, rows, *more):
            seen.append({r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()})
            hot = max(Counter(str(r.features) for r in rows.collect()).values())
            seen.append(hot)
            return super().fit(rows, *more)

    monkeypatch.setattr(url_filter, "GBTClassifier", Trees)
    hot = "http://hot.com/" + "h" * 60
    rows = [(n, f"http://s{n % 9}.net/es/{n}" if n < 3 else hot if n % 3 == 0 else f"http://s{n}.com/de/{'x' * (n % 50)}/{n}") for n in range(3000)] + [(3000, "http://a.org/")]
    assert url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), sample=150).count() == 3001
    labels, most = seen
    assert labels[1.0].n == 3 and labels[0.0].n == 147
    assert labels[1.0].weight == pytest.approx(3) and labels[0.0].weight == pytest.approx(2997)
    assert 25 < most < 75


def brute_nearest(rows, k, every):
    ids = np.array([r[0] for r in rows])
    units = np.array([np.array(r[1]) / np.sqrt((np.array(r[1]) ** 2).sum()) for r in rows])
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        near = units @ units[n]
        near[n] = -9
        order = np.lexsort((ids, -np.round(near, 12)))[: min(k, len(ids) - 1)]
        out[int(ids[n])] = [int(ids[i]) for i in order]
    return out


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES_BLOCK", 4)
    draw = np.random.default_rng(6)
    points = [draw.normal(0, 1, 12).astype("float32").tolist() for _ in range(500)]
    points[100:160] = [points[100]] * 60
    odd = [(1000, None), (1050, [0.0] * 12), (1100, [float("nan")] * 12), (1150, [1.0, None] * 6), (1200, [1.0]), (None, points[0]), (1250, [])]
    table_rows = [*enumerate(points), *odd, (50, points[50])]
    frame = spark.createDataFrame(table_rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = {}
    for r in sorted(nearest.nearest(frame).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute_nearest([*enumerate(points)], 5, 50)


def test_copies_of_a_vector_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 100)
    rows = [(n, [1.0, 2.0], curve, 7 if n % 3 else n) for n in range(1500) for curve in range(2)]
    keyed = spark.createDataFrame(rows, "vec_id long, v array<double>, curve int, key long")
    sizes = [r["count"] for r in nearest.dealt(keyed).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300
    draw = np.random.default_rng(8)
    points = [draw.normal(0, 1, 6).tolist() if n % 3 else [1.0] * 6 for n in range(600)]
    found = {}
    for r in sorted(nearest.nearest(spark.createDataFrame([*enumerate(points)], "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute_nearest([*enumerate(points)], 5, 50)


def test_nearest_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 4.0])], schema)).count() == 2


def test_hilbert_curve_steps_by_one():
    grid = np.array([(a, b) for a in range(8) for b in range(8)])
    order = grid[np.argsort(nearest.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    assert len(set(nearest.hilbert_keys(grid, 3).tolist())) == 64


@pytest.mark.parametrize("operator", [secret_scan.secret_spans, lambda d: token_counts.token_counts(d, __import__("public_tokenizers").path("piece_bpe_32k.model"))])
def test_empty_tables(documents, operator):
    assert operator(documents()).count() == 0


def test_runs_of_many_words_are_scanned(documents):
    """Long dotted, hyphenated and snake-cased runs: no deep stack, and what follows them is found."""
    tail = " db_user=anna password_hint host=db.example.com AKIA" + "A1B2" * 5
    texts = [word * 20_000 + tail for word in ("a.", "ab-", "key_")]
    found = secret_scan.secret_spans(documents(*enumerate(texts))).collect()
    assert [r.n_access for r in found] == [1, 1, 1]


def test_a_part_is_not_its_own_complement(documents):
    texts = ["access_key=abcdefgh https://example.com", "user=anna sort_key=created_at", "login: form, cache_key = frontpage"]
    found = secret_scan.secret_spans(documents(*enumerate(texts))).collect()
    assert all(not r.linked for r in found)
    both = secret_scan.secret_spans(documents((1, "access_key_id=abcdefgh secret_access_key=ijklmnop host=db.example.com"))).collect()
    assert len(both[0].linked) == 2


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """Spark judges them by the table they are made of, and the driver would hold one copy for each group of vector blocks."""
    vectors = spark.range(60).selectExpr("id as vec_id", "array(cast(id as double), 1.0D, 2.0D) as v", "id as key")
    found = nearest.completion(vectors, vectors.where("vec_id % 10 = 0").selectExpr("*", "-2.0D as bound"), 3)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
