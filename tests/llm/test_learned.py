"""Language identification, co-training and page extraction: held-out accuracy and edge cases."""

import itertools
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import cotraining, html_extract, language_id
from fleetgauge.llm.html_blocks import read_blocks
from fleetgauge.llm.html_templates import PageMaker
from tests.llm import plain_blocks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def languages(docs):
    return language_id.fit(docs, ~language_id.held_out(), per_language=60)


def test_held_out_languages(docs, languages):
    got = language_id.identify(docs.where(language_id.held_out()).select("text", F.col("lang").alias("is")), languages)
    assert got.agg(F.avg((F.col("is") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_spans_of_mixed_text_and_edges(spark, languages, docs):
    first = {r.lang: r.text for r in docs.where("n_chars > 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = first["de"][:800] + "\n" + first["fr"][:500]
    texts = [mixed, None, "", "123 !? \n", "и что это", "e"] + [first["es"] * 40]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in language_id.identify(df, languages).collect()}
    spans = rows[0].spans
    assert [s.lang for s in spans] == ["de", "fr"] and abs(spans[1].start - 801) < 60 and rows[0].lang_pred == "de"
    assert 0.5 < rows[0].score < 0.75
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].spans == [] for k in (1, 2, 3))
    assert rows[6].lang_pred == "es" and rows[6].score > 0.95
    none = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    some = language_id._sample(df, "text", "lang", F.lit(True), 100, ["doc_id"])
    assert 50 < some.count() < 150


def test_viterbi_equals_every_path():
    r = np.random.default_rng(2)
    sizes = [0, 1, 5, 0, 6, 3]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.normal(size=(offsets[-1], 3))
    labels = language_id.viterbi(scores, offsets, 0.8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        value = lambda p, a=a: sum(scores[a + k, x] for k, x in enumerate(p)) - 0.8 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
        assert value(labels[a:b].tolist()) == pytest.approx(best)


def test_co_training_on_held_out_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = F.col("doc_id") % 3 == 0
    model = cotraining.fit(docs, labels.where(~odd))
    got = cotraining.score(docs, model).join(labels.where(odd), "doc_id")
    right = (F.col("kept") == (F.col("quality") == 1)).cast("double")
    assert got.agg(F.avg(right)).first()[0] > 0.95


def test_scores_without_labels_and_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, None, None, 9), (2, "", "s", "en", 9), (2, "a b", "s", "en", 9), (None, "c", "s", "en", 9)],
                                 "doc_id long, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 1)], "doc_id long, quality int")
    rows = cotraining.score(docs, cotraining.fit(docs, labels)).collect()
    assert len(rows) == 4 and all(r.score == 1.0 and r.kept for r in rows)
    assert cotraining.score(docs.limit(0), cotraining.fit(docs, labels.limit(0))).count() == 0


def test_a_rare_class_is_fitted_and_kept_aside(spark):
    n = 200
    one = lambda y: cotraining.Sparse(n, np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.concatenate([y * 2.0 - 1, np.ones(n)]))
    y = np.ones(n, np.int64)
    y[[1, 2]] = 0  # neither is a 4th label
    model = cotraining.co_train(one(y), one(y), y)
    assert model.content is not None and ((model.scores(one(y), one(y))[2] >= 0.5) == y).all()
    assert cotraining.co_train(one(y), one(y), np.where(np.arange(n) == 2, -1, y)).prior == pytest.approx(198 / 199)

    text = lambda k: "click here to buy cheap now " * 9 if k % 50 == 7 else f"The long report number {k} says what was found. " * 9
    docs = spark.createDataFrame([(k, text(k), "web" if k % 50 == 7 else "book", "en") for k in range(600)], "doc_id long, text string, source string, lang string")
    labels = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 != 7).cast("int").alias("quality"))
    model = cotraining.fit(docs, labels, labelled=40)
    rows = cotraining.score(docs, model).collect()
    assert model.content is not None and model.prior == pytest.approx(0.98)
    assert all(r.kept == (r.doc_id % 50 != 7) for r in rows)


def test_the_fit_does_not_hang_on_partitions_and_takes_its_surest_from_all_rows(spark, monkeypatch):
    """Rows of one id with several texts, repeated rows, nulls; the pseudo-labels equal those picked from all rows at once."""
    monkeypatch.setattr(cotraining, "PASSED_ON", 9)
    bad, good = "click here to buy cheap now " * 5, "The long report says what was found there. " * 5
    rows = []
    for k in range(240):
        rows.append((k, (bad if k % 3 == 0 else good) + f"{k} words", "web" if k % 3 == 0 else "book", "en"))
        if k % 4 == 0:
            rows += [(k, f"another text {j} of number {k}", "web", None) for j in range(3)] + rows[-1:]
    rows += [(300, None, None, None), (300, "", None, None), (None, good, "book", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    asked = []
    real = cotraining._surest
    monkeypatch.setattr(cotraining, "_surest", lambda *a: asked.append((a[2], a[3], real(*a))) or asked[-1][2])
    models = []
    for parts in (1, 5, 13):
        spread = docs.repartition(parts, F.rand(parts))
        models.append(cotraining.fit(spread, labels))
    assert all(np.array_equal(m.content, models[0].content) and np.array_equal(m.meta, models[0].meta) and m.joint == models[0].joint for m in models)
    assert len(asked) == 3 * cotraining.ROUNDS
    free = sorted({r for r in rows if r[0] is not None and r[0] >= 60}, key=str)
    content, meta = cotraining.content_features([r[1] for r in free]), cotraining.meta_features([r[1] for r in free], [r[2] for r in free], [r[3] for r in free])
    for fitted, most, given in asked:
        for mine, other in ((0, 1), (1, 0)):
            w, (a, b) = fitted[other]
            p = cotraining.sigmoid(a * (content, meta)[other].dot(w) + b)
            got = given[mine][1]
            assert (got == 1).sum() == min(most, (p >= cotraining.SURE).sum()) and (got == 0).sum() == min(most, (1 - p >= cotraining.SURE).sum())
            assert given[mine][0].n == len(got)


def test_views_teach_each_other():
    r = np.random.default_rng(4)
    n = 600
    y = r.integers(0, 2, n)
    view = lambda noise: (y * 2 - 1) + r.normal(0, noise, n)

    def sparse(x):
        return cotraining.Sparse(n, np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.concatenate([x, np.ones(n)]))

    label = np.where(np.arange(n) < 60, y, -1)
    model = cotraining.co_train(sparse(view(0.5)), sparse(view(0.7)), label)
    assert ((model.scores(sparse(view(0.5)), sparse(view(0.7)))[2] >= 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("tag", ["math", "svg", "object", "canvas", "audio", "video", "template", "datalist"])
def test_contents_of_elements_that_hold_no_raw_text_are_read(tag):
    whole = read_blocks(f"<article><p>one <{tag}>two</{tag}> three</p><p>four</p></article>")
    assert [b.text for b in whole] == ["one two three", "four"]
    unclosed = read_blocks(f"<article><p>one</p><{tag}><p>two</p><p>three</p></article><p>four</p>")
    assert [b.text for b in unclosed] == ["one", "two", "three", "four"]
    assert tag in unclosed[1].path and tag not in unclosed[3].path
    nested = read_blocks(f"<p>a</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>b</p>")
    assert " ".join(b.text for b in nested) == "a xyz b" and tag not in nested[-1].path
    assert read_blocks("<p>a</p><script>var x = '<p>'</script><p>b</p>")[1].text == "b"


def test_blocks_of_untidy_pages():
    html = """<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> -->
    <p>One <b>t</b>wo<br>three &amp; f&eacute;<p>four</i> five<ul><li>a<li>b</ul><script>var x = "</p>";</script>
    <div hidden>six</div><p title="a > b">seven</p><textarea>no</textarea> eight < nine"""
    blocks = read_blocks(html)
    assert [b.text for b in blocks] == ["One two", "three & fé", "four five", "a", "b", "six", "seven", "eight < nine"]
    assert ".!hidden" in blocks[5].path and ".li" in blocks[3].path and "ul" in blocks[4].path
    assert read_blocks(None) == read_blocks("") == read_blocks(" \n") == []


@pytest.fixture(scope="module")
def labeller():
    rows = duckdb.sql(f"select html from '{SF}/pages.parquet' order by page_id").fetchall()
    return html_extract.train([r[0] for r in rows[:150]], made=1000, epochs=6), [r[0] for r in rows]


def test_held_out_layouts(labeller):
    model, htmls = labeller
    maker = PageMaker([b.text for h in htmls[150:] for b in read_blocks(h)], 99)
    pages = [html_extract._made(maker) for _ in range(150)]
    want = np.array([x for _, labels in pages for x in labels])
    got = model.probability(html_extract.features([p for p, _ in pages])) >= 0.5
    assert (got == want).mean() > 0.98


def test_articles_of_held_out_pages(labeller, spark):
    model, htmls = labeller
    right = 0
    for html, text in zip(htmls[150:], html_extract.main_texts(htmls[150:], model), strict=True):
        inside = html[html.index("<article>") : html.index("</article>") + 10]
        right += text == " ".join(b.text for b in read_blocks(inside))
    assert right >= 0.97 * len(htmls[150:])
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (3, "u", "<nav><a>Home</a></nav>", 5), (4, "u", htmls[0], 5)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    assert [rows[k].text for k in (1, 2, 3)] == ["", "", ""] and rows[4].n_chars == len(rows[4].text) > 0


def test_gradient_of_the_labeller():
    maker = PageMaker(["some words that stand in a line here", "and a few other ones for the pages"], 5)
    pages = [html_extract._made(maker) for _ in range(3)]
    x = html_extract.features([p for p, _ in pages])
    y = np.array([v for _, labels in pages for v in labels], np.float32)
    model = html_extract.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    w = np.ones(len(y))

    def loss():
        p = np.clip(model.probability(x), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = model.gradient(x, y, w)
    for name in ("fx", "fh", "bx", "bh", "out", "path", "word"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        keep = model.w[name][at]
        model.w[name][at] = keep + 1e-2
        up = loss()
        model.w[name][at] = keep - 1e-2
        down = loss()
        model.w[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-5), name


def test_a_slash_does_not_close_a_script():
    html = "<p>one</p><script src='a.js'/>var x = 1;</script><style />p {}</style><p>two</p><svg><style/><text>in</text></svg>"
    assert [b.text for b in read_blocks(html)] == ["one", "two", "in"]


def test_blocks_equal_a_plain_reader():
    draw = random.Random(1)
    names = "div p li ul td tr table b i a span svg math h1 script style br img option select body head dt dd dl template label".split()
    held = ["", " class=x", " class='menu bar'", " hidden", "/", " /", ' x="a>b"', " y='", ' z="']
    pieces = ["text ", "&amp;", "&#65;", "<", ">", '"', "'", "</", "<!", "<!--", "-->", "<![CDATA[", "]]>", "<?x>", "\n", "/>", "<a"]
    for _ in range(4000):
        parts = []
        for _ in range(draw.randrange(1, 30)):
            kind, close = draw.random(), draw.choice([">"] * 9 + [""])
            if kind < 0.7:
                parts.append(f"<{draw.choice(names)}{draw.choice(held)}{close}" if kind < 0.4 else f"</{draw.choice(names)}{close}")
            else:
                parts.append(draw.choice(pieces) if kind < 0.85 else draw.choice(["one two ", "x"]))
        html = "".join(parts)
        assert read_blocks(html) == plain_blocks.read_blocks(html), html


def test_pages_of_a_million_characters_take_linear_time():
    for unit in ("<div>", "<div>x", '<a href="', "<a '\"", "</b>", "<b><div></b>", "<a", '<a "" ', "</script ", "<script>", "&", "<!--", "<p>x", "<b>", "<", "<!"):
        for last in ("", "'>"):
            begin = time.process_time()
            read_blocks(unit * (1_000_000 // len(unit)) + last)
            assert time.process_time() - begin < 8, unit  # one or two seconds; quadratic work would be minutes
    begin = time.process_time()
    read_blocks("<b>" * 150_000 + "<div>x</div>" * 50_000)
    assert time.process_time() - begin < 8


def test_numbers_too_long_for_a_character():
    assert [b.text for b in read_blocks("a &#" + "9" * 5000 + "; b &#" + "0" * 5000 + "65;")] == ["a \ufffd b A"]


def test_empty_tables_and_columns_of_any_name(spark, languages, labeller):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages.limit(0), labeller[0])
    assert got.count() == 0 and html_extract.extract(pages, labeller[0]).columns == got.columns
    assert html_extract.digest(pages.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 0.5, "y")], "doc_id long, text string, lang string, score double, spans string")
    assert language_id.identify(docs.limit(0), languages).count() == 0 and language_id.identify(docs, languages).count() == 1
    assert language_id.digest(docs.limit(0)).count() == 0
