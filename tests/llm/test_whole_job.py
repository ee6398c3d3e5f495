"""Inputs on which an operator once did less than the whole job."""

import random

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import main_text, shingle_dedup  # noqa: E402

DIR = "/root/testdata/sf0.001"


def _jaccard_labels(rows, k=5, least=0.8):
    """The smallest id reachable by links between sets of word shingles, by brute force."""
    ids, sets = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        ids.append(i)
        sets.append({b" ".join(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set())
    near = np.array([[a == b or len(a & b) >= least * len(a | b) for b in sets] for a in sets])
    label = np.array(ids)
    for _ in range(len(ids)):
        new = np.where(near, label[None, :], 10**9).min(axis=1)
        if (new == label).all():
            break
        label = new
    return dict(zip(ids, label.tolist()))


def test_near_copies_by_five_word_jaccard(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(8):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()}
    assert got == _jaccard_labels(rows)
    assert shingle_dedup.near_duplicates(docs.where("false")).count() == 0


def test_pipeline_drops_near_copies_of_similarity_08(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = _jaccard_labels([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()}
    assert got == {i for i, x in want.items() if i == x} and not got & {145, 177}


@pytest.mark.parametrize("odd", ["</>", "</ p>", "</3 you>", '<p class="a"">', "<p class='a''>", '<p class="a" ">', '<p title="never closed>'])
def test_malformed_markup_keeps_the_rest_of_the_page(odd):
    tail = "The rest of the story goes on for a while here, with words enough."
    page = f"<article><h1>Title</h1><p>Before it, some words of the story.</p>{odd}<p>{tail}</p><p>And an end of the story that is told.</p></article>"
    for p in (page, page.replace("<p>And", "<p class=b>And")):
        texts = ["".join(i for i in x.items if isinstance(i, str)) for x in main_text.parse(p)]
        assert tail in texts and "And an end of the story that is told." in texts
    if "never" not in odd:  # a later quote must not swallow what lies between
        assert tail in [t for x in main_text.parse(page.replace("<p>And", '<p class="b">And')) for t in x.items if isinstance(t, str)]


def test_text_directly_in_the_body_is_a_block():
    trees = main_text.fitted()
    story = "The old story begins here, and it goes on for a good while. There is more of it, told in plain words, line after line."
    more = "Then a second part follows, as long as the first one was. It has words enough to be read, and it ends in the way that stories do."
    assert main_text.extract(f"{story}<br><br>{more}", trees) == f"{story} {more}"
    assert main_text.extract(f"<html><body>{story}<br>{more} <b>Bold</b> end.</body></html>", trees) == f"{story} {more} Bold end."
    page = f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="content"><h1>Title</h1><p>{story}</p></div></div>{more}<footer>&copy; me</footer>'
    got = main_text.extract(page, trees)
    assert story in got and more in got and "Home" not in got and "me" not in got.split()


SHAPES = ["<div>", "<div class=entry-content>", "<article>", "<div class='entry-content no-sidebar'>", "<article class='post category-news tag-menu'>", "<div class='ad-free layout'>", "<div id=widget-content>", "<main id=page-menu-open>", "<div class=social-story>", "<form>", "<form id=aspnetForm>", "<section class='share comment-count-3'>", "<div class='header-image sidebar-left'>"]


@pytest.mark.parametrize("shape", SHAPES)
def test_names_do_not_decide_over_an_article(shape):
    rng = random.Random(len(shape))
    words = "the old mill stood by a river that no one had named and people of the village went there in summer to swim".split()
    one, two = (" ".join(rng.choice(words) for _ in range(160))[:700].strip() for _ in range(2))
    inner = f"{shape}<h1>A title of it</h1><p>{one}</p><p>{two}</p></{shape[1:].split()[0].rstrip('>')}>"
    trees = main_text.fitted()
    for page in (inner, f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{inner}<footer>&copy; 2020 All rights</footer></body></html>"):
        got = main_text.extract(page, trees)
        assert one in got and two in got and "Home" not in got and "rights" not in got
        assert "form" in shape or "A title of it" in got  # a title in a form around the whole page may be taken for its label


def test_readers_comments_without_a_telling_section_go():
    words = "I was there last year and it was cold but we swam all the same".split()
    rng = random.Random(2)
    note = lambda n: " ".join(rng.choice(words) for _ in range(n))
    page = f"<article><h1>Title</h1><p>{note(150)}</p><p>{note(120)} the end.</p></article><section class='discussion'><div class=comment>{note(40)} zebra</div><div class=comment>{note(30)} zebra</div></section>"
    got = main_text.extract(page, main_text.fitted())
    assert got.endswith("the end.") and "zebra" not in got


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    n = 20_000
    assert len(main_text.parse("<div>" * n + "<p>x" * 50)) == n + 51
    main_text.parse("<div>" * n + "</p></section></table>" * n)
    main_text.parse("<p>a<b>" * n)
    assert time.time() - began < 5


def test_pipeline_stages_keep_columns_named_like_their_own(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", "doc_id * 3 as _row_key", "'mine' as _kept_text", "lang as _row_check")
    plain = docs.drop("_row_key", "_kept_text", "_row_check")
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats, corpus_pipeline.drop_leaks):
        got, want = stage(spark, docs, DIR), stage(spark, plain, DIR)
        assert got.columns == docs.columns
        rows = {r["doc_id"]: r for r in got.collect()}
        assert {i: r["text"] for i, r in rows.items()} == {r["doc_id"]: r["text"] for r in want.collect()}
        assert all(r["_row_key"] == 3 * i and r["_kept_text"] == "mine" and r["_row_check"] == r["lang"] for i, r in rows.items())
