"""Cases in which a simpler operator gives another result than its contract."""

import random

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import decontaminate, embedding_dedup, language_id, main_text, pieces, queries, simhash, shingle_dedup, substring_dedup, suffix_dedup, token_counts, toxicity  # noqa: E402
from panelforge.llm.queries import tokenizer_path  # noqa: E402

DIR = "/root/testdata/sf0.001"
#: Extra columns named like columns that operators use inside.
CLASH = ", b string, s int, kind int, key string, vid int, copies int, list string, probes int, row string, y int, fold int, url2 string"
FILL = ("x", 1, 2, "k", 3, 4, "l", 5, "r", 6, 7, "u")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *FILL) for i, t in rows], "doc_id long, text string" + CLASH)


def test_words_that_defeat_polynomial_hashes_are_told_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(12)) + " "
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs(spark, [(1, head + word), (2, head + other), (3, head + word)])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_repeats_up_a_tree_of_groups(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(40))
    rows = [(i, f"{'q%d ' % i * rng.randint(0, 20)}{passage} {'r%d ' % i * rng.randint(0, 20)}") for i in range(300)] + [(None, passage), (None, "z " + passage), (5, passage + " e")]
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs(spark, rows), fan=2).where("doc_id > 5").collect()}
    assert set(words.values()) == {40} and len(words) == 294
    cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs(spark, rows), fan=2).where("doc_id > 5").collect()}
    assert min(cut.values()) >= len(passage) and len(cut) == 294
    first = suffix_dedup.remove_repeats(docs(spark, rows), fan=2).where("doc_id = 0").first()
    assert first["n_removed"] <= max(0, len(rows[0][1]) - len(passage))


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[1_000_000:1_000_500] + "y")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: (len(long), 0), 2: (502, 500)}
    assert {r["doc_id"]: r["n_tokens"] > 10**5 for r in token_counts.token_counts(docs(spark, rows), tokenizer_path("word_bpe_49k.json")).collect()} == {1: True, 2: False}


def test_links_through_rows_without_an_id(spark):
    fps = np.array([0, 0b111, 0b111111, 1 << 60], np.uint64)
    edges = simhash.link_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    assert {tuple(sorted((r["u"], r["v"]))) for r in edges.collect()} >= {(0, 0b111)}
    text = [" ".join(f"t{i}" for i in range(n)) for n in (400, 401, 402)]
    rows = [(1, text[0]), (None, text[1]), (3, text[2]), (None, "apart from all of these")]
    own = [simhash.fingerprint(t) for _, t in rows]
    near = lambda x, y: (own[x] ^ own[y]).bit_count() <= 3
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    reach = near(0, 1) and near(1, 2) or near(0, 2)
    assert got[f"{own[0]:016x}"] == 1 and got[f"{own[2]:016x}"] == (1 if reach else 3) and got[f"{own[3]:016x}"] is None


def test_blocks_of_tiles_lose_no_link(spark):
    from panelforge.llm.components import components

    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = np.array(sorted(fps), np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, np.arange(len(fps))
    for _ in range(40):
        label = np.where(near, label[None, :], 10**9).min(axis=1)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for block in (10, 1 << 15):
        got = {r[0]: r[1] for r in components(simhash.link_edges(frame, 3, block)).collect()}
        groups: dict[int, set] = {}
        for x, y in zip(fps.view(np.int64).tolist(), label.tolist()):
            groups.setdefault(y, set()).add(x)
        assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_fingerprint_by_definition():
    import re

    from xxhash import xxh64_intdigest

    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("aAbB é\t\n Z") for _ in range(rng.randint(0, 60)))
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_in_blocks(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    whole = {(r["doc_id"], r["component_id"]) for r in shingle_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert whole == {(r["doc_id"], r["component_id"]) for r in shingle_dedup.near_duplicates(docs(spark, rows), block=1).collect()}


def test_vectors_with_ties_and_clashing_names(spark):
    c = 0.93
    rows = [(1, [1.0, 0.0], 1), (2, [c, float(np.sqrt(1 - c * c))], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (None, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, *FILL) for r in rows], "vec_id long, embedding array<double>, label int" + CLASH)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame, lists=2).collect()}
    x = np.array(rows[1][1]) / np.linalg.norm(rows[1][1])
    linked = float(x[0]) >= c
    assert got[1] == (3 if linked else 2, 1) and got[3] == got[1][:1] + (1,) and got[4] == (0, 4) and got[2] == ((3, 1) if linked else (0, 2)) and got[None][0] == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    want = db.sql(queries.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_counts_of_characters_of_every_plane():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    odd = [0x1C, 0x1F, 0x85, 0xA0, 0x2028, 0xA7CB, 0xA7DC, 0x88F, 0x18DC5, 0x1DFCD, 0x130, 0x1E9E, 0x3A3]
    lines = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'{chr(c)}" for c in [*range(0x700), *range(0x700, 0x2FA20, 37), *odd] if not 0xD800 <= c < 0xE000]
    assert [own.count(x) for x in lines] == [len(e.ids) for e in library.encode_batch(lines, add_special_tokens=False)]


def test_prefix_counts_beyond_latin():
    own = token_counts.counter(tokenizer_path("word_bpe_49k.json"))
    line = own.normal("привет мир ½ ε'll 中文 12")
    assert own.prefix_counts(line) == [own.count(line[:i]) for i in range(len(line) + 1)]


def test_signs_without_letters_have_no_language(spark):
    filters = language_id.train(spark.read.parquet(f"{DIR}/documents.parquet"))
    rows = [(1, "½ ½"), (2, "²³"), (3, "Ⅷ"), (4, "①②"), (5, "_ 12 _"), (6, "été"), (6, "été"), (None, "the one")]
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs(spark, rows), filters).collect()]
    assert {l for i, l in got if i and i < 6} == {"und"} and "und" not in {l for i, l in got if i in (6, None)}


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(2)
    rows = []
    for k in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows += [(100 * k + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)), f"l{k:02}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(frame, language_id.train(frame)).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert got > 0.9


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(8)
    plain = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30))
    rows = [(i, plain() if i % 3 else f"{plain()} vile rotten {plain()}") for i in range(200)]
    rows += [(3, rows[3][1]), (None, "vile rotten"), (501, None), (502, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), *FILL) for i in range(200)] + [(6, 0, *FILL), (7, None, *FILL), (None, 1, *FILL)], "doc_id long, toxic int" + CLASH)
    scorer = toxicity.train(docs(spark, rows), labels)
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.score(docs(spark, rows), scorer).collect()}
    assert {(i, int(i % 3 == 0)) for i in range(200)} | {(None, 1), (501, 0), (502, 0)} == got
    empty = toxicity.train(docs(spark, rows).where("false"), labels)
    assert toxicity.score(docs(spark, rows).where("false"), empty).count() == 0


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "no"), (2, "to be"), (2, "to be")], "item_id long, text string")
    rows = [(1, "I know nothing"), (2, "No."), (3, "to be, or"), (4, "to bend"), (None, "no"), (5, "")]
    got = sorted(((r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted([(2, 1, 0, 2), (3, 2, 0, 5), (3, 2, 0, 5), (None, 1, 0, 2)], key=str)


def test_leaks_equal_brute_force(spark):
    """Every stretch of a document against every item, by edit distance over all of it."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [prose(rng.randint(15, 30)) for _ in range(6)]

    def edited(text, k):
        text = list(text)
        for _ in range(k):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
        return "".join(text)

    rows = [(i, f"{prose(rng.randint(0, 20))} {edited(rng.choice(items), rng.randint(0, 14))} {prose(rng.randint(0, 20))}") for i in range(60)]
    want = set()
    for i, text in rows:
        line = decontaminate.normalise(text)
        for k, item in enumerate(items):
            column = list(range(len(item) + 1))
            least = column[-1]
            for c in line:
                new = [0]
                for j, x in enumerate(item, 1):
                    new.append(min(column[j - 1] + (x != c), column[j] + 1, new[j - 1] + 1))
                column, least = new, min(least, new[-1])
            if least <= int(len(item) * decontaminate.RATE):
                want.add((i, k, least))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == want and want


def test_unigram_paths_equal_brute_force():
    own = pieces.transducer(tokenizer_path("piece_bpe_32k.model"), "unigram")
    rng = random.Random(4)

    def least(text):
        if not text:
            return 0.0
        return min((own.weight[own.inner[text[:k]]] if text[:k] in own.inner else own.worst) + least(text[k:]) for k in range(1, len(text) + 1) if text[:k] in own.inner or k == 1 and text[0] not in own.single)

    for _ in range(60):
        text = "".join(rng.choice("▁athenrsé中") for _ in range(rng.randint(1, 9)))
        weight, steps = own.shortest_path(text)
        assert weight == pytest.approx(least(text)) and "".join(s for _, s in steps) == text


STORY = "The old story begins here, and it goes on for a good while. There is more of it, told in plain words, line after line."


@pytest.mark.parametrize("odd", ["<iframe src=x>", "<object data=y>", "<math>", "<textarea>", "<p data-x=don't>", "</ ", "<noscript>", "<svg>", "<title>", "<video>", "<!-->", "<template>", "<iframe></iframe><iframe>"])
def test_odd_elements_keep_the_rest_of_the_page(odd):
    page = f"<article><h1>Title</h1><p>Before it, some words of the story.</p>{odd}<p>{STORY}</p><p>And an end of the story that is told.</p></article>"
    got = main_text.extract(page, main_text.fitted())
    assert STORY in got and "And an end of the story that is told." in got


def test_text_of_math_and_of_objects(spark):
    page = f"<article><h1>Sums</h1><p>{STORY} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>words in place</object> of it.</p></article>"
    frame = spark.createDataFrame([(1, "u", page, *FILL), (1, "u", page, *FILL), (None, None, page * 40, *FILL)], "page_id long, url string, html string" + CLASH)
    got = [r["text"] for r in main_text.main_texts(frame).collect()]
    assert got[0] == got[1] == f"Sums\n{STORY} x=2 and words in place of it." and got[2].count("Sums") == 40


def test_pipeline_rows_without_and_with_repeated_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    rng = random.Random(6)
    text = lambda k: " ".join(f"{k}{rng.randint(0, 500)}" for _ in range(60))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(900_001, a), (900_001, b), (None, c), (None, c), (900_002, a), (900_003, None), (900_004, "")]
    extra = base.limit(1).select(*[x for x in base.columns if x not in ("doc_id", "text")])
    frame = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(extra).select(*base.columns)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, frame, DIR).collect()), key=str)
    assert kept == sorted([(900_001, a), (900_001, b), (None, c), (900_003, None)], key=str)
    cut = corpus_pipeline.cut_repeats(spark, frame, DIR)
    assert cut.columns == base.columns and cut.count() == len(rows)
    assert {(r["doc_id"], r["text"]) for r in cut.where("doc_id = 900002 or doc_id is null").collect()} == {(900_002, ""), (None, c)}
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    leaky = spark.createDataFrame([(None, item), (5, item), (5, a)], "doc_id long, text string").crossJoin(extra).select(*base.columns)
    assert [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, leaky, DIR).collect()] == [(5, a)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.where("false"), DIR).count() == 0


def test_recall_of_probes_at_the_threshold(spark):
    """Partners at a cosine just above the threshold, among vectors of no preferred direction."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = rng.normal(size=(400, 48))
    d -= (d * x[:400]).sum(1)[:, None] * x[:400]
    d /= np.linalg.norm(d, axis=1)[:, None]
    c = 0.932
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, c * x[:400] + np.sqrt(1 - c * c) * d)))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lists=60).collect()}
    assert sum(got[i] > 0 for i in range(400)) >= 0.99 * 400 and sum(got[i] > 0 for i in range(1500, 1900)) >= 0.99 * 400
    assert not any(got[i] for i in range(400, 1500))
