"""The ten operators and the pipeline against brute force, library results and held-out rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import components, decontaminate, embedding_dedup, language_id, main_text, pieces, simhash, substring_dedup, suffix_dedup, token_counts, toxicity  # noqa: E402
from panelforge.llm.queries import tokenizer_path  # noqa: E402
from panelforge.llm.suffix_array import permuted_lcp, suffix_array  # noqa: E402

DIR = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
EXTRA = ", b string, s int, kind int, fp long, rep long, component_id long, kept string, n_removed long"


def frame(spark, rows, extra=True):
    return spark.createDataFrame([(i, t, *(("x", 1, 2, 3, 4, 5, "y", 6) if extra else ())) for i, t in rows], "doc_id long, text string" + (EXTRA if extra else ""))


def odd_rows(seed=0):
    rng = random.Random(seed)
    vocabulary = ["ab", "c", "dé", "élan", "foo", "Bar", "x" * 40]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(None, passage), (5, None), (6, ""), (7, "  \t\n "), (8, "word"), (9, passage), (10, passage), (10, passage), (11, "a" * 500), (12, "pre " + passage + " post"), (13, "a" * 300)]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) + (" " + passage[rng.randint(0, 50) :] if rng.random() < 0.4 else "")) for i in range(20, 60)]
    rows.append((99, (passage + "\n") * 200))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in range(60):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 90)).astype(np.uint16)
        t = np.tile(t, 3) if k % 3 == 0 else t
        raw = t.tolist()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        sa = suffix_array(t)
        assert sa.tolist() == want
        lcp = permuted_lcp(t.astype(np.uint8), sa)
        for x, y in zip(want, want[1:]):
            n = 0
            while max(x, y) + n < len(raw) and raw[x + n] == raw[y + n]:
                n += 1
            assert lcp[y] == n


def test_suffix_dedup(spark):
    rows = odd_rows()
    seen, want = set(), []
    for i, text in ordered(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            piece = raw[a : a + 100]
            if piece in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_dedup(spark):
    rows = odd_rows(1)
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    first = {}
    for i, text in rows:
        words = split(text)
        for a in range(len(words) - 12):
            key, rank = tuple(words[a : a + 13]), math.inf if i is None else i
            first[key] = min(first.get(key, rank), rank)
    want = []
    for i, text in rows:
        words = split(text)
        gone = [False] * len(words)
        for a in range(len(words) - 12):
            if first[tuple(words[a : a + 13])] < (math.inf if i is None else i):
                gone[a : a + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_links(spark):
    rows = [r for r in odd_rows(2) if r[0] is not None] + [(70, "ab c " * 30 + "end"), (71, "ab c " * 30 + "End.")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    ids = [i for i, _ in rows]
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array(ids)
    for _ in range(len(ids)):
        label = np.where(near, label[None, :], 10**9).min(axis=1)
    assert {i: got[i]["component_id"] for i in ids} == {i: int(x) for i, x in zip(ids, label)}
    assert got[5]["fingerprint"] == got[6]["fingerprint"] == got[7]["fingerprint"] == "0" * 16


def test_simhash_tiles_lose_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.concatenate([base ^ np.uint64(1 << k) for k in range(0, 60, 7)] + [base])
    found = {(i, j) for a, b in simhash.links(fps, fps) for i, j in zip(a.tolist(), b.tolist())}
    want = {tuple(x) for x in np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3).tolist()}
    assert found == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == got[90] == 90
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(size=8) * 0.15 * (i % 3)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 0), (204, rows[0][1], None), (205, [1.0, 2.0], 0), (206, [None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, lists=20, block=16).collect()}
    ok = [r for r in rows if r[0] < 201]
    x = np.array([r[1] for r in ok], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    lab = np.array([r[2] for r in ok])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    label = np.array([r[0] for r in ok])
    for _ in range(50):
        label = np.where(link, label[None, :], 10**9).min(axis=1)
    for k, r in enumerate(ok):
        assert got[r[0]]["n_links"] == link[k].sum() - 1
        assert got[r[0]]["component_id"] == label[k]
    for i in range(201, 207):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]


def texts(seed=4):
    rng = random.Random(seed)
    signs = "aabcdeeε éÉßΣσςñ  \t\n'’sSréll.,!?123½中文😀\u0085▁<|endoftext|>"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "it's they'll", "a" * 3000, "<|endoftext|>hi"]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = list(enumerate(texts())) + [(None, "one two"), (999, None)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, rows), tokenizer_path("word_bpe_49k.json"), limit=20).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (n, n > 20, len((t or "").encode()))


def test_prefix_counts():
    own = token_counts.counter(tokenizer_path("word_bpe_49k.json"))
    line = "the quick brownish fox, 12 unbelievable élan"
    counts = own.prefix_counts(line)
    assert counts == [own.count(line[:i]) for i in range(len(line) + 1)]
    assert own.count(line[: own.truncate(line, 7)]) <= 7 < own.count(line[: own.truncate(line, 7) + 1])


def test_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = list(enumerate(texts(5))) + [(None, "one two"), (999, None)]
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(frame(spark, rows), path)
    got = {r["doc_id"]: r for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, path).collect()}
    for i, t in rows:
        assert got[i]["ids"] == library.encode(t or "") and got[i]["round_trip"]
        assert back[i] == (t or "").replace("▁", " ")


def test_unigram_shortest_path():
    own = pieces.transducer(tokenizer_path("piece_bpe_32k.model"), "unigram")
    ids = own.lattice_path("▁hello")
    assert own.decode(np.array(ids)) == "hello"


def test_decontamination(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = prose(40)
    edited = item[:50] + "#" + item[51:120] + "zz" + item[120:]
    rows = [(1, prose(50) + " " + item.upper() + ". " + prose(50)), (2, prose(20) + edited + prose(20)), (3, prose(300)), (4, None), (5, ""), (6, item[: len(item) // 2]), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7] == 0 and 0 < got[2, 7] <= 4
    assert decontaminate.find_leaks(frame(spark, rows), bench.where("false")).count() == 0


def test_banded_alignment_is_edit_distance():
    rng = random.Random(2)
    for _ in range(40):
        a = [rng.randint(0, 3) for _ in range(20)]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = 9
        text = [5] * 7 + b + [6] * 7
        got = decontaminate.banded(np.array(a, np.uint32), np.array(text, np.uint32), 7, 6, 20)
        best = list(range(len(a) + 1))
        least = best[-1]
        column = best
        for c in text:  # semi-global: a match may begin anywhere
            new = [0]
            for i, x in enumerate(a, 1):
                new.append(min(column[i - 1] + (x != c), column[i] + 1, new[i - 1] + 1))
            column = new
            least = min(least, column[-1])
        assert got is not None and got[0] == least


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    filters = language_id.train(docs)
    got = language_id.predict(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "x")]), filters).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] in filters.names
    nothing = language_id.train(docs.where("false"))
    assert language_id.predict(docs.limit(3), nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    got = toxicity.score(docs, scorer).join(labels, "doc_id").where("held_out and toxic is not null")
    row = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.sum(F.expr("int(toxic = 1 and predicted = 1)")), F.sum("toxic")).first()
    assert row[0] > 0.97 and row[1] >= 0.85 * row[2]
    odd = toxicity.score(frame(spark, [(1, None), (2, "")]), scorer).collect()
    assert all(0 <= r["score"] < 0.5 for r in odd)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs.limit(5), none).where("predicted = 1").count() == 0


def test_segments_are_maximal():
    rng = random.Random(3)
    for _ in range(100):
        s = np.array([rng.choice([0.0, 0.0, 0.0, 1.0, 2.5]) for _ in range(30)])
        found = toxicity.segments(s, 0.7)
        value = np.where(s > 0, s, -0.7)
        best = max((value[a : z + 1].sum() for a in range(30) for z in range(a, 30)), default=0)
        if s.max() > 0:
            assert max(x for _, _, x in found) == pytest.approx(best)
        for a, z, x in found:
            assert value[a : z + 1].sum() == pytest.approx(x)


def test_main_text(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First  block of\n the story, with <b>bold</b> words and more of it.<p>Second block&#33; It goes on for a while here.</article><section id="comments"><div class="comment"><p>nice one</p></div></section><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, None, "<!-- open")]
    got = {r["page_id"]: r for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nFirst block of the story, with bold words and more of it.\nSecond block! It goes on for a while here."
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (2, 3, 4, 5))


def test_main_text_held_out_nodes():
    rng, trees, right, total = random.Random(99), main_text.fitted(), 0, 0
    for _ in range(60):
        page, _ = main_text.compose(rng)
        nodes = main_text.parse(page)
        kept = main_text.decode(nodes, trees.odds([nodes]))[1:]
        truth = [x == "1" for x in re.findall(r'data-own="(\d)"', page)]
        right += sum(a == b for a, b in zip(kept, truth))
        total += len(truth)
    assert right / total > 0.98


def test_pages_of_the_table(spark):
    import html as entities

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text.main_texts(pages).collect()}
    for r in pages.collect():
        a = r["html"].find("<article>")
        z = r["html"].find("</article>", a)
        body = "" if a < 0 else re.sub(r"<[^>]*$", "", r["html"][a + 9 : z if z >= 0 else None])
        blocks = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", lambda m: " " if "r" in m[0] else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert main_text.main_texts(spark.read.parquet(f"{DIR}/pages.parquet").where("false")).count() == 0
    assert embedding_dedup.near_duplicates(spark.read.parquet(f"{DIR}/embeddings.parquet").where("false")).count() == 0


def test_pipeline(spark):
    """Each stage's decision, by brute force on its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.train(docs, labels)
    rows = {i: t for i, t in rows.items() if scorer.score(t) < 0.5}
    ids = sorted(rows)
    fps = np.array([simhash.fingerprint(rows[i], 5) for i in ids], np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, np.array(ids)
    sets = []
    for i in ids:
        w = (rows[i] or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({b" ".join(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set())
    near |= np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    for _ in range(20):
        label = np.where(near, label[None, :], 10**9).min(axis=1)
    ids = [i for i, x in zip(ids, label.tolist()) if i == x]
    seen, cut = set(), {}
    for i in ids:
        raw = rows[i].encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            piece = raw[a : a + 100]
            if piece in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(piece)
        cut[i] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else rows[i]
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {i: t for i, t in cut.items() if not any(x in decontaminate.normalise(t) for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == {i: library.encode(t) for i, t in clean.items()}
