"""Tokenising, packing, formatting, extraction, language and toxicity: exact round trips, public libraries, held-out accuracy, odd rows."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import bpe, charlm, chat, html, langid, packing, queries, toxicity

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "héllo wörld"), (4, "héllo wörld"), (None, "key is null"), (5, "a" * 20_000 + " " + "xyz " * 3000), (6, "漢字かな 🎉 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated keys and texts, an empty and a long one, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, key int, ids int, score int")


def tiktoken_of(name):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library():
    import public_tokenizers as P

    codec, own = tiktoken_of(bpe.DEFAULT_RANKS), bpe.codec(P.path(bpe.DEFAULT_RANKS), P.PATTERN)
    rnd = random.Random(3)
    alphabets = ["abcdefghij", "aab", "the andingtion ", "äöüß éèñ", "漢字かな한글 ", "01239 ", "!?.,'st \n\t\r\x0b\x85  ", "🎉👩‍👩‍👧", " ́٠Ⅷ²"]
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(0, 60)))
        ids = own.packed(text)
        assert np.frombuffer(ids, "<u4").tolist() == codec.encode_ordinary(text)
        assert own.unpacked(ids) == text.encode()
        piece = bytes(rnd.randrange(256) for _ in range(20))
        assert own.encode_bytes(piece) == codec._encode_single_piece(piece)


def test_op1(spark, odd):
    codec = tiktoken_of(bpe.DEFAULT_RANKS)
    got = bpe.encode(odd, decode=True).collect()
    assert len(got) == len(ODD)
    for r, (key, text) in zip(got, ODD):
        want = codec.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"]) == (key, len(want))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and bytes(r["decoded"]) == (text or "").encode()
    assert bpe.encode(odd.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, TINY).collect()
    assert len(rows) == len(texts)
    for r in rows:  # every row of the query
        ids = codec.encode_ordinary(texts[r["doc_id"]])
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def library_ids(texts):
    """By the tokenizers file as it is, added tokens included."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.DEFAULT_TOKENIZER))
    return [[*e.ids, packing.END_ID] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_op8_added_tokens():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", " <|endoftext|>\n\n x", "<|ENDOFTEXT|>", "it's\u00a0x<|endoftext|>'s"]
    own = packing.encoder(packing.DEFAULT_TOKENIZER)
    for text, want in zip(texts, library_ids(texts)):
        assert own.ids(text).tolist() == want[:-1], text


def check_pieces(rows, docs, window=2048):
    """Every id of every document once, sequences without gaps, full or a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, ids in docs.items():
        pieces = sorted(by_doc.pop(key), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist() == ids
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        n = sum(r["length"] for r in pieces)
        assert n == window or (n < window and n & (n - 1) == 0)


def test_op8(spark, odd):
    unique = odd.dropDuplicates(["doc_id", "text"])
    rows = unique.select("doc_id", "text").collect()
    check_pieces(packing.pack(unique).collect(), dict(zip([r["doc_id"] for r in rows], library_ids([r["text"] for r in rows]))))
    assert packing.pack(odd.limit(0)).count() == 0
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    packed = packing.pack(docs)
    check_pieces(packed.collect(), dict(zip([r["doc_id"] for r in rows], library_ids([r["text"] for r in rows]))))
    ids = {r["doc_id"]: x for r, x in zip(rows, library_ids([r["text"] for r in rows]))}
    seen = dict.fromkeys(ids, 0)
    for r in queries.op8_packing(spark, TINY).collect():  # every piece of the query, by the library's ids
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["ids_crc32"], r["doc_tokens"], len(piece)) == (packing.crc32_of(piece.tobytes()), len(ids[r["doc_id"]]), r["length"])
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(x) for k, x in ids.items()}


def test_nonnegative_least_squares():
    counts = {500: 10, 1548: 8, 1024: 6, 2: 1}
    combos = packing.combinations_filling(np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)]), 2048)
    assert (500, 1548) in combos and (1024, 1024) in combos and all(sum(c) == 2048 for c in combos)
    x = packing.nonnegative_least_squares(combos, counts, 500, 1e-9)
    use = np.array([[c.count(k) for c in combos] for k in counts], float)
    gradient = use.T @ (use @ x - np.array(list(counts.values())))
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient @ x) < 1e-5  # the conditions of the optimum


def test_chat_round_trip():
    rnd = random.Random(0)
    signs = ["\\", "<turn>", "</turn>", "###", " ", "\n", "a", "n", ":", "é", "<", "/", "#", "turn>"]
    own = r"\### Assistant: </turn> ok"
    for _ in range(500):
        turns = [("".join(rnd.choices(signs, k=rnd.randint(0, 5))), "".join(rnd.choices(signs, k=rnd.randint(0, 12)))) for _ in range(rnd.randint(0, 4))]
        text, spans = chat.render([*turns, ("assistant", own)])
        assert chat.read_back(text) == [*turns, ("assistant", own)]
        got = chat.tokenizer_of(chat.DEFAULT_TOKENIZER).encode(text, add_special_tokens=False)
        mask, covered = chat.loss_mask(np.array(got.offsets).reshape(-1, 2), spans)
        want = "".join(s for r, s in [*turns, ("assistant", own)] if r == "assistant")
        assert chat.unescape("".join(text[a:b] for a, b in covered)) == want and mask.any()


def test_op6(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 2, None, None), (None, 0, "user", "x"), (2, None, "assistant", ""), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyes\n\n\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, hashlib.sha256(b"yes").hexdigest())
    assert got[2]["loss_chars"] == 0 and got[3]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    probe = queries.op6_chat_format(spark, TINY).where("conv_id = -7").first()
    own = r"\### Assistant: </turn> ok"
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert (probe["loss_chars"], probe["loss_sha256"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, really, yes, and more text here.</div><div class="wrap"><div class="sidebar"><p>Side, bar, text, with, commas.</p></div>
<main><h1>Title &amp; more</h1><div class="content"><p>One, two,&nbsp; three<p>Four <i>five</i>, six<script>var x = "</p>";</script>
<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table></div><section class="comments"><p>hello, I, comment, a lot, of, commas</p></section></main></div>
<form><p>name, mail, and so on, please</p></form><footer>foot, note</footer></body></html>"""


def test_op3(spark):
    assert html.main_text(PAGE).split("\n") == ["Title & more", "One, two, three", "Four five, six", "a", "b", "x", "y", "z"]
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a, b</nav>") == ""
    assert html.main_text("<p>just text, here") == "just text, here" and html.main_text("plain") == "plain"
    assert html.main_text("<div>" * 30_000 + "x, y") == "x, y"
    assert html.main_text("<p>1 < 2 && 3 &#x41;&lt;b&gt;</p>") == "1 < 2 && 3 A<b>"
    headed = '<div class="header">Site, name, more</div><article><div class="article-header"><h1>Head</h1></div><p>Text, long, enough.</p><div class="ads">Buy, now</div></article>'
    assert html.main_text(headed) == "Head\nText, long, enough."
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html.extract(df).collect()
    assert [r["text"] for r in got] == [html.main_text(r[2]) for r in rows] and html.extract(df.limit(0)).count() == 0
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{TINY}/pages.parquet").collect()}
    for r in queries.op3_html_text(spark, TINY).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


P = "This is the first paragraph of the story, long enough, with commas, to be one. " * 2
Q = "A second paragraph follows here, which says more, at length, about the same thing. " * 2
p, q = P.strip(), Q.strip()
#: One page template each, and the blocks of its main text.
TEMPLATES = {
    "form": (f'<html><body><form id="aspnetForm"><div class="nav"><a href=1>a</a></div><div id="content"><h1>T</h1><p>{P}</p><p>{Q}</p></div></form></body></html>',["T",p,q]),
    "relwork": (f'<article><h1>T</h1><p>{P}</p><div class="warning">Mind the gap, please.</div><section id="related-work"><h2>Related work</h2><p>{Q}</p></section></article>',["T",p,"Mind the gap, please.","Related work",q]),
    "related links": (f'<article><h1>T</h1><p>{P}</p><p>{Q}</p><div class="related"><h3>Related</h3><ul><li><a href=1>one thing</a><li><a href=2>another</a></ul></div></article><aside><p>{P}</p></aside>',["T",p,q]),
    "comments": (f'<div id="main"><div class="post"><h2>T</h2><p>{P}</p><p>{Q}</p></div><div id="comments">'+f'<div class="comment"><p>I, for one, think, {P}</p></div>'*6+'</div></div>',["T",p,q]),
    "table": (f'<table><tr><td class="menu"><a href=1>x</a><a href=2>y</a></td><td><h1>T</h1><p>{P}<p>{Q}</td></tr></table><div class="footer">Copyright, all rights, me</div>',["T",p,q]),
    "header": (f'<div class="page-header"><h1>Site</h1></div><div class="wrapper has-sidebar"><div class="entry-content"><h1>T</h1><p>{P}</p><p>{Q}</p></div><div class="left-sidebar"><p>{P}</p></div></div>',["T",p,q]),
    "ads": (f'<main><h1>T</h1><p>{P}</p><div class="ad-slot"><p>Buy, buy, buy now, {P}</p></div><p>{Q}</p><form class="newsletter"><p>Sign up, do, now</p><input></form></main>',["T",p,q]),
    "sections": (f'<body><main><header><h1>T</h1></header><section><h2>A</h2><p>{P}</p></section><section id="social-impact"><h2>B</h2><p>{Q}</p></section><footer>by me</footer></main></body>',["T","A",p,"B",q]),
    "plain": (f'<body><p>{P}<p>{Q}</body>',[p,q]),
    "contact": (f'<body><div class="menu"><a href=1>x</a></div><div class="contact"><h1>T</h1><p>{P}</p><p>{Q}</p></div></body>',["T",p,q]),
    "divs": (f'<div class="nav">Home, about</div><div class="story">{P}<br><br>{Q}</div><div class="cookie-notice">We use cookies, and, more.</div>',[p+" "+q]),
    "list": (f'<article><h1>T</h1><p>{P}</p><ul><li>one</li><li>two <a href=x>link</a></li></ul><blockquote>{Q}</blockquote><div class="share">Share, tweet</div></article>',["T",p,"one","two link",q]),
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_op3_templates(name):
    page, want = TEMPLATES[name]
    assert html.main_text(page).split("\n") == want


def test_models_of_runs_and_of_words_agree():
    words = {"ab": 3, "abc": 2, "bca": 1, "cab": 4, "zzz": 1}
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(w for w, n in words.items() for _ in range(n)), "ab, (cab) 12 x1"])], ["text"])
    (found,) = list(toxicity.count_grams(iter([batch])))
    a = charlm.CharLM.of_grams("x", found.column(0).to_pylist(), found.column(1).to_numpy().astype(float))
    b = charlm.CharLM.fit({"x": words | {"ab": 4, "cab": 5}}, 3)
    assert np.allclose(a.score_words(["abca", "zab", "q"]), b.score_words(["abca", "zab", "q"]), atol=1e-5)


def test_samples_are_bounded(spark):
    rows = [("a", i % 40, f"t{i}") for i in range(400)] + [("b", i, f"u{i}") for i in range(500)] + [("c", 7, "same")] * 300
    df = spark.createDataFrame(rows, "lang string, hash bigint, text string")
    got = {r["lang"]: (r["count"], r["kinds"]) for r in langid.bounded_sample(df, "lang", "hash", 100).groupBy("lang").agg(F.count("*").alias("count"), F.countDistinct("hash").alias("kinds")).collect()}
    assert got == {"a": (40, 40), "b": (100, 100), "c": (1, 1)}


def test_op4_odd_rows_of_a_fitted_model(spark):
    """Keys of another type, keys that repeat, null, empty and long texts, with a model that was learned."""
    texts = [f"they saw a {'moron' if i % 3 == 0 else 'cat'} by the {w} {i % 5}" for i, w in enumerate(["river", "house", "long road", "old mill"] * 45)]
    texts = [" ".join(random.Random(i).sample(t.split(), len(t.split()))) for i, t in enumerate(texts)]  # else near copies count once
    rows = [(str(i), t, 0) for i, t in enumerate(texts)] + [("7", None, 0), ("7", "", 0), (None, "a moron", 0), ("x", "word " * 30_000 + "moron", 0), ("7", texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, score int")
    labels = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(len(texts))], "doc_id string, toxic int")
    model = toxicity.fit(df.limit(len(texts)), labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and model.constant is None
    want = [int("moron" in (t or "")) for _, t, _ in rows]
    assert [r["predicted"] for r in got] == want
    ints = toxicity.fit(df.where("doc_id <> 'x'").limit(len(texts)).select(F.col("doc_id").try_cast("int").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("int").alias("doc_id"), "toxic"))
    assert ints.weights == model.weights


def test_kneser_ney_sums_to_one():
    lm = charlm.CharLM.fit({"x": {"ab": 3, "abc": 2, "bca": 1, "cab": 4}}, 3)
    letters = "abc" + chr(charlm.BOUNDARY) + "?"
    for before in ("", "a", "b", "c"):
        # the last letter of a word is the step from the word without it
        scores = [toxicity.trigram_log_p(lm, (chr(charlm.BOUNDARY) + before)[-2:], x) for x in letters]
        assert np.exp(scores).sum() == pytest.approx(1, abs=1e-4)
    whole = lm.score_words(["ab"])[0, 0]
    mark = chr(charlm.BOUNDARY)
    steps = toxicity.trigram_log_p(lm, mark, "a") + toxicity.trigram_log_p(lm, mark + "a", "b") + toxicity.trigram_log_p(lm, "ab", mark)
    assert whole == pytest.approx(steps, abs=1e-4)


def test_op2(spark, odd):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.accepted.mean() > 0.98
    model = langid.fit(odd)
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert (rows[1]["lang_pred"], rows[1]["score"], rows[2]["lang_pred"], rows[3]["lang_pred"]) == ("und", 0.0, "und", "und")
    assert rows[4]["lang_pred"] == "en" and len(rows) == 7
    nothing = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(odd.limit(0), model).count() == 0


def test_op4(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.op4_toxicity(spark, SF).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98 and got[got.toxic == 1].score.mean() > clean.score.mean() + 0.3
    one_sided = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, one_sided).collect()} == {0.0} and toxicity.score(odd.limit(0), one_sided).count() == 0


def test_disguises_are_undone(spark):
    clean = ["the cat sat on a warm mat and slept", "we like long walks by the river", "this is a plain line of words", "good people read good books"]
    rows = [(i, clean[i % 4] + f" {i % 7}", 0) for i in range(120)] + [(1000 + i, f"{clean[i % 4]} you {'moron' if i % 2 else 'idiot'} number {i % 5}", 1) for i in range(60)]
    # different neighbours keep the texts apart
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.lm, model.weights)
    for shown in ("m0r0n", "mor*on", "mooooron", "m.o.r.o.n", "m o r o n", "1d1ot", "MORON!"):
        assert model.score(reader.total(f"you are a {shown} indeed")) >= 0.5, shown
    assert model.score(reader.total("a cat on a mat")) < 0.5 and model.score(reader.total(None)) < 0.5


def test_memos_do_not_change_sums():
    words = ["river", "r1ver", "riverside", "rrriver!!!", "m0r0n$$$", "moron,", "(moron)", "long", "roads", "l-o-n-g", "42", "%%%"]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(300)]
    (found,) = list(toxicity.count_grams(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    lm = charlm.CharLM.of_grams("x", found.column(0).to_pylist(), found.column(1).to_numpy().astype(float))
    weights = {"moron": 2.5, "river": 0.25, "^rive": 0.5, "42": 0.125}
    small, large = toxicity.Reader(lm, weights, limit=1), toxicity.Reader(lm, weights)
    small.decoder.limit = 1
    for t in texts:
        hits = dict(max(map(large.weigh, sorted(large.look(x))), key=lambda f: f[1]) for x in large.tokens(t))
        assert small.total(t) == large.total(t) == large.total(t) == sum(hits.values())


def test_disguises_among_shared_words(spark):
    """At a sentence's end, in quotes, behind a one-letter word: only the disguised word tells, all others are in both labels."""
    clean = ["the cat sat on a warm mat and slept", "we like long walks by the river", "this is a plain line of words", "good people read good books"]
    bad = ["moron", "idiot", "dumb"]
    rows = [(i, clean[i % 4] + f" {i % 7} they saw a cat", 0) for i in range(180)] + [(1000 + i, f"{clean[i % 4]} {i % 7} they saw a {bad[i % 3]}", 1) for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    reader = toxicity.Reader(model.lm, model.weights)
    shown = ("m0r0n", "1d1ot", "1d10t", "m--o--r--o--n", "m o r o n", "m - o - r - o - n", "m 0 r 0 n", "d u m b", "mooooron", "!diot")
    missed = []
    for word in (*shown, "moron"):
        for text in (f"they saw a {word}", f"they saw a {word}.", f"they saw a {word}, we like it", f"they saw a {word}!!!", f'they saw "{word}".', f"they saw ({word})...", f"{word} they saw a cat"):
            if model.score(reader.total(text)) < 0.5:
                missed.append(text)
    assert missed == []
    for word in ("cat", "c4t", "c a t", "2024", "b o o k s", "1,000", "p-l-a-i-n", "(words)"):
        for text in (f"they saw a {word}", f"they saw a {word}!!!", f'they saw "{word}".'):
            assert model.score(reader.total(text)) < 0.5, text
