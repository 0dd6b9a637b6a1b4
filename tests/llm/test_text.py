"""Licences, HTML, packing, toxicity and decontamination."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import decontaminate, html, licenses, packing, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def base_licence(text):
    w = WORD.findall((text or "").translate(UPPER))
    hits = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


LICENCE_TEXTS = [
    None, "", "CC-BY 4.0 cc by cc by", "All Rights Reserved. all rights  reserved", "GNU General\nPublic License; general public licenses", "É cc ÀBY cc\x00by über all rights reserved", "cc " * 5000 + "by", "İ cc by K",
    "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception\nrest", "all rights reserved all rights reserved general public license",
]


def test_licences(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(LICENCE_TEXTS)] + [(1, "", "z")], "doc_id long, text string, labels string")
    got = sorted(licenses.scan(df).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(LICENCE_TEXTS) + 1
    for r in got:
        assert tuple(r)[1:6] == base_licence(LICENCE_TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tag = next(r for r in got if r["doc_id"] == 8)
    assert tag["labels"] == "apache-2.0,gpl-3.0-only,mit" and tag["score"] == 0.95
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_query(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = licenses.op8_license_scan(spark, tiny).collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:6] == base_licence(docs[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("text,want", [("mit", ["mit"]), ("a or b and c", ["a", "b", "c", "and", "or"]), ("(a or b) and c with d", ["a", "b", "or", "c", "d", "with", "and"]), ("a or", ["a"]), ("", []), ("a b", ["a"]), ("((a", ["a"]), (")", [])])
def test_shunting_yard(text, want):
    assert licenses.postfix(text) == want


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div>
<header><h1>Site</h1></header><article><h1>Title &amp; more</h1><p><b>One  two<br><p>Three &quot;four&quot; &am five</p><form>q</form><div class="sidebar">s</div><p>Six <script>x("</p>")</script>seven &lt;p&gt;</article>
<section id="comments"><p>%s</p></section><aside>no</aside><footer>&copy; f</footer>""" % ("I disagree. " * 80)


@pytest.mark.parametrize("page,want", [(PAGE, 'Title & more\n\nOne two\n\nThree "four" &am five\n\nSix seven <p>'), ("", ""), ("plain  words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<body><p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()), ("<div>" * 3000 + "deep", "deep"), ("<article", ""), ("<ul><li>one item here<li>two items here</ul>", "one item here\n\ntwo items here")])
def test_html(page, want):
    assert html.extract(page) == want


def sections(*sizes, tag="section"):
    """The page and its text; paragraphs of 400 characters."""
    texts = [[f"{k}-{i} ".ljust(399, "x") + "." for i in range(n)] for k, n in enumerate(sizes)]
    page = "".join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in own) + f"</{tag}>" for own in texts)
    return f"<body><nav><a href=/>menu</a></nav><div>{page}</div><footer>f</footer></body>", "\n\n".join(p for own in texts for p in own)


@pytest.mark.parametrize("sizes,tag", [((5, 5, 5), "section"), ((8, 3, 3), "section"), ((3, 8, 3), "section"), ((5, 5, 5), "article"), ((8, 3, 3), "article")])
def test_html_keeps_all_parts_of_an_article(sizes, tag):
    page, want = sections(*sizes, tag=tag)
    assert html.extract(page) == want


@pytest.mark.parametrize("tag,name", [("h2", 'id="search-algorithms"'), ("section", 'id="legal-status"'), ("div", 'class="social-history"'), ("section", 'id="related-work"'), ("h2", 'class="section-header"'), ("p", 'class="notice"'), ("div", 'class="chapter section-header"')])
def test_html_names_of_parts_do_not_cut_them(tag, name):
    text = "Words of the part that stay. " * 8
    page = f"<body><article><h1>Title</h1><p>{text}</p><{tag} {name}>{text}</{tag}><p>{text}</p></article></body>"
    assert html.extract(page) == "\n\n".join(["Title", *[text.strip()] * 3])


@pytest.mark.parametrize("name", ['class="ad"', 'class="box sidebar"', 'class="cookie-banner"', 'id="share-buttons"', 'class="related-posts"', 'role="complementary"'])
def test_html_names_of_noise_cut_it(name):
    text = "Words of the part that stay. " * 8
    assert html.extract(f"<body><article><p>{text}</p><div {name}>Buy this.</div></article></body>") == text.strip()
    links = "<a href=/x>more of it</a> " * 5
    assert html.extract(f'<body><article><p>{text}</p><div class="more-related-things">{links}</div></article></body>') == text.strip()


def article(page):
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    out = []
    for part in re.split(r"</?(?:p|h\d|div|article)\b[^>]*>", body):
        import html as entities

        part = " ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "br" in part else "", part)).split())
        if part:
            out.append(part)
    return "\n\n".join(out)


def test_html_query(spark, small):
    got = {r["page_id"]: r for r in html.op3_html_extract(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article(p["html"])
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
    df = spark.createDataFrame([(1, None, None, "z"), (1, None, None, "z")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()] == [("", 0)] * 2
    assert html.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 120_000 + "x", "<b>" * 60_000 + "</i>" * 60_000 + "x", "<table><td>" + "<i>" * 60_000 + "</b>" * 60_000 + "x", "<p>" + "<span>" * 60_000 + "<li>" * 60_000 + "x", "<ul><li>" * 60_000 + "x", "<header>" * 60_000 + "<p>x"])
def test_html_takes_time_in_proportion_to_a_page(page):
    import time

    began = time.perf_counter()
    assert html.extract(page) in ("x", "")
    assert time.perf_counter() - began < 15


def test_html_density_finds_the_article_without_marks():
    words = "The quick brown fox jumps over the lazy dog again and again. "
    menu = "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(30))
    parts = [words * 4 + f"Part {k}." for k in range(6)]
    page = f"<body><div><ul>{menu}</ul></div><div><div><h2>Head</h2>" + "".join(f"<p>{p} <a href='x'>more</a> <b>bold</b></p>" for p in parts) + f"</div></div><div><ul>{menu}</ul></div></body>"
    assert html.extract(page) == "\n\n".join(["Head", *[f"{p} more bold" for p in parts]])
    one = f"<body><div><ul>{menu}</ul></div><section><h1>Only</h1><p>{words * 3}<b>a</b> <i>b</i> <a href='x'>c</a></p></section></body>"
    assert html.extract(one) == f"Only\n\n{(words * 3).strip()} a b c"


def check_packing(pieces, lengths, capacity, segments, loss, shares):
    seen, bins = {}, {}
    for k, start, n, seq, offset in pieces:
        assert n > 0
        seen.setdefault(k, []).append((start, n))
        bins.setdefault(seq, []).append((offset, n, shares[k]))
    for k, total in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[k]):
            assert start == at
            at += n
        assert at == total
    padding = 0
    for own in bins.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity and len(own) <= segments and sum(n * s for _, n, s in own) <= loss + len(own)
        padding += capacity - at if at & (at - 1) else 0
    return padding


@pytest.mark.parametrize("segments,loss,share,cut", [(128, 64, 1.0, True), (4, 64, 0.5, False), (3, 20, 0.7, True), (128, 64, 0.0, False)])
def test_vector_packing(segments, loss, share, cut):
    rng = random.Random(5)
    lengths = [rng.choice([1, 2, 3, 7, 30, 63, 64, 65, 200]) for _ in range(400)]
    shares = [share if rng.random() < 0.5 else min(1.0, share * 1.2) for _ in lengths]
    pieces = packing.pack_block(lengths, shares, 64, segments, loss, cut)
    padding = check_packing(pieces, lengths, 64, segments, loss, shares)
    if segments == 128 and share == 1.0:
        assert padding == 0


def test_packing_query(spark, tiny):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    ids = {k: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for k, x in docs.items()}
    got = packing.op10_pack(spark, tiny).collect()
    names = {k: i for i, k in enumerate(docs)}
    padding = check_packing([(names[r["doc_id"]], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], [len(ids[k]) for k in docs], 1024, 128, 1024, [1.0] * len(docs))
    assert padding <= 0.01 * sum(map(len, ids.values()))
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_added_tokens_inside_a_text(spark):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    for x in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n", "<|endoftext", "<|other|> <|endoftext|>x"):
        assert encode(x) == t.encode(x, add_special_tokens=False).ids


def test_each_limit_binds(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 60))) + rng.choice(["", "\nanswer " * rng.randint(1, 30)])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    share = packing.answer_share(df["text"])
    shares = {r["doc_id"]: r["s"] for r in df.select("doc_id", share.alias("s")).collect()}
    for limits, binds in (({"capacity": 256}, "tokens"), ({"capacity": 1024, "segments": 3}, "segments"), ({"capacity": 512, "loss": 300}, "loss")):
        bins = {}
        for r in packing.pack(df, packing.tokenizer_path(), loss_share=share, cut=False, **limits).collect():
            bins.setdefault(r["sequence_id"], []).append((r["length"], shares[r["doc_id"]]))
        tokens, segments, loss = ([f(b) for b in bins.values()] for f in (lambda b: sum(n for n, _ in b), len, lambda b: sum(round(n * s) for n, s in b)))
        full = {"tokens": max(tokens) / limits["capacity"], "segments": max(segments) / limits.get("segments", 128), "loss": max(loss) / limits.get("loss", limits["capacity"])}
        assert all(v <= 1 for v in full.values()) and full[binds] > 0.97
        assert binds == "tokens" or np.mean(np.array(tokens) < limits["capacity"]) > 0.8
    for wrong in ({"capacity": 0}, {"segments": 0}, {"loss": 0}):
        with pytest.raises(ValueError):
            packing.pack(df, packing.tokenizer_path(), **wrong)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 5), (None, "a b", 5)], "doc_id long, text string, length int")
    got = packing.pack(df, packing.tokenizer_path(), with_ids=True).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0) == [(0, 3), (1, 1), (1, 1), (2, 1)]
    assert sum(r["length"] for r in got) == 6 and all(len(r["ids"]) == r["length"] for r in got)
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0


def test_both_encoders_agree():
    import public_tokenizers

    a, b = packing.encoder(packing.tokenizer_path()), packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for x in ("", "Öl 😀 don't\n\n  x", "\x00퟿", "a" * 3000):
        assert a(x) == b(x)


def trained_decoder():
    words = ["idiot", "clown", "moron", "worthless", "the", "and", "other", "station", "letter"] * 40
    counts = np.zeros((64, 64, 64))
    code = {c: k + 2 for k, c in enumerate(toxicity.LETTERS)}
    for w in words:
        c = [0, 0, *(code[x] for x in w), 0]
        for x in zip(c, c[1:], c[2:], strict=False):
            counts[x] += 1
    return toxicity.Decoder(toxicity.language_model(counts))


def lattice(token, model, borders=False):
    """word -> likeliest way to write it, by enumeration of all readings of a token."""
    code, m = {c: k + 2 for k, c in enumerate(toxicity.LETTERS)}, model.tolist()
    look, drop, hide, absorb = toxicity.COSTS
    best = {}

    def go(i, word, a, b, last, score):
        if i == len(token):
            best[word] = max(best.get(word, -1e9), score + m[a][b][0])
            return
        c = token[i]
        readings = [(x, look) for x in toxicity.LOOKALIKE.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
        for x, cost in readings:
            k = code.get(x, 1)
            go(i + 1, word + x, b, k, x, score + m[a][b][k] - cost)
            if x == last:
                go(i + 1, word, a, b, last, score - absorb - cost)
        if c in toxicity.DROPPABLE:
            go(i + 1, word, a, b, last, score - drop)
            if borders and b:
                go(i + 1, word + " ", 0, 0, "", score + m[a][b][0])
        if c in "*#":
            for x, k in code.items():
                go(i + 1, word + x, b, k, x, score + m[a][b][k] - hide)

    go(0, "", 0, 0, "", 0.0)
    return best


@pytest.mark.parametrize("token,borders", [("1d10t", False), ("m*r*n", False), ("i.d.1.o.t", True), ("iid11oot", False), ("a m-o.n", True), ("w0*", False), ("**o*", False), ("жш1", False)])
def test_decoder_against_full_enumeration(token, borders):
    decoder = trained_decoder()
    want = lattice(token, decoder.array, borders)
    got = decoder.decode(token, borders)
    ranked = sorted(want.values(), reverse=True)[: decoder.keep]
    assert len(got) >= len(ranked) and np.allclose([want[w] for w in got[: len(ranked)]], ranked, atol=1e-4)


def test_long_tokens_are_decoded_whole():
    decoder = trained_decoder()
    for n in (10, 44, 95, 3000):
        assert any(w.endswith("idiot") for w in decoder.decode("theother"[: n % 8] + "theother" * (n // 8) + "1d10t"))


@pytest.mark.parametrize("text", ["such an idioot", "an іdіоt here", "ｉｄｉｏｔ", "id\u200bio\u200bt", "i d\ni o t", "1D10T!", "(i.d.i.o.t)"])
def test_folded_and_doubled_letters(text):
    assert "idiot" in toxicity.Reader(trained_decoder(), lambda w: w).read(text)


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("cl0wn", "clown"), ("m*ron", "moron"), ("w0rth1e$$", "worthless"), ("i d i o t", "idiot")])
def test_decoder(token, word):
    assert word in trained_decoder().decode(token)


@pytest.mark.parametrize("text,word", [("such a m o r o n here", "moron"), ("y o u a r e a n i d i o t", "idiot"), (" ".join("the" * 15 + "moron" + "the" * 5), "moron"), ("i d i o t", "idiot")])
def test_spaced_words_after_others(text, word):
    counts = np.zeros((64, 64, 64))
    code = {c: k + 2 for k, c in enumerate(toxicity.LETTERS)}
    for w in ["idiot", "moron", "such", "a", "here", "you", "are", "an", "the", "the", "and", "other"] * 40:
        c = [0, 0, *(code[x] for x in w), 0]
        for x in zip(c, c[1:], c[2:], strict=False):
            counts[x] += 1
    assert word in toxicity.Reader(toxicity.Decoder(toxicity.language_model(counts)), lambda w: w).read(text)


def test_letter_counts(spark):
    texts = ["The the", None, "", "é9x", "ab" * 10]
    got = toxicity.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros((64, 64, 64))
    code = {c: k + 2 for k, c in enumerate(toxicity.LETTERS)}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            c = [0, 0, *(code[x] for x in w), 0]
            for x in zip(c, c[1:], c[2:], strict=False):
                want[x] += 1
    got[0, 0, 0] = 0
    # the border after a word may be counted once more as a beginning; what follows two letters is exact
    assert (got[2:, :, :][:, 2:, :] == want[2:, :, :][:, 2:, :]).all() and (got[0, 0] == want[0, 0]).all()


def test_toxicity_finds_disguised_words(spark):
    rng = random.Random(2)
    clean = ["letter", "station", "other", "garden", "window", "river", "market", "silver"]
    docs, labels = [], []
    for k in range(900):
        y = k % 4 == 0
        w = [rng.choice(clean) for _ in range(30)]
        if y:
            w[rng.randrange(30)] = rng.choice(["idiot", "moron", "vexing" + rng.choice(["ly", "est", "ness"])])
        docs.append((k, " ".join(w), 0.5))
        labels.append((k, int(y), 1))
    labels += labels[:20] + [(None, 1, 0), (5000, None, 0)]
    df = spark.createDataFrame([*docs, (None, None, 0.1), (9000, "", 0.1), (9001, "letter 1d10t river", 0.1), (9002, "market m.o.r.o.n x", 0.2), (9003, "letter vexingish river", 0.1), (9004, "letter i d i o t window", 0.1)], "doc_id long, text string, score double")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(got[k], k % 4 == 0) for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert got[None] < 0.5 and got[9000] < 0.5
    assert all(got[k] >= 0.5 for k in (9001, 9002, 9003, 9004))


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).count() == 0


def test_toxicity_query(spark, small):
    got = toxicity.op6_toxicity(spark, small).toPandas()
    marks = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic").dropna().toPandas().groupby("doc_id")["toxic"].max()
    held = got[got["held_out"] & got["doc_id"].isin(marks.index)]
    assert (held["predicted"] == held["doc_id"].map(marks)).mean() > 0.97
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def brute_leaks(docs, items, similarity=0.8):
    out = set()
    for i, t in items:
        q, a = decontaminate.halves(t or "")
        w = q + a
        size = min(5, len(w))
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        if not w:
            continue
        for d, x in docs:
            v = decontaminate.WORD.findall((x or "").lower())
            have = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
            if len(own & have) >= similarity * len(own):
                out.add((d, i))
    return out


def test_decontamination_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    items = duckdb.connect().sql(f"select item_id, text from '{tiny}/benchmark.parquet'").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_decontaminate(spark, tiny).collect()}
    assert got == brute_leaks(docs, items) and got


def test_decontamination_edits_and_parts(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 40
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) + rng.choice(["", ".", "\nthe answer " + str(k)])) for k in range(60)]
    docs = []
    for d in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            own = decontaminate.WORD.findall(items[rng.randrange(60)][1])
            if d % 2 and len(own) > 12:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[0][1])] + docs[:2]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (None, "x y"), (99, None), items[0]], "item_id long, text string")
    want = {x for x in brute_leaks([d for d in docs if d[0] is not None], items)}
    for chars in (8_000_000, 2000):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench, part=0.0, part_chars=chars).collect()}
        assert got == want
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0


def test_absorbed_repetitions_as_the_decoder_reads_them():
    rng = np.random.default_rng(5)
    decoder = toxicity.Decoder(toxicity.language_model(rng.integers(0, 50, (toxicity.SIDE,) * 3).astype(float)))
    words = ["".join(c * int(n) for c, n in zip(rng.choice(list("abeiostxéж"), 6), rng.choice([1, 1, 2, 3], 6), strict=True)) for _ in range(300)]
    for w in [*words, "a" * 200, "ab"]:
        assert decoder.absorbed(w) == (decoder.decode(w) or [w])[0]
