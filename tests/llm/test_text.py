import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm import bpe, html, licences, quality
from heaplens.llm.chat import chat_format
from heaplens.llm.mixing import mix_sources

from .conftest import DATA, ODD

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoding():
    path, pattern = bpe._tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe(spark, docs, docs_pdf, encoding, odd):
    for df, texts in ((docs, list(zip(docs_pdf.doc_id, docs_pdf.text))), (odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), dict((i, t) for i, t in ODD if i is not None).items())):
        got = {r.doc_id: r for r in bpe.bpe_digests(df).collect()}
        for i, t in texts:
            ids = encoding.encode_ordinary(t or "")
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i
    path, pattern = bpe._tokenizer()
    whole = bpe.bpe_decode(bpe.bpe_encode(odd, path, pattern), path)
    assert whole.columns == [*odd.columns, "ids", "decoded"] and whole.count() == len(ODD)
    assert bpe.bpe_digests(odd.where("false")).count() == 0


def test_bpe_head_changes_nothing(docs):
    path, pattern = bpe._tokenizer()
    a, b = ({r.doc_id: bytes(r.ids) for r in bpe.bpe_encode(docs.limit(40), path, pattern, head_words=n).collect()} for n in (1, 100_000))
    assert a == b


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_merges(text):
    path, pattern = bpe._tokenizer()
    ranks = test_merges.ranks = getattr(test_merges, "ranks", None) or bpe.load_ranks(path)
    data = text.encode("utf-8")
    if data:
        assert bpe.merge_short(data, ranks) == bpe.merge_long(data, ranks)


def test_mix(spark, docs_pdf):
    rows = [(i, f"s{i % 10 if i % 10 < 3 else 0}", "x") for i in range(2000)] + [(5000 + i, None, "x") for i in range(60)] + [(1, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = mix_sources(df, {"s0": 5, "s1": 2}, 1, block_rows=8).toPandas()
    assert sorted(out.mix_pos) == list(range(len(rows)))
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()
    assert out.groupby("slot")[["block"]].nunique().max().iloc[0] == 1 and (out.sort_values("mix_pos").slot.diff().dropna() >= 0).all()
    weight = {"s0": 5 / 9, "s1": 2 / 9, "s2": 1 / 9}
    blocks = out.drop_duplicates("slot").sort_values("slot")
    ends = blocks.groupby(blocks.source.fillna("?")).slot.max().min()  # until the first source has run out
    for t in range(1, int(ends) + 1):
        done = blocks[blocks.slot < t].source.value_counts()
        assert all(abs(done.get(s, 0) - w * t) < 1 for s, w in weight.items())
    assert mix_sources(df.where("false")).count() == 0
    with pytest.raises(Exception, match="add up"):
        mix_sources(df, {"s0": 5000}).count()


def test_html_rules():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="home"><div class="cookie-notice">We use cookies</div><header>Site</header><nav><ul><li>x<li>y</ul></nav>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>bold<br>next<p>Two&nbsp;  &#233; <span class="ad">buy</span> end<form>f <input></form><ul><li>a<li>b</ul><aside>side</aside><div class="comments">bad</div><table><tr><td>c<td>d</table></article>
    <section id="comments"><article>reader says</article></section><footer>foot</footer>"""
    assert [t for r, t in html.blocks(page) if r == html.ARTICLE] == ["Title & more", "One bold", "next", "Two é", "end", "a", "b", "c", "d"]
    assert html.blocks(None) == [] and html.blocks("plain & <b>text") == [(html.OTHER, "plain & text")]


@pytest.mark.parametrize("named, within, around", [
    ("ad", True, True), ("site-footer", False, True), ("ad-slot", False, True), ("comment_list", False, True), ("nav main-nav", False, True), ("related-work", True, False), ("related-work", False, False), ("side note", True, False),
    ("header-note", True, False), ("header-note", False, False), ("share-count", True, False), ("banner-story", False, False), ("banner", True, False), ("banner", False, True), ("sidebar", True, True), ("newsletter-box", True, False), ("", True, False),
])
def test_html_class_words(named, within, around):
    assert html.names_chrome(named, within) == around


def test_html_parts_of_articles_stay():
    page = "<main><h1>T</h1>" + "".join(f'<div class="{c}"><p>{c} stays</p></div>' for c in ("related-work", "side note", "header-note", "share-count", "banner-story")) + '<div class="ad">goes</div><div class="comments">goes</div></main>'
    assert [t for r, t in html.blocks(page) if r == html.ARTICLE] == ["T", "related-work stays", "side note stays", "header-note stays", "share-count stays", "banner-story stays"]


def test_html_repeated_pages(spark):
    """A page that is there several times is one page: what it has alone stays, however often the row is repeated, and what three different pages have goes."""
    own = lambda k: f"<div><p>words of page number {k} that no other page of this host has at all</p></div>"
    shared = "<div><p>the same long line of text on every page of this very host</p></div>"
    rows = [(1, "http://a/1", own(1))] * 3 + [(2, "http://a/2", own(2) + shared)] * 2 + [(3, "http://a/3", own(3) + shared), (4, "http://a/4", own(4) + shared), (5, "http://b/1", own(1))]
    for keys in (1 << 21, -1):
        got = html.extract_html(spark.createDataFrame(rows, "page_id long, url string, html string"), table_keys=keys).collect()
        assert sorted((r.page_id, r.text) for r in got) == sorted((i, f"words of page number {1 if i == 5 else i} that no other page of this host has at all") for i, *_ in rows)


def test_html_host(spark):
    shell = "<body><div>Welcome to our site it has many nice pages for you</div><p>{}</p><div>Contact us by mail or by phone at any time of day</div>"
    rows = [(k, "http://h.example/" + str(k), shell.format(f"Story number {k} tells of item{k} and thing{k} only"), "x") for k in range(6)]
    rows += [(10, None, None, "x"), (11, "//g.example", "", "x"), (12, "http://h.example/12", "<article><p>Welcome to our site it has many nice pages for you</article>", "x"), (12, "http://h.example/12", "<article><p>Same</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.text) for r in html.extract_html(df).collect()}
    assert got == {(k, f"Story number {k} tells of item{k} and thing{k} only") for k in range(6)} | {(10, ""), (11, ""), (12, "Welcome to our site it has many nice pages for you"), (12, "Same")}
    # neither how pages are dealt nor the way that shared strings come to them makes a difference
    for frame, keys in ((df.repartition(len(rows)), 1 << 21), (df.coalesce(1), 0), (df.repartition(5), 0)):
        assert {(r.page_id, r.text) for r in html.extract_html(frame, table_keys=keys).collect()} == got
    assert html.extract_html(df.where("false")).count() == 0 and html.extract_html(df.where("false"), table_keys=-1).count() == 0
    # without markup the article that six other pages repeat goes, too
    plain = {(r.page_id, r.text) for r in html.extract_html(df, markup=False).collect()}
    assert plain == (got - {(12, "Welcome to our site it has many nice pages for you")}) | {(12, "")}


def test_html_strings_meet_articles(spark):
    """Blocks of articles are held against the host's strings, too; what those cover is told, and stays by markup alone."""
    notice = "We value your trust so please read our terms again"
    rows = [(k, f"http://h.example/{k}", f"<div>{notice}</div><article><p>Story {k} tells of item{k}" + (f"<p>{notice}" if k < 2 else "") + "</article>") for k in range(4)] + [(9, "http://g.example/9", f"<article><p>{notice}</article>")]
    for keys in (1 << 21, -1):
        got = {(r.page_id, r.text, r.n_shared) for r in html.extract_html(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), table_keys=keys).collect()}
        assert got == {(k, f"Story {k} tells of item{k}" + (f"\n{notice}" if k < 2 else ""), int(k < 2)) for k in range(4)} | {(9, notice, 0)}


def test_html_long_and_short_segments(spark):
    """Menus of a few words are strings of their own; a very long page is one like any other."""
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(k, "http://h.example/a", f"{menu}<p>text {k} a b c d e f{k}</p><div class='ad'>buy now{k}</div>") for k in range(4)] + [(9, "http://h.example/b", f"{menu}<p>{long}</p>")]
    for markup in (True, False):
        got = {r.page_id: r.text for r in html.extract_html(spark.createDataFrame(rows, "page_id long, url string, html string"), markup=markup).collect()}
        assert got[9] == long and got[2] == "text 2 a b c d e f2" + ("" if markup else "\nbuy now2")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), max_size=3), max_size=5))
def test_runs(pages):
    """Strings of three tokens, or of a shorter segment as a whole, with the number of pages that hold each."""
    stream = html.Stream([[(html.OTHER, k, " ".join(words)) for k, words in enumerate(page)] for page in pages], 3)
    strings = lambda words: [tuple(words[s : s + 3]) for s in range(max(1, len(words) - 2))]
    want = {}
    for k, page in enumerate(pages):
        for words in page:
            for w in strings(words):
                want.setdefault(w, set()).add(k)
    starts, n = stream.runs()
    keys = dict(zip(stream.keys(starts, 7).tolist(), n.tolist()))
    assert sorted(keys.values()) == sorted(len(x) for x in want.values()) and len(keys) == len(want)
    shared = np.array([keys[x] > 1 for x in stream.keys(stream.starts, 7).tolist()], bool)
    got = np.array([stream.covered(shared)[a:b].sum() for _, _, a, b, _ in stream.blocks])
    expected = []
    for page in pages:
        for words in page:
            own = [False] * len(words)
            for s, w in enumerate(strings(words)):
                if len(want[w]) > 1:
                    own[s : s + 3] = [True] * len(own[s : s + 3])
            expected.append(sum(own))
    assert got.tolist() == expected


def test_pages_against_markup(spark):
    import html as std
    import re

    pages = pd.read_parquet(DATA / "pages.parquet")
    got = {r.page_id: r.text for r in html.extract_html(spark.read.parquet(str(DATA / "pages.parquet"))).collect()}
    for i, h in zip(pages.page_id, pages.html):
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = [re.sub(r"\s+", " ", std.unescape(re.sub(r"<!--.*?-->|</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[i] == "\n".join(x for x in parts if x)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0


def test_licences(spark, odd):
    import re

    mit = licences.TEMPLATES["MIT text"]
    texts = [(1, "intro\nReleased under the MIT License.\nend"), (2, mit), (3, "a b\n\n" + mit.replace(", ", ",\n", 3) + "\n\nx y"), (4, mit.replace("software", "program").replace("Software", "Program")), (5, "licensed UNDER cc by nc 4 0"), (6, "mit license"), (7, None)]
    parts = lambda name, *ends: "\n\n".join(re.split("(?<=" + "|".join(ends) + ") ", licences.TEMPLATES[name]))
    around = "\n".join(f"line {k} of a longer text, which says nothing of licences but goes on for a while" for k in range(12))
    texts += [(8, f"{around}\n\n{parts('GPL-3.0 header', 'version[.]')}\n\n{around}".replace("useful, ", "useful,\n\n").replace("it under", "it\n\nunder").replace("but WITHOUT", "but\n\nWITHOUT"))]
    texts += [(9, around + "\n" + licences.TEMPLATES["Apache-2.0 header"].replace("use this", "use\nthis").replace("to in", "to in\n# ").replace("WITHOUT", "\n# WITHOUT") + "\n" + around)]
    texts += [(10, f"{around}\nReleased under the\nMIT License.\n{around}"), (11, around + "\r\n" + licences.TEMPLATES["BSD-2-Clause"].replace(" 1.", "\r\n\r\n1.").replace(" 2.", "\r\n\r\n2.") + "\r\n\r\n" + around)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, passages string")
    grams = lambda t: {" ".join(p) for w in [licences._plain(t)] for p in zip(w, w[1:])}

    want = {}
    for i, t in texts:
        lines = [w for line in re.split(r"[\r\n]+", t or "") if (w := licences._plain(line))]
        runs = [" ".join(sum(lines[a:b], [])) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)]
        for kind, passages in enumerate(({*re.split(r"[\r\n]+", t or ""), *re.split(r"\r?\n[ \t]*\r?\n", t or ""), t or ""}, runs)):
            for p in passages:
                for name, template in licences.TEMPLATES.items():
                    if (d := dice(grams(p), grams(template))) >= 0.8 and (not kind or len(p.split()) <= 1.5 * len(grams(template)) + 1):
                        best, *n = want.get((i, name), (0, 0, 0))
                        n[kind] += 1
                        want[i, name] = (max(best, d), *n)
    got = {(r.doc_id, r.licence): (r.dice, r.n_passages, r.n_runs) for r in licences.licence_scan(df).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1:] == want[k][1:] for k in want)
    # several paragraphs within a longer text, and a notice wrapped within a paragraph, are found by runs alone
    assert {k for k, v in got.items() if k[0] > 7 and not v[1] and v[2]} == {(8, "GPL-3.0 header"), (9, "Apache-2.0 header"), (10, "MIT"), (11, "BSD-2-Clause")}
    assert {1, 2, 3, 5} <= {i for i, _ in got} and licences.licence_scan(odd).count() == 0 and licences.licence_scan(df.where("false")).count() == 0


def test_quality(spark, docs, docs_pdf, odd):
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).toPandas()
    assert set(docs.columns) < set(rows.columns) and ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.7)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    both = rows.merge(pd.read_parquet(DATA / "labels.parquet"), on="doc_id")
    own, held = both[~both.held_out], both[both.held_out]
    assert (own.predicted == own.quality).mean() > 0.95 and (held.predicted == held.quality).mean() > 0.8
    # labels that are held out play no part
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 4) = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = quality.train_quality(docs, turned)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    scored = quality.score_quality(odd, model)
    assert scored.count() == len(ODD) and scored.where("doc_id IN (1, 2, 3)").select("score").distinct().count() == 1
    none = quality.train_quality(docs, labels.where("false"))
    assert {r.score for r in quality.score_quality(odd, none).select("score").collect()} == {0.5}
    assert quality.score_quality(odd.where("false"), model).count() == 0


def _forward(model, bag):
    """The score of one document by loops over its passages, straight from the definition of gated attention."""
    import math

    w = {k: v.tolist() for k, v in model.weights.items()}
    dot = lambda v, m, j: sum(x * row[j] for x, row in zip(v, m))
    encoded, power = [], []
    for x in model.encode(bag).tolist():
        e = [math.tanh(dot(x, w["W"], j) + w["b"][j]) for j in range(len(w["b"]))]
        encoded.append(e)
        power.append(math.exp(sum(math.tanh(dot(e, w["V"], j)) / (1 + math.exp(-dot(e, w["U"], j))) * w["w"][j] for j in range(len(w["w"])))))
    z = [sum(a * e[j] for a, e in zip(power, encoded)) / sum(power) for j in range(len(w["b"]))]
    return 1 / (1 + math.exp(-sum(c * x for c, x in zip(w["c"], z)) - w["d"][0]))


def test_attention_by_definition():
    rng = np.random.default_rng(1)
    bags = [quality.passages(t) for t in ("Some words here. " * 60, "", "x", "BAD!! *** ### " * 90 + "Good words after all. " * 30)]
    every = np.concatenate(bags)
    model = quality.initial(every.mean(axis=0), every.std(axis=0), 5, 3, rng)
    assert np.allclose(model.scores(bags), [_forward(model, b) for b in bags], atol=1e-8)
    x, first, y = model.encode(every), np.cumsum([0, *(len(b) for b in bags[:-1])]), np.array([1.0, 0.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y > 0.5, p := model.forward(x, first)["p"], 1 - p)))
    grad = quality.gradient(model, x, first, y)
    assert grad.keys() == model.weights.keys()
    for k, w in model.weights.items():
        for at in [np.unravel_index(i, w.shape) for i in rng.integers(0, w.size, 12)]:
            kept = w[at]
            w[at] = kept + 1e-6
            above = loss()
            w[at] = kept - 1e-6
            assert grad[k][at] == pytest.approx((above - loss()) / 2e-6, rel=1e-4, abs=1e-8)
            w[at] = kept


def test_attention_learns():
    bags = [quality.passages("fine words here and there. " * k) for k in range(1, 9)] + [quality.passages("fine words here. " * k + "BAD!! *** ### " * 30) for k in range(1, 9)]
    y = np.array([1.0] * 8 + [0.0] * 8)
    model = quality.fit(bags, y, epochs=120, batch=8)
    assert ((model.scores(bags) > 0.5) == (y > 0.5)).all()


def test_chat(spark):
    turn = lambda c, *ts: [(c, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(ts)]
    rows = turn(1, "hi", "yo") + turn(2, "hi", "yo", "how?") + turn(3, "hi", "yo", "how?", "so") + turn(4, "hi", "yo", "how?", "so") + turn(5, "hi", "no") + turn(6, "hi") + turn(None, "lost")
    rows += [(7, 0, None, None, "x"), (7, 0, None, None, "x"), (8, 0, "user", "<|im_end|>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefixes string")
    got = {r.conv_id: r for r in chat_format(df).collect()}
    assert set(got) == {3, 5, 7, 8, None} and got[3].n_copies == 2 and got[3].n_turns == 4
    assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert got[7].rendered == "<|im_start|>user\n<|im_end|>\n" and got[8].rendered == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat_format(df.where("false")).count() == 0
    # where role and text part differently around a line end, conversations differ; a very long conversation is one row
    odd = [(1, 0, "a\nb", "c"), (2, 0, "a", "b\nc"), *[(3, k, "user", f"turn {k}") for k in range(3000)]]
    rows = {r.conv_id: r for r in chat_format(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].n_copies == rows[2].n_copies == 1 and rows[3].n_turns == 3000
