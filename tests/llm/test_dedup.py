import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.llm import simhash, substrings
from heaplens.llm.common import connected_components, split_heavy, star_edges
from heaplens.llm.embedding import embedding_dedup
from heaplens.llm.exact_dedup import exact_dedup

from .conftest import ODD, components


def test_exact_against_brute_force(docs, docs_pdf):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, digests=True).collect()}
    groups = {}
    for i, t in zip(docs_pdf.doc_id, docs_pdf.text):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want


def test_exact_frequent_and_rare_lengths(spark):
    """Lengths that many rows have and lengths that few have take different ways; both give all copies."""
    texts = [f"common {k % 500:04d}" for k in range(4000)] + ["hot text of its own"] * 1500 + [f"r{'x' * (k % 300)}{k % 600}" for k in range(900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(rows).collect()}
    counts = {t: texts.count(t) for t in first}
    assert got == {i: (first[t], counts[t]) for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in exact_dedup(rows, survivors_only=True).collect()) == sorted(first.values())


def test_exact_odd(odd, spark):
    rows = exact_dedup(odd, digests=True).collect()
    assert len(rows) == len(ODD)
    word = [r for r in rows if r.keep_id == 4]
    assert len(word) == 4 and sum(r.kept for r in word) == 1 and word[0].group_size == 4  # 4, 4, 5 and the null id; "one word " differs
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (1, 2, 3)} == {1: 1, 2: 1, 3: 3}
    kept = exact_dedup(odd, survivors_only=True)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 10, 11]
    assert exact_dedup(odd.where("false")).count() == 0 and exact_dedup(odd.where("false"), survivors_only=True).count() == 0


def test_simhash_against_brute_force(docs, docs_pdf):
    rows = sorted(simhash.simhash_dedup(docs).collect(), key=lambda r: r.doc_id)
    prints = [simhash.fingerprint(t) for t in docs_pdf.sort_values("doc_id").text]
    assert [int(r.fingerprint, 16) for r in rows] == prints
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in components(len(rows), edges)]


def test_fingerprint_by_definition():
    import xxhash

    text = "The\tquick brown  fox Jumps over É the lazy dog the quick brown fox jumps"
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_odd(odd):
    rows = simhash.simhash_dedup(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5, 6, None)} == {4}
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert simhash.simhash_dedup(odd.where("false")).count() == 0


@pytest.mark.parametrize("heavy", [8, 10_000])
def test_tries_deep(spark, heavy):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    prints = [int(x) for x in base]
    for x in base[:80]:
        y = int(x)
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
            prints.append(y)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, bits long")
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    got = [(r.a, r.b) for r in simhash.simhash_links(df, node_rows=32, heavy_rows=heavy).collect()]
    assert all(a > b for a, b in got)
    assert components(len(prints), got) == components(len(prints), edges)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(0, 200))
def test_trie_join(values, seed):
    rng = np.random.default_rng(seed)
    values = sorted({v ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for v in values for k in (0, 1, 3, 5)})
    bits = np.array(values, np.uint64)
    pieces = list(simhash.trie_join(bits, None, 0, [4] * 64, leaf=2, most=3))
    i, j = (np.concatenate([p[k] for p in pieces] + [np.empty(0, np.int64)]) for k in (0, 1))
    assert len(i) == len(set(zip(i.tolist(), j.tolist())))
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(600, edges)
    assert {x: got.get(x, x) for x in range(600)} == dict(enumerate(want))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_edges_and_heavy(spark):
    a, b = np.array([5, 3, 9, 20]), np.array([3, 1, 20, 11])
    assert dict(zip(*(x.tolist() for x in star_edges(a, b)))) == {3: 1, 5: 1, 11: 9, 20: 9}
    rows = spark.range(50).selectExpr("CASE WHEN id < 40 THEN 'hot' ELSE 'cold' END AS k", "id")
    groups = {}
    for r in split_heavy(rows, "k", 10).collect():
        groups.setdefault((r.k, r.part), set()).add(r.id)
    hot = [g for (k, _), g in groups.items() if k == "hot"]
    assert all(any({x, y} <= g for g in hot) for x in range(40) for y in range(x)) and len(hot) > 1 and sum(k == "cold" for k, _ in groups) == 1


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 32))
    near = base[:40] + 0.05 * rng.standard_normal((40, 32))
    x = np.concatenate([base, near, base[:10] * 2.0, base[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 2) if i < 120 else int((i - 120) % 40 % 2) if i < 160 else int((i - 160) % 2) if i < 170 else int((i - 170) % 2), "x") for i in range(len(x))]
    odd = [(900, None, 0, "x"), (901, [0.0] * 32, 0, "x"), (902, [float("nan")] * 32, 0, "x"), (903, [None] * 32, 0, "x"), (904, rows[0][1], None, "x"), (905, [1.0] * 3, 0, "x"), (907, [0.0, 2.0], 0, "x"), (908, [0.1, 2.0], 0, "x"), (906, [float("inf")] * 32, 0, "x"), (None, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, key string")
    for leaf, heavy in ((8, 4), (256, 2048)):
        got = {r.vec_id: r for r in embedding_dedup(df, leaf_rows=leaf, heavy_rows=heavy).collect()}
        y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        label = np.array([r[2] for r in rows])
        link = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
        np.fill_diagonal(link, False)
        found = sum(got[i].n_links for i in range(len(x)))
        assert found >= 0.97 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(len(x)))
        assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 907)) and got[None].component_id is None
        assert [(got[k].n_links, got[k].component_id) for k in (907, 908)] == [(1, 907), (1, 907)]  # a length of their own
        if found == link.sum():
            assert [got[i].component_id for i in range(len(x))] == components(len(x), list(zip(*np.nonzero(link))))
    assert embedding_dedup(df.where("false")).count() == 0


def test_embeddings_recall(spark):
    """Default parameters, 10,000 vectors of a label, among them 1500 that are all alike: links are counted once, and most are found."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5500, 64))
    x = np.concatenate([base, base[:2000] + 0.25 * rng.standard_normal((2000, 64)), base[:1000] + 0.2 * rng.standard_normal((1000, 64)), base[0] + 0.1 * rng.standard_normal((1500, 64))]).astype(np.float32)
    got = embedding_dedup(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = y @ y.T >= 0.93
    np.fill_diagonal(link, False)
    want, found = link.sum(axis=1), got.n_links.to_numpy()
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    pairs = slice(1, 5500)  # without the large group, which outweighs all others
    assert found[pairs].sum() >= 0.9 * want[pairs].sum()
    roots = components(len(x), list(zip(*np.nonzero(link))))
    assert np.mean([a == b for a, b in zip(got.component_id, roots)]) >= 0.97


def brute(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_substrings(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [(i, " ".join(rng.choice([shared[rng.randint(0, 3)], " ".join(word() for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    texts += [(100, "x" * 500), (101, "ab" * 300), (102, None), (103, ""), (104, texts[3][1]), (105, "y" + "x" * 120 + "y")]
    want = brute(texts, 100)
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, tag string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.substring_dedup(df).collect()} == want
    docs = df.selectExpr("doc_id AS id", "0L AS tag", "coalesce(text, '') AS text").where("octet_length(text) >= 100")
    few = {}
    for r in substrings.repeated_ranges(docs, substrings._packed(docs), heavy_spans=1, bucket_spans=3).collect():
        few.setdefault(r.id, []).append((r.lo, r.hi))
    assert {i: int(sum(b - a for a, b in substrings.merged(np.array(v)))) for i, v in few.items()} == {i: w[1] for i, w in want.items() if w[1]}


def test_substrings_odd(odd):
    rows = substrings.substring_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[None].n_removed == 0 and by[1].n_bytes == 0 and by[11].n_removed == 59_999 and by[11].n_spans == 1
    assert substrings.substring_dedup(odd.where("false")).count() == 0


@pytest.mark.parametrize("tasks", [1, 5])
def test_substrings_rows_repeated_in_full(spark, tasks):
    """Rows repeated in full are one document: they keep their text, and lose what an earlier document has."""
    import random

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, tail = text(300), text(250)
    texts = [(None, text(400)), (1, text(350)), (2, text(150) + shared + text(90)), (3, shared[40:260] + tail), (4, text(30) + tail[10:] + text(40)), (5, "x" * 450)]
    want = {k: v for (k, _), v in zip(texts, brute([(-1 if i is None else i, t) for i, t in texts], 100).values())}
    rows = [(i, t) for i, t in texts for _ in range(3)]
    rng.shuffle(rows)
    for dealt in (rows, sorted(rows, key=lambda r: r[0] or 0)):
        out = substrings.substring_dedup(spark.createDataFrame(dealt, "doc_id long, text string").repartition(tasks)).collect()
        assert len(out) == len(rows)
        assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in out)
    docs = spark.createDataFrame([(-1 if i is None else i, 0, t) for i, t in rows], "id long, tag long, text string").repartition(tasks)
    few = {}
    for r in substrings.repeated_ranges(docs, substrings._packed(docs), heavy_spans=1, bucket_spans=3).collect():
        few.setdefault(r.id, []).append((r.lo, r.hi))
    assert {i: int(sum(b - a for a, b in substrings.merged(np.array(v)))) for i, v in few.items()} == {-1 if i is None else i: w[1] for i, w in want.items() if w[1]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=8))
def test_lpf(texts):
    flags, count = substrings.lpf_at_least([t.encode() for t in texts], 4)
    want, seen = [], set()
    for t in texts:
        for s in range(len(t) - 3):
            want.append(t[s : s + 4] in seen)
            seen.add(t[s : s + 4])
    assert flags.tolist() == want and count.sum() == len(want)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=700).map(lambda b: bytes(x % 3 for x in b)))
def test_anchors_cover_all_windows(data):
    h, lo, n = substrings.anchors(data, 100, 5)
    assert int(n.sum()) == max(0, len(data) - 99) and (np.cumsum(n) - n).tolist() == lo.tolist()
