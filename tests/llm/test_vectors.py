"""Whitening, clustering and token files against plain definitions."""

import hashlib
import json
import pathlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heaplens.llm.clusters import BallTree, assign, cluster, op12_clusters, squared_distances
from heaplens.llm.token_files import ChunkEncoder, ids_crc32, op13_token_files, read_tokens, write_tokens
from heaplens.llm.whitening import Moments, op11_whitening, symmetric_qr, whiten

DATA = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<double>, label int, n long, component string, x string, id string"


def table(spark, rows):
    """Vectors with extra columns whose names operators also use."""
    return spark.createDataFrame([(i, v, None, 7, "c", "x", "id") for i, v in rows], TABLE)


ODD = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (None, [0.5, 0.25]), (6, [0.5, 0.25]), (6, [0.5, 0.25]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.75, 1.5])]


# Whitening


def test_moments_stream_and_merge():
    """Streaming and merging in any cut give the centred sums of exact arithmetic."""
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (40, 3)) + 30
    rows = [[Fraction(int(v)) for v in r] for r in x]
    mean = [sum(c) / 40 for c in zip(*rows)]
    want = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows)) for j in range(3)] for i in range(3)])
    for cuts in ([], [1], [7, 8, 30], list(range(1, 40))):
        whole = Moments(3)
        for part in np.split(x, cuts):
            own = Moments(3)
            for batch in np.array_split(part, 2):
                own.stream(batch)
            whole.merge(own.n, own.total, own.mean, own.m2)
        assert whole.n == 40 and whole.total.tolist() == x.sum(axis=0).tolist()
        assert np.allclose(whole.m2, want, rtol=1e-12) and np.allclose(whole.mean, x.mean(axis=0), rtol=1e-15)
    # one row at a time is the rank-one recurrence itself
    mean, m2 = np.zeros(3), np.zeros((3, 3))
    for k, row in enumerate(x.astype(float), 1):
        gap = row - mean
        mean = mean + gap / k
        m2 += np.outer(gap, row - mean)
    assert np.allclose(m2, want, rtol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64])
def test_symmetric_qr(size):
    rng = np.random.default_rng(size)
    low_rank = rng.standard_normal((size, max(1, size // 2)))
    for a in (np.eye(size), np.zeros((size, size)), low_rank @ low_rank.T, np.diag(np.arange(size, dtype=float)), (lambda b: b + b.T)(rng.standard_normal((size, size)))):
        values, rows = symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max() * size))
        assert np.allclose(rows @ rows.T, np.eye(size), atol=1e-12) and np.allclose(rows.T @ np.diag(values) @ rows, a, atol=1e-11 * max(1, np.abs(a).max() * size))


def brute_whiten(vectors, k=16):
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, q = np.linalg.eigh(np.cov((fit - 1_000_000).T, bias=True).reshape(x.shape[1], -1))
    values, q = values[::-1], q[:, ::-1]
    white = (n * x - total) / n @ q[:, :k] / np.sqrt(values[:k])
    return n, [int(s) for s in ((n * x - total).astype(object) ** 2).sum(axis=1)], white, values[:k] / values.sum()


def test_op11_brute_force(spark):
    got = op11_whitening(spark, DATA).toPandas()
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    n, deviation, white, share = brute_whiten(source["embedding"])
    assert len(got) == 16 * len(source) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[source["vec_id"]].to_numpy()
    sign = np.sign((wide * white).sum(axis=0))
    assert np.allclose(wide * sign, white, atol=1e-6)
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-9) and (got.groupby("component")["explained"].nunique() == 1).all()
    assert got.drop_duplicates("vec_id").set_index("vec_id").loc[source["vec_id"], "deviation"].tolist() == deviation


def test_whiten_odd_rows(spark):
    got = whiten(table(spark, ODD)).orderBy(F.col("vec_id").asc_nulls_first(), "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(None, 1), (None, 2), (6, 1), (6, 1), (6, 2), (6, 2), (7, 1), (7, 2)] + [(8, 1), (8, 2), (8, 3), (9, 1), (9, 2)]
    n, deviation, white, share = brute_whiten([[0.5, 0.25], [0.5, 0.25], [0.0, 0.0], [-0.75, 1.5]])
    first = {r.vec_id: r for r in got if r.component == 1}
    assert {r.n for r in got if r.vec_id != 8} == {3} and [int(first[i].deviation) for i in (6, 7, 9)] == deviation[1:] and np.allclose(np.abs([first[i].whitened for i in (6, 7, 9)]), np.abs(white[1:, 0]))
    # the only vector of its length: nothing varies
    assert [(r.n, r.whitened, r.explained, int(r.deviation), r.identity_error) for r in got if r.vec_id == 8] == [(1, None, 0.0, 0, 0.0)] * 3
    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, [(1, None)])).collect() == []
    with pytest.raises(Exception, match="too large to whiten"):
        whiten(table(spark, [(1, [1e300])])).collect()
    # sums of squares that a long doesn't hold are exact still
    big = whiten(table(spark, [(1, [2.0**40]), (2, [0.0])])).where("component = 1 AND vec_id = 1").first()
    assert int(big.deviation) == (2**46) ** 2


def test_whiten_many_lengths(spark):
    """Vectors of each length have a model of their own, also where the models go out in groups; a third of the rows are copies."""
    rng = np.random.default_rng(2)
    rows = [(100 * d + i, rng.standard_normal(d).tolist()) for d in (2, 3, 4, 5) for i in range(20)]
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    one = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(table(spark, rows), components=2).collect()}
    two = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(table(spark, rows), components=2, model_bytes=1).collect()}
    assert one.keys() == two.keys() and len(one) == 2 * len(rows) and all(np.isclose(one[k], two[k], rtol=1e-9) for k in one)
    n, _, white, _ = brute_whiten([v for i, v in rows if len(v) == 2], 2)
    assert n == 20 and np.allclose([one[i, 1] for i, v in rows if len(v) == 2], np.abs(white[:, 0]))


# Clustering


def brute_cluster(ids, x, k=8, rounds=10, seed=3):
    order = sorted((i for i in range(len(x)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = [x[i].astype(object) for i in order[:k]]
    near = lambda v: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j))
    for _ in range(rounds):
        at = [near(v) for v in x.astype(object)]
        for j in range(len(c)):
            own = [x[i].astype(object) for i in range(len(x)) if at[i] == j]
            if own:
                c[j] = np.array([sum(col) // len(own) for col in zip(*own)], object)
    at = [near(v) for v in x.astype(object)]
    distance = [int(sum((a - b) ** 2 for a, b in zip(v, c[j]))) for v, j in zip(x.astype(object), at)]
    per = [sum(d for d, a in zip(distance, at) if a == j) for j in range(len(c))]
    return sorted(((ids[i], at[i], distance[i], per[at[i]], sum(distance), hashlib.sha256(",".join(map(str, c[at[i]])).encode()).hexdigest()) for i in range(len(x))), key=str)


def test_op12_brute_force(spark):
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x = np.array([np.floor(1024 * np.asarray(v, float)).astype(int) for v in source["embedding"]])
    assert sorted(map(tuple, op12_clusters(spark, DATA).collect()), key=str) == brute_cluster(source["vec_id"].tolist(), x)


def test_cluster_groups_ties_copies(spark):
    """Well parted groups, where whole balls go, ties on the integer grid and a third of all rows equal."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 3, 2) * 50 + rng.integers(-1, 2, 2)).astype(float).tolist()) for i in range(150)] + [(1000 + i, [50.0, 50.0]) for i in range(75)]
    got = cluster(table(spark, rows), k=5, rounds=4, scale=1, dim=2, tree_rows=64, leaf=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_cluster([i for i, _ in rows], np.array([v for _, v in rows]).astype(int), 5, 4)


def test_cluster_odd_rows(spark):
    got = cluster(table(spark, ODD), k=3, rounds=2, dim=2)
    x = np.floor(1024 * np.array([[0.5, 0.25], [0.5, 0.25], [0.5, 0.25], [0, 0], [-0.75, 1.5]])).astype(int)
    assert sorted(map(tuple, got.collect()), key=str) == brute_cluster([None, 6, 6, 7, 9], x, 3, 2)
    assert cluster(table(spark, []), dim=2).collect() == [] and cluster(table(spark, [(1, None)]), dim=2).collect() == []
    with pytest.raises(Exception, match="too large to cluster"):
        cluster(table(spark, [(1, [1e9, 0.0])]), dim=2).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=80), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=4), st.integers(1, 8))
def test_ball_tree(points, centroids, leaf):
    """Balls hold what they say, and filtering assigns each point as a full comparison does."""
    points, centroids = np.array(points), np.array(centroids)
    tree = BallTree(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    for low, high, total, center, radius in zip(tree.low, tree.high, tree.sums, tree.center, tree.radius):
        own = tree.points[low:high]
        assert (own.sum(axis=0) == total).all() and (np.sqrt(((own - center) ** 2).sum(axis=1)) <= radius + 1e-9).all()
    ball, rest, nearest = assign({"center": tree.center, "radius": np.array(tree.radius), "parent": np.array(tree.parent), "low": np.array(tree.low), "high": np.array(tree.high), "points": tree.points}, centroids)
    got = np.full(len(points), -1)
    for i in np.flatnonzero(ball >= 0):
        assert (got[tree.low[i] : tree.high[i]] == -1).all()
        got[tree.low[i] : tree.high[i]] = ball[i]
    assert (got[rest] == -1).all()
    got[rest] = nearest
    assert (got == [min(range(len(centroids)), key=lambda j: (((p - centroids[j]) ** 2).sum(), j)) for p in tree.points]).all()


def test_distances_beyond_doubles():
    x, c = np.array([[1 << 27, -(1 << 27)] * 32, [3] * 64]), np.array([[-(1 << 27), 1 << 27] * 32, [5] * 64])
    assert squared_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


# Token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return path, lambda text: own.encode(text or "", add_special_tokens=False).ids


PIECES = st.sampled_from(["a", "word", "Zé", "日", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "\x1c", "'s", "'ll", "1", "½", "!", ".", ", ", "<|endoftext|>", "​", "🙂", "\x00"])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=5))
def test_encoder(tokenizer, texts):
    path, encode = tokenizer
    encoder = ChunkEncoder(pathlib.Path(path).read_text(), 2)
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode([*texts, None])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encode(t) + [2] for t in [*texts, None]]


def test_encoder_forgets_and_other_kinds(tokenizer):
    path, encode = tokenizer
    text = pathlib.Path(path).read_text()
    encoder = ChunkEncoder(text, None, most=3)
    for t in ("one two three four five", "six seven, eight.", "one two nine"):
        assert encoder.encode([t])[0].tolist() == encode(t)
    # a tokenizer of another kind is asked for whole texts
    other = json.loads(text)
    other["normalizer"] = {"type": "Lowercase"}
    encoder = ChunkEncoder(json.dumps(other), 2)
    assert not encoder.cuts and encoder.encode(["One TWO"])[0].tolist() == encode("one two") + [2]
    assert ChunkEncoder(text, 2, special_as_text=False).encode(["a <|endoftext|> b"])[0].tolist() == encode("a ") + [50256] + encode(" b") + [2]


def check_files(rows, want):
    start = 0
    assert len(rows) == len(want)
    for r, (doc_id, ids) in zip(rows, want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op13(spark, tokenizer, docs_pdf):
    _, encode = tokenizer
    rows = op13_token_files(spark, DATA).orderBy("doc_id").collect()
    check_files(rows, [(r.doc_id, encode(r.text) + [2]) for r in docs_pdf.sort_values("doc_id").itertuples()])


def test_token_files_odd(spark, odd, tokenizer, tmp_path):
    path, encode = tokenizer
    write_tokens(odd, f"file://{tmp_path}/t", path)
    rows = read_tokens(spark, f"file://{tmp_path}/t")
    got = ids_crc32(rows).orderBy("start").collect()
    texts = {(r.doc_id, zlib.crc32(np.array(encode(r.text) + [2], "<u4").tobytes())) for r in odd.collect()}
    assert len(got) == odd.count() and {(r.doc_id, r.ids_crc32) for r in got} == texts
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    write_tokens(odd.where("false"), f"file://{tmp_path}/none", path)
    assert read_tokens(spark, f"file://{tmp_path}/none").collect() == []


def test_token_files_format(spark, tokenizer, tmp_path):
    """Several stripes in a file, a Bloom filter that tells absent ids, and filters and columns that reach the scan."""
    path, encode = tokenizer
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc number "), F.col("id"), F.repeat(F.lit(" and so on"), 20)).alias("text"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(7_000_001).cast("bigint")).crossJoin(spark.range(7000)).drop("id"))  # one id has a quarter of all rows
    folder = f"file://{tmp_path}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_tokens(docs, folder, path, stripe_bytes=100_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = read_tokens(spark, folder)
    assert rows.count() == 27_000 and rows.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == rows.agg(F.sum("n_tokens")).first()[0]
    assert rows.where("doc_id = 1234").select("ids").collect()[0].ids == encode("doc number 1234" + " and so on" * 20) + [2]
    parts = spark.read.orc(f"{folder}/files").where("doc_id = 7000001").select("part").distinct().count()
    assert parts > 1
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    sizes = []
    for file in pathlib.Path(tmp_path, "t", "files").glob("*.orc"):
        at = jvm.org.apache.hadoop.fs.Path(str(file))
        reader = jvm.org.apache.orc.OrcFile.createReader(at, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        sizes.append(reader.getStripes().size())
        reader.close()
    assert max(sizes) > 1

    def scanned(condition):
        frame = spark.read.orc(f"{folder}/files").where(condition).select("n_tokens")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        leaf = plan
        while leaf.children().size():
            leaf = leaf.children().head()
        assert "PushedFilters: [IsNotNull(doc_id)" in plan.toString() and "ids" not in plan.toString().split("ReadSchema")[1]
        return leaf.metrics().apply("numOutputRows").value()

    assert 0 < scanned("doc_id = 20000") <= 1000
    absent = [scanned(f"doc_id = {i}") for i in (5001, 9001, 20001, 25001, 30001)]  # within the bounds of a row group, so it takes the Bloom filter to tell
    assert absent.count(0) >= 4
    assert scanned("doc_id > 900000000") == 0
