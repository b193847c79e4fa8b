"""SimHash near-dedup by a self-join of binary tries over the fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, split_heavy, star_edges

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = 64
#: Shingles whose bits are counted at a time.
_STEP = 1 << 17


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of ``width``-word shingles (repeats count); 0 without words. Words are cut at ASCII white space, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash64(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    hashes = np.array([hash64(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64).astype(">u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _pairs(lo_a, hi_a, lo_b, hi_b, most: int):
    """Positions (i, j) of all values of pairs of nodes, at most about ``most`` at a time; a larger pair of nodes comes in strips."""
    rows = np.maximum(1, most // np.maximum(hi_b - lo_b, 1))
    strips = -((lo_a - hi_a) // rows)
    k = np.repeat(np.arange(len(lo_a)), strips)
    first = lo_a[k] + (np.arange(len(k)) - np.repeat(np.cumsum(strips) - strips, strips)) * rows[k]
    last, lo_b, width = np.minimum(first + rows[k], hi_a[k]), lo_b[k], (hi_b - lo_b)[k]
    total = np.cumsum((last - first) * width)
    at = 0
    while at < len(k):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        f, w, n = first[at:end], width[at:end], ((last - first) * width)[at:end]
        inside, w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(w, n)
        yield np.repeat(f, n) + inside // w, np.repeat(lo_b[at:end], n) + inside % w
        at = end


def trie_join(left: np.ndarray, right: np.ndarray | None, start: int, budgets: list[int], leaf: int = 64, most: int = 1 << 21):
    """Positions (i, j), in pieces of bounded size, of the pairs of sorted uint64 arrays that differ in at most ``budgets[-1]`` bits; ``right`` None: pairs i < j within ``left``.

    The two sorted arrays are binary tries: a node is a range of values with a common prefix. Pairs of nodes go down
    together, one bit at a time from bit ``start``; a pair of unlike children adds one error, and a pair leaves when its errors after
    bit k exceed ``budgets[k]``. Pairs of nodes with few values are compared directly.
    """
    same = right is None
    right = left if same else right
    one = np.int64(1)
    lo_a, hi_a = np.array([0]), np.array([len(left)])
    lo_b, hi_b = np.array([0]), np.array([len(right)])
    errors = np.array([0])
    if not same and len(left) and len(right):
        errors = np.array([int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(BITS - start)))]) if start else errors
    for bit in range(start, BITS + 1):
        size_a, size_b = hi_a - lo_a, hi_b - lo_b
        small = (size_a * size_b <= leaf) | (bit == BITS)
        if small.any():
            for i, j in _pairs(lo_a[small], hi_a[small], lo_b[small], hi_b[small], most):
                near = np.bitwise_count(left[i] ^ right[j]) <= budgets[-1]
                if same:
                    near &= i < j
                yield i[near], j[near]
        go = ~small
        if not go.any():
            break
        lo_a, hi_a, lo_b, hi_b, errors = lo_a[go], hi_a[go], lo_b[go], hi_b[go], errors[go]
        shift = np.uint64(BITS - 1 - bit)
        ones_a = np.concatenate([[0], np.cumsum((left >> shift) & np.uint64(1), dtype=np.int64)])
        ones_b = ones_a if same else np.concatenate([[0], np.cumsum((right >> shift) & np.uint64(1), dtype=np.int64)])
        mid_a, mid_b = hi_a - (ones_a[hi_a] - ones_a[lo_a]), hi_b - (ones_b[hi_b] - ones_b[lo_b])
        unlike = errors + one
        twin = same & (lo_a == lo_b) & (hi_a == hi_b)
        down = [
            (lo_a, mid_a, lo_b, mid_b, errors, None),
            (mid_a, hi_a, mid_b, hi_b, errors, None),
            (lo_a, mid_a, mid_b, hi_b, unlike, None),
            (mid_a, hi_a, lo_b, mid_b, unlike, ~twin),
        ]
        kept = [[], [], [], [], []]
        for *child, extra in down:
            ok = (child[1] > child[0]) & (child[3] > child[2]) & (child[4] <= budgets[bit])
            if extra is not None:
                ok &= extra
            for to, x in zip(kept, child):
                to.append(x[ok])
        lo_a, hi_a, lo_b, hi_b, errors = (np.concatenate(x) for x in kept)
        if not len(lo_a):
            break


def spanning(pairs, ids_a: np.ndarray, ids_b: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the graph of all the pairs of positions (those for which keep(i, j) holds), held as at most one for each id."""
    a = b = np.empty(0, np.int64)
    held, count = [], 0
    for i, j in pairs:
        if keep is not None:
            near = keep(i, j)
            i, j = i[near], j[near]
        held.append((i, j))
        count += len(i)
        if count > 1 << 20:
            a, b = star_edges(np.concatenate([a, *(ids_a[i] for i, _ in held)]), np.concatenate([b, *(ids_b[j] for _, j in held)]))
            held, count = [], 0
    return star_edges(np.concatenate([a, *(ids_a[i] for i, _ in held)]), np.concatenate([b, *(ids_b[j] for _, j in held)]))


def _starts(blocks: int) -> list[int]:
    """First bits of ``blocks`` disjoint blocks, and the end."""
    return [round(k * BITS / blocks) for k in range(blocks + 1)]


def _links(depth: int, budget: int, blocks: int):
    """Links within one pair of nodes at ``depth``: spanning edges between ids."""
    starts, per_block = _starts(blocks), budget // blocks

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "bits"])
        trie = int(pdf["trie"].iloc[0])
        width = starts[trie + 1] - starts[trie]
        bits = pdf["bits"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(bits, kind="stable")
        bits, ids = bits[order], pdf["id"].to_numpy(np.int64)[order]
        if depth:
            prefix = bits >> np.uint64(BITS - depth)
            cut = int(np.searchsorted(prefix, prefix[0], "right"))
        else:
            cut = len(bits)
        budgets = [per_block] * width + [budget] * (BITS - width)
        if bool(pdf["twin"].iloc[0]):
            a, b = spanning(trie_join(bits, None, depth, budgets), ids, ids)
        else:  # if one of the two nodes has no value here, there is no pair
            a, b = spanning(trie_join(bits[:cut], bits[cut:], depth, budgets) if cut < len(bits) else [], ids[:cut], ids[cut:])
        return pd.DataFrame({"a": a, "b": b})

    return links


def simhash_links(prints: DataFrame, budget: int = 4, blocks: int = 3, node_rows: int = 4096, heavy_rows: int = 50_000) -> DataFrame:
    """Edges ``a``, ``b`` that connect all ids whose distinct fingerprints differ in at most ``budget`` bits (columns ``id``, ``bits``).

    Of ``blocks`` blocks of bits one has at most budget // blocks errors, so one trie per block, which begins with that block, is
    walked with that stricter budget at first. Each trie is cut at a depth at which nodes have about ``node_rows`` values; pairs of
    nodes within the stricter budget there (the node itself, and each one-bit neighbour) are the groups that Spark deals
    to tasks, which walk down the rest. A pair of nodes with more than ``heavy_rows`` values is dealt in pairs of chunks.
    """
    if budget // blocks > 1:
        raise ValueError("more than one error a block isn't supported; take more blocks")
    count = prints.count()
    starts = _starts(blocks)
    depth = max(0, min(BITS // blocks, math.ceil(math.log2(max(1, count) / node_rows))))
    turns = []
    for k, at in enumerate(starts[:-1]):
        turns.append(F.struct(F.lit(k).alias("trie"), (F.shiftleft("bits", at).bitwiseOR(F.shiftrightunsigned("bits", BITS - at)) if at else F.col("bits")).alias("bits")))
    rows = prints.select("id", F.explode(F.array(*turns)).alias("t")).select("id", "t.trie", "t.bits")
    node = F.shiftrightunsigned("bits", BITS - depth) if depth else F.lit(0).cast("bigint")
    flips = [F.lit(0)] + ([F.lit(1 << i) for i in range(depth)] if budget // blocks else [])
    rows = rows.withColumn("node", node).withColumn("flip", F.explode(F.array(*[x.cast("bigint") for x in flips])))
    other = F.col("node").bitwiseXOR(F.col("flip"))
    key = (F.least("node", other) * (depth + 1) + F.when(F.col("flip") == 0, 0).otherwise(F.log2(F.col("flip").cast("double")).cast("bigint") + 1)) * blocks + F.col("trie")
    rows = rows.select(key.alias("pair"), (F.col("flip") == 0).alias("twin"), "trie", "id", "bits")
    rows = split_heavy(rows, "pair", heavy_rows)
    return rows.groupBy("pair", "part").applyInPandas(_links(depth, budget, blocks), "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, blocks: int = 3) -> DataFrame:
    """One row for each input row: ``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Equal fingerprints are one value with their smallest id before the join, so a group of copies of any size is one
    entry of the tries. Null texts count as empty; texts without words have fingerprint zero and link like any other.
    Rows with a null id have a fingerprint and the component of their equals, but name no component (null if they are alone).
    Repeated rows give repeated results. Other columns are not read; an empty table gives an empty result.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.array([fingerprint(t, width) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "bits": bits})

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(source.mapInPandas(prints, "id bigint, bits bigint"), "simhash")
    distinct = materialise(rows.groupBy("bits").agg(F.min("id").alias("id")), "simhash")
    edges = simhash_links(distinct.where("id IS NOT NULL"), budget, blocks)
    parts = connected_components(edges)
    named = distinct.join(parts, distinct["id"] == parts["node"], "left").select("bits", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, "bits", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Prefix bits of a trie for near duplicates, and words of 64 bits that all tries share.
_PREFIX, _SHARED = 12, 3


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``width``-word shingles (a shorter text is one), words as in ``fingerprint``; empty without words."""
    import xxhash

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(max(1, len(words) - width + 1))], np.uint64))


def wide_print(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` * 64 bits: each shingle hash is mixed anew for every word."""
    ones = np.zeros(words * BITS, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(shingles), 4096):
        z = shingles[i : i + 4096, None] + salt
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype(">u8").view(np.uint8).reshape(len(z), -1), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(shingles)).view(">u8").astype(np.uint64)


def similar(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that span the graph of all pairs of sets with a Jaccard similarity of at least ``similarity``: a search that compares a set with those not yet reached."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    left, tokens, begin = np.arange(len(sets)), flat, first
    edges: list[tuple[int, int]] = []
    alive = np.ones(len(sets), bool)
    for start in range(len(sets)):
        stack = [start] if alive[start] else []
        alive[start] = False
        while stack:
            x = stack.pop()
            if 2 * alive[left].sum() <= len(left):  # read only sets that may still be reached
                left = left[alive[left]]
                tokens = np.concatenate([flat[first[k] : first[k] + size[k]] for k in left] or [flat[:0]])
                begin = np.cumsum(size[left]) - size[left]
            if not len(left):
                return edges
            own = flat[first[x] : first[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[tokens], begin)
            mark[own] = 0
            for k in left[alive[left] & (both >= similarity * (size[x] + size[left] - both) - 1e-9)].tolist():
                edges.append((x, k))
                alive[k] = False
                stack.append(k)
    return edges


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, tries: int = 32, id_col: str = "doc_id", text_col: str = "text", node_rows: int = 4096, heavy_rows: int = 16_384, heavy_sets: int = 2048,
) -> DataFrame:
    """``node``, ``component`` for ids that aren't the smallest of their component of documents of a ``width``-word shingle similarity from ``similarity`` on.

    Two documents of Jaccard similarity s differ in a share of arccos(2s / (1 + s)) / pi of their SimHash bits (0.15 at 0.8), too many for 64 bits and
    a budget of a few errors. So the prints are wider, and there are ``tries`` binary tries, each of which begins with 12 bits of its own and
    goes on with bits that all share. Each is joined with itself: pairs of nodes go down together, without an error in
    the first 12 bits, and then with a budget that grows with the depth, 3.3 deviations above the errors expected at ``similarity``. A pair at 0.8 shares
    the beginning in one of 32 tries at least with a chance of 0.99, one at 0.9 with 0.9999. What the tries link makes candidate components, and within
    each of them the shingle sets decide every pair exactly, so no link below ``similarity`` is made, and one that the tries missed is
    found if others connect its ends.

    Equal sets are one before the tries. A node of more than ``heavy_rows`` prints and a candidate component of more than ``heavy_sets``
    sets are dealt in pairs of chunks. Null ids and texts without words link with nothing; an empty table gives an empty result.
    Rows that repeat an id are one node.
    """
    unlike = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    allowed = lambda n: math.floor(n * unlike + 3.3 * math.sqrt(n * unlike * (1 - unlike)) + 0.5)
    budgets = [0] * _PREFIX + [allowed(k) for k in range(1, BITS - _PREFIX + 1)]
    whole = allowed(BITS - _PREFIX + BITS * (_SHARED - 1))
    own_words = -(-tries * _PREFIX // BITS)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                s = shingle_set(text, width)
                if len(s):
                    bits = wide_print(s, _SHARED + own_words)
                    own = np.unpackbits(bits[_SHARED:].astype(">u8").view(np.uint8))[: tries * _PREFIX].reshape(tries, _PREFIX)
                    digest = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)
                    out.append((i, digest, bits[:_SHARED].view(np.int64), own @ (1 << np.arange(_PREFIX - 1, -1, -1))))
            yield pd.DataFrame(out, columns=["id", "digest", "shared", "own"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = (pdf["own"].to_numpy(np.uint64) << np.uint64(BITS - _PREFIX)) | (pdf["bits"].to_numpy(np.int64).view(np.uint64) >> np.uint64(_PREFIX))
        order = np.argsort(bits, kind="stable")
        bits, ids = bits[order], pdf["id"].to_numpy(np.int64)[order]
        more = [pdf[c].to_numpy(np.int64).view(np.uint64)[order] for c in ("more1", "more2")]
        keep = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]) + sum(np.bitwise_count(m[i] ^ m[j]) for m in more) <= whole
        a, b = spanning(trie_join(bits, None, depth, budgets), ids, ids, keep)
        return pd.DataFrame({"a": a, "b": b})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingle_set(t, width) for t in pdf["text"]]
            some = [len(s) > 0 for s in own]
            yield pd.DataFrame({"component": pdf["component"][some], "id": pdf["id"][some], "hashes": [s.tobytes() for s in own if len(s)]})

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        edges = np.array(similar([np.frombuffer(b, np.uint64) for b in pdf["hashes"]], similarity), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(source.mapInPandas(sign, "id bigint, digest bigint, shared array<bigint>, own array<int>"), "near")
    distinct = rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("shared").alias("shared"), F.min("own").alias("own"))
    distinct = materialise(distinct, "near")
    equal = rows.join(distinct.where("id <> last").select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    depth = max(0, min(_PREFIX, math.ceil(math.log2(max(1, distinct.count()) / node_rows))))
    each = distinct.select("id", "shared", F.posexplode("own").alias("trie", "own"))
    node = F.shiftright("own", _PREFIX - depth) * tries + F.col("trie")
    each = each.select(node.alias("node"), "id", "own", *[F.get("shared", F.lit(k)).alias(c) for k, c in enumerate(("bits", "more1", "more2"))])
    found = split_heavy(each, "node", heavy_rows).groupBy("node", "part").applyInPandas(links, "a bigint, b bigint")
    maybe = connected_components(found)
    members = maybe.select(F.col("node").alias("id"), "component").unionAll(maybe.select(F.col("component").alias("id"), "component").distinct())
    full = materialise(source.join(members.hint("merge"), "id").mapInPandas(sets, "component bigint, id bigint, hashes binary").dropDuplicates(["id", "hashes"]), "near")
    pairs = split_heavy(full, "component", heavy_sets).groupBy("component", "part").applyInPandas(verified, "a bigint, b bigint")
    return connected_components(pairs.unionAll(equal))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_dedup`` over all of ``documents``."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
