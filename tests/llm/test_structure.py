"""Sharding, whitening and the prefix trie against brute force, and their defined edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import prefix_trie, sharding, whitening
from voltide.llm.prefix_sums import running

# prefix sums


def test_running_sums_and_xors_over_partitions(spark):
    rows = [(k % 7, k * 37 % 101, k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(5)
    got = running(df, [F.col("a"), F.col("b").desc(), F.col("v")], {"s": F.col("v"), "n": F.lit(1)}, {"x": F.col("v")})
    assert got.columns == ["a", "b", "v", "s", "n", "x"]
    s = n = x = 0
    want = set()
    for a, b, v in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        s, n, x = s + v, n + 1, x ^ v
        want.add((a, b, v, s, n, x))
    assert {tuple(r) for r in got.collect()} == want


def test_running_deals_out_equal_rows(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("k")).repartition(4)
    got = running(df, [F.col("k")], {"n": F.lit(1)})
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001))


# 11


def brute_shards(rows, shards, overhead=16):
    """rows: (id, text); by the running sum over one list."""
    listed = sorted(((i, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    every, upto, slots, out = sum(r[1] for r in listed), 0, Counter(), []
    for i, size, crc in listed:
        shard = (2 * upto + size) * shards // (2 * every)
        out.append((i, size, crc, shard, slots[shard]))
        upto, slots[shard] = upto + size, slots[shard] + 1
    return out


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_match_brute_force(docs, shards):
    want = brute_shards([(r.doc_id, r.text) for r in docs.collect()], shards)
    assert Counter(map(tuple, sharding.assign(docs, shards).collect())) == Counter(want)


def test_shards_edges(edge, empty):
    got = sharding.assign(edge, 5)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_shards([(r.doc_id, r.text) for r in edge.collect()], 5))
    assert sharding.assign(empty, 5).count() == 0


def test_a_document_of_more_than_a_share_leaves_shards_empty(spark):
    df = spark.createDataFrame([(k, "x" * (5000 if k == 5 else 10)) for k in range(10)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.assign(df, 4).collect()}
    assert got[4] == 0 and got[5] == 2 - (got[5] == 1) and got[6] == 3


def test_text_ids_are_sharded_in_their_order(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "2"), (None, "3")], "doc_id string, text string")
    assert [(r.doc_id, r.slot) for r in sorted(sharding.assign(df, 1).collect(), key=lambda r: r.slot)] == [("a", 0), ("b", 1), (None, 2)]


def test_written_shards_hold_every_row_in_order(spark, edge, tmp_path):
    wide = edge.withColumn("shard", F.lit("theirs"))
    sharding.write_shards(wide, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 14 and {r.shard_before for r in got.collect()} == {"theirs"}
    assert Counter((r.doc_id, r.text, r.row) for r in got.collect()) == Counter((r.doc_id, r.text, r.row) for r in edge.collect())
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# 12


def whole(vectors):
    return np.floor(np.array(vectors, dtype=float) * 1024) + 100_000


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_cholesky_and_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d + 3)) * np.logspace(0, -5, d)[:, None]
    v = a @ a.T
    factor, order = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-13)
    assert np.all(np.diff(np.diag(factor)) <= 1e-12) and np.allclose(factor, np.tril(factor))
    turned = whitening.one_sided_jacobi(factor)
    products = turned.T @ turned
    scale = np.sqrt(np.outer(products.diagonal(), products.diagonal()))
    assert np.max(np.abs(products / scale - np.eye(len(products)))) < 1e-13
    assert np.allclose(np.sort(products.diagonal()), np.sort(np.linalg.eigvalsh(v)), rtol=1e-6, atol=1e-13)


def test_whitening_matches_an_eigensolver(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = whole([r.embedding for r in rows])
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    z = c @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    got = whitening.op12_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * len(rows)
    at = {r.vec_id: k for k, r in enumerate(rows)}
    found = np.zeros_like(z)
    for r in got:
        found[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(found - z * np.sign((found * z).sum(axis=0))).max() < 1e-9
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    exact = {r.vec_id: sum((n * int(q) - t) ** 2 for q, t in zip(x[at[r.vec_id]], s)) for r in rows}
    assert all(r.deviation == exact[r.vec_id] and r.n == n for r in got)
    assert all(abs(r.explained - e[::-1][r.component - 1] / e.sum()) < 1e-12 for r in got)
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1


SCHEMA = "vec_id long, embedding array<float>, deviation string, v long, whitened string"


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.5]), (2, [2.0, 1.0, 0.5]), (None, [0.0, 0.0, 1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 2.0]), (6, [1.0, inf, 2.0]), (7, []), (8, [1.0]), (9, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame([(i, e, "theirs", 1, "theirs") for i, e in vectors], SCHEMA).repartition(3)
    model = whitening.Whitening.fit(df)
    assert (model.n, model.d) == (4, 3)
    out = model.transform(df, 2)
    assert out.columns == ["vec_id", "embedding", "deviation_before", "v", "whitened_before", "deviation", "whitened"]
    assert Counter(r.vec_id for r in out.collect()) == Counter([1, 2, 2, None])
    assert whitening.identity_error(out, 2) < 1e-12
    # four points in a plane at most: a third component of a third, equal dimension has no variance
    flat = spark.createDataFrame([(k, [float(k), float(-k), 0.25 * k * k], "", 0, "") for k in range(6)], SCHEMA)
    model = whitening.Whitening.fit(flat)
    assert len(model.eigenvalues) == 2 and model.explained(8)[2] == 0.0
    assert all(r.whitened[2] is None and r.whitened[1] is not None for r in model.transform(flat).collect())
    one = whitening.Whitening.fit(flat.limit(1))
    assert one.explained(8) == [None] * 3 and one.transform(flat.limit(1)).first().whitened == [None] * 3


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(k, [1e9 + k * 1e7, -3e8 * k], "", 0, "") for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string, v long, whitened string")
    model = whitening.Whitening.fit(df)
    x = [[int(np.floor(c * 1024)) + 100_000 for c in r[1]] for r in rows]
    assert model.sums == [sum(c) for c in zip(*x)]
    assert abs(model.eigenvalues.sum() / model.trace - 1) < 1e-12
    n, s = 5, model.sums
    want = {k: sum((n * c - t) ** 2 for c, t in zip(v, s)) for k, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in model.transform(df).collect()} == {k: v if v < 2**63 else None for k, v in want.items()}


def test_whitening_of_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, "", 0, "")], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# 13


def brute_trie(rows, rebuild=True):
    """rows: (conv_id, turn, role, text), turns in order; every prefix of every conversation in one dictionary."""
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role or "", text or ""))
    nodes, kids = defaultdict(list), defaultdict(list)
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        s = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append((c, d == len(s)))
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ids = ",".join(str(c) for c, ends in sorted(nodes[p]) if ends)
        first = lambda q: min(c for c, _ in nodes[q])
        out.append((first(p), len(p), first(p[:-1]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


def in_turn_order(df):
    """Turns of one number are in the order of their hashes."""
    hashes = [F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("t1")]
    rows = df.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", *hashes).collect()
    return [r[:4] for r in sorted(rows, key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.t1))]


def test_trie_matches_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert Counter(map(tuple, prefix_trie.op13_prefix_trie(spark, sf_dir).collect())) == brute_trie(in_turn_order(df))


@pytest.fixture(scope="module")
def talks(spark):
    """Copies, branches, prefixes of each other, ties, nulls everywhere, long shared chains, turnless rebuilt conversations."""
    rows = []
    chain = [("user" if k % 2 else "assistant", f"turn {k} ü") for k in range(12)]
    for c in range(100, 118):  # copies, cut and varied
        said = chain[: 12 - c % 4] + ([("user", f"own {c % 3}")] if c % 5 == 0 else [])
        rows += [(c, k, *s) for k, s in enumerate(said)]
    rows += [(c, 0, "user", "only") for c in range(201, 230)]  # no conversation 200: those with h > 0 have no turns
    rows += [(300, None, None, None), (300, 0, "", ""), (300, 0, "user", None), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "user", "a"), (None, 0, "user", "nobody"), (-7, 1, "user", "below zero")]
    rows += [(400, k, "user", "x" * 70_000 if k == 3 else "same") for k in range(40)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, place long").repartition(3)


def test_trie_edges(spark, talks, tmp_path):
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == brute_trie(in_turn_order(talks))


def test_trie_of_conversations_as_they_are(talks):
    got = prefix_trie.prefix_trie(prefix_trie.turns_of(talks.where("conv_id >= 100")))
    assert Counter(map(tuple, got.collect())) == brute_trie(in_turn_order(talks.where("conv_id >= 100")), rebuild=False)


def test_trie_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert prefix_trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_lists_of_many_ids_are_hashed_in_pieces(spark):
    ids = [k * 3 for k in range(9000)]
    df = spark.createDataFrame([(c, 0, "user", "same") for c in ids], "conv_id long, turn long, role string, text string").repartition(4)
    got = prefix_trie.prefix_trie(prefix_trie.turns_of(df)).where("depth = 1").first()
    assert got.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got.n_convs == 9000
