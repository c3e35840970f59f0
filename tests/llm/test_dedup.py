"""Deduplication operators against brute force, and their defined edge cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voltide.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from voltide.llm.substring_dedup import word_edges, word_hashes
from voltide.llm.suffix_dedup import suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(texts, width=100):
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                gone[k : k + width] = b"\1" * width
            else:
                seen.add(b[k : k + width])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def in_order(df):
    """Rows as numbered() orders them: by doc_id, null last."""
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_suffix_dedup_matches_brute_force(docs):
    o = in_order(docs)
    want = Counter((r.doc_id, *w) for r, w in zip(o, brute_bytes([r.text for r in o])))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == want


def test_suffix_dedup_edges(edge, empty):
    got = suffix_dedup.suffix_dedup(edge).collect()
    assert len(got) == 14
    o = in_order(edge)
    # rows of one id stand in some order of their own: one of the orders gives every column of every row
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    groups = [list(g) for _, g in itertools.groupby(o, key=lambda r: r.doc_id)]
    orders = itertools.product(*[itertools.permutations(g) for g in groups])
    assert any(Counter((r.doc_id, *w) for r, w in zip(rows, brute_bytes([r.text for r in rows]))) == found for rows in (sum(map(list, x), []) for x in orders))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    t = np.r_[rng.integers(1, 3 + seed, 300), 0].astype(np.uint16)
    if seed % 2:
        t[50:150] = t[150:250]
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix_order(t, 400).tolist() == want


def brute_words(texts, width=35):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_substring_dedup_matches_brute_force(name, request):
    df = request.getfixturevalue(name)
    o = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(o, brute_words([r.text for r in o])))
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(df).collect()) == want


def test_heavy_keys_take_the_exact_way(docs, monkeypatch):
    want = Counter(map(tuple, substring_dedup.substring_dedup(docs).collect()))
    first = Counter(map(tuple, suffix_dedup.suffix_dedup(docs).collect()))
    monkeypatch.setattr(substring_dedup, "MOST", 1)
    monkeypatch.setattr(suffix_dedup, "MOST", 1)
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == want
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == first


def test_word_hashes_tell_words_apart():
    raw = np.frombuffer(b" ab ba ab\tabc  a", dtype=np.uint8)
    starts, ends = word_edges(raw)
    h = word_hashes(raw)
    assert [bytes(raw[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"ba", b"ab", b"abc", b"a"]
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = [x for x in WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 30)])
def test_jaccard_components_match_brute_force(docs, words, percent):
    o = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sizes, comps = brute_components([r.text for r in o], words, percent)
    want = {r.doc_id: (n, o[c].doc_id) for r, n, c in zip(o, sizes, comps)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, jaccard_join.Rule(words, percent)).collect()}
    assert got == want


def test_jaccard_edges(edge, empty):
    got = jaccard_join.jaccard_components(edge, jaccard_join.Rule(4, 85)).collect()
    assert len(got) == 14
    of = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert of[(7, 1)] == of[(8, 1)] == 7 and of[(4, 0)] == 4 and of[(5, 0)] == 5
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.one_of_each(edge).columns == edge.columns


def test_signature_tree_drops_no_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 120).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.r_[base[k % 20][: 120 - k // 20], rng.integers(0, 2**63, k // 20).astype(np.uint64)]) for k in range(300)]
    order = sorted(range(300), key=lambda i: len(sets[i]))  # as blocks are laid out
    sets = [sets[i] for i in order]
    rule = jaccard_join.Rule(5, 80)
    marks = [jaccard_join.marks(s) for s in sets]
    assert all((jaccard_join.unpack_marks(jaccard_join.pack_marks(m)) == m).all() for m in [*marks, np.zeros(0, np.uint16)])
    found = set()
    for i, j, _ in jaccard_join.task_pairs(np.array([len(s) for s in sets]), marks, np.arange(300), np.zeros(300, np.int64), 80):
        found |= {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if rule.linked(sets[i], sets[j])}
    assert want <= found and len(found) < 300 * 299 / 4


def test_exact_dedup(edge, empty, spark):
    got = exact_dedup.exact_dedup(edge).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    assert len(got) == 14
    for rows in groups.values():
        assert {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
    assert hashlib.sha256(b"").hexdigest() in groups and len(groups[hashlib.sha256(b"").hexdigest()]) == 4
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.kept_rows(edge).count() == len(groups)


def test_exact_dedup_appends_only_what_is_new(edge, spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_twice")
    first = index.add(edge).where("kept").count()
    assert index.read().count() == first
    again = index.add(edge).collect()
    assert not any(r.kept for r in again) and index.read().count() == first
    more = spark.createDataFrame([(77, "something new"), (78, PASSAGE_TEXT)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in index.add(more).collect()} == {77: True, 78: False}
    assert index.read().count() == first + 1


PASSAGE_TEXT = " ".join(f"word{i} größe" for i in range(60))


def test_a_batch_added_again_keeps_what_it_kept(edge, spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_again")
    first = Counter((r.doc_id, r.kept) for r in index.add(edge, batch="one").collect())
    rows = index.read().count()
    assert Counter((r.doc_id, r.kept) for r in index.add(edge, batch="one").collect()) == first and index.read().count() == rows


def test_exact_dedup_leaves_no_index_behind(edge, spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(edge).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_dedup_compares_the_first_batch_with_its_index(edge, spark, monkeypatch):
    reads, read = [], exact_dedup.DigestIndex.read
    monkeypatch.setattr(exact_dedup.DigestIndex, "read", lambda self: (reads.append(read(self).count()), read(self))[1])
    index = exact_dedup.DigestIndex(spark, "digest_index_first")
    kept = index.add(edge).where("kept").count()
    assert reads == [0, kept]
