"""N-gram Jaccard join with signature trees; no link between different texts is lost.

Texts with equal shingle sets form a class, of which one representative goes on. The trees' first level is the shingle:
a fixed-size sketch of how many texts have one gives all shingles one order, rare ones first, and linked sets share c
shingles among the first n - ceil(t * n) + c of either, so texts that share fewer can't overlap enough. The texts that
share one are a block; shingles with the same texts and blocks with the same smallest text count as one, and texts leave
that share too few of their first shingles or have none of like size beside them. Over each block stands a signature tree
(nodes: OR-combined bitmaps, size ranges, component ranges), and a dual traversal drops node pairs that can't hold a link
between components. In each of ROUNDS rounds every text has the one pair with another component verified that the bounds
rate highest, which is linear and joins most of what is linked. Then all pairs are verified that may still link two
components, and those alone.

Defined cases: a text of fewer than `words` words is one shingle; a null or empty text has none and is linked with
nothing; repeated rows form a class; ids may be null or repeat (a component's id is the smallest that is not null, if
any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, identified, shuffle_partitions, swept, table, written
from .shingling import shingle_sets, slices
from .superkmers import numbered

CELLS = 1 << 17  # of each of the sketch's two rows
BITS, SPREAD, MOST_BITS = 2048, 32, 1 << 16  # least bits of a bitmap, bits a shingle, most bits
LEAF, FANOUT = 16, 8
COMMON = 40  # so many shingles of a set ask for one more that its prefix shares
TILE = 4096  # texts of a block that one tree stands over; larger blocks are pairs of tiles
TASK_BYTES = 32 << 20  # bitmaps of a task's blocks, on average
ROUNDS = 2  # of best pairs
FEW = 100_000  # ids, at most, that are broadcast
Portion = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; links of `percent` per cent similarity or more."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """Among so many first shingles of either, linked sets share `common` of the smaller one."""
        return min(n, n - -(-self.percent * n // 100) + self.common(n)) if n else 0

    def common(self, n):
        """Shingles that the prefix of a set of n must share, for a number or a column of them."""
        return 1 + (n // COMMON if isinstance(n, int) else F.floor(n / COMMON))

    def near(self, less: str, more: str):
        """Whether sets of these sizes (columns, the first no larger) can be linked; not, if one is missing."""
        return F.coalesce(100 * F.col(less) >= self.percent * F.col(more), F.lit(False))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def shingles(text: bytes, words: int) -> np.ndarray:
    return shingle_sets([text], words)[0]


def _spots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(CELLS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64)


def sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Two rows of CELLS counts of texts by shingle: a fixed size, whatever the input."""
    parts, width = 64, 2 * CELLS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for row, spot in zip(total, _spots(shingle_sets(texts[a:b], rule.words)[0])):
                    row += np.bincount(spot, minlength=CELLS)
        flat = total.reshape(parts, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in rows["counts"])
        return pd.DataFrame({"part": rows["part"][:1], "counts": [total.tobytes()]})

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros((parts, width), dtype=np.int64)
    for r in found.collect():
        out[r.part] = np.frombuffer(r.counts, dtype=np.int64)
    return out.reshape(2, CELLS)


def ordered(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers that sort shingles in the order that all texts share: the count's power of two, halves told apart, then the hash.

    Shingles that happen to share a number meet in one block, which only adds pairs to look at.
    """
    a, b = _spots(h)
    seen = np.minimum(counts[0][a], counts[1][b])
    level = np.floor(2 * np.log2(np.maximum(seen, 1))).astype(np.uint64)
    return (level << np.uint64(56)) | (h >> np.uint64(8))


def marks(h: np.ndarray) -> np.ndarray:
    """A set's bits in the widest bitmap, one a shingle; a narrower bitmap takes their low bits."""
    return np.sort(((h >> np.uint64(20)) & np.uint64(MOST_BITS - 1)).astype(np.uint16))


def pack_marks(own: np.ndarray) -> bytes:
    """Marks as steps from one to the next, low bytes before high ones, of which most are 0 and cost a shuffle little."""
    return np.diff(own, prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_marks(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
    return np.cumsum(steps, dtype=np.uint16)


def width(n: np.ndarray | int) -> np.ndarray:
    """Bits of the bitmap of a set of n shingles: a power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(np.asarray(n) * SPREAD, 1))).astype(np.int64), BITS, MOST_BITS)


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=bool)
    out[own & (bits - 1)] = True
    return np.packbits(out).view(np.uint64)


def _described(docs: DataFrame, rule: Rule, spread) -> DataFrame:
    """A row a text: id, doc_id, n, digest, keys (the prefix), packed (the text, compressed)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, press = spread.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                flat, begin = shingle_sets(texts[a:b], rule.words)
                place, size = ordered(flat, counts), np.diff(begin)
                sets = [flat[x:y] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                keys = []
                for x, n in zip(begin[:-1].tolist(), size.tolist()):
                    place[x : x + n].sort()
                    keys.append(place[x : x + rule.prefix(n)].view(np.int64))
                edges = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()),
                    pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], pa.binary()),
                    pa.ListArray.from_arrays(edges, pa.array(np.concatenate(keys))),
                    pa.array([press.compress(t) for t in texts[a:b]], pa.binary()),
                ], names=["id", "doc_id", "n", "digest", "keys", "packed"])

    given = docs.select("id", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(describe, "id long, doc_id string, n long, digest binary, keys array<long>, packed binary")


def _marked(texts: DataFrame, rule: Rule) -> DataFrame:
    """id, packed, marks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [unpack.decompress(x) for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                flat, begin = shingle_sets(texts[a:b], rule.words)
                own = [pack_marks(marks(flat[x:y])) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(own, pa.binary())], names=["id", "packed", "marks"])

    return texts.select("id", "packed").mapInArrow(mark, "id long, packed binary, marks binary")


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of (a, b) pairs those that are links, by their whole sets. texts: id, packed."""
    texts = _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    one = texts.select(F.col("id").alias("a"), F.col("packed").alias("left"))
    two = texts.select(F.col("id").alias("b"), F.col("packed").alias("right"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = dict(zip(batch["a"], batch["left"])) | dict(zip(batch["b"], batch["right"]))
            pairs, k = list(zip(batch["a"].tolist(), batch["b"].tolist())), 0
            keep = np.zeros(len(pairs), dtype=bool)
            while k < len(pairs):  # as many pairs at once as have about a slice of text
                first, texts, size = k, {}, 0
                while k < len(pairs) and (k == first or size < 1 << 20):
                    for i in pairs[k]:
                        if i not in texts:
                            texts[i] = unpack.decompress(packed[i])
                            size += len(texts[i])
                    k += 1
                flat, begin = shingle_sets(list(texts.values()), rule.words)
                at = {i: flat[x:y] for i, x, y in zip(texts, begin[:-1].tolist(), begin[1:].tolist())}
                for p in range(first, k):
                    keep[p] = rule.linked(at[pairs[p][0]], at[pairs[p][1]])
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return both.mapInPandas(check, "a long, b long")


def components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp with the components that links (u, v: labels of linked components) join given one label, the smallest.

    Each round takes the smallest label among neighbours, then that label's own; rounds grow with the logarithm of the
    longest way, and only labels that links touch take part.
    """
    edges = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("to"))
    while True:
        seen = edges.join(state, F.col("v") == F.col("node")).select("u", "to", F.lit(None).cast("long").alias("own"))
        seen = seen.unionByName(state.select(F.col("node").alias("u"), "to", F.col("to").alias("own")))
        new = seen.groupBy("u").agg(F.min("to").alias("new"), F.max("own").alias("old"))
        hop = new.select(F.col("u").alias("h"), F.col("new").alias("of_h"))
        new = cut(new.join(hop, F.col("new") == F.col("h")).select(F.col("u").alias("node"), F.col("of_h").alias("to"), (F.col("of_h") != F.col("old")).alias("changed")))
        state = new.select("node", "to")
        if not new.agg(F.max("changed")).first()[0]:
            return cut(comps.join(state, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("to", "comp").alias("comp")))


def rate(level: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The largest overlap that pairs of a level's nodes can have, as a part of both sizes.

    0 where it is too small for a link, and for pairs within one component.
    """
    _, _, least, most, more, mask, low, high = level
    fits = (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
    fits &= ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
    rated = np.zeros(len(i))
    some = np.flatnonzero(fits)
    step = max(1, (1 << 21) // mask.shape[1])
    for k in range(0, len(some), step):
        s = some[k : k + step]
        shared = np.bitwise_count(mask[i[s]] & mask[j[s]]).sum(axis=1, dtype=np.int64)
        bound, both = np.minimum(more[i[s]], more[j[s]]) + shared, least[i[s]] + least[j[s]]
        # overlap >= t / (1 + t) of both sizes together
        rated[s] = np.where((100 + percent) * bound >= percent * both, bound / np.maximum(both, 1), 0)
    return rated


def leaves(n: np.ndarray, bits: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree's lowest level: first and last text, least and most size, shingles that share a bit, bits, component range."""
    extra = n - np.bitwise_count(bits).sum(axis=1)
    return np.arange(len(n)), np.arange(1, len(n) + 1), n, n, extra, bits, comp, comp


class SignatureTree:
    """A block's texts in order of size, in leaves of LEAF, under nodes of FANOUT children."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        level = leaves(n, bits, comp)
        self.levels = [level]
        for size in (LEAF, *[FANOUT] * 40):
            if len(level[0]) == 1:
                break
            at = np.arange(0, len(level[0]), size)
            first, last, least, most, more, mask, low, high = level
            level = (first[at], np.r_[last[at[1:] - 1], last[-1]], np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(more, at), np.bitwise_or.reduceat(mask, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            self.levels.append(level)
        self.sizes = [LEAF, *[FANOUT] * 40][: len(self.levels) - 1]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j, _ in self.rated_pairs(percent):
            yield i, j

    def rated_pairs(self, percent: int) -> Iterator[Portion]:
        """Text pairs (i < j) that bounds don't exclude, rated, by a traversal of the tree against itself, in portions."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            depth, i, j = stack.pop()
            rated = rate(self.levels[depth], i, j, percent)
            keep = rated > 0
            i, j, rated = i[keep], j[keep], rated[keep]
            if not depth:
                keep = i != j
                if keep.any():
                    yield i[keep], j[keep], rated[keep]
                continue
            width, below = self.sizes[depth - 1], len(self.levels[depth - 1][0])
            a, b = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
            for k in range(0, len(i), 1024):
                x = (i[k : k + 1024, None] * width + a.ravel()).ravel()
                y = (j[k : k + 1024, None] * width + b.ravel()).ravel()
                ok = (x < below) & (y < below) & (x <= y)
                stack.append((depth - 1, x[ok], y[ok]))


def leaf_pairs(level: tuple[np.ndarray, ...], edges: np.ndarray, percent: int) -> Iterator[Portion]:
    """What `rated_pairs` gives, for all blocks whose tree is a single leaf, together."""
    size = np.diff(edges)
    rows = np.flatnonzero(np.repeat(size <= LEAF, size))
    after = np.repeat(edges[1:], size)[rows] - rows - 1  # texts that follow in the block
    for k in range(0, len(rows), 65_536):
        row, count = rows[k : k + 65_536], after[k : k + 65_536]
        i = np.repeat(row, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        rated = rate(level, i, j, percent)
        keep = rated > 0
        yield i[keep], j[keep], rated[keep]


class Best:
    """For each of a task's texts the pair rated highest so far."""

    def __init__(self, ids: np.ndarray):
        self.names, self.label = np.unique(ids, return_inverse=True)
        self.high, self.one, self.two = np.zeros(len(self.names)), np.full(len(self.names), -1), np.full(len(self.names), -1)

    def add(self, i: np.ndarray, j: np.ndarray, rated: np.ndarray) -> None:
        order = np.argsort(rated, kind="stable")
        for own in (self.label[i], self.label[j]):
            top = np.full(len(self.names), -1)
            top[own[order]] = order  # the last one, rated highest, stays
            better = np.flatnonzero(top >= 0)
            better = better[rated[top[better]] > self.high[better]]
            at = top[better]
            self.high[better], self.one[better], self.two[better] = rated[at], i[at], j[at]


def task_pairs(n: np.ndarray, own: list[np.ndarray], comp: np.ndarray, key: np.ndarray, percent: int) -> Iterator[Portion]:
    """Rated pairs of the rows (in order of key and size) of a task's blocks; two sets are compared in the smaller one's width."""
    bits = width(n)
    for w in np.unique(bits).tolist():
        # sets of the next width take part where they are small enough for a link
        at = np.flatnonzero((bits == w) | ((bits == 2 * w) & (n * percent <= 100 * (w // SPREAD))))
        mask = np.stack([bitmap(own[k], w) for k in at])
        level = leaves(n[at], mask, comp[at])
        own_key = key[at]
        edges = np.flatnonzero(np.r_[True, own_key[1:] != own_key[:-1], True])
        for i, j, rated in leaf_pairs(level, edges, percent):
            yield at[i], at[j], rated
        for e in np.flatnonzero(np.diff(edges) > LEAF):
            a, b = edges[e], edges[e + 1]
            for i, j, rated in SignatureTree(n[at[a:b]], mask[a:b], comp[at[a:b]]).rated_pairs(percent):
                yield at[a + i], at[a + j], rated


def _admitted(rule: Rule, best: bool):
    """u, v, a, b, rated: pairs of texts (a, b) of components (u, v) that bounds don't exclude, as they are found.

    If `best`, one for each text, and a row without u for each text a of block b that has any pair: all others can
    have none later on, when components are larger.
    """

    def named(ids: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray, rated: np.ndarray) -> pd.DataFrame:
        a, b = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
        swap = ids[i] < ids[j]
        out = pd.DataFrame({"u": np.where(swap, comp[j], comp[i]), "v": np.where(swap, comp[i], comp[j]), "a": a, "b": b, "rated": rated.astype(float)})
        return out.drop_duplicates(["a", "b"])

    def task(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(["key", "n", "id"], ignore_index=True)
        key, n, ids, comp = (rows[c].to_numpy() for c in ("key", "n", "id", "comp"))
        portions = task_pairs(n, [unpack_marks(x) for x in rows["marks"]], comp, key, rule.percent)
        del rows
        if not best:
            yield from (named(ids, comp, *p) for p in portions if len(p[0]))
            return
        alive, top = np.zeros(len(ids), dtype=bool), Best(ids)
        for portion in portions:
            top.add(*portion)
            alive[portion[0]] = alive[portion[1]] = True
        has = top.one >= 0
        yield named(ids, comp, top.one[has], top.two[has], top.high[has]).astype({"u": object, "v": object})
        yield pd.DataFrame({"u": None, "v": None, "a": ids[alive], "b": key[alive], "rated": n[alive].astype(float)})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tasks follow each other in a partition; one is held at a time, and its pairs leave in portions."""
        held, now = [], None
        for batch in batches:
            for one, rows in batch.groupby("task", sort=False):
                if held and one != now:
                    yield from task(pd.concat(held, ignore_index=True))
                    held = []
                now = one
                held.append(rows.drop(columns="task"))
        if held:
            yield from task(pd.concat(held, ignore_index=True))

    return pairs


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids; these are broadcast where they are few, by count."""
    few = ids.limit(FEW + 1).count() <= FEW
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _candidates(blocks: DataFrame, held: DataFrame, rule: Rule, best: bool, some: bool) -> DataFrame:
    """Pairs of the blocks' texts (some, or about all of those held), as `_admitted` gives them."""
    of_set = F.least(F.greatest(F.col("n") * (SPREAD // 4), F.lit(BITS // 8)), F.lit(MOST_BITS // 8))
    tasks = max(shuffle_partitions(blocks.sparkSession), int(blocks.agg(F.sum(of_set)).first()[0] or 0) // TASK_BYTES)
    own = held.select("id", "marks")
    described = blocks.join(_only(own, blocks.select("id").distinct()) if some else own, "id")
    described = described.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).repartition(tasks, "task").sortWithinPartitions("task")
    return described.mapInPandas(_admitted(rule, best), "u long, v long, a long, b long, rated double")


def _tiled(blocks: DataFrame, *of: str) -> DataFrame:
    """Adds key: the block `of` where its m texts are TILE at most, else each pair of its tiles."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), tiles).cast("int")
    with_tile = F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1))
    rows = blocks.select("*", own.alias("own"), F.explode(with_tile).alias("other"))
    return rows.withColumn("key", F.xxhash64(*of, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")


def often(counts: np.ndarray) -> int:
    """The level of shingles that may be in more texts than a few cells of the sketch hold on average, and than a thousand."""
    return int(2 * np.log2(max(1000, 4 * counts[0].sum() / CELLS)))


def _blocks(reps: DataFrame, rule: Rule, hot: int) -> DataFrame:
    """key, id, n: blocks of two texts or more, so that any two linked texts share one.

    A shingle's texts are told by the exclusive or of their hashes; shingles with the same texts are one block. A shingle
    of a level above `hot` is a block of its own whose rows are dealt out, with as many texts as its level stands for; the
    sketch never counts too few, so windows over the others are bounded. Then all blocks with the same smallest text are
    laid together, which only adds pairs to look at and leaves far fewer rows.
    """
    level = F.shiftright("key", 56)
    is_hot, texts = level > hot, F.pow(F.lit(2.0), (level + 1) / 2).cast("long")
    each = reps.select("id", "n", F.explode("keys").alias("key")).withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(1024))).otherwise(0))
    whole = Window.partitionBy("key", "salt").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_size = Window.partitionBy("key", "salt").orderBy("n", "id")
    each = each.select("id", "n", "key", is_hot.alias("hot"), texts.alias("texts"), F.count(F.lit(1)).over(whole).alias("m"), F.bit_xor(F.xxhash64("id")).over(whole).alias("same"), F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    each = each.where(F.col("hot") | rule.near("less", "n") | rule.near("n", "more"))
    each = each.select("id", "n", F.when(F.col("hot"), F.col("key")).otherwise(F.col("same")).alias("same"), F.when(F.col("hot"), F.col("texts")).otherwise(F.col("m")).alias("m"))
    blocks = _tiled(each.groupBy("same", "m", "id", "n").agg(F.count(F.lit(1)).alias("shared")), "same", "m").select("key", "id", "n", "m", "shared")
    blocks = _sized(_sharing(blocks, rule), rule)
    least = F.min("id").over(Window.partitionBy("key"))  # a block has two tiles at most
    blocks = blocks.select(least.alias("least"), "id", "n").distinct()
    return _tiled(blocks.join(blocks.groupBy("least").agg(F.count(F.lit(1)).alias("m")), "least"), "least").select("key", "id", "n")


def _sharing(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Without texts that share fewer of their first shingles with others than a link to the smallest text in reach asks
    for; adds what such a link asks for, and how many are shared in blocks of more than two texts.
    """
    own = Window.partitionBy("id")  # a row a text and block: a prefix at most
    asked = rule.common(F.floor(rule.percent * F.col("n") / 100))
    many = F.sum(F.when(F.col("m") > 2, F.col("shared")).otherwise(0)).over(own)
    rows = blocks.select("key", "id", "n", "m", "shared", F.sum("shared").over(own).alias("all"), many.alias("many"), asked.alias("asked"))
    return rows.where(F.col("all") >= F.col("asked")).drop("all")


def _sized(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Without texts whose size is too far from all others of the block: in order of size, the next one is then too far.
    Two texts alone in a block share its shingles and at most what either shares in larger blocks.
    """
    by_size = Window.partitionBy("key").orderBy("n", "id")  # a block has two tiles at most
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = blocks.select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"), F.min("many").over(whole).alias("fewest"))
    rows = rows.where((rule.near("less", "n") | rule.near("n", "more")) & ((F.col("m") > 2) | (F.col("shared") + F.col("fewest") >= F.col("asked"))))
    return rows.drop("less", "more", "fewest", "many", "asked")


def _open(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the blocks that hold two components."""
    rows = blocks.join(comps, "id")
    two = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return rows.join(two, "key", "left_semi").select("key", "id", "n", "comp")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    docs = numbered(docs, text_col)
    counts = sketch(docs, rule)
    spread = docs.sparkSession.sparkContext.broadcast(counts)
    rows = written(_described(docs, rule, spread), "jaccard-texts")
    swept(docs.sparkSession)
    classes = rows.where("n > 0").groupBy("n", "digest").agg(F.min("id").alias("id"))
    reps = rows.join(classes.select("id"), "id", "left_semi")
    blocks = cut(_blocks(reps, rule, often(counts)))
    swept(docs.sparkSession)
    held = written(_marked(rows.select("id", "packed").join(blocks.select("id").distinct(), "id", "left_semi"), rule), "jaccard-blocks")
    comps = held.select("id", F.col("id").alias("comp"))
    tried = None
    for k in range(ROUNDS + 1):
        swept(docs.sparkSession)
        open_ = cut(_open(blocks, comps))
        if open_.isEmpty():
            break
        pairs = _candidates(open_, held, rule, best=k < ROUNDS, some=k > 0)
        if k < ROUNDS:
            found = cut(pairs)
            blocks = found.where("u IS NULL").select(F.col("b").alias("key"), F.col("a").alias("id"), F.col("rated").cast("long").alias("n"))
            # the best pair of each text, of all its blocks
            sides = found.where("u IS NOT NULL").select(F.explode(F.array("a", "b")).alias("of"), F.struct("rated", "a", "b", "u", "v").alias("pair"))
            pairs = sides.groupBy("of").agg(F.max("pair").alias("pair")).select("pair.*")
        pairs = pairs.select("a", "b", "u", "v").dropDuplicates(["a", "b"])
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        swept(docs.sparkSession)
        found = verified(pairs.select("a", "b"), held, rule)
        found = pairs.join(found, ["a", "b"]).select("u", "v")
        comps = components(comps, found)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
    # every text has its class's representative, and that one its component
    own = rows.join(classes.select("n", "digest", F.col("id").alias("rep")), ["n", "digest"], "left").select("id", F.col("doc_id").cast("long").alias("doc_id"), "n", F.coalesce("rep", "id").alias("rep"))
    own = own.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", "doc_id", "n", F.coalesce("comp", "rep").alias("comp"))
    names = own.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return own.join(names, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "id")


def one_of_each(df: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """The rows of `df` without near duplicates: of a component the row with the smallest doc_id stays; all columns.

    Texts without words are no near duplicates of anything; null ids sort after all others.
    """
    rows, row = identified(df)
    found = jaccard_components(rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")), rule)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*df.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Rule(words=4, percent=85)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
