"""Suffix-array dedup over bytes, by external induced sorting.

Every byte that a `WIDTH`-byte string covers which also starts earlier is removed. Super-k-mers whose content occurs
again are settled by digest, and only one representative a content goes on, to the shard of its minimiser; windows
that are equal meet in one shard. A shard's representatives are laid end to end and their suffixes sorted by
induction: the S* substrings are sorted and named, the string of names is sorted by doubling up to the depth that
windows need, and from it first the L and then the S suffixes are induced through disk-backed priority queues, one
first-in-first-out queue a symbol (suffixes are induced in order of rank, so order of arrival is order of rank). Then
neighbours in suffix order are compared over WIDTH bytes, and of windows that are equal the earliest is kept.

Defined cases: a null or empty text has no bytes; texts of fewer than WIDTH bytes lose none; of repeated rows the
later loses what the earlier has; null ids count as later than any id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .substring_dedup import _runs, _windows_of, reps_with_text
from .superkmers import Shape, by_id, merged, numbered, packed_texts, repeated, runs_of

WIDTH = 100
SHAPE = Shape(width=WIDTH, gram=24, cover=64)
#: Representatives a shard, on average; keys with more of them than MOST are compared window by window instead.
SHARD, MOST = 20_000, 50_000
HELD = 1 << 22  # bytes of a queue that stay in memory


class Queues:
    """Priority queues of suffixes by first symbol; within a symbol, suffixes leave as they came. Long ones lie on disk."""

    def __init__(self, symbols: int):
        self.files: list = [None] * symbols

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order].astype(np.int64)
        edges = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(symbols)]):
            c = int(symbols[a])
            if self.files[c] is None:
                self.files[c] = tempfile.SpooledTemporaryFile(HELD)
            self.files[c].write(suffixes[a:b].tobytes())

    def pop(self, c: int) -> np.ndarray:
        """All that the symbol's queue has now."""
        file, self.files[c] = self.files[c], None
        if file is None:
            return np.zeros(0, dtype=np.int64)
        with file:
            file.seek(0)
            return np.frombuffer(file.read(), dtype=np.int64)


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type: smaller than the next one; the last counts as L."""
    change = np.flatnonzero(t[:-1] != t[1:])
    up = np.zeros(len(t), dtype=bool)
    nearest = np.searchsorted(change, np.arange(len(t) - 1))
    some = nearest < len(change)
    at = change[nearest[some]]
    up[:-1][some] = t[at] < t[at + 1]
    return up


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks by keys, the first one most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _star_order(t: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """S* suffixes sorted, to `depth` symbols: substrings named, then the string of names doubled."""
    length = np.diff(np.r_[star, len(t) - 1]) + 1
    # a symbol of S type sorts after the same one of L type; with types, no S* substring is the start of another
    padded = np.r_[t, np.zeros(4, dtype=t.dtype)].astype(np.uint64) * np.uint64(2)
    padded[: len(t)] += _types(t)
    names = np.zeros(len(star), dtype=np.int64)
    for k in range(0, int(length.max()), 4):
        chunk = np.zeros(len(star), dtype=np.uint64)
        for j in range(4):
            has = k + j < length
            chunk = (chunk << np.uint64(16)) | np.where(has, padded[np.minimum(star + k + j, len(padded) - 1)], np.uint64(0))
        names = _ranks([names, chunk])
    step = 1
    while step <= depth // 2 and names.max() + 1 < len(names):
        names = _ranks([names, np.r_[names[step:] + 1, np.zeros(min(step, len(names)), dtype=np.int64)][: len(names)]])
        step *= 2
    return star[np.argsort(names, kind="stable")]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t in order of their first `depth` symbols at least. t: symbols below 2**15, its last the least."""
    small = _types(t)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = int(t.max()) + 1
    seeds = _star_order(t, star, depth) if len(star) else star
    first = t[seeds]
    edge = np.searchsorted(first, np.arange(size + 1))
    queues, large = Queues(size), [[] for _ in range(size)]
    queues.push(t[-1:], np.array([len(t) - 1]))

    def induce(source: np.ndarray, s_type: bool) -> None:
        before = source - 1
        before = before[(before >= 0)]
        before = before[small[before] == s_type]
        queues.push(t[before], before)

    for c in range(size):  # L suffixes, from the least symbol up
        while len(block := queues.pop(c)):
            large[c].append(block)
            induce(block, False)
        induce(seeds[edge[c] : edge[c + 1]], False)
    parts: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):  # S suffixes, from the greatest symbol down; queues hold them in falling order
        while len(block := queues.pop(c)):
            parts.append(block)
            induce(block, True)
        rising = np.concatenate(large[c]) if large[c] else np.zeros(0, dtype=np.int64)
        parts.append(rising[::-1])
        induce(rising[::-1], True)
    return np.concatenate(parts)[::-1]


def sort_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of a shard's pieces that occur earlier in it."""
    rows = rows.sort_values(["id", "run"], ignore_index=True)
    run = rows["run"].to_numpy()
    counts, lengths = run & 255, np.array([len(p) for p in rows["piece"]]) + 1
    raw = np.frombuffer(b"\0".join(rows["piece"]) + b"\0", dtype=np.uint8)
    t = raw.astype(np.uint16) + 1
    t[np.cumsum(lengths) - 1] = 0  # ends of pieces sort before every byte
    piece, at = _windows_of(counts, lengths)
    window = np.full(len(t), -1, dtype=np.int64)
    window[at] = np.arange(len(at))
    order = window[suffix_order(t, WIDTH + 1)]
    order = order[order >= 0]
    views = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
    equal = np.zeros(len(order), dtype=bool)
    for k in range(1, len(order), 65_536):
        part = order[k - 1 : k + 65_536]
        equal[k : k + 65_536] = (views[at[part[1:]]] == views[at[part[:-1]]]).all(axis=1)
    starts = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(order, starts) if len(order) else order
    flag = np.zeros(len(at), dtype=bool)
    flag[order] = order != np.repeat(earliest, np.diff(np.r_[starts, len(order)]))
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _runs(flag, piece, (run >> 8)[piece] + inside, rows["id"].to_numpy())


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for i, packed, reps in zip(batch["id"], batch["packed"], batch["reps"]):
            raw = unpack.decompress(packed)
            out += [(i, r["key"], r["run"], raw[r["run"] >> 8 : (r["run"] >> 8) + (r["run"] & 255) + WIDTH - 1]) for r in reps]
        yield pd.DataFrame(out, columns=["id", "key", "run", "piece"])


def later_windows(docs: DataFrame) -> DataFrame:
    """id, run of every window whose bytes also start earlier."""
    found = cut(repeated(runs_of(docs, SHAPE, lambda raw: raw.astype(np.uint64))))
    copied = found.where("NOT first").select("id", "run")
    reps = found.where("first AND others").select("id", "key", "run")
    heavy = reps.groupBy("key").count().where(F.col("count") > MOST).select("key")
    shards = max(1, reps.count() // SHARD)
    pieces = reps_with_text(reps, docs).mapInPandas(_pieces, "id long, key long, run long, piece binary")
    pieces = pieces.join(heavy.withColumn("heavy", F.lit(True)), "key", "left")
    light = pieces.where("heavy IS NULL").groupBy(F.pmod("key", F.lit(shards))).applyInPandas(lambda rows: sort_shard(rows), "id long, run long")
    # a key of very many contents: its windows are told apart by their bytes, spread by content
    each = pieces.where("heavy").select("id", F.shiftright("run", 8).alias("at"), "piece", F.explode(F.sequence(F.lit(0), F.col("run").bitwiseAND(255).cast("int") - 1)).alias("k")).select("id", ((F.col("at") + F.col("k")) * 256 + 1).alias("run"), F.substring("piece", F.col("k") + 1, F.lit(WIDTH)).alias("window"))
    first = each.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "run")).alias("earliest")).where("n > 1")
    late = each.join(first, "window").where(F.struct("id", "run") != F.col("earliest")).select("id", "run")
    return copied.unionByName(light).unionByName(late)


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc_id, packed, runs in zip(batch["doc_id"], batch["packed"], batch["runs"]):
            raw = unpack.decompress(packed)
            starts, ends = merged(runs, WIDTH, len(raw)) if runs is not None else ((), ())
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
            out.append((doc_id, len(raw), len(raw) - len(kept), len(starts), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = numbered(docs, text_col)
    runs = by_id(later_windows(docs))
    texts = packed_texts(docs).join(runs, F.col("id") == F.col("of"), "left")
    return texts.select("doc_id", "packed", "runs").mapInPandas(_strip, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
