"""Super-k-mers: consecutive windows of a sequence that share a minimiser, and what the corpus repeats of them.

A window is WIDTH symbols (bytes or words); its minimiser is the least hash among its GRAM-symbol grams, leftmost of
equals. Equal windows have equal minimisers at equal places, so they meet wherever super-k-mers are grouped by their
minimiser's hash (`key`). A second hash (`same`) covers the whole super-k-mer: equal (key, same) of 128 bits are
taken as equal content, so of a content that occurs often only one representative has to be looked at again, and
keys with a single content not at all. That pre-aggregation is what keeps groups of copies small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, text_of
from .shingling import A, C, mix

PLACE = np.uint64(0xFFFFFF)  # the low bits hold a gram's place in its block
#: Symbols of one block of work; longer documents are cut, and the cut's windows go with the later part.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Shape:
    """width: symbols a window; gram: symbols a gram; cover: a power of two, at most width and at least its third."""

    width: int
    gram: int
    cover: int

    @property
    def grams(self) -> int:
        return self.width - self.gram + 1


def _double(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice the symbols from hashes of `step` symbols."""
    return mix(h[:-step] * A + h[step:])


def _hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` symbols, from runs of powers of two."""
    h, have, out, done = mix(symbols * A + C), 1, None, 0
    while have <= size:
        if size & have:
            out = h if out is None else mix(out[: len(h) - done] * A + h[done:])
            done += have
        if 2 * have <= size:
            h = _double(h, have)
        have *= 2
    return out


def block_runs(symbols: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Super-k-mers of a block of sequences laid end to end: first window, number of windows, key, same.

    ends: where each sequence ends; windows never cross an end.
    """
    n = len(symbols) - shape.width + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64))
    valid = np.ones(n, dtype=bool)
    for e in ends:
        valid[max(0, e - shape.width + 1) : min(e, n)] = False
    grams = _hashes(symbols, shape.gram)
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= shape.grams:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < shape.grams:
        least = np.minimum(least[: len(least) - (shape.grams - step)], least[shape.grams - step :])
    at = (least[:n] & PLACE).astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    last = np.ones(n, dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    first, final = np.flatnonzero(valid & new), np.flatnonzero(valid & last)
    count = final - first + 1
    long = count + shape.width - 1
    cover = _hashes(symbols, shape.cover)
    end = first + long - shape.cover
    same = mix(cover[first] * A + cover[end])
    same = mix(same * A + cover[np.minimum(first + shape.cover, end)])
    same = mix(same * A + long.astype(np.uint64))
    return first, count, grams[at[first]].view(np.int64), same.view(np.int64)


def numbered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """id, doc_id, text: a unique id that sorts as doc_id does (null ids last), the doc_id itself where it is unique."""
    rows, row = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text_col).alias("text")))
    return rows.select(F.col(row).alias("id"), "doc_id", "text")


def packed_texts(docs: DataFrame) -> DataFrame:
    """id, doc_id (as text), packed: texts as compressed bytes, which is what a join by id moves."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [press.compress(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "doc_id", "packed"])

    return docs.select("id", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(pack, "id long, doc_id string, packed binary")


def runs_of(docs: DataFrame, shape: Shape, symbols_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, key, same, run: the super-k-mers of every text; run is first window * 256 + number of windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held, size = [], 0

            def flush():
                nonlocal held, size
                if not held:
                    return None
                lengths = np.array([len(s) for _, _, s in held])
                ends = np.cumsum(lengths)
                first, count, key, same = block_runs(np.concatenate([s for _, _, s in held]), ends, shape)
                of = np.searchsorted(ends, first, side="right")
                base = np.array([b for _, b, _ in held]) - (ends - lengths)
                out = pa.RecordBatch.from_arrays([pa.array(np.array([i for i, _, _ in held])[of]), pa.array(key), pa.array(same), pa.array((first + base[of]) * 256 + count)], names=["id", "key", "same", "run"])
                held, size = [], 0
                return out

            for i, raw in enumerate(batch.column(1)):
                symbols = symbols_of(np.frombuffer(raw.as_buffer() or b"", dtype=np.uint8))
                for k in range(0, max(1, len(symbols) - shape.width + 1), BLOCK):
                    part = symbols[k : k + BLOCK + shape.width - 1]
                    if len(part) < shape.width:
                        continue
                    held.append((ids[i], k, part))
                    size += len(part)
                    if size >= BLOCK and (out := flush()) is not None:
                        yield out
            if (out := flush()) is not None:
                yield out

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(find, "id long, key long, same long, run long")


def repeated(runs: DataFrame) -> DataFrame:
    """Adds to the runs whose key occurs again: copies (of the same content), first (of these), others (contents of the key differ).

    One shuffle and one sort serve all three.
    """
    of_key = Window.partitionBy("key")
    of_same = Window.partitionBy("key", "same")
    found = runs.select("*", F.row_number().over(of_same.orderBy("id", "run")).alias("nth"), F.count(F.lit(1)).over(of_same).alias("copies"))
    found = found.select("*", F.count(F.lit(1)).over(of_key).alias("of_key"), (F.min("same").over(of_key) != F.max("same").over(of_key)).alias("others"))
    return found.where("of_key > 1").select("id", "key", "run", (F.col("nth") == 1).alias("first"), (F.col("copies") > 1).alias("copied"), "others")


def by_id(ranges: DataFrame) -> DataFrame:
    """of, runs: all of a document's ranges."""
    return ranges.groupBy(F.col("id").alias("of")).agg(F.collect_list("run").alias("runs"))


def merged(runs, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal ranges of symbols that the runs' windows cover."""
    mark = np.zeros(length + 1, dtype=np.int64)
    runs = np.asarray(runs, dtype=np.int64)
    np.add.at(mark, runs >> 8, 1)
    np.add.at(mark, (runs >> 8) + (runs & 255) + width - 1, -1)
    on = np.cumsum(mark[:-1]) > 0
    edge = np.diff(np.r_[False, on, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
