"""Substring dedup over words: super-k-mers travel to their minimiser's bucket, where sorting counts windows exactly.

Every window of `width` words whose word sequence also starts anywhere else is found, and every word that such a
window covers is removed. Super-k-mers of copied content are settled by their digests; of the rest, one
representative a content is packed as one string and sent to the bucket of its minimiser, where all of its windows
are sorted and equal neighbours counted.

Defined cases: a null or empty text has no words and keeps none; texts with fewer than `width` words keep all of
them; repeated rows repeat each other's windows, so both lose them; ids may be null or repeat; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .shingling import word_edges, word_hashes
from .superkmers import Shape, by_id, merged, numbered, packed_texts, repeated, runs_of

SHAPE = Shape(width=35, gram=8, cover=32)
#: Representatives a bucket, on average; keys with more of them than MOST are counted window by window instead.
BUCKET, MOST = 20_000, 50_000


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each representative, joined by one space."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for i, packed, reps in zip(batch["id"], batch["packed"], batch["reps"]):
            raw = unpack.decompress(packed)
            starts, ends = word_edges(np.frombuffer(raw, dtype=np.uint8))
            for r in reps:
                first, count = r["run"] >> 8, r["run"] & 255
                words = [raw[a:b] for a, b in zip(starts[first : first + count + SHAPE.width - 1], ends[first : first + count + SHAPE.width - 1])]
                out.append((i, r["key"], r["run"], b" ".join(words)))
        yield pd.DataFrame(out, columns=["id", "key", "run", "piece"])


def _windows_of(counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of `lengths` symbols laid end to end with `counts` windows each: each window's piece and place."""
    piece = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return piece, (np.cumsum(lengths) - lengths)[piece] + inside


def _runs(flag: np.ndarray, piece: np.ndarray, inside_first: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Flagged windows as (id, run) of consecutive ones. inside_first: each window's place in its document."""
    at = np.flatnonzero(flag)
    if not len(at):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "run": np.zeros(0, np.int64)})
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(piece[at]) != 0)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    return pd.DataFrame({"id": ids[piece[at[first]]], "run": inside_first[at[first]] * 256 + count})


def count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of a bucket's pieces that occur twice or more among them: sorted as rows of word numbers, exactly."""
    rows = rows.sort_values(["id", "run"], ignore_index=True)
    words = [p.split(b" ") for p in rows["piece"]]
    numbers, _ = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    run = rows["run"].to_numpy()
    counts, lengths = run & 255, np.array([len(w) for w in words])
    piece, at = _windows_of(counts, lengths)
    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(numbers.astype(">u4"), SHAPE.width)[at]).view(np.dtype((np.void, 4 * SHAPE.width))).ravel()
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    flag = np.zeros(len(window), dtype=bool)
    flag[order[1:]] |= equal
    flag[order[:-1]] |= equal
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _runs(flag, piece, (run >> 8)[piece] + inside, rows["id"].to_numpy())


def reps_with_text(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """id, packed, reps: representatives beside their document's text."""
    own = reps.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("key", "run")).alias("reps"))
    return packed_texts(docs).join(own, F.col("id") == F.col("of")).select("id", "packed", "reps")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """id, run of every window whose words also start elsewhere."""
    found = cut(repeated(runs_of(docs, SHAPE, word_hashes)))
    copied = found.where("copied").select("id", "run")
    reps = found.where("first AND others").select("id", "key", "run")
    heavy = reps.groupBy("key").count().where(F.col("count") > MOST).select("key")
    buckets = max(1, reps.count() // BUCKET)
    pieces = reps_with_text(reps, docs).mapInPandas(_pieces, "id long, key long, run long, piece binary")
    pieces = pieces.join(heavy.withColumn("heavy", F.lit(True)), "key", "left")
    light = pieces.where("heavy IS NULL").groupBy(F.pmod("key", F.lit(buckets))).applyInPandas(lambda rows: count_bucket(rows), "id long, run long")
    # a key of very many contents: its windows are counted by their words, spread by content
    words = pieces.where("heavy").withColumn("w", F.split(F.col("piece").cast("string"), " "))
    each = words.select("id", F.shiftright("run", 8).alias("at"), "w", F.explode(F.sequence(F.lit(0), F.col("run").bitwiseAND(255).cast("int") - 1)).alias("k")).select("id", ((F.col("at") + F.col("k")) * 256 + 1).alias("run"), F.array_join(F.slice("w", F.col("k") + 1, SHAPE.width), " ").alias("window"))
    again = each.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return copied.unionByName(light).unionByName(each.join(again, "window").select("id", "run"))


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc_id, packed, runs in zip(batch["doc_id"], batch["packed"], batch["runs"]):
            raw = unpack.decompress(packed)
            starts, ends = word_edges(np.frombuffer(raw, dtype=np.uint8))
            keep = np.ones(len(starts), dtype=bool)
            if runs is not None:
                for a, b in zip(*merged(runs, SHAPE.width, len(starts))):
                    keep[a:b] = False
            kept = b" ".join(raw[a:b] for a, b in zip(starts[keep], ends[keep]))
            out.append((doc_id, len(starts), int((~keep).sum()), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    docs = numbered(docs, text_col)
    runs = by_id(repeated_windows(docs))
    texts = packed_texts(docs).join(runs, F.col("id") == F.col("of"), "left")
    return texts.select("doc_id", "packed", "runs").mapInPandas(_strip, "doc_id string, n_words long, n_removed long, kept binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 33))) AS i FROM d),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
s AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone, coalesce(len(gone), 0) AS n FROM d LEFT JOIN s USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM k),
v AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY u.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN v USING (doc_id)
"""
