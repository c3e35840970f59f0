"""Byte-level BPE encoding and decoding by a ranks file, with long texts encoded in overlapping chunks.

A text of more than CHUNK code points is dealt as chunks that overlap by OVERLAP, each pre-tokenised by itself from its
own first character. Two neighbours resynchronise at the first pre-token boundary that both place in their overlap:
from there both see the same text from the same start, so the left one's pre-tokens go on as the right one's. The text
is cut at these boundaries into pieces, which are encoded in parallel and put together by document. A text of which two
neighbours share no boundary (a blank run or a word longer than the overlap) is encoded whole. A text is cut up in one pass
over it, so work grows with its length.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; ids may be
null or repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_of

CHUNK, OVERLAP = 32_768, 1_024
RANKS = "byte_bpe_multi_50k.tiktoken"


@functools.cache
def encoding(path: str, pattern: str):
    """The encoding of a ranks file, read once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of a text start, by a match from its first character."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 32) -> Iterator[pd.DataFrame]:
    """Rows as they come, in frames of at most `most`."""
    while part := list(itertools.islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)


DIGESTS = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(doc_ids, ids: list[bytes], path: str, pattern: str) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": doc_ids,
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(decode(x, path, pattern)).hexdigest() for x in ids],
    })


def _encoder(path: str, pattern: str, digested: bool = False):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(path, pattern)
        for batch in batches:
            ids = [np.asarray(own.encode_ordinary(t), dtype="<u4").tobytes() if t else b"" for t in batch["piece"]]
            yield _digested(batch["doc_id"], ids, path, pattern) if digested else pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "at": batch["at"], "ids": ids})

    return encode


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, digested: bool = False) -> DataFrame:
    """row, doc_id, ids: a text's token ids as little-endian unsigned 32-bit integers; or, if `digested`, doc_id, n_tokens,
    ids_sha256 and decoded_sha256, made where the ids are, so that a task has one Python worker.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    short = rows.where(F.length("text") <= chunk).select("row", "doc_id", F.lit(0).alias("at"), F.col("text").alias("piece"))
    # the long texts are written once: the pieces are cut from the rows that the chunks were
    long = cut(rows.where(F.length("text") > chunk))

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                yield from _frames(((row, k, text[k : k + chunk + overlap]) for k in range(0, len(text), chunk)), ["row", "start", "chunk"])

    chunks = long.select("row", "text").mapInPandas(chunked, "row long, start int, chunk string")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, start, text in zip(batch["row"], batch["start"], batch["chunk"]):
                places = boundaries(text, pattern)
                head = [start + p for p in places if p < overlap]
                # the last two pre-tokens may depend on text beyond this chunk
                tail = [start + p for p in places[:-2] if p >= chunk]
                out.append((row, start, head, tail))
            yield pd.DataFrame(out, columns=["row", "start", "head", "tail"])

    near = chunks.repartition("row", "start").mapInPandas(edges, "row long, start int, head array<int>, tail array<int>")
    by_start = Window.partitionBy("row").orderBy("start")
    cuts = near.select("row", "start", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_start)))).alias("cut"))
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list("cut")).alias("cuts"), F.count(F.when(F.col("cut").isNull(), 1)).alias("unmet"))
    cuts = cuts.select(F.col("row").alias("of"), F.when(F.col("unmet") == 0, F.col("cuts")).otherwise(F.array(F.lit(0))).alias("cuts"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text, cuts in zip(batch["row"], batch["doc_id"], batch["text"], batch["cuts"]):
                ends = [*cuts[1:], len(text)]
                yield from _frames(((row, doc_id, a, text[a:b]) for a, b in zip(cuts, ends)), ["row", "doc_id", "at", "piece"])

    pieces = long.join(cuts, F.col("row") == F.col("of")).select("row", "doc_id", "text", "cuts").mapInPandas(cut_up, "row long, doc_id string, at int, piece string").repartition("row", "at")
    schema = "row long, doc_id string, at int, ids binary"
    whole = short.mapInPandas(_encoder(path, pattern, digested), DIGESTS if digested else schema)
    parts = pieces.mapInPandas(_encoder(path, pattern), schema).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"),
    )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch["parts"]]
            yield _digested(batch["doc_id"], ids, path, pattern) if digested else pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "ids": ids})

    parts = parts.mapInPandas(joined, DIGESTS if digested else "row long, doc_id string, ids binary")
    return whole.unionByName(parts) if digested else whole.select("row", "doc_id", "ids").unionByName(parts)


def decode(ids: bytes, path: str, pattern: str) -> bytes:
    """The raw bytes of the tokens, one after another."""
    return encoding(path, pattern).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def encode_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return encode(docs, path, pattern, digested=True).withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
