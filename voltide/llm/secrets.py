"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions at its hits, embedded checksums.

Kinds, in order: assign (a secret-like name, a separator and a value of 6 or more characters), access (AKIA and
capitals or digits, 20 or more characters), hex (24 or more lower-case hexadecimal digits, which have no keyword and
are found by their run), checked (a prefixed token of 36 characters whose last six are the base-62 CRC-32 of the
thirty before, validated), key_block (a PEM private key from its BEGIN to its END line). The first three are found
leftmost and without overlap by kind, and stay whatever else is found.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("assign", "access", "hex", "checked", "key_block")
BASE = 3
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BLOCK = "-----begin "
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [*((n, 0) for n in NAMES), ("akia", 1), *((p, 3) for p in PREFIXES), (BLOCK, 4)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """The CRC-32 of a token's body, six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, rest = divmod(n, 62)
        out = DIGITS[rest] + out
    return out


def _hits(text: str) -> dict[int, list[int]]:
    """Where keywords start, in code points, by kind; case is folded for A-Z alone, which keeps every offset."""
    folded = text.encode("utf-8", "surrogatepass").lower()
    plain, hits, at, chars = len(folded) == len(text), {}, 0, 0
    for end, (kind, length) in _automaton().iter(folded.decode("latin-1")):
        start = end + 1 - length
        if not plain:  # bytes to code points, counted on from the hit before; keywords are ASCII, so starts are whole characters
            low, high = (at, start) if start >= at else (start, at)
            step = sum((b & 0xC0) != 0x80 for b in folded[low:high])
            chars, at = (chars + step if start >= at else chars - step), start
            start = chars
        hits.setdefault(kind, []).append(start)
    return {k: sorted(set(v)) for k, v in hits.items()}


def _anchored(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """The leftmost non-overlapping matches of a pattern that starts with one of its keywords."""
    end = 0
    for place in places:
        if place >= end and (m := pattern.match(text, place)):
            end = m.end()
            yield m


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every secret, by start, then kind; code points, end exclusive."""
    hits = _hits(text)
    spans = [(0, *m.span()) for m in _anchored(ASSIGN, text, hits.get(0, [])) if len(m[2]) >= 6]
    spans += [(1, *m.span()) for m in _anchored(ACCESS, text, hits.get(1, [])) if len(m[0]) >= 20]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    spans += [(3, *m.span()) for m in _anchored(CHECKED, text, hits.get(3, [])) if checksum(m[1]) == m[2]]
    spans += [(4, *m.span()) for m in _anchored(KEY_BLOCK, text, hits.get(4, []))]
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (listed), spans (listed)."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t) for t in batch["text"]]
            base = [[s for s in x if s[0] < BASE] for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {f"n_{KINDS[k]}": [sum(s[0] == k for s in x) for x in base] for k in range(BASE)} | {"base": list(map(listed, base)), "spans": list(map(listed, found))})

    return df.select(F.col("doc_id").cast("string").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(scanned, "doc_id string, n_assign long, n_access long, n_hex long, base string, spans string").withColumn("doc_id", F.col("doc_id").cast("long"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
