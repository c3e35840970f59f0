"""Toxicity of text restored from obfuscation.

A character trigram model is counted over the whole corpus. Suspicious spans of a text become character lattices: words
with leetspeak signs in them or at either end, single letters with separators between them, words that separators cut,
and letters three or more times in a row. A sign may stand for the letters it resembles, a run for one or two of its
letter, a separator between single letters for nothing, and one within a word for nothing or for itself; letters of other scripts that look Latin count as Latin in words that have Latin letters too. Each of these
has a cost, and Viterbi decoding under the trigram model picks the restored span. The restored text is scored by a logistic model over
character n-grams, found by one automaton pass; n-grams and weights are learned from a bounded sample of labelled rows
outside the held-out fold.

Defined cases: a null or empty text scores as a text without any n-gram; labels with null ids or classes are not used;
without labels of both classes every score is the share of toxic labels (0 without any); repeated rows are scored
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, table, text_of
from .shingling import SLICE, slices

#: At most so many labelled rows of each class are learned from, and so many n-grams kept.
TOXIC_ROWS, CLEAN_ROWS, GRAMS = 1500, 3000, 1200
SHORTEST, LONGEST = 4, 8
LETTERS = 28  # 0: all but letters, 1-26: a-z, 27: bytes of letters beyond ASCII

# The letters that a sign resembles.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
# Cyrillic and Greek letters that look like Latin ones.
LOOKS = str.maketrans("асеорхуіјѕһԁοαενι", "aceopxyijshdoaevi")
SIGN_COST, RUN_COST, GAP_COST, JOIN_COST = 0.7, 0.5, 0.1, 1.0
CACHED = 60  # characters of a part that a worker keeps decoded
SIGN = re.escape("".join(LEET))
BETWEEN = r"[\s.,:;_*/\\~-]"  # separators between single letters
WITHIN = "._*~"  # separators within a word
#: Single letters with separators between them, or a run of letters, signs and separators within; one pass, linear in the text.
TOKEN = re.compile(rf"(?P<spaced>(?<![a-z0-9])(?:[a-z{SIGN}]{BETWEEN}{{1,3}}){{3,}}[a-z{SIGN}](?![a-z0-9]))|[a-z{SIGN}]+(?:[{WITHIN}]+[a-z{SIGN}]+)*")
INSIDE = re.compile(rf"[a-z][{SIGN}]+[a-z]|([a-z])\1\1|[a-z][{WITHIN}]+[a-z]")  # signs or separators within a word, long runs
LEADING = re.compile(rf"[{SIGN}]+[a-z]{{2,}}")  # signs at the start of a word
TRAILING = re.compile(r"[a-z]{2}[013457@$]{1,2}$")  # or at its end
OPEN = re.compile(rf"(?:[{SIGN}{WITHIN}]|([a-z])\1\1+)(?:[a-z]?(?:[{SIGN}{WITHIN}]|([a-z])\2\2+))*")  # what has a choice, less than two fixed letters apart
LOOKALIKE, WORDS = re.compile("[асеорхуіјѕһԁοαενι]"), re.compile(r"\w+")


def _codes() -> np.ndarray:
    codes = np.zeros(256, dtype=np.uint8)
    for i in range(26):
        codes[ord("a") + i] = codes[ord("A") + i] = i + 1
    codes[128:] = 27
    return codes


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code, n: character trigrams of every text, at most LETTERS**3 rows. A text of any length is counted slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _codes(), np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                c = codes[np.frombuffer(b"\n\n".join([b"", *texts[a:b], b""]), dtype=np.uint8)]
                for k in range(0, len(c) - 2, SLICE):
                    part = c[k : k + SLICE + 2].astype(np.int32)
                    total += np.bincount((part[:-2] * LETTERS + part[1:-1]) * LETTERS + part[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    given = docs.select(text_of(text_col).cast("binary").alias("text")).where(F.length("text") > 0)
    return given.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-ln p(c | a, b) for each trigram; LETTERS**3 numbers, whatever the corpus."""
    n = np.full(LETTERS**3, 0.02)
    for r in trigram_counts(docs, text_col).collect():
        n[r.code] += r.n
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    return -np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


def _lattice(span: str, spaced: bool = False) -> Iterator[tuple[int, int, str, float]]:
    """Arcs (from, to, letters, cost) over the span's characters, in order of `from`. spaced: separators stand for nothing."""
    i = 0
    while i < len(span):
        j = i + 1
        while j < len(span) and span[j] == span[i]:
            j += 1
        ch = span[i]
        stands = [(ch, 0.0)] if ch.isalpha() else [(x, SIGN_COST) for x in LEET.get(ch, "")]
        if not stands:  # a separator, however often
            yield i, j, "", GAP_COST if spaced else JOIN_COST
            if not spaced:
                yield i, j, span[i:j], 0.0
        elif j - i >= 3:
            yield from ((i, j, x * k, cost + RUN_COST) for x, cost in stands for k in (1, 2))
        else:
            yield from ((k, k + 1, x, cost) for k in range(i, j) for x, cost in stands)
        i = j


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


def decode(span: str, model: np.ndarray, before: str = "", after: str = "", spaced: bool = False) -> str:
    """The cheapest restored span: channel costs plus the trigram model, from the fixed letters before it to those after it.

    Without letters before or after, a word starts or ends there. A state has its cost, its last letters and the state
    before it, so that time and memory grow with the span's length.
    """
    first = (0, 0, *map(_code, before[-2:]))[-2:]
    best: dict[int, dict] = {0: {first: (0.0, "", None)}}
    for at, arcs in itertools.groupby(_lattice(span, spaced), key=operator.itemgetter(0)):
        arcs = list(arcs)
        for (p, q), state in best.pop(at, {}).items():
            cost = state[0]
            for _, to, letters, extra in arcs:
                a, b, c = p, q, cost + extra
                for x in letters:
                    k = _code(x)
                    c += float(model[a, b, k])
                    a, b = b, k
                states = best.setdefault(to, {})
                if (a, b) not in states or c < states[a, b][0]:
                    states[a, b] = (c, letters, state)
    ends = []
    for (a, b), state in best.get(len(span), {}).items():
        c = state[0]
        for k in (*map(_code, after[:2]), 0)[:2]:
            c += float(model[a, b, k])
            a, b = b, k
        ends.append((c, len(ends), state))
    if not ends:
        return span
    state, parts = min(ends)[-1], []
    while state:
        parts.append(state[1])
        state = state[2]
    return "".join(reversed(parts))


def restorer(model: np.ndarray):
    """text -> lower-cased text with its suspicious spans decoded, in time linear in the text.

    Two fixed letters leave one state of the model, so a word is decoded part by part between such pairs, exactly.
    """
    known = functools.lru_cache(50_000)(lambda part, before, after: decode(part, model, before, after))

    def part_of(word: str, m: re.Match) -> str:
        before, after = word[max(0, m.start() - 2) : m.start()], word[m.end() : m.end() + 2]
        return (known if len(m[0]) <= CACHED else decode_long)(m[0], before, after)

    decode_long = lambda part, before, after: decode(part, model, before, after)  # noqa: E731  long parts seldom come again

    def restore(m: re.Match) -> str:
        span = m[0]
        if m["spaced"]:
            return decode(span, model, spaced=True)
        word = span.rstrip("!|+")  # punctuation
        starts = m.start() == 0 or m.string[m.start() - 1].isspace()
        if not (INSIDE.search(word) or TRAILING.search(word[-4:]) or starts and LEADING.match(word)):
            return span
        return OPEN.sub(lambda part: part_of(word, part), word) + span[len(word) :]

    def latin(m: re.Match) -> str:
        return m[0].translate(LOOKS) if re.search("[a-z]", m[0]) else m[0]

    def whole(text: str) -> str:
        text = text.lower()
        return TOKEN.sub(restore, WORDS.sub(latin, text) if LOOKALIKE.search(text) else text)

    return whole


def restored(docs: DataFrame, model: np.ndarray, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` of the documents as text, and their restored text."""
    kept = docs.select(*[F.col(c).cast("string").alias(c) for c in columns], text_of(text_col).alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = restorer(spread.value)
        for batch in batches:
            yield batch.assign(text=batch["text"].map(own))

    return kept.mapInPandas(restore, kept.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int]) -> DataFrame:
    """doc_id, label, text: for each class the `rows` labelled documents outside the held-out fold with the smallest draw."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    draw = F.crc32(F.concat(F.lit("draw:"), F.col("doc_id").cast("string")).cast("binary"))
    picked = None
    for value, most in rows.items():
        part = own.where(F.col("label") == value).orderBy(draw, "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # `rows` bounds the broadcast; a repeated id counts once, with its least text
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))


def _matcher(grams: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, g in enumerate(grams):
        found.add_word(g, i)
    if grams:
        found.make_automaton()
    return (lambda text: sorted({i for _, i in found.iter(text)})) if grams else (lambda text: [])


def learn(sample: DataFrame, n_grams: int = GRAMS) -> tuple[list[str], np.ndarray, float]:
    """n-grams, their weights and the bias, from (doc_id, label, restored text) rows."""
    sample = cut(sample)
    n = {int(r.label): r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return [], np.zeros(0), math.log((share + 1e-9) / (1 - share + 1e-9))
    words = sample.select("doc_id", "label", F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("w")).where(F.length("w") >= SHORTEST)
    # n-grams of each distinct word once: words are counted first, then cut
    words = words.groupBy("w", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("w")))).alias("size")
    parts = words.select("w", "label", "n", sizes).select("label", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1), lambda i: F.substring("w", i, F.col("size"))))).alias("g"))
    t, c = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    odds = F.log((F.col("t") + 0.1) / (n[1] + 0.2)) - F.log((F.col("c") + 0.1) / (n[0] + 0.2))
    grams = parts.groupBy("g").agg(t.alias("t"), c.alias("c")).where("t >= 3").withColumn("odds", odds).where("odds > 1.5")
    grams = [r.g for r in grams.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "g").limit(n_grams).collect()]

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _matcher(grams)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"].astype(int), "found": batch["text"].map(own)})

    rows = sample.select("label", "text").mapInPandas(present, "label int, found array<int>").collect()
    return grams, *_logistic([r.found for r in rows], np.array([r.label for r in rows], dtype=float), len(grams))


def _logistic(found: list[list[int]], y: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presence, classes weighted alike, by accelerated gradient steps."""
    x = np.zeros((len(found), width + 1), dtype=np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1
    x[:, -1] = 1
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    order = np.lexsort(np.vstack([x[:, : min(width, 64)].T, y]))  # rows come in any order; sums are made in one
    x, y, weight = x[order], y[order], weight[order]
    w, v, pull = np.zeros(width + 1), np.zeros(width + 1), np.r_[np.full(width, ridge), 1e-3]
    step = 1 / (0.25 * float((weight * (x**2).sum(axis=1)).max()) * min(len(y), 1 + float(x[:, :-1].mean(axis=0).max()) * len(y)) + ridge)
    for k in range(rounds * 10):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ v))) - y)) + pull * v
        new = v - step * g
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: np.ndarray, grams: list[str], weights: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """doc_id, score of every document's restored text."""
    spread = docs.sparkSession.sparkContext.broadcast((model, grams, weights, bias))
    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of(text_col).alias("text"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, grams, weights, bias = spread.value
        restore, find = restorer(model), _matcher(grams)
        for batch in batches:
            z = [bias + float(weights[f].sum()) if (f := find(restore(t))) else bias for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [round(1 / (1 + math.exp(-max(-60.0, min(60.0, s)))), 6) for s in z]})

    return kept.mapInPandas(scored, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", {1: TOXIC_ROWS, 0: CLEAN_ROWS})
    grams, weights, bias = learn(restored(sample, model, ["doc_id", "label"]))
    out = score(docs, model, grams, weights, bias)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
