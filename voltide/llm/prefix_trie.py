"""The prefix trie of conversations by truncation peeling.

Conversations that are equal to the end merge first, then peeling descends from the deepest turn that different sequences
share: nodes that survive from the depth below and sequences that end here are grouped by the key of their prefix, which
gives the depth's nodes with members, children, leaves and saved tokens of their subtrees in one aggregation; then each
node's last turn is stripped, and it goes on to the next depth as a row of its parent. A tail that one sequence has alone
is stripped at once, since nothing can merge with it, so there are as many steps as the deepest shared turn has turns
before it, however long conversations are.

A prefix's key is two 64-bit sums (exclusive or) of hashes of its turns with their depths, taken as equality. Keys and
positions come from sums over all turns in order (`prefix_sums`), so a conversation of any number of turns is never in one
task. Texts are read once and hashed there; only hashes and lengths are shuffled.

Defined cases: a null role or text is empty; turns of one number are in the order of their hashes, a null number is first;
repeated rows are turns of their own; rows without a conversation's id belong to none and are left out; a conversation
without turns (a rebuilt one can be) is a member of the root; texts of any length count by their code points; an empty
table has no nodes, the root included; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table, written
from .prefix_sums import running

#: Conversations of a century take up to this many turns less one from its first.
HEADS = 6
#: Nodes with more than one in HEAVY of all nodes below them are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000
#: Ids of so many consecutive numbers are listed in one row before a list is hashed.
PIECE = 4096

NODE = ("k1", "k2")


def turns_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A narrow row a turn: conv_id, depth (from 1), t1 and t2 (hashes of role and text), chars (code points of the text)."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), role, text).alias("t2"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    rows = running(rows, order, {"place": F.lit(1)}).drop("turn")
    first = rows.groupBy("conv_id").agg((F.min("place") - 1).alias("before"))
    return rows.join(first.hint("merge"), "conv_id").select("conv_id", (F.col("place") - F.col("before")).alias("depth"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % 100 for its own first h; h is the unsigned CRC-32
    of c's decimal digits, modulo HEADS. Returns the turns, and the conversations with their number of turns, 0 included.
    """
    turns = cut(turns)
    own = turns.groupBy("conv_id").agg(F.max("depth").alias("n_own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS, "of": F.col("conv_id") - F.col("conv_id") % 100})
    head = F.array_sort(F.collect_list(F.struct("depth", "t1", "t2", "chars")))  # fewer than HEADS turns
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("depth") < HEADS)).groupBy(F.col("conv_id").alias("of")).agg(head.alias("head"))
    convs = own.join(heads, "of", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = cut(convs.withColumn("ends", F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))
    taken = convs.select("conv_id", F.inline("head"))
    kept = turns.join(convs.select("conv_id", "h", F.size("head").alias("n_head")).hint("merge"), "conv_id").where("depth > h")
    kept = kept.withColumn("depth", F.col("depth") - F.col("h") + F.col("n_head"))
    return taken.unionByName(kept.select(*taken.columns)), convs.select("conv_id", F.col("ends").cast("long").alias("ends"))


def _keyed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Adds to each turn the key of the prefix that it ends (k1, k2), that of the one before it (p1, p2), the code points
    of all turns so far, and its conversation's number of turns.
    """
    own = {"x1": F.xxhash64("depth", "t1", "t2"), "x2": F.xxhash64(F.lit("second"), "depth", "t1", "t2")}
    rows = running(turns.select("conv_id", "depth", "chars", *[x.alias(name) for name, x in own.items()]), [F.col("conv_id"), F.col("depth")], {"upto": F.col("chars")}, {"k1": F.col("x1"), "k2": F.col("x2")})
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    first = rows.where("depth = 1").select("conv_id", xor("k1", "x1").alias("b1"), xor("k2", "x2").alias("b2"), (F.col("upto") - F.col("chars")).alias("before"))
    rows = rows.join(first.join(convs, "conv_id").hint("merge"), "conv_id")
    rows = rows.withColumns({"k1": xor("k1", "b1"), "k2": xor("k2", "b2"), "upto": F.col("upto") - F.col("before")})
    return rows.withColumns({"p1": xor("k1", "x1"), "p2": xor("k2", "x2")}).select("conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "upto", "ends")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256: the digest of the ids that end at a node, ascending, joined by commas.

    Ids are listed a piece at a time; a digest is made in one go over its pieces, in order and one at a time, whatever their number.
    """
    at = ["depth", "k1", "k2"]
    piece = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")  # at most PIECE ids
    pieces = ends.groupBy(*at, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(piece.alias("ids"))
    pieces = pieces.repartition(shuffle_partitions(ends.sparkSession), *at).sortWithinPartitions(*at, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*at, "ids"))):
                if key == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        out.append([*node, digest.hexdigest()])
                    node, digest = key, hashlib.sha256(ids.encode())
            yield _rows(out)
        yield _rows([[*node, digest.hexdigest()]] if node else [])

    return pieces.drop("piece").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _rows(out: list[list]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "k1", "k2", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """turns: conv_id, depth (1 to the conversation's number of turns), t1, t2, chars, as `turns_of` gives; convs: conv_id
    and ends, the number of turns, if some conversations may have none.

    Returns a row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The turn of a node is that of its conv_id at its depth.
    """
    spark = turns.sparkSession
    if convs is None:
        convs = turns.groupBy("conv_id").agg(F.max("depth").alias("ends"))
    zero = F.lit(0).cast("long")
    rows = cut(_keyed(turns, convs))
    ends = rows.where("depth = ends").select("depth", "k1", "k2", "conv_id", "upto").unionByName(
        convs.where("ends = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("upto")))
    # equal conversations are one sequence, which its smallest id stands for
    sequences = cut(ends.groupBy("depth", *NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("upto").alias("whole")))
    stands = sequences.select("conv_id", "n_convs", "whole")
    prefixes = rows.join(stands.hint("merge"), "conv_id").groupBy("depth", *NODE).agg(
        F.count(F.lit(1)).alias("sequences"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("chars").alias("chars"),
        F.min_by(F.struct("conv_id", "n_convs", "ends", (F.col("whole") - F.col("upto") + F.col("chars")).alias("rest")), "conv_id").alias("one"))
    prefixes = written(prefixes, "prefixes")
    shared = prefixes.where("sequences > 1")
    # what a lone tail's node counts is known at once: it has one leaf, and all below it have the same members
    lone = prefixes.where("sequences = 1").select("depth", *NODE, "p1", "p2", "one.conv_id", "one.n_convs", (F.col("depth") < F.col("one.ends")).cast("long").alias("n_children"),
                                                  F.lit(1).cast("long").alias("n_leaves"), ((F.col("one.n_convs") - 1) * F.col("one.rest")).alias("saved_tokens"))
    nodes = [lone]
    depth = shared.agg(F.max("depth")).first()[0] or 0
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    none = {c: zero for c in counts}
    # a prefix that is shared, without members yet: where it hangs, and the length of its last turn
    places = shared.select("depth", *NODE, "p1", "p2", "chars", F.lit(None).cast("long").alias("conv_id")).withColumns(none)
    # what comes to such a prefix from below it: the tops of lone tails, a row each parent, and sequences that end
    nowhere = {c: F.lit(None).cast("long") for c in ("p1", "p2", "chars")}
    tails = lone.where(F.col("depth") <= depth + 1).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumns(nowhere)
    ended = sequences.where(F.col("depth") <= depth).select("depth", *NODE, "conv_id", "n_convs").withColumns(none | nowhere | {"n_convs": F.col("n_convs")})
    waiting = written(places.unionByName(tails).unionByName(ended), "waiting").select("depth", *NODE, "p1", "p2", "chars", "conv_id", *counts)
    stripped = None
    for d in range(depth, -1, -1):
        here = waiting.where(F.col("depth") == d)
        here = here if stripped is None else here.unionByName(stripped)
        level = here.groupBy("depth", *NODE).agg(*[F.max(c).alias(c) for c in ("p1", "p2", "chars")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in counts])
        # rows of a lone prefix are in its tail already
        level = level.where("chars IS NOT NULL") if d else level.where("conv_id IS NOT NULL")
        level = level.withColumns({"n_leaves": F.greatest(F.col("n_leaves"), F.lit(1)), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce("chars", zero)})
        level = cut(level)
        nodes.append(level.drop("chars"))
        stripped = level.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens").withColumns(nowhere).select(*waiting.columns)
    every = nodes[0]
    for level in nodes[1:]:
        every = every.unionByName(level)
    every = written(every, "nodes")
    # a node's parent is the same conversation's in a tail, else a shared prefix; those with many children are broadcast
    n_nodes = every.count()
    above = lone.select("depth", *NODE).withColumn("lone", F.lit(True))
    parents = every.join(above, ["depth", *NODE], "left_anti").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = cut(parents)
    by = ["depth", "p1", "p2"]
    heavy = parents.where(F.col("n_children") * HEAVY > n_nodes).drop("n_children")
    light = parents.where(F.col("n_children") * HEAVY <= n_nodes).drop("n_children")
    of_heavy = every.join(F.broadcast(heavy), by)
    of_light = every.join(F.broadcast(heavy.select(*by)), by, "left_anti").join(light.hint("merge"), by, "left")
    linked = of_heavy.unionByName(of_light)
    linked = linked.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    out = linked.join(_digests(ends), ["depth", *NODE], "left")
    return out.select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


#: Every prefix of every conversation as a list, with CRC-32 from its polynomial as in `sharding.SQL`.
SQL = r"""
WITH b AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384)) ORDER BY n) AS rest FROM (SELECT unnest(range(256)) AS n)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN regexp_extract_all(c::VARCHAR, '.')]), lambda r, x: xor(r >> 8, rest[(xor(r, x) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), b),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {r: coalesce(role, ''), x: coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
re AS (SELECT h.c, p AS d, turn FROM h JOIN t ON t.c = h.c - h.c % 100 AND p <= h
  UNION ALL SELECT h.c, p - h + least(h, coalesce(n, 0)), turn FROM h JOIN t ON t.c = h.c AND p > h LEFT JOIN n ON n.c = h.c - h.c % 100),
s AS (SELECT h.c, coalesce(list(turn ORDER BY d) FILTER (d IS NOT NULL), []) AS s FROM h LEFT JOIN re ON re.c = h.c GROUP BY h.c),
pre AS (SELECT c, d = len(s) AS ends, d, s[1:d] AS k FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kid AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
every AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].x) ELSE 0 END AS saved FROM node LEFT JOIN kid USING (k)),
below AS (SELECT k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM every) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
FROM every a JOIN below USING (k) LEFT JOIN node p ON a.d > 0 AND p.k = a.k[1:a.d - 1]
"""
