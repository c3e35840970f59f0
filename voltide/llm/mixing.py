"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards by a seeded digest of their id. A source's targets over the shards so far are apportioned as
equal-token blocks: its i-th block has the quotient target / (2 i + 1), and it gets those blocks whose quotients are the
highest, above half a block's words. What a shard adds to them is its integer quota, so quotas miss by less than a block
wherever the shards are cut, and the last shard's last block is a part of one, so that the source's total is its target
to the word. A source never gets more than `cap` times the words that a shard has of it; where whole blocks would (or would
take some back), as with sources at their cap, its blocks are of one word. Then the quota's words are taken along the
documents of the shard and source in seeded order, once round and again where the quota asks for more.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, sorted last; repeated
rows are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, identified, n_words_of, table, text_of, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: A block has a 50,000th of all words, at least 1 and at most 1,024; a shard has 4,096 blocks' worth of words.
BLOCKS, MOST_WORDS, SHARD_BLOCKS = 50_000, 1024, 4096


def _draw(seed: str, what: str) -> Column:
    """A whole number below 2**32, from the seed and the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row a source: source, source_size, target.

    Water filling in closed form: a target is the smaller of cap * size and level * weight; sorted by cap * size over
    weight, a prefix of the sources is at its cap, and the rest share what is left. One row a source reaches the
    window, not one a document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    whole = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    rest = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    by = by.select(
        "*",
        F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(rest).alias("open_weight"),
        F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    by = by.withColumn("level", (share * F.col("all") - F.col("capped")) / F.col("open_weight"))
    # the first source, in order of ratio, whose level is no more than its ratio sets the level of all that follow
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    return by.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """sizes: doc_id, source, size (words), and row, which tells rows apart, if they have it already.

    Returns doc_id, source, size, source_size, target, taken, block_words, row.
    """
    row = F.col("row") if "row" in sizes.columns else F.monotonically_increasing_id().alias("row")
    rows = cut(sizes.select(row, "doc_id", "source", F.col("size").cast("long").alias("size")))
    words = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = max(1, min(MOST_WORDS, words // BLOCKS))
    shards = max(1, -(-words // (block * SHARD_BLOCKS)))
    rows = rows.withColumn("shard", _draw(seed, "shard") % shards)
    targets = source_targets(rows, weights, share, cap)
    # quotas: a row for each shard and source reaches these windows
    held = rows.groupBy("shard", "source").agg(F.sum("size").alias("held"))
    held = held.join(F.broadcast(targets) if _few(targets) else targets, held["source"].eqNullSafe(targets["source"])).drop(targets["source"]).where("held > 0")
    plan = held.withColumn("upto", F.sum("held").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    due = lambda n: F.col("target") * (n / F.col("source_size"))
    blocks = lambda n: F.when(n == F.col("source_size"), F.round(F.col("target"))).otherwise(F.round(due(n) / block) * block).cast("long")
    plan = plan.select("*", (blocks(F.col("upto")) - blocks(F.col("upto") - F.col("held"))).alias("quota"), (F.round(due(F.col("upto"))) - F.round(due(F.col("upto") - F.col("held")))).cast("long").alias("words"))
    fits = F.min(F.col("quota").between(0, cap * F.col("held"))).over(Window.partitionBy("source"))
    take = F.when(fits, F.col("quota")).otherwise(F.col("words"))
    plan = plan.select(F.col("shard").alias("p_shard"), F.col("source").alias("p_source"), "held", F.least(take, cap * F.col("held")).alias("take"))
    # blocks lie end to end along the seeded order; whole rounds take every word, the last one the words before its end
    line = Window.partitionBy("shard", "source").orderBy(_draw(seed, "order"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.withColumn("end", F.sum("size").over(line))
    laid = laid.join(plan, (F.col("shard") == F.col("p_shard")) & F.col("source").eqNullSafe(F.col("p_source")), "left")
    rounds, last = F.floor(F.col("take") / F.col("held")), F.col("take") % F.col("held")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("end"), last) - (F.col("end") - F.col("size")))
    laid = laid.select("row", "doc_id", "source", "size", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))
    t = targets.withColumnRenamed("source", "t_source")
    laid = laid.join(F.broadcast(t) if _few(targets) else t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    return laid.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "taken", F.lit(block).cast("long").alias("block_words"), "row")


def _few(targets: DataFrame, most: int = 50_000) -> bool:
    """Whether the sources are few enough to broadcast; counted up to one more than that."""
    return targets.limit(most + 1).count() <= most


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words_of(text_of()).alias("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row for each whole round that takes a document, and one, with
    the words that are taken joined by spaces, where the mix ends within it.
    """
    rows, row = identified(docs)
    sizes = rows.select(F.col(row).alias("row"), "doc_id", "source", n_words_of(text_of()).alias("size"))
    taken = mix(sizes, **how).where("taken > 0").select(F.col("row").alias("__of"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    own = [F.col(c).alias(f"__own_{c}") for c in docs.columns]  # so that no name of theirs is in the way
    rows = rows.select(F.col(row).alias("__at"), *own).join(taken, F.col("__at") == F.col("__of"))
    rows = rows.withColumn("__round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__taken") - 1) / F.col("__size")))))
    rest = F.col("__taken") - F.col("__round") * F.col("__size")
    cut_text = F.array_join(F.slice(words_of(text_of("__own_text")), F.lit(1), rest.cast("int")), " ")
    rows = rows.withColumn("__own_text", F.when(rest >= F.col("__size"), F.col("__own_text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("__own_n_chars", F.length("__own_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes_of(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1:shard:' || doc_id), 1, 8))::BIGINT AS draw,
         ('0x' || substr(md5('mix-1:order:' || doc_id), 1, 8))::BIGINT AS place
  FROM documents),
n AS (SELECT sum(size)::BIGINT AS words, greatest(1, least(1024, sum(size)::BIGINT // 50000)) AS block FROM d),
k AS (SELECT *, greatest(1, (words + block * 4096 - 1) // (block * 4096)) AS shards FROM n),
r AS (SELECT d.*, draw % shards AS shard, block FROM d, k),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0::DOUBLE, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size / weight AS ratio FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
        - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
l AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, l.level * weight) AS target FROM v, l),
h AS (SELECT shard, r.source, any_value(block) AS block, any_value(source_size) AS size, any_value(target) AS target, sum(size)::BIGINT AS held
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source GROUP BY shard, r.source HAVING sum(size) > 0),
g AS (SELECT *, sum(held) OVER (PARTITION BY source ORDER BY shard)::BIGINT AS upto FROM h),
q AS (SELECT *, round(target * (upto / size)) - round(target * ((upto - held) / size)) AS words,
             CASE WHEN upto = size THEN round(target) ELSE round(target * (upto / size) / block) * block END - round(target * ((upto - held) / size) / block) * block AS quota FROM g),
e AS (SELECT shard, source, held, least(CASE WHEN bool_and(quota BETWEEN 0 AND 2 * held) OVER (PARTITION BY source) THEN quota ELSE words END, 2 * held)::BIGINT AS take FROM q),
a AS (SELECT *, sum(size) OVER (PARTITION BY shard, source ORDER BY place, doc_id)::BIGINT AS stop FROM r)
SELECT a.doc_id, a.size::BIGINT AS size, t.source_size, t.target,
       coalesce((take // held) * size + greatest(0, least(stop, take % held) - (stop - size)), 0)::BIGINT AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
LEFT JOIN e ON a.shard = e.shard AND a.source IS NOT DISTINCT FROM e.source
"""
