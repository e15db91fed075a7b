"""A mix of sources with an exact number of words from each.

1. The size of a text is its number of words. Sources are numbered in the order of their code points (null last), by a range
   exchange and one row for each of its partitions; they weigh WEIGHTS in turn.
2. Targets share the words of all texts by weight. Those above EPOCHS times their source stop there, and what is left is shared
   again by weight among the others, until none is above; each round is one aggregate over the sources.
3. Every document gets a hash-random key. One range exchange on (source, key) sorts each source at random, whatever its size: a
   source with a third of all rows is cut like any other stretch of the order. Sums of each (partition, source) give
   what stands before a partition, a window inside it the rest.
4. A budget of b words from a source of s is b div s whole epochs of all its documents, and one more of the first b mod s words of
   the order. The document at the cut gives its first words only, so a source gives its budget to the word.

Rows that move hold a source number, a key, an id and a size, never a text.

Cases: a null or empty text has size 0 and gives nothing; rows without an id and repeated rows are documents of their own
(equal rows may swap what they give, which changes no result); null is a source like any other; a table without
words gives zeros; an empty table gives an empty one; other columns are not read. Numbers of sources, documents and words are not bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.storage import kept
from cartlens.session import freeze

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix"
WORD = r"[^\\x20\\x09-\\x0D]+"

COLUMNS = ("doc_id", "source", "size", "source_size", "target", "taken", "whole", "part")


def size_of(text: str) -> Column:
    """The number of words of a text column."""
    return F.expr(f"coalesce(cast(regexp_count(`{text}`, '{WORD}') as bigint), 0L)")


def key_of(id_column: str, text: str, seed: str = SEED) -> Column:
    """A number that is random for every id, and for every text of rows without one."""
    named = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), named))


def _before(sums: DataFrame, of: list[str], value: str) -> DataFrame:
    """Adds `before`: the sum of `value` in earlier partitions (part) of the same group."""
    earlier = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("bigint")))


def numbered(sources: DataFrame) -> DataFrame:
    """Distinct sources with their number (from 0) in the order of code points, null last."""
    parts = freeze(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        parts.join(_before(counts, [], "n").drop("n"), "part")
        .withColumn("number", F.col("before") + F.row_number().over(inside) - 1)
        .drop("part", "before")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds `target` to sources with source_size and number. A source stops at `epochs` times its size."""
    listed = F.array(*[F.lit(w).cast("bigint") for w in weights])
    most = F.col("source_size") * epochs
    weighed = kept(
        sources.withColumn("weight", F.element_at(listed, (F.col("number") % len(weights) + 1).cast("int"))).withColumn("most", most), "sources"
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, 0
    if total:
        # The share of a unit of weight only grows from round to round, so a source that has stopped stays so.
        weight = weighed.agg(F.sum("weight")).first()[0]
        while weight:
            stopped = F.col("most").cast("decimal(38,0)") * F.lit(weight) < F.col("weight").cast("decimal(38,0)") * F.lit(rest)
            found = weighed.agg(
                F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0)).alias("most"),
                F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)).alias("weight"),
            ).first()
            if (total - found["most"], found["weight"]) == (rest, weight):
                break
            rest, weight = total - found["most"], found["weight"]
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return weighed.withColumn("target", F.when(F.lit(weight > 0), F.least(share, F.col("most").cast("double"))).otherwise(F.col("most").cast("double")))


def mix(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row for every row of `texts`: COLUMNS. `taken` words are `whole` times the document and its first `part` words."""
    rows = kept(
        texts.select(
            F.col(f"`{id_column}`").alias("doc_id"),
            F.col(f"`{source_column}`").alias("source"),
            size_of(text_column).alias("size"),
            key_of(id_column, text_column, seed).alias("key"),
        ),
        "sizes",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = kept(targets(numbered(sources), weights, epochs), "targets")
    order = ["number", "key", "doc_id", "size", "row"]
    placed = (
        # The row number only tells equal rows apart, so that many of them are cut as well.
        rows.withColumn("row", F.monotonically_increasing_id())
        .join(budgets.select("source", "number"), rows["source"].eqNullSafe(budgets["source"]))
        .select(*order, rows["source"])
    )
    parts = freeze(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("number", "part").agg(F.sum("size").alias("words"))
    sums = _before(sums, ["number"], "words").join(budgets.drop("source", "weight", "most"), "number")
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    sums = sums.select(
        "number", "part", "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5D) as bigint) div source_size")).otherwise(F.lit(0)).alias("whole"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(F.lit(0)).alias("rest"),
    )
    inside = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(sums, ["number", "part"])
        .withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at"))))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .select(*[F.col(c).cast("bigint") if c in ("whole", "part", "taken") else F.col(c) for c in COLUMNS])
    )
