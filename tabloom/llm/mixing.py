"""Operator 4: mixing sources to target weights by Pareto order sampling.

Each source gets a target in words; targets above ``most`` times a source's size are cut to that,
and the excess goes to the others by weight. Within a source a document's expected number of copies
is its weight times a rate, at most ``most``, with the rate that makes the expected words the target.
The weight is a measure of the document's worth, by default the root of its words, rounded down:
longer documents are likelier, but short ones are not crowded out. The whole part of the expected
number is certain, and for the rest p one more copy is drawn.

The draw ranks documents by random odds u / (1 - u) over inclusion odds p / (1 - p) (Pareto order
sampling) and takes the best until the words that the target still lacks are reached, so the
sample's size is fixed: it ends at the document that brings the total nearest, and two further
passes offer what a long document at the end has left over to the documents after it.

Rows are dealt into sorted ranges of rank, so running sums are taken in two levels (ranges, then
rows within a range) and a source with most of the rows is spread over many tasks. The same rows and
seed give the same mix, however they are partitioned. Null texts have no words; a null source is one
source, last in order; documents without words are taken zero times; repeated rows are documents of
their own, told apart by a number, so each has a draw of its own, also where all ids are null. Equal
odds go by id (null first), size, text and that number. Texts are counted whole, at any length. Other
columns are read only where ``weight`` names them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, saved, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one range of ranks: about so many in small inputs, more in large ones, where ranges are many.
BLOCK, LARGE_BLOCK, RANGES = 5_000, 500_000, 256
FILLS = 2


def n_words(text: Column) -> Column:
    """The number of words of a text: a word starts where the text or white space ends."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) that only the seed and the keys decide; DuckDB computes the same."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def ranked_sources(sizes: DataFrame, source_col: str) -> DataFrame:
    """Add ``place``, from 0, by code point with null last; two levels, so no task sorts all sources."""
    null = F.col(source_col).isNull()
    dealt = sizes.withColumn("__null", null).repartitionByRange(F.col("__null"), F.col(source_col)).withColumn("__part", F.spark_partition_id())
    dealt = saved(dealt)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = Window.partitionBy("__part").orderBy("__null", source_col)
    return dealt.join(F.broadcast(parts), "__part").select(*sizes.columns, (F.row_number().over(within) - 1 + F.col("__before")).alias("place"))


def targets(sizes: DataFrame, source_col: str, total: int, most: int = 3) -> DataFrame:
    """Add each source's target: ``total`` shared by ``weight``, at most ``most`` times ``source_size``.

    Only sums come to the driver, twice at each round; rounds end when no source is above its bound.
    """
    level: float | None = None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.lit(most) * F.col("source_size")
        cut, weight = sizes.agg(F.sum(F.when(above, F.lit(most) * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        now = (total - (cut or 0)) / weight if weight else level
        if now is None or now == level or not weight:
            level = now or 0.0
            break
        level = now
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (F.lit(most) * F.col("source_size")).cast("double")))


def with_blocks(df: DataFrame, value: Column, out: str, all_blocks: bool = False) -> DataFrame:
    """Add the sum of ``value`` over the source's blocks: those before the row's own, or all."""
    blocks = df.groupBy("place", "block").agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy("place")
    over = over if all_blocks else over.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("place", "block", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias(out))
    return df.join(blocks, ["place", "block"])


RANK = ("q", "doc_id", "size", "digest", "copy")


def rates(by_weight: DataFrame, most: int = 3) -> DataFrame:
    """Add the copies of each weight in each source: ``whole``, certain, and ``p``, the chance of one more.

    Takes (place, w, words, target) for each weight of each source, and adds ``lack``, the words that
    the source's target still lacks after the whole copies. Expected copies are least(most, rate * w);
    the rate follows in closed form once it is known how many of the largest weights reach ``most``.
    """
    down = Window.partitionBy("place").orderBy(F.desc("w"))
    cut = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = by_weight.withColumn("rate", F.try_divide(F.col("target") - F.lit(most) * cut, open_.cast("double")))
    first = F.max(F.when(F.col("rate") * F.col("w") <= most, F.struct("w", "rate"))).over(Window.partitionBy("place"))
    copies = F.when(F.col("w") > 0, F.coalesce(F.least(F.lit(float(most)), first["rate"] * F.col("w")), F.lit(float(most)))).otherwise(0.0)
    known = tried.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    certain = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("place"))
    return known.withColumn("lack", F.col("target") - certain).drop("rate", "copies")


def pareto_take(rows: DataFrame, fills: int = FILLS) -> DataFrame:
    """Draw one more copy of some rows of each source; adds ``extra``, 1 for those drawn.

    Takes a saved table, which it deletes, of place, block (a range of the rank), RANK, size and lack,
    the words that the source still needs. The first pass walks by rank to the document that comes
    nearest; a fill offers the gap to the documents not drawn that fit in it, by rank as well.
    """
    out, held = rows.withColumn("extra", F.lit(0)), rows
    within = Window.partitionBy("place", "block").orderBy(*RANK).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(fills + 1):
        if k:
            out = with_blocks(out, F.col("extra") * F.col("size"), "got", all_blocks=True).withColumn("gap", F.col("lack") - F.col("got")).drop("got")
            fits = F.col("size") <= F.col("gap")
        else:
            out, fits = out.withColumn("gap", F.col("lack")), F.lit(True)
        offered = F.when((F.col("extra") == 0) & fits & (F.col("gap") > 0), F.col("size")).otherwise(0)
        out = with_blocks(out.withColumn("offered", offered), F.col("offered"), "ahead")
        before = F.col("ahead") + F.coalesce(F.sum("offered").over(within), F.lit(0))
        out = out.withColumn("before", before)
        after = F.col("before") + F.col("offered")
        near = after <= F.col("gap")
        if not k:
            near = near | (after - F.col("gap") < F.col("gap") - F.col("before"))
        drawn = (F.col("offered") > 0) & (F.col("before") < F.col("gap")) & near
        out = saved(out.withColumn("extra", F.col("extra") + F.when(drawn, 1).otherwise(0)).drop("offered", "ahead", "before", "gap"))
        discard(held)
        held = out
    return out


def odds(x: Column) -> Column:
    return x / (1 - x)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weight: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each document: doc_id, source, digest (of the text), copy (from 0 among repeated rows), size, source_size, target, copies, taken.

    ``weight`` is a whole number from columns of ``docs`` or from ``size``, 1 at least for texts with words.
    """
    weight = F.floor(F.sqrt(F.col("size").cast("double"))) if weight is None else F.when(F.col("size") > 0, weight).otherwise(0)
    read = docs.withColumns({"size": n_words(F.col(f"`{text_col}`")), "digest": F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    read = read.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), "digest", "size", weight.cast("long").alias("w"))
    counted = read.groupBy("doc_id", "source", "digest", "size", "w").agg(F.count("*").alias("n"))
    rows = saved(counted.select("doc_id", "source", "digest", "size", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
    by_weight = saved(rows.groupBy("source", "w").agg(F.sum("size").alias("words"), F.count("*").alias("n_rows")))
    sources = by_weight.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = ranked_sources(sources, "source").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    sources = saved(sources)
    n, total = by_weight.agg(F.sum("n_rows"), F.sum("words")).first()
    known = targets(sources, "source", total or 0, most).select(_key("source").alias("key"), "place", "source_size", "target")
    known = saved(rates(by_weight.select(_key("source").alias("key"), "w", "words").join(known, "key"), most).drop("words"))
    rows = rows.withColumn("key", _key("source")).join(known, ["key", "w"]).drop("key")
    u = uniform(seed, F.col("doc_id"), F.col("digest"), F.col("copy"))
    rows = saved(rows.withColumn("q", F.when((F.col("p") > 0) & (F.col("lack") > 0), odds(u) / odds(F.col("p")))).drop("w", "p"))
    offered = rows.where("q is not null")
    ranges = max(1, min(-(-(n or 0) // BLOCK), RANGES), -(-(n or 0) // LARGE_BLOCK))
    dealt = saved(offered.repartitionByRange(ranges, "place", *RANK).withColumn("block", F.spark_partition_id()))
    taken = rows.where("q is null").withColumn("extra", F.lit(0)).unionByName(pareto_take(dealt).drop("block"))
    copies = F.col("whole") + F.col("extra")
    return taken.select("doc_id", "source", "digest", "copy", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _key(column: str) -> Column:
    return F.when(F.col(column).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(column)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents, sources weighing 1, 2, 3 in turn."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_oracle(documents: str = "documents", seed: str = "mix", fills: int = FILLS) -> str:
    """The same mix in DuckDB: targets in closed form, and one step of running sums for each pass."""
    steps = []
    for k in range(fills + 1):
        was = f"pass{k - 1}" if k else "drawn0"
        fits = "TRUE" if not k else "size <= gap"
        near = "after <= gap" + (" OR after - gap < gap - before" if not k else "")
        steps.append(f"""
gap{k} AS (SELECT * EXCLUDE (gap), lack - sum(extra * size) OVER (PARTITION BY place) AS gap FROM {was}),
offer{k} AS (SELECT *, CASE WHEN extra = 0 AND {fits} AND gap > 0 THEN size ELSE 0 END AS offered FROM gap{k}),
walk{k} AS (SELECT *, coalesce(sum(offered) OVER (PARTITION BY place ORDER BY q, doc_id NULLS FIRST, size, digest, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM offer{k}),
near{k} AS (SELECT *, before + offered AS after FROM walk{k}),
pass{k} AS (SELECT * EXCLUDE (extra, offered, before, after), extra + CASE WHEN offered > 0 AND before < gap AND ({near}) THEN 1 ELSE 0 END AS extra FROM near{k})""")
    return rf"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM {documents}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy, floor(sqrt(size::DOUBLE))::BIGINT AS w FROM sized),
total AS (SELECT coalesce(sum(size), 0)::BIGINT AS t FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, place % 3 + 1 AS weight FROM src),
cut AS (SELECT *, row_number() OVER w AS k, coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cut_size,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, place)),
level AS (SELECT (SELECT (t - cut_size)::DOUBLE / open_weight FROM cut, total WHERE weight * ((t - cut_size)::DOUBLE / open_weight) <= 3 * source_size ORDER BY k LIMIT 1) AS l),
known AS (SELECT source, place, source_size, least(weight * coalesce(l, 0), (3 * source_size)::DOUBLE) AS target FROM weighed, level),
by_weight AS (SELECT k.place, d.w, any_value(k.target) AS target, sum(d.size)::BIGINT AS words FROM numbered d JOIN known k ON d.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
tried AS (SELECT *, (target - 3 * coalesce(sum(words) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / nullif(sum(w * words) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS rate FROM by_weight WINDOW v AS (PARTITION BY place ORDER BY w DESC)),
rate AS (SELECT place, arg_max(rate, w) AS rate FROM tried WHERE rate * w <= 3 GROUP BY place),
copied AS (SELECT b.*, CASE WHEN w > 0 THEN coalesce(least(3.0::DOUBLE, r.rate * w), 3) ELSE 0 END AS e FROM by_weight b LEFT JOIN rate r USING (place)),
lacking AS (SELECT place, w, floor(e)::BIGINT AS whole, e - floor(e) AS p, target - sum(floor(e)::BIGINT * words) OVER (PARTITION BY place)::BIGINT AS lack FROM copied),
expected AS (SELECT d.doc_id, d.size, d.digest, d.copy, k.place, k.source_size, k.target, l.whole AS copies, l.lack, l.p,
  (cast('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest || ':' || d.copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM numbered d JOIN known k ON d.source IS NOT DISTINCT FROM k.source JOIN lacking l ON l.place = k.place AND l.w = d.w),
drawn0 AS (SELECT *, u / (1 - u) / (p / (1 - p)) AS q, 0 AS extra, 0.0::DOUBLE AS gap FROM expected WHERE p > 0 AND lack > 0),{",".join(steps)}
SELECT doc_id, size, source_size, target, ((copies + extra) * size)::BIGINT AS taken FROM pass{fills}
UNION ALL SELECT doc_id, size, source_size, target, (copies * size)::BIGINT FROM expected WHERE NOT (p > 0 AND lack > 0)
"""
