"""Operator 12: exact copies by an extendible-hash index on shared files, with DataFrame functions alone.

Every document has an entry (64-bit hash of its text, id) in the shared folder. Entries of equal hash
are one key, merged in each task before they are shuffled, so that a group of copies, however large,
is one row. Keys lie in buckets by the leading bits of their hash. A bucket with more keys than a
task should own is overfull and splits by one more bit; that doubles the directory, which points
from as many leading bits as the deepest bucket has to the bucket's number (``directory``). Each task
owns whole buckets, which are ranges of keys, and writes their files.

Only documents whose key has several entries can be copies. Their texts (kept apart by a map of
bits) are grouped by hash and by the text itself, which compares bytes; a key with several texts is a
collision, and its texts are a chain of entries, each a group of its own. So hashes find candidates
and bytes decide. With more repeated keys than the map has bits, more texts are compared and the
result stays the same; all texts are shuffled once at most.

Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id
stays; of rows that are equal in text and id, one stays; a null id is smaller than all others. Columns
named in ``keep`` pass unchanged unless an output has their name; others are not read. Texts of any
length are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import discard, maybe_among, saved, table

#: Keys of a bucket at least, and buckets that the keys are dealt to, about: the directory is at most some times as large.
CAPACITY, BUCKETS = 8192, 1 << 14
#: Cells of a directory that may be sent to all tasks.
CELLS = 1 << 20
#: A key with more than this part of all rows is joined by a broadcast: there are fewer than so many.
HOT = 1000
BITS = 64


def hashed(text: Column, bits: int = BITS) -> Column:
    """The key of a text: its hash, of which the leading ``bits`` count (fewer than 64 only to test collisions)."""
    h = F.xxhash64(text)
    return h if bits == BITS else F.shiftleft(leading(h, bits), BITS - bits) if bits else F.lit(0).cast("bigint")


def leading(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int, bits: int = BITS) -> tuple[DataFrame, int]:
    """((cell, bucket, depth), bits of a cell): the bucket of each value of the leading bits of ``h``.

    It starts at the depth that even keys would need. Overfull buckets alone are counted again, one
    bit deeper, until none is left; a bucket of one key cannot split and stays as it is.
    """
    total = keys.count()
    depth = min(bits, max(0, ceil(log2(total / capacity)))) if total else 0
    leaves, rest = None, keys.select("h")
    while True:
        counts = saved(rest.groupBy(leading(F.col("h"), depth).alias("cell")).agg(F.count("*").alias("held")))  # a row for each bucket
        full = counts.where(F.col("held") > capacity) if depth < bits else counts.limit(0)
        done = counts.join(F.broadcast(full.select("cell")), "cell", "left_anti").select(F.lit(depth).alias("depth"), "cell")
        leaves = done if leaves is None else leaves.unionByName(done)
        if full.isEmpty():
            break
        rest = rest.join(F.broadcast(full.select("cell")), leading(F.col("h"), depth) == F.col("cell"), "left_semi")  # fewer than total / capacity rows
        depth += 1
    wide = leaves.select("depth", F.expr("shiftleft(1L, depth) + cell").alias("bucket"), F.expr(f"shiftleft(cell, {depth} - depth)").alias("first"))  # numbers of all depths differ
    return wide.select(F.expr(f"explode(sequence(first, first + shiftleft(1L, {depth} - depth) - 1))").alias("cell"), "bucket", "depth"), depth


def index(entries: DataFrame, capacity: int | None = None, bits: int = BITS) -> DataFrame:
    """(bucket, h, n, last): the keys in files of whole buckets; ``last`` is the entry of the largest id."""
    keys = saved(entries.groupBy("h").agg(F.count("*").alias("n"), F.max(F.struct("id", (-F.col("tag")).alias("tag"))).alias("last")))
    cells, depth = directory(keys, capacity or max(CAPACITY, keys.count() // BUCKETS), bits)
    cells = F.broadcast(cells) if depth <= log2(CELLS) else cells
    placed = keys.join(cells, leading(F.col("h"), depth) == F.col("cell")).select("bucket", "h", "n", "last")
    out = saved(placed.repartition("bucket").sortWithinPartitions("bucket", "h"))
    discard(keys)
    return out


def _groups(keys: DataFrame) -> list[Column]:
    """keep_id, group_size and kept of a row joined with its key ``n`` and ``last``; rows without one are alone."""
    alone = F.col("n").isNull()
    return [F.when(alone, F.col("id")).otherwise(F.col("last.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (alone | (F.col("last.tag") == -F.col("tag"))).alias("kept")]


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows, each with its key's group; keys that many rows have are few, and go to all tasks."""
    total = rows.count()
    names, made = [c for c in rows.columns if c not in (*on, "tag")], _groups(keys)
    hot = F.broadcast(keys.where(F.col("n") * HOT > total))
    many = rows.join(hot, on).select(*names, *made)
    few = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col("n") * HOT <= total), on, "left").select(*names, *made)
    return many.unionByName(few)


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, capacity: int | None = None, bits: int = BITS) -> DataFrame:
    """One row for each document: ``keep``, id, keep_id, group_size, kept, text_sha256."""
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    keep = [c for c in keep or [] if c not in (id_col, *made)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]).withColumn("h", hashed(F.col("text"), bits))
    extra = [f"keep{i}" for i in range(len(keep))]
    entry = ["id", "h", F.monotonically_increasing_id().alias("tag"), F.unhex(F.sha2("text", 256)).alias("sha"), *extra]
    rows = saved(source.select(*entry))  # written, so that a tag stays with its row
    keys = index(rows, capacity, bits)
    repeated = keys.where("n > 1")

    # Texts that may be copies, compared by their bytes.
    texts = maybe_among(source.select("h", "text"), F.col("h"), repeated, F.col("h")).groupBy("h", "text").agg(F.count("*").alias("n"))
    collided = saved(texts.groupBy("h").agg(F.count("*").alias("chain")).where("chain > 1").select("h"))
    if collided.isEmpty():
        out = with_keys(rows, repeated.select("h", "n", "last"), ["h"])
    else:
        chained = saved(maybe_among(source, F.col("h"), collided, F.col("h")).join(collided, "h").select(*entry, "text"))
        chain = chained.groupBy("h", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", (-F.col("tag")).alias("tag"))).alias("last"))
        single = with_keys(rows.join(collided, "h", "left_anti"), repeated.select("h", "n", "last").join(collided, "h", "left_anti"), ["h"])
        out = single.unionByName(with_keys(chained, saved(chain), ["h", "text"]).select(*single.columns))
    names = [F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*names, F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies among all documents; the row with the largest id of each group stays."""
    return exact_copies(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""
