"""Operator 10: SimHash fingerprints, and a search within a Hamming radius by permuted block tables.

A text's terms are its pairs of neighbouring words, lower-cased (one word alone is a term of its
own). A term's weight is 1 + floor(log2(count)), and each bit of its 128-bit hash votes with that
weight; a bit of the fingerprint is 1 where the votes for it prevail. The likeness of two
fingerprints at Hamming distance h is cos(pi h / 128), not below 0: the estimate of the cosine.

For a radius r the search cuts fingerprints into blocks, one table for each. With (r + 1) / (f + 1)
blocks, two within r differ in at most f bits of some block, so an equality join of one side's blocks
with the other's under all flips of up to f bits finds all of them; f follows the number of
fingerprints. A pair is reported by the first block that it nearly agrees on.

Null texts are empty; texts without words have fingerprint 0. The next document in descending id is
found by ranges of ids with about as many bytes each: every range also gets the first document of the
range below it, and the lowest the first of all, so texts are shuffled once and each task streams its
range in order. Equal ids are ordered by a hash of the text, then by the text, and are cut into ranges
by that hash where they are many; null ids come last. A bit whose votes tie is 0. Texts are
fingerprinted whole, at any length, in slices of their terms. Columns of the input stay but for one
named like the output; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Cache, chunks, forget, saved, table, with_columns

#: Sets of word 5-grams 75 % alike in long texts are 14 bits apart on average, as operator 9 links them.
BITS, RADIUS = 128, 17
#: Bytes of the texts of one range of ids, about, the most ranges, and documents of a range that are looked at to cut it.
RANGE_BYTES, MOST_RANGES, LOOKED_AT = 4_000_000, 20_000, 100
#: Terms whose bits are unpacked at once.
SLICE = 200_000
_WORDS = Cache(xxhash.xxh3_64_intdigest)
_NO_ID = -(2**63)
_LIKENESS = np.maximum(np.cos(np.pi * np.arange(BITS + 1) / BITS), 0.0)


def _mixed(x: np.ndarray, add: int) -> np.ndarray:
    x = x + np.uint64(add)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints as rows of 16 bytes."""
    out = [np.zeros((0, BITS // 8), np.uint8)]
    for a, b in chunks(texts, 1_000_000):
        _WORDS.trim()
        words = [t.lower().encode().split() for t in texts[a:b]]
        counts = np.array([len(w) for w in words], np.int64)
        one = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
        del words  # of a long text they are larger than all arrays
        doc = np.repeat(np.arange(b - a, dtype=np.int32), counts)
        # A pair of words, unless the text ends between them; a text of one word has that.
        term = _mixed(one, 0)
        term[:-1] += one[1:]
        use = np.r_[doc[1:] == doc[:-1], False] if len(one) else np.zeros(0, bool)
        use |= counts[doc] == 1
        term[counts[doc] == 1] = one[counts[doc] == 1]
        term, doc = _mixed(term[use], 1), doc[use]
        order = np.lexsort((term, doc))
        term, doc = term[order], doc[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(term)])
        weight = 1 + np.floor(np.log2(np.maximum(times, 1))).astype(np.int64)
        term, doc = np.repeat(term[first], weight), np.repeat(doc[first], weight)
        votes = np.zeros((b - a, BITS), np.int64)
        for lo in range(0, len(term), SLICE):  # a term's bits take 128 bytes
            part, of = term[lo : lo + SLICE], doc[lo : lo + SLICE]
            bits = np.unpackbits(np.stack([part, _mixed(part, 2)], axis=1).view(np.uint8), axis=1)
            shown, start = np.unique(of, return_index=True)
            sizes = np.diff(np.r_[start, len(of)])
            votes[shown] += 2 * np.add.reduceat(bits, start, axis=0, dtype=np.int32) - sizes[:, None]
        out.append(np.packbits(votes > 0, axis=1))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    return _LIKENESS[np.bitwise_count(a ^ b).sum(axis=1)]


def add_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column, as hex digits."""

    def fn(columns: list[pa.Array]) -> list:
        return [[x.tobytes().hex() for x in fingerprints([t or "" for t in columns[0].to_pylist()])]]

    return with_columns(df, [text_col], [T.StructField(out_col, T.StringType())], fn)


def _long(fingerprint: Column, half: int) -> Column:
    """Half of a fingerprint as a signed number."""
    parts = [F.conv(F.substring(fingerprint, 16 * half + 8 * k + 1, 8), 16, 10).cast("long") for k in (0, 1)]
    return F.shiftleft(parts[0], 32).bitwiseOR(parts[1])


def _digits(name: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{half}"), 16, "0") for half in ("hi", "lo")]))


def _flips(radius: int, rows: int) -> int:
    """How many bits to flip in a block: the least probes and candidates of one query among ``rows`` fingerprints."""

    def cost(flips: int) -> float:
        tables = max(3, -(-(radius + 1) // (flips + 1)))
        width = BITS / tables
        probes = tables * sum(math.comb(round(width), k) for k in range(flips + 1))
        return probes * (10 + rows / 2**width)

    return min(range(min(radius, 3) + 1), key=cost)


def _bits(hi: Column, lo: Column, a: int, b: int) -> Column:
    """Bits a to b of a fingerprint in two halves, fewer than 63."""
    mask = (1 << (b - a)) - 1
    if b <= 64:
        return F.shiftrightunsigned(hi, 64 - b).bitwiseAND(F.lit(mask))
    if a >= 64:
        return F.shiftrightunsigned(lo, 128 - b).bitwiseAND(F.lit(mask))
    return F.shiftleft(hi.bitwiseAND(F.lit((1 << (64 - a)) - 1)), b - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - b))


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS, flips: int | None = None) -> DataFrame:
    """All (query, match, distance) of fingerprints within ``radius``; each frame has a ``fingerprint``.

    Distinct fingerprints alone are joined; join the result to the rows on either side for ids.
    """
    flips = _flips(radius, index.count()) if flips is None else flips
    tables = max(3, -(-(radius + 1) // (flips + 1)))
    cuts = [round(k * BITS / tables) for k in range(tables + 1)]
    spans = list(zip(cuts, cuts[1:]))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        # Two numbers stand for a fingerprint in the shuffles, not its 32 digits.
        only = df.where("fingerprint is not null").select(_long(F.col("fingerprint"), 0).alias(f"{name}_hi"), _long(F.col("fingerprint"), 1).alias(f"{name}_lo")).distinct()
        keys = [F.lit(t << 44).bitwiseOR(_bits(F.col(f"{name}_hi"), F.col(f"{name}_lo"), *span)) for t, span in enumerate(spans)]
        return only.select("*", F.posexplode(F.array(*keys)).alias("table", "key"))

    def masks(width: int) -> list[int]:
        return [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(width), k)]

    probes = blocks(queries, "query")
    if flips:
        turned = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks(b - a)]) for a, b in spans])
        probes = probes.withColumn("mask", F.explode(F.get(turned, F.col("table")))).withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask")
    # Spark takes the probes for as small as the fingerprints that they are made of, so it is told not to send them to all tasks.
    both = probes.hint("merge").join(blocks(index, "match").drop("table"), "key")
    hi, lo = F.col("query_hi").bitwiseXOR(F.col("match_hi")), F.col("query_lo").bitwiseXOR(F.col("match_lo"))
    distance = F.bit_count(hi) + F.bit_count(lo)
    first = distance <= radius
    for t, span in enumerate(spans[:-1]):
        first = first & ((F.col("table") <= t) | (F.bit_count(_bits(hi, lo, *span)) > flips))
    return both.where(first).select(_digits("query").alias("query"), _digits("match").alias("match"), distance.alias("distance"))


def _below(cuts: list[int], key: Column) -> Column:
    """How many of sorted numbers are below a key; many are searched by the last of each part first."""
    if len(cuts) <= 128:
        return F.size(F.filter(F.lit(cuts), lambda c: c < key)) if cuts else F.lit(0)
    step = math.isqrt(len(cuts))
    part = F.size(F.filter(F.lit(cuts[step - 1 :: step]), lambda c: c < key))
    rest = F.get(F.array(*[F.lit(cuts[k : k + step]) for k in range(0, len(cuts), step)]), part)
    return part * step + F.coalesce(F.when(rest.isNotNull(), F.size(F.filter(rest, lambda c: c < key))), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Deal (doc_id, text) into sorted ranges of descending id, each with the document that follows it.

    Adds ``bucket`` and ``tail``; a row with tail 0 is followed by its next document in its partition.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = F.octet_length("text") + 100
    total = docs.agg(F.sum(size)).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, math.ceil(total / RANGE_BYTES)))
    at = [k / ranges for k in range(1, ranges)]
    # A sample in which a document stands by its bytes; only its quantiles come to the driver.
    looked_at = docs.where(F.xxhash64("key", "tie", F.lit(1)) / float(2**64) + 0.5 < size * (ranges * LOOKED_AT / max(total, 1)))
    cuts = Counter(looked_at.agg(F.percentile_approx("key", at, 10 * LOOKED_AT * ranges)).first()[0] or []) if at else Counter()
    known = sorted(cuts)
    times, before = [cuts[c] for c in known], [0, *accumulate(cuts[c] for c in known)]
    if known:
        place = _below(known, F.col("key"))
        # An id with the bytes of several ranges has several, by the hash of the text.
        own = F.when(F.get(F.lit(known), place) == F.col("key"), F.get(F.lit(times), place) - 1 - F.floor((F.col("tie") / float(2**64) + 0.5) * F.get(F.lit(times), place)))
        bucket = (F.get(F.lit(before), place) + F.greatest(F.coalesce(own, F.lit(0)), F.lit(0))).cast("int")
    else:
        bucket = F.lit(0)
    docs = docs.withColumn("bucket", bucket)
    first = F.max(F.struct("key", F.bitwise_not("tie").alias("down"))).alias("x")  # the largest id, of equals the smallest hash
    heads = sorted((r.bucket, r.x.key, ~r.x.down) for r in docs.groupBy("bucket").agg(first).collect())  # at most MOST_RANGES
    after = docs.sparkSession.createDataFrame([(key, tie, heads[(k + 1) % len(heads)][0]) for k, (_, key, tie) in enumerate(heads)], "key long, tie long, to int")
    tails = docs.join(F.broadcast(after), ["key", "tie"]).dropDuplicates(["to"]).select("doc_id", "key", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("tail"))
    both = docs.withColumn("tail", F.lit(0)).unionByName(tails)
    return both.repartition(ranges, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "tie", "text")


def near_pairs(docs: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, near_id, distance, rows): of the rows asked about, each fingerprint within ``radius``.

    ``near_id`` is the smallest doc_id with that fingerprint, of ``rows`` in all; their own is included.
    """
    classes = saved(docs.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.min("doc_id").alias("near_id")))
    found = search(docs.where(asked), classes, radius)
    return found.join(classes, found["match"] == classes["fingerprint"]).select(F.col("query").alias("fingerprint"), "near_id", "distance", "rows")


def near_counts(docs: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near, near): for the fingerprints of the rows asked about, the rows within ``radius``, their own included, and the pairs."""
    pair = F.struct("near_id", "distance")
    return near_pairs(docs, asked, radius).groupBy("fingerprint").agg(F.sum("rows").alias("n_near"), F.sort_array(F.collect_list(pair)).alias("near"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text.

    ``n_near`` is the number of documents within RADIUS of a document whose id is divisible by 20,
    found by the search over all documents, and ``near`` has the smallest id and the distance of each
    fingerprint found; both are null for the others.
    """
    made = saved(edited_fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    answers = made.where(asked).join(near_counts(made, asked), "fingerprint").select(*made.columns, "n_near", "near")
    rest = made.where(~asked).withColumns({"n_near": F.lit(None).cast("long"), "near": F.lit(None).cast(answers.schema["near"].dataType)})
    return answers.unionByName(rest)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): fingerprints of each text and of the text with its last half from the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        prints = np.zeros((0, BITS // 8), np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                more = list(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True))
                rows, prints = rows[-1:] + more, np.concatenate([prints[-1:], fingerprints([r[1] for r in more])])
                pairs = [k for k in range(len(rows) - 1) if not rows[k][2]]
                edited = [_edited(rows[k][1], rows[k + 1][1]) for k in pairs]
                own, following, other = prints[pairs], prints[[k + 1 for k in pairs]], fingerprints(edited)
                columns = [
                    pa.array([rows[k][0] for k in pairs], pa.int64()),
                    pa.array([len(rows[k][1]) for k in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([x.tobytes().hex() for x in own], pa.string()),
                    pa.array([x.tobytes().hex() for x in other], pa.string()),
                    pa.array(likeness(own, other), pa.float64()),
                    pa.array(likeness(own, following), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
        forget()

    return with_next(docs).select("doc_id", "text", "tail").mapInArrow(run, schema)


def _edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]
