"""Operator 11: phrases of words that stand together more often than their parts would by chance.

All n-grams of each language become rows and are counted by a hash aggregation; counts of the parts
are joined to the candidates, scores are exact decimals, phrases that hardly ever stand without one
more word are dropped by an anti-join, and a window ranks the rest.

Rows are made level by level so that those which cannot count are never made: a phrase with
``least`` occurrences has that many of each of its words and of each pair of neighbours. So words
are counted first, then pairs whose words are frequent, then longer phrases whose pairs are all
frequent. A task looks words and pairs up in a map of bits (``bits_of``), which lets all frequent ones
through and by chance a few others; those are counted like the rest and drop out by their exact
count. The map has 16 bits a key, MOST_BITS at most: with more keys it lets more through, which
costs time and changes nothing. Phrases are combined in each task's chunk of text before Spark sees
them, and by Spark before the shuffle, so a phrase or language with a third of all words is no hot key.

A text is cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and a piece into words ``[^\\x20\\x09]+``; A-Z
are lower-cased. A null text has no words; a null language is ``und``. Repeated rows count each.
Ties of score go to the smaller first part, ties of rank to the larger count, then to the phrase by
its bytes. A very long text is one chunk: about 60 bytes a word. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Cache, chunks, discard, forget, saved, table

#: Words of a phrase, its least occurrences, the percentage of them that makes a longer phrase replace it, and phrases a language.
MOST_WORDS, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Characters of text that are combined before their phrases become rows.
CHUNK = 4_000_000
#: Bits of the map of frequent words or pairs: 32 MB at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

_ENDS = b",;:!?\n\x0b\x0c\r"
_PIECES = bytes.maketrans(_ENDS + bytes(range(65, 91)), b"." * len(_ENDS) + bytes(range(97, 123)))
_hashes = Cache(xxhash.xxh3_64_intdigest)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The lower-cased words in order, with ``.`` for each cut and one more at the end: no word holds a dot."""
    return text.encode("utf-8", "replace").translate(_PIECES).replace(b".", b" . ").split() + [b"."]


def mixed(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its start and its next word."""
    h = (hashes ^ (hashes >> np.uint64(29))) * _MIX + more
    return h ^ (h >> np.uint64(32))


def salted(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of words in a language."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")))
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    _hashes.trim()
    return mixed(np.full(len(h), own), h)


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def grams(lang: str, words: list[bytes], sizes: range, bits: np.ndarray | None) -> Iterator[tuple[list[str], np.ndarray]]:
    """(phrases, counts) for each size: all n-grams within pieces whose words (size 2) or pairs (above) are in the map.

    Counting is exact: numbers stand for words and phrases of this list, not hashes.
    """
    seen: dict[bytes, int] = {b".": 0}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    known = list(seen)
    if sizes.start == 1:
        counts = np.bincount(ids, minlength=len(known))
        yield [w.decode() for w in known[1:]], counts[1:]
        return
    own = salted(lang, known)
    inside = ids > 0
    if sizes.start == 2:
        inside &= among(bits, own)[ids]
    goes_on = inside[:-1] & inside[1:]  # whether the word at i and the next may stand in one phrase
    if sizes.start > 2:
        hashes = own[ids]
        goes_on[goes_on] = among(bits, mixed(hashes[:-1], hashes[1:])[goes_on])
    at, phrase = np.flatnonzero(goes_on), ids[:-1][goes_on]
    phrase = phrase * len(known) + ids[at + 1]
    for n in range(2, sizes.stop):
        if n > 2:  # one more word, where the pair that it makes goes on; numbers of phrases are dense, so products fit 64 bits
            more = np.flatnonzero((at + n - 2 < len(goes_on)) & goes_on[np.minimum(at + n - 2, len(goes_on) - 1)])
            at, phrase = at[more], phrase[more] * len(known) + ids[at[more] + n - 1]
        if not len(at):
            return
        _, first, phrase, counts = np.unique(phrase, return_index=True, return_inverse=True, return_counts=True)
        if n >= sizes.start:
            starts = at[first].tolist()
            yield [b" ".join(words[i : i + n]).decode() for i in starts], counts


def gram_rows(df: DataFrame, text_col: str, lang_col: str, sizes: range, bits: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, size, f): n-grams as rows, counted within chunks of text."""
    source = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    held = df.sparkSession.sparkContext.broadcast(bits)

    def flush(texts: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        for lang, some in texts.items():
            words: list[bytes] = []
            for t in some:
                words += words_of(t)
            for phrases, counts in grams(lang, words, sizes, held.value):
                size = phrases[0].count(" ") + 1 if phrases else 0
                for i in range(0, len(phrases), 100_000):
                    part = pa.array(phrases[i : i + 100_000], pa.string())
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), part, pa.array(np.full(n, size, np.int32)), pa.array(counts[i : i + n].astype(np.int64))], names=["lang", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            langs, some = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(some, CHUNK):
                for lang, t in zip(langs[a:b], some[a:b], strict=True):
                    texts.setdefault(lang, []).append(t)
                    size += len(t)
                if size >= CHUNK:
                    yield from flush(texts)
                    texts, size = {}, 0
        yield from flush(texts)
        forget()

    return source.mapInArrow(run, "lang string, phrase string, size int, f bigint")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def bits_of(frequent: DataFrame) -> np.ndarray:
    """The map of frequent words, or pairs, of all languages; its size is bounded by MOST_BITS."""
    keys = frequent.count()
    n = LEAST_BITS
    while n < min(16 * keys, MOST_BITS):
        n *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(phrase.encode().split(b" "))
            for lang, some in by.items():
                h = salted(lang, [w[0] for w in some])
                if len(some[0]) == 2:
                    h = mixed(h, salted(lang, [w[1] for w in some]))
                at = h & np.uint64(n - 1)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["place", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n // 64, dtype=np.uint64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(df: DataFrame, text_col: str, lang_col: str, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases with ``least`` occurrences, (lang, n) with all words of each language)."""
    words = saved(counted(gram_rows(df, text_col, lang_col, range(1, 2))))
    totals = saved(words.groupBy("lang").agg(F.sum("f").alias("n")))
    levels = [saved(words.where(F.col("f") >= least))]
    discard(words)
    for sizes in (range(2, 3), range(3, most_words + 1)):
        if sizes.start <= most_words:
            levels.append(saved(counted(gram_rows(df, text_col, lang_col, sizes, bits_of(levels[-1]))).where(F.col("f") >= least)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def part(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of phrases of two words or more, by their lowest-scoring cut."""
    cuts = frequent.where("size > 1").selectExpr("lang", "phrase", "size", "f as a", "split(phrase, ' ') as words", "explode(sequence(1, size - 1)) as k")
    cuts = cuts.selectExpr("lang", "phrase", "size", "a", "k", f"{part('words', '1', 'k')} as first", f"{part('words', 'k + 1', 'size')} as rest")
    # Both parts are frequent themselves, as they stand wherever the phrase does.
    both = cuts.join(frequent.selectExpr("lang", "phrase as first", "f as l"), ["lang", "first"]).join(frequent.selectExpr("lang", "phrase as rest", "f as r"), ["lang", "rest"]).join(totals, "lang")
    exact = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.expr(f"struct({exact} as score, k, size, a, l, r, n)")).alias("x"))
    return lowest.select("lang", "phrase", "x.size", "x.a", "x.l", "x.r", "x.n", "x.score")


def extensions(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a phrase that has one word more. A longer one still has no larger count."""
    inner = f"explode(array({part('words', '1', 'size - 1')}, {part('words', '2', 'size - 1')})) as phrase"
    return frequent.where("size > 2").selectExpr("lang", "f", "size", "split(phrase, ' ') as words").selectExpr("lang", "f", inner).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, or all with ``top`` None."""
    frequent, totals = frequent_phrases(df, text_col, lang_col, most_words, least)
    longer = extensions(frequent).withColumnsRenamed({"lang": "__lang", "phrase": "__phrase"})
    covered = (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")) & (F.col("longer") * 100 >= F.col("a") * share)
    kept = scored(frequent, totals).join(longer, covered, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)  # Spark keeps the first in each task before the shuffle
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def collocations_oracle(most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The same phrases in DuckDB, from all n-grams."""
    leads = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, most_words))
    texts = [" || ' ' || ".join(["w", *[f"w{k}" for k in range(1, n)]]) for n in range(1, most_words + 1)]
    each = " UNION ALL ".join(f"SELECT lang, {n + 1} AS size, {t} AS phrase FROM g WHERE {'w' if n == 0 else f'w{n}'} IS NOT NULL" for n, t in enumerate(texts))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
g AS (SELECT lang, w, {leads} FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM ({each}) GROUP BY ALL HAVING f >= {least}),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1),
x AS (SELECT c.lang, c.phrase, c.size, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:], ' ')),
low AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = low.lang AND f.size > low.size AND contains(' ' || f.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * f.f >= {share} * low.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {top}
"""
