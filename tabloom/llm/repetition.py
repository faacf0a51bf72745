"""Operator 5: quality rules on repetition, from a suffix array over the words of each whole text.

The suffixes of all texts of a chunk are sorted together by prefix doubling (words first, then
twice as many words at each step, only among suffixes that are still equal); texts never mix, as a
text's number is part of its words' ranks. Longest common prefixes of neighbours in that order give
the longest repeat that starts at each word; where a repeat is not the tail of the one before it,
it is a maximal repeated passage. The union of those of at least MIN_WORDS words gives the covered
fraction. A text is rejected if the fraction or the longest repeat is above its limit.

Null and empty texts have no words, which fails the base rule. Rows are judged one by one, so repeated
rows and ids do not matter; measures at a limit pass. A very long text is one chunk, whole, with about
19 times its size of memory. Columns of the input stay but for those named like an output; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.llm.common import chunks, table, with_columns

#: Repeats of fewer words do not count as covered.
MIN_WORDS = 8
#: Rejected above these: the share of words in repeats, and the words of the longest repeat.
MAX_COVERED, MAX_LONGEST = 0.25, 60
#: Words of the texts of one call beyond which common prefixes are found in text order.
LONG = 400_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def suffix_ranks(first: np.ndarray, doc: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes, and (with ``keep``) for h = 1, 2, 4, ... those by their first h words alone.

    ``first`` are dense ranks of (text, word), so suffixes of one text are neighbours.
    """
    n = len(first)
    counts = np.bincount(first, minlength=1)
    rank = (np.cumsum(counts) - counts)[first]
    levels, h = [rank], 1
    open_ = np.flatnonzero(counts[first] > 1)
    while len(open_):
        after = open_ + h
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[open_[inside]]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = open_[order], key[order]
        old, place = rank[at], np.arange(len(at))
        new_old = np.r_[True, old[1:] != old[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        rank = rank.copy() if keep else rank
        rank[at] = old + start
        single = new & np.r_[new[1:], True]
        open_, h = at[~single], h * 2
        if keep:
            levels.append(rank)
    return rank, levels


def in_text_order(first: np.ndarray, doc: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each word, the common prefix of its suffix with the one before it in order: one array and one pass.

    The prefix shrinks by at most one from a word to the next, so all steps together are linear.
    """
    n = len(first)
    out = np.zeros(n, np.int64)
    word, text, before, at, made, h = memoryview(first), memoryview(doc), memoryview(order), memoryview(rank), memoryview(out), 0
    for i in range(n):
        if at[i] == 0:
            h = 0
            continue
        j = before[at[i] - 1]
        if text[i] != text[j]:
            h = 0
            continue
        while i + h < n and j + h < n and word[i + h] == word[j + h]:  # words of different texts differ
            h += 1
        made[i] = h
        h = max(h - 1, 0)
    return out


def longest_repeats(first: np.ndarray, doc: np.ndarray, long: int = LONG) -> np.ndarray:
    """For each word, how many words of the passage that starts there also start elsewhere in its text.

    Beyond ``long`` words common prefixes are found in text order, which keeps no ranks by length.
    """
    n = len(first)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    rank, levels = suffix_ranks(first, doc, n <= long)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    if n > long:
        out = in_text_order(first, doc, order, rank)
        same = out[order[1:]]
        np.maximum.at(out, order[:-1], same)
        return out
    near = np.flatnonzero(first[order[1:]] == first[order[:-1]])
    i, j = order[near], order[near + 1]
    same = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(i + same, n - 1), np.minimum(j + same, n - 1)
        fits = (i + same < n) & (j + same < n) & (levels[k][a] == levels[k][b])
        same += fits.astype(np.int64) << k
    np.maximum.at(out, i, same)
    np.maximum.at(out, j, same)
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edges = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def measure(texts: list[str]) -> dict[str, list]:
    """The columns of ``add_repetition`` for some texts."""
    words = [t.encode().split() for t in texts]  # on the ASCII white space of the contract, no other
    sizes = np.array([len(w) for w in words], np.int64)
    n, bounds = int(sizes.sum()), np.r_[0, np.cumsum(sizes)]
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, n)
    del words  # of a long text they are larger than all arrays
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    first = (np.unique(doc * np.int64(max(len(numbers), 1)) + ids, return_inverse=True)[1] if len(texts) > 1 else ids) if n else ids
    del ids
    repeat = longest_repeats(first, doc)
    three = np.flatnonzero(repeat >= 3)
    in_three = _covered(three, np.full(len(three), 3), n)
    long_ = np.flatnonzero(repeat >= MIN_WORDS)
    before = np.r_[0, repeat[:-1]] if n else repeat
    maximal = long_[before[long_] != repeat[long_] + 1]
    in_long = _covered(maximal, repeat[maximal], n)

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[bounds[1:]] - total[bounds[:-1]]

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, repeat)
    edge = np.diff(np.r_[0, in_long.astype(np.int8), 0])
    opens = np.flatnonzero((edge[:-1] == 1) | (in_long & np.r_[True, doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    closes = np.flatnonzero((edge[1:] == -1) | (in_long & np.r_[doc[1:] != doc[:-1], True])) + 1 if n else opens
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        spans[doc[a]].append((a - int(bounds[doc[a]]), b - int(bounds[doc[a]])))
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
    return {
        "n_words": sizes.tolist(),
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": sums(in_three).tolist(),
        "n_covered_words": sums(in_long).tolist(),
        "longest_repeat": longest.tolist(),
        "repeat_spans": spans,
    }


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def add_repetition(df: DataFrame, text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Add word counts, repetition measures, ``repeat_spans`` (word positions) and the verdicts."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")

    def fn(columns: list[pa.Array]) -> list:
        texts = [t or "" for t in columns[0].to_pylist()]
        found: dict[str, list] = {k: [] for k in (*longs, "repeat_spans")}
        for a, b in chunks(texts):
            for k, v in measure(texts[a:b]).items():
                found[k] += v
        spans = [[{"start": a, "end": b} for a, b in s] for s in found["repeat_spans"]]
        failed = [n < 50 or 100 * r > 50 * n for n, r in zip(found["n_words"], found["n_repeat_words"], strict=True)]
        kept = [not f and c <= max_covered * n and m <= max_longest for f, c, m, n in zip(failed, found["n_covered_words"], found["longest_repeat"], found["n_words"], strict=True)]
        return [*(found[k] for k in longs), spans, failed, kept]

    fields = [*(T.StructField(k, T.LongType()) for k in longs), T.StructField("repeat_spans", SPAN), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return with_columns(df, [text_col], fields, fn)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every whole document."""
    return add_repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "repeat_spans")


#: The same in DuckDB, without a suffix array: windows of 1, 2, 4, ... words are ranked by prefix doubling, and the longest
#: repeat of a text lies between the last length with a repeated window and twice that, where it is searched by halves.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT i, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
level AS (
  SELECT 0 AS k, i, pos, r, count(*) OVER (PARTITION BY i, r) AS held FROM (SELECT i, pos, dense_rank() OVER (PARTITION BY i ORDER BY word) AS r FROM words)
  UNION ALL
  SELECT k, i, pos, r, count(*) OVER (PARTITION BY i, r) FROM (
    SELECT k + 1 AS k, i, pos, dense_rank() OVER (PARTITION BY i ORDER BY r, after) AS r FROM (
      SELECT k, i, pos, r, coalesce(lead(r, 1 << k) OVER (PARTITION BY i ORDER BY pos), 0) AS after, max(held) OVER (PARTITION BY i) AS most FROM level) WHERE most > 1)),
top AS (SELECT i, max(k) FILTER (held > 1) AS k FROM level GROUP BY i),
ranked AS (SELECT l.i, l.pos, l.r, l.k FROM level l JOIN top ON l.i = top.i AND l.k = top.k),
halved AS (
  SELECT i, (1 << k)::BIGINT AS base, 0::BIGINT AS more, (1 << k)::BIGINT // 2 AS step FROM top WHERE k IS NOT NULL
  UNION ALL
  SELECT i, base, more + CASE WHEN most > 1 THEN step ELSE 0 END, step // 2 FROM (
    SELECT i, base, more, step, max(n) AS most FROM (
      SELECT h.i, base, more, step, count(b.r) AS n FROM halved h JOIN ranked a ON a.i = h.i LEFT JOIN ranked b ON b.i = a.i AND b.pos = a.pos + h.more + h.step
      WHERE step > 0 GROUP BY h.i, base, more, step, a.r, b.r) GROUP BY i, base, more, step)),
longest AS (SELECT i, base + more AS longest_repeat FROM halved WHERE step = 0),
triples AS (SELECT i, pos, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY i ORDER BY pos)),
three AS (SELECT i, pos FROM (SELECT i, pos, count(*) OVER (PARTITION BY i, a, b, c) AS held FROM triples WHERE c IS NOT NULL) WHERE held > 1),
in_three AS (SELECT i, count(DISTINCT pos + j) AS n FROM three, range(3) t(j) GROUP BY i),
in_long AS (SELECT i, count(DISTINCT pos + j) AS n FROM level, range({MIN_WORDS}) t(j) WHERE level.k = {MIN_WORDS.bit_length() - 1} AND held > 1 GROUP BY i),
lines AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
found AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(in_three.n, 0)::BIGINT AS n_repeat_words, coalesce(in_long.n, 0)::BIGINT AS n_covered_words, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN lines USING (i) LEFT JOIN in_three USING (i) LEFT JOIN in_long USING (i) LEFT JOIN longest USING (i)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND n_covered_words <= {MAX_COVERED}::DOUBLE * n_words AND longest_repeat <= {MAX_LONGEST} AS kept FROM judged
"""
