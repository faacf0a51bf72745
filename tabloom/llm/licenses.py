"""Operator 8: licence scan with a positional rare-token index.

Texts are lower-cased (A-Z) words of letters, digits and non-ASCII characters. Licence templates are
indexed by word: a posting is a template and the word's place in it. Long licences are several
templates, cut where a name or year stands. Document frequencies are counted over all documents.

Of a template of n words at least MATCHED must stand at their places, so at most m = n - need may
fail. Words of the template that a file lacks fail anyway, and a template that lacks too many is out.
Of the others the file looks up those with the highest inverse document frequency, as many as hold
more places than may still fail: one of them stands at its place in any match, so none is missed.
Postings are intersected by relative position (template start = place in the file - place in the
template), and each start is verified: enough words at their places, and the mandatory key phrases
in the window.

The base labels are places of fixed phrases, found in every text whatever the index says.
A null text is empty: no words, no labels, score 0. Rows are scanned one by one, whole at any length, so
repeated rows and ids do not matter. Words of equal frequency are looked up in the order of their
bytes. Columns of the input stay but for those named like an output; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import table, with_columns

# Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
with open(os.path.join(os.path.dirname(__file__), "licence_templates.json"), encoding="utf-8") as _file:
    #: Label, words, and the phrases without which a match does not count.
    TEMPLATES = [(x["label"], x["text"], x["keys"]) for x in json.load(_file)]
#: The share of words at their places that verifies a start.
MATCHED = 0.6
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def document_counts(df: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each word of a small vocabulary."""
    words = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            held[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                held.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = df.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


class Scanner:
    """Templates with their index."""

    def __init__(self, n: int, counts: dict[bytes, int], templates: list = TEMPLATES, matched: float = MATCHED) -> None:
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.need = [math.ceil(matched * len(words)) for _, words, _ in self.templates]
        idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for _, words, _ in self.templates for w in words}
        self.places: list[dict[bytes, list[int]]] = []
        for _, words, _ in self.templates:
            at: dict[bytes, list[int]] = defaultdict(list)
            for k, w in enumerate(words):
                at[w].append(k)
            self.places.append({w: at[w] for w in sorted(at, key=lambda w: (-idf[w], w))})  # rarest first
        self.words = [frozenset(p) for p in self.places]
        self.phrases = [(words_of(p), label) for p, label in PHRASES.items()]
        self.known = frozenset().union(*self.words, *(p for p, _ in self.phrases))

    def lookups(self, there: set[bytes]) -> dict[bytes, list[tuple[int, int]]]:
        """The postings of the words that a file with these licence words looks up."""
        out: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, places in enumerate(self.places):
            spare = len(self.templates[t][1]) - self.need[t]
            if len(absent := self.words[t] - there) <= spare and (spare := spare - sum(len(places[w]) for w in absent)) >= 0:
                for w, at in places.items():
                    if w in there:
                        out[w] += [(t, k) for k in at]
                        spare -= len(at)
                        if spare < 0:
                            break
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "places": []}
        there = self.known.intersection(words)
        if not there:
            return out
        base = []
        for phrase, label in self.phrases:
            if there.issuperset(phrase):
                base += [(start, label) for start in find(words, phrase)]
        starts: set[tuple[int, int]] = set()
        if rare := self.lookups(there):
            for i, w in enumerate(words):
                if w in rare:
                    starts.update((t, i - k) for t, k in rare[w])
        found = [(start, self.templates[t][0], share) for t, start in starts if (share := self.verify(words, t, start))]
        if base:
            places = [s for s, _ in base]
            out |= {"n_base": len(base), "first_word": min(places), "last_word": max(places), "base_labels": ",".join(sorted({x for _, x in base}))}
        out["labels"] = ",".join(sorted({x for _, x in base} | {x for _, x, _ in found}))
        out["score"] = 1.0 if base else max((s for _, _, s in found), default=0.0)
        out["places"] = sorted([*((max(s, 0), x, share) for s, x, share in found), *((s, x, 1.0) for s, x in base)])
        return out

    def verify(self, words: list[bytes], t: int, start: int) -> float:
        """The share of a template's words at their places; 0 if too few or without a key phrase."""
        _, template, keys = self.templates[t]
        hits = sum(w == x for w, x in zip(words[max(start, 0) : start + len(template)], template[max(-start, 0) :]))
        if hits < self.need[t]:
            return 0.0
        window = words[max(0, start - 2) : start + len(template) + 2]
        return hits / len(template) if all(find(window, k) for k in keys) else 0.0


def find(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """All places where the words of a phrase stand one after the other."""
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def scan_licenses(df: DataFrame, text_col: str = "text", templates: list = TEMPLATES) -> DataFrame:
    """Add counts, labels, score and ``places`` (start word, label, share of the template)."""
    vocabulary = {w for _, text, _ in templates for w in words_of(text)}
    scanner = df.sparkSession.sparkContext.broadcast(Scanner(*document_counts(df, vocabulary, text_col), templates))
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])

    def fn(columns: list[pa.Array]) -> list:
        found = [scanner.value.scan(t) for t in columns[0].to_pylist()]
        places = [[dict(zip(("start", "label", "share"), p, strict=True)) for p in x["places"]] for x in found]
        return [*([x[k] for x in found] for k in kinds), places]

    return with_columns(df, [text_col], [*(T.StructField(k, v) for k, v in kinds.items()), T.StructField("places", T.ArrayType(place))], fn)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "places")


def licenses_oracle(templates: list = TEMPLATES, matched: float = MATCHED) -> str:
    """The same in DuckDB, without an index: all words of a text against all places of all templates."""

    def text(words: list[bytes]) -> str:
        return " ".join(w.decode() for w in words)

    split = [(label, words_of(words), keys) for label, words, keys in templates]
    rows = ",\n".join(f"({t}, '{label}', '{text(words)}', {math.ceil(matched * len(words))}, {[text(words_of(k)) for k in keys]}::VARCHAR[])" for t, (label, words, keys) in enumerate(split))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
template(t, label, words, need, keys) AS (VALUES {rows}),
phrase(label, p) AS (VALUES {phrases}),
base AS (SELECT i, label, unnest(list_filter(range(1, len(w) + 1), lambda k: w[k] = p[1] AND w[k:k + len(p) - 1] = p)) - 1 AS start FROM d, phrase),
places AS (SELECT t, unnest(string_split(words, ' ')) AS word, unnest(range(len(string_split(words, ' ')))) AS k FROM template),
words AS (SELECT i, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
hits AS (SELECT i, t, pos - k AS start, count(*) AS n FROM words JOIN places USING (word) GROUP BY ALL),
near AS (SELECT i, label, keys, hits.n / len(string_split(words, ' ')) AS share, ' ' || array_to_string(w[greatest(start - 2, 0) + 1:start + len(string_split(words, ' ')) + 2], ' ') || ' ' AS around
  FROM hits JOIN template USING (t) JOIN d USING (i) WHERE hits.n >= need),
found AS (SELECT i, label, share FROM near WHERE len(list_filter(keys, lambda x: NOT contains(around, ' ' || x || ' '))) = 0),
b AS (SELECT i, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY i),
f AS (SELECT i, max(share) AS share FROM found GROUP BY i),
l AS (SELECT i, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT i, label FROM base UNION ALL SELECT i, label FROM found) GROUP BY i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score FROM d LEFT JOIN b USING (i) LEFT JOIN f USING (i) LEFT JOIN l USING (i)
"""
