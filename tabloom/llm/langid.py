"""Operator 7: language identification by multinomial naive Bayes over hashed character n-grams.

Training takes, of each language, documents drawn by a hash of id and text, PER_LANG of them in
expectation (all, if there are fewer): a bound on the training rows, not on what is scored. Their
n-grams of 1 to 3 code points of the lower-cased text are hashed into CELLS cells and counted by
Spark for each language and cell. The smoothed log-probability matrix, CELLS by languages, is
broadcast, and batches of texts are scored sparsely in numpy: only the rows of cells that occur
are read, and summed over each whole text.

Null texts and texts without a letter give ``und`` with score 0; so does everything where no
document has a language. Null languages are not learned; a null id is like any other, as the draw
hangs on the text too: rows that are equal in both are drawn or left together. Languages have equal
prior odds; of equally likely ones the first in order is taken. Texts are scored whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import chunks, table, with_columns

CELLS = 1 << 15
SIZES = (1, 2, 3)
#: Training documents of one language, in expectation.
PER_LANG = 1500
#: Languages that a model may have; their shares go to every task.
MOST_LANGS = 10_000
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def id_hash(id_col: str = "doc_id") -> Column:
    """crc32 of an id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def ngram_cells(texts: list[str], cells: int = CELLS) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells of the n-grams of some texts, an array for each size, by the place where they start.

    An n-gram that would reach into the next text has the cell ``cells``. The second result has the
    place where each text starts; every text has at least one place.
    """
    lowered = [t.lower() + "\0" for t in texts]
    starts = np.cumsum([0, *map(len, lowered)])[:-1]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, out = codes == 0, []
    key, bad = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n in range(max(SIZES)):
        part, stop = np.zeros_like(key), np.ones_like(bad)
        part[: len(codes) - n], stop[: len(codes) - n] = codes[n:], ends[n:]
        key = (key ^ part) * _MIX[n]
        key ^= key >> np.uint32(15)
        bad = bad | stop
        if n + 1 in SIZES:
            out.append(np.where(bad, np.int32(cells), (key % np.uint32(cells)).astype(np.int32)))
    return out, starts


def training_sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, per_lang: int) -> DataFrame:
    """Documents of each language whose hash is under the share that gives ``per_lang`` of them."""
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()  # a row for each language, as the matrix has a column
    if len(counts) > MOST_LANGS:
        raise ValueError(f"{len(counts)} languages; at most {MOST_LANGS}")
    shares = docs.sparkSession.createDataFrame([(r[0], per_lang / r[1]) for r in counts], "__lang string, __share double")
    u = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(shares), F.col(lang_col) == F.col("__lang")).where(u < F.col("__share")).drop("__lang", "__share")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log-probabilities with a last row of zeros for no n-gram."""
    sample = training_sample(docs.select(F.col(id_col), F.col(lang_col), F.col(text_col)), lang_col, id_col, text_col, per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                for lang in set(langs[a:b]):
                    own = [t for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang]
                    held.setdefault(lang, np.zeros(cells + 1, np.int64))
                    for found in ngram_cells(own, cells)[0]:
                        held[lang] += np.bincount(found, minlength=cells + 1)
        for lang, sums in held.items():
            at = np.flatnonzero(sums[:cells])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "cell", "n"])

    counts = sample.select(F.col(lang_col).alias("lang"), text_col).mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names, at = counts["lang"].to_pylist(), counts["cell"].to_numpy()
    langs = sorted(set(names))
    sums = np.ones((cells, len(langs)))
    np.add.at(sums, (at, np.array([langs.index(x) for x in names], np.int64)), counts["n"].to_numpy())
    logs = np.log(sums / sums.sum(axis=0)) if langs else sums
    logs = logs - logs.mean(axis=1, keepdims=True) if langs else logs  # what all languages share never decides
    return langs, np.vstack([logs, np.zeros((1, len(langs)))]).astype(np.float32)


def classify(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and posterior of each text."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    shown = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if langs else []
    columns = [np.ascontiguousarray(logs[:, k]) for k in range(len(langs))]
    for a, b in chunks([texts[i] for i in shown]):
        found, starts = ngram_cells([texts[i] for i in shown[a:b]], len(logs) - 1)
        sums = np.zeros((b - a, len(langs)))
        for k, column in enumerate(columns):
            for cells in found:
                sums[:, k] += np.add.reduceat(column[cells], starts, dtype=np.float64)
        best = sums.argmax(axis=1)
        p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, s in zip(shown[a:b], best.tolist(), p.tolist(), strict=True):
            names[i], scores[i] = langs[k], s
    return names, scores


def add_language(df: DataFrame, langs: list[str], logs: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast((langs, logs))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_columns(df, [text_col], fields, lambda columns: list(classify(columns[0].to_pylist(), *shared.value)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that are not held out, and predict all."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_hash(), F.lit(4)) == 2
    langs, logs = train(docs.where(~held_out))
    return add_language(docs.select("doc_id", held_out.alias("held_out"), "text"), langs, logs).drop("text")
