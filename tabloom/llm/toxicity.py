"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences (ended by . ! ? or a line end). A sentence's probability is a
logistic function of the distinct words in it and of their starts of STARTS letters, which stand for
a word in all its endings, hashed into CELLS cells; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only labels of whole documents are learned from: the fit maximises their
likelihood under the noisy-or with a leak, a small probability that a document is marked without
any sentence being the cause, so labels by mistake do not make each long document suspicious. The
sentence scores then locate the offending sentences.

Training takes at most MAX_DOCS labelled documents of each class, those first by a hash of the id.
Cells are candidates if documents of class 1 hold them far more often than the base rate explains;
Spark counts them. To the driver come the candidates, and of each document of the sample the
sentences that hold one and the number of the others.
Scores are stretched so that the threshold that is best on the training documents is THRESHOLD.

Null and empty texts have no sentence and score 0. Rows with a null label or id are not learned
from; of several labels of a document the highest counts, and of several texts the smallest. Ties of
the hash go by the id, so reruns learn the same. Without both classes all scores are 0. Texts are
scored whole, at any length; columns of the input stay but for those named like an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import chunks, forget, saved, table, with_columns
from tabloom.llm.langid import id_hash

CELLS = 1 << 20
MAX_DOCS = 3000
#: Letters of the starts of longer words.
STARTS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
#: A candidate word is in so many documents of class 1, and so many standard deviations above
#: chance; a small group of copies that share a wrong label stays below that.
LEAST_DOCS, LEAST_Z = 12, 5.0
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 46 if c in b".!?\n" else 32 for c in range(256))
_END = b"."
_SENTENCE = re.compile(r"[^.!?\n]+")


def _cells(word: bytes) -> list[int]:
    """The cells of a word and of its starts."""
    letters = word if word.isascii() else word.decode("utf-8", "replace")
    starts = [letters[:k] for k in STARTS if k < len(letters)]
    return [zlib.crc32(word) & CELLS - 1, *(zlib.crc32(x if isinstance(x, bytes) else x.encode(), 1) & CELLS - 1 for x in starts)]


class Words(dict):
    """The packed cells of each word, all or only those among ``known``; CELLS for the end of a sentence."""

    def __init__(self, known: np.ndarray | None = None, most: int = 150_000) -> None:
        super().__init__()
        self.known, self.most = None if known is None else frozenset(known.tolist()), most

    def __missing__(self, word: bytes) -> bytes:
        cells = [CELLS] if word == _END else _cells(word) if self.known is None else [c for c in _cells(word) if c in self.known]
        value = self[word] = np.array(cells, np.int32).tobytes() if cells else b""
        return value


def sentence_cells(texts: list[str], words: Words | None = None) -> list[np.ndarray]:
    """Cells of the words of each text and of their starts, with CELLS after each sentence that has a word."""
    words = Words() if words is None else words
    if len(words) > words.most:
        words.clear()
    out = []
    for t in texts:
        sentences = b" . ".join(filter(None, map(bytes.strip, t.lower().encode().translate(_TABLE).split(_END))))
        out.append(np.frombuffer(b"".join(map(words.__getitem__, (sentences + b" .").split())) if sentences else b"", np.int32))
    return out


class Model(NamedTuple):
    cells: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    cut: float  # the raw score that becomes THRESHOLD

    def stretched(self, raw: np.ndarray) -> np.ndarray:
        low, high = raw * THRESHOLD / self.cut, THRESHOLD + (raw - self.cut) * (1 - THRESHOLD) / (1 - self.cut)
        return np.where(raw < self.cut, low, high)


def _among(cells: np.ndarray) -> np.ndarray:
    """A table of all cells that tells which are among some."""
    out = np.zeros(CELLS + 1, bool)
    out[cells] = True
    return out


def hit_sentences(bag: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, int]:
    """Of a document, the sentences that hold one of some cells, with these alone, and the number of the others."""
    flat, end = bag, bag == CELLS
    sentence, known = np.cumsum(end) - end, _among(cells)[bag]
    there = np.zeros(int(end.sum()), bool)
    there[sentence[known]] = True
    return flat[(known | end) & there[sentence]], int((~there).sum())


def candidates(bags: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Cells that documents of class 1 hold far more often than chance explains."""
    y = labels.astype(float)
    pairs = np.unique(np.concatenate([i * (CELLS + 1) + np.unique(b[b < CELLS]).astype(np.int64) for i, b in enumerate(bags)]))
    values, place, counts = np.unique(pairs % (CELLS + 1), return_inverse=True, return_counts=True)
    found, rate = np.bincount(place, weights=y[pairs // (CELLS + 1)]), y.mean()
    z = (found - counts * rate) / np.sqrt(counts * rate * (1 - rate))
    return values[(found >= LEAST_DOCS) & (z >= LEAST_Z)]


def sentence_logits(bags: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all sentences, and the bag of each."""
    flat = np.concatenate([np.zeros(0, np.int32), *bags])
    bag = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    end = flat == CELLS
    sentence = np.cumsum(end) - end
    known = np.flatnonzero(_among(model.cells)[flat])
    pairs = np.unique(sentence[known].astype(np.int64) * (CELLS + 1) + flat[known])
    sums = np.zeros(int(end.sum()))
    np.add.at(sums, pairs // (CELLS + 1), model.weights[np.searchsorted(model.cells, pairs % (CELLS + 1))])
    return sums + model.bias, bag[end]


def noisy_or(logits: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each bag."""
    return -np.expm1(-np.bincount(bag, weights=np.logaddexp(0, logits), minlength=n))


def fit(bags: list[np.ndarray], labels: np.ndarray, cells: np.ndarray | None = None, others: np.ndarray | None = None, rounds: int = 400) -> Model:
    """Weights of the candidate cells, bias and leak, by gradient ascent on the documents' likelihood.

    ``cells`` are the candidates if they are known; then bags may hold only sentences with one of
    them, and ``others`` is how many more each document has.
    """
    none = Model(np.zeros(0, np.int64), np.zeros(0), -30.0, 0.5)
    y, n = labels.astype(float), len(bags)
    if not n or y.min() == y.max():
        return none
    cells = candidates(bags, labels) if cells is None else np.sort(cells)
    if not len(cells):
        return none
    few = [hit_sentences(b, cells) for b in bags]
    bags, plain = [b for b, _ in few], np.array([k for _, k in few], float) + (0 if others is None else others)
    start = Model(cells, np.zeros(len(cells)), 0.0, 0.5)
    flat, bag = np.concatenate([np.zeros(0, np.int32), *bags]), np.repeat(np.arange(n, dtype=np.int32), [len(b) for b in bags])
    end = flat == CELLS
    sentence = np.cumsum(end) - end
    own = np.unique(sentence[~end].astype(np.int64) * (CELLS + 1) + flat[~end])
    of, feature = own // (CELLS + 1), np.searchsorted(cells, own % (CELLS + 1))
    with_word, its_bag = np.arange(int(end.sum())), bag[end]
    # weights, bias, logit of the leak
    x = np.r_[np.full(len(cells), 0.5), -6.0, -3.0]
    first, second, penalty = np.zeros(len(x)), np.zeros(len(x)), 0.02
    for k in range(1, rounds + 1):
        w, bias, leak = x[:-2], x[-2], x[-1]
        logits = bias + np.bincount(of, weights=w[feature], minlength=len(with_word))
        s = np.bincount(its_bag, weights=np.logaddexp(0, logits), minlength=n) + plain * np.logaddexp(0, bias) + np.logaddexp(0, leak)
        # The slope of the log-likelihood by s: -1 for label 0, 1 / (e^s - 1) for label 1.
        slope = np.where(y > 0, 1 / np.expm1(np.clip(s, 1e-9, 50)), -1.0)
        by_logit = slope[its_bag] / (1 + np.exp(-logits))
        up = np.r_[np.bincount(feature, weights=by_logit[of], minlength=len(cells)) - penalty * w, by_logit.sum() + (slope * plain).sum() / (1 + np.exp(-bias)) - penalty * (bias + 8), slope.sum() / (1 + np.exp(-leak))]
        first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up**2
        x = x + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        x[-2] = min(x[-2], -4.0)
    model = start._replace(weights=x[:-2], bias=float(x[-2]))
    logits, of_bag = sentence_logits(bags, model)
    raw = -np.expm1(-np.bincount(of_bag, weights=np.logaddexp(0, logits), minlength=n) - plain * np.logaddexp(0, model.bias))
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
    best = int(np.argmax(np.where(np.r_[raw[order][1:] < raw[order][:-1], True], f1, 0)))
    low = raw[order][best + 1] if best + 1 < n else 0.0
    return model._replace(cut=float(np.clip((raw[order][best] + low) / 2, 1e-6, 1 - 1e-6)))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents of each class."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * max_docs rows of two numbers: small enough to send to every task
    sample = saved(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    n, ones = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < ones < n:
        return fit([], np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            held = [np.unique(b[b < CELLS]) for a, z in chunks(texts) for b in sentence_cells(texts[a:z])]
            values, place, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *held]), return_inverse=True, return_counts=True)
            found = np.bincount(place, np.repeat(y, [len(h) for h in held]), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(counts, pa.int64()), pa.array(found.astype(np.int64))], names=["cell", "n", "ones"])
        forget()

    rate = ones / n
    z = (F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    counted = sample.select("text", "y").mapInArrow(count, "cell int, n long, ones long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    found = counted.where((F.col("ones") >= LEAST_DOCS) & (z >= LEAST_Z)).select("cell").collect()
    cells = np.sort(np.array([r.cell for r in found], np.int64))  # CELLS at most, each in LEAST_DOCS of the sample

    def reduced(columns: list[pa.Array]) -> list:
        texts = columns[0].to_pylist()
        few = [hit_sentences(b, cells) for a, z in chunks(texts) for b in sentence_cells(texts[a:z])]
        return [[b.tobytes() for b, _ in few], [k for _, k in few]]

    rows = with_columns(sample, ["text"], [T.StructField("cells", T.BinaryType()), T.StructField("others", T.LongType())], reduced).select("id", "y", "cells", "others").toArrow().sort_by("id")
    return fit([np.frombuffer(b, np.int32) for b in rows["cells"].to_pylist()], rows["y"].to_numpy(), cells, rows["others"].to_numpy())


def sentence_spans(text: str, model: Model, least: float = 0.5, words: Words | None = None) -> list[dict]:
    """Code point spans of a text's sentences with a probability of at least ``least``; all are scored at once."""
    found = list(_SENTENCE.finditer(text))
    logits, of = sentence_logits(sentence_cells([m[0] for m in found], words), model)
    scores = 1 / (1 + np.exp(-logits))
    return [{"start": found[k].start(), "end": found[k].end(), "score": float(scores[i])} for i, k in enumerate(of.tolist()) if scores[i] >= least]


def add_toxicity(df: DataFrame, model: Model, text_col: str = "text", locate: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted``; with ``locate`` also ``toxic_sentences`` of those predicted 1."""
    shared, held = df.sparkSession.sparkContext.broadcast(tuple(model)), []  # held: the words of one task

    def fn(columns: list[pa.Array]) -> list:
        model, texts = Model(*shared.value), [t or "" for t in columns[0].to_pylist()]
        if not held:
            held.append(Words(model.cells))
        scores: list[float] = []
        for a, b in chunks(texts):
            bags = sentence_cells(texts[a:b], held[0])
            scores += model.stretched(noisy_or(*sentence_logits(bags, model), len(bags))).clip(0, 1).tolist()
        made = [scores, [int(s >= THRESHOLD) for s in scores]]
        return [*made, [sentence_spans(t, model, words=held[0]) if s >= THRESHOLD else [] for t, s in zip(texts, scores, strict=True)]] if locate else made

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_columns(df, [text_col], [*fields, *([T.StructField("toxic_sentences", T.ArrayType(span))] if locate else [])], fn)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labels that may be learned from."""
    return train(docs, table(spark, sf_dir, "labels").where(F.pmod(id_hash(), F.lit(3)) != 1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document, and locate the offending sentences of those predicted 1."""
    docs = table(spark, sf_dir, "documents")
    scored = add_toxicity(docs.select("doc_id", (F.pmod(id_hash(), F.lit(3)) == 1).alias("held_out"), "text"), trained(spark, docs, sf_dir), locate=True)
    return scored.drop("text")
