"""Operator 1: SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch (a word with the space mark before it) are sorted, which is
the depth-first order of their trie, and the forward state of each trie node is computed once and
reused by all words below it. The model files are of the BPE kind. For these the forward pass
keeps, for each prefix, the one last piece that the merges of that prefix end in: a segmentation
is what the merges make if and only if every two neighbouring pieces stay apart when merged on
their own, so the state of a prefix follows from those of shorter prefixes, as in Viterbi's
recursion, and the result is the public library's, not merely one of high total score.

Nulls give null ids and null texts; the empty text gives no ids; null ids within an array are left
out; ids that are not in the model, negative ones too, raise. A model that is not of the BPE kind, or
that the coder cannot follow otherwise, is refused when it is read: the ids of some hundred pieces,
alone and side by side, are compared with the library's.

Rows are coded one by one, so repeated rows and ids do not matter, and of segmentations that tie the
library's is taken. A text is coded whole, at any length: its memory goes by its words. Columns of the
input stay but for those named like an output; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import CACHES, chunks, table, with_columns

#: A public model; a parameter of every function here.
MODEL = os.environ.get("TABLOOM_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"


#: Places of the map that tells which neighbours some piece holds side by side, as a power of two.
PAIRS = 21
#: Answers on neighbouring pieces that are remembered.
MOST_APART = 200_000


def pair_places(codes: np.ndarray) -> np.ndarray:
    """The place of each character and the next in the map of neighbours."""
    mixed = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - PAIRS)


class State(dict):
    """A start of pieces, the longest that ends where a walk stands: the next state by character, and the pieces that end here."""

    __slots__ = ("coder", "ends", "text")

    def __init__(self, coder: PieceCoder, text: str) -> None:
        super().__init__()
        self.coder, self.text, self.ends = coder, text, coder.ending(text)

    def __missing__(self, c: str) -> State:
        return self.coder.move(self, c)


class Apart(dict):
    """Whether a piece stays apart from each piece before it."""

    __slots__ = ("coder", "right")

    def __init__(self, coder: PieceCoder, right: str) -> None:
        super().__init__()
        self.coder, self.right = coder, right

    def __missing__(self, left: int) -> bool:
        self.coder.make_room()
        known = self[left] = self.coder.stay_apart(self.coder.pieces[left], self.right)
        return known


class PieceCoder:
    """The pieces of one model, and the encoder and decoder over them."""

    def __init__(self, path: str, most_words: int = 80_000) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of this model reach over word bounds")
        self.pieces = pieces
        #: Starts of pieces, with their states once walked to; a walk over a word keeps the longest that ends where it stands.
        self.starts: dict[str, State | None] = dict.fromkeys(p[:i] for p in self.id for i in range(len(p) + 1))
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.alike = Counter(s for p, s in self.score.items() if len(p) > 1)  # pieces by score
        #: Line ends that no piece holds are bounds as well, which keeps the distinct words few.
        self.lines = not any("\n" in p for p in self.id)
        self.bytes_of = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif model.is_byte(i):
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not model.is_control(i):
                self.bytes_of[i] = p.replace(MARK, " ").encode()
        #: Two neighbours that no piece holds side by side never merge: a word may be cut there, exactly. Where the map
        #: takes others for such a pair the word stays whole, which changes no ids.
        self.joined = np.zeros(1 << PAIRS, bool)
        pairs = "".join(sorted({p[i : i + 2] for p in self.id for i in range(len(p) - 1)}))
        self.joined[pair_places(np.frombuffer(pairs.encode("utf-32-le"), "<u4"))[::2]] = True
        self.packed: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: Kept between tasks: few numbers for each piece.
        self.apart: dict[int, Apart] = {}
        self.known_apart = 0
        self.most_words = most_words
        CACHES.extend((self.packed, self.parts))
        few = plain[:: max(1, len(plain) // 300)]
        texts = [pieces[a].replace(MARK, " ") + pieces[b].replace(MARK, " ") for a, b in zip(few, few[1:] + few[:1], strict=True)]
        if [np.frombuffer(x, "<i4").tolist() for x in self.encode(texts)] != model.encode(texts):
            raise ValueError(f"{path} is not a model whose pieces come from merges")

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What the merges alone make of a short text: the best-scored pair first, of equals the leftmost; no fewer parts than ``least``."""
        parts, score = list(text), self.score
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge is the last in making a piece; None if its score is another's too or no lower than its parts'."""
        if piece not in self.splits:
            parts = self.merged(piece, 2)
            made = len(parts) == 2 and self.alike[self.score[piece]] == 1 and all(len(x) == 1 or (self.score[x] > self.score[piece] and self.split(x)) for x in parts)
            self.splits[piece] = (parts[0], parts[1]) if made else None
        return self.splits[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether two pieces side by side are what the merges make of their text.

        The merges are undone from the last on, always the later of the two at the bound. What stands
        there then merges over the bound if that is a piece better than the merge just undone, or
        as good if that was on the right, as of equals the leftmost goes first.
        """
        if not all(len(x) == 1 or self.split(x) for x in (a, b)):
            return self.merged(a + b) == [a, b]
        get, first, splits = self.score.get, float("inf"), self.splits
        least, or_equal = -first, True
        x, y = a, b
        sx, sy = first if len(x) == 1 else get(x), first if len(y) == 1 else get(y)
        while True:
            s = get(x + y)
            if s is not None and (s > least or (or_equal and s == least)):
                return False
            if sx < sy:
                least, or_equal = sx, False
                x = splits[x][1]
                sx = first if len(x) == 1 else get(x)
            elif sy < first:
                least, or_equal = sy, True
                y = splits[y][0]
                sy = first if len(y) == 1 else get(y)
            else:
                return True

    def make_room(self) -> None:
        """Before another answer on neighbouring pieces: forget all if there are too many."""
        self.known_apart += 1
        if self.known_apart > MOST_APART:
            for known in self.apart.values():
                known.clear()
            self.known_apart = 1

    def state(self, text: str) -> State:
        found = self.starts[text]
        if found is None:
            found = self.starts[text] = State(self, text)
        return found

    def move(self, state: State, c: str) -> State:
        """The longest start of a piece that ends in c after ``state``."""
        now = state.text + c
        while now not in self.starts:
            now = now[1:]
        found = self.state(now)
        if now or c in self.starts:
            state[c] = found
        return found

    def ending(self, state: str) -> list[tuple[int, int, Apart]]:
        """Length, id and answers on neighbours of the pieces that end a state, the longest first."""
        tails = (state[i:] for i in range(len(state)))
        these = [p for p in tails if p in self.id and (len(p) == 1 or self.merged(p) == [p])]
        return [(len(p), self.id[p], self.apart.setdefault(self.id[p], Apart(self, p))) for p in these]

    def cut(self, words: list[str]) -> list[list[str]]:
        """Each word in parts that merge on their own."""
        text = "".join(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.ones(len(text) + 1, bool)
        if len(text) > 1:
            np.logical_not(self.joined[pair_places(np.frombuffer(text.encode("utf-32-le"), "<u4"))], out=starts[1:-1])
        starts[ends] = True
        at = np.flatnonzero(starts)
        last = np.searchsorted(at, ends).tolist()
        parts = [text[a:b] for a, b in itertools.pairwise(at.tolist())]
        return [parts[a:b] for a, b in itertools.pairwise([0, *last])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of marked words as packed 32-bit integers."""
        cut, parts = self.cut(words), self.parts
        asked = set(itertools.chain.from_iterable(cut))
        self.trim(parts, asked)
        parts.update(self.encode_parts(asked.difference(parts)))
        return [parts[c[0]] if len(c) == 1 else b"".join(map(parts.__getitem__, c)) for c in cut]

    def trim(self, known: dict[str, bytes], asked: set[str]) -> None:
        """Beyond ``most_words`` entries, keep only those that are asked for now, as frequent words nearly always are."""
        if len(known) > self.most_words:
            stay = {w: known[w] for w in asked if w in known}
            known.clear()
            known.update(stay)

    def encode_parts(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct parts; one walk over their trie."""
        out, pack = {}, struct.Struct("<i").pack
        # For each prefix of the word: the state, and the last piece's id (below 0: a character beyond the model, or the start).
        states, last, before, length_of = [self.state("")], [-1], "", [len(p) for p in self.pieces]
        push, add = states.append, last.append
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for c in word[shared:]:
                state = state[c]
                push(state)
                for length, piece, apart in state.ends:
                    left = last[-length]
                    if left < 0 or apart[left]:
                        add(piece)
                        break
                else:
                    if state.text:
                        raise AssertionError(f"no segmentation of {word[: len(last)]!r}")
                    add(-1 - ord(c))
            before, n, found = word, len(word), []
            while n:
                piece = last[n]
                if piece < 0:
                    found += [self.byte_id[b] for b in reversed(chr(-1 - piece).encode())]
                    n -= 1
                else:
                    found.append(piece)
                    n -= length_of[piece]
            found.reverse()
            out[word] = pack(found[0]) if len(found) == 1 else struct.pack(f"<{len(found)}i", *found)
        return out

    def words(self, text: str) -> list[str]:
        """Keys of the marked words of a text, each without the one space before it.

        A key that starts with a line end stands for a word without a mark.
        """
        text = text.replace(MARK, " ")
        parts = (text.replace("\n", " \n") if self.lines else text).split(" ")
        if "" not in parts:
            return parts
        out, held = [], ""
        for p in parts[:-1]:
            if p:
                out.append(held + p)
                held = ""
            else:
                held += " "
        return [*out, held + parts[-1]]

    def marked(self, key: str) -> str:
        rest = key.lstrip(" ")
        return MARK * (len(key) - len(rest) + (not (self.lines and rest[:1] == "\n"))) + rest

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of each text."""
        done: list[bytes | None] = []
        for a, b in chunks([t or "" for t in texts]):
            split = [self.words(t) if t else [] for t in texts[a:b]]
            packed, asked = self.packed, set().union(*split)
            self.trim(packed, asked)
            new = list(asked.difference(packed))
            packed.update(zip(new, self.encode_words([self.marked(w) for w in new]), strict=True))
            done += [None if t is None else b"".join(map(packed.__getitem__, s)) for t, s in zip(texts[a:b], split, strict=True)]
        return done

    def decode(self, ids: list[bytes | None]) -> list[str | None]:
        """Texts of packed ids; bytes that are no UTF-8 become U+FFFD."""
        out: list[str | None] = []
        for x in ids:
            if x is None:
                out.append(None)
                continue
            these = np.frombuffer(x, "<i4")
            if len(these) and not 0 <= these.min() <= these.max() < len(self.bytes_of):
                raise ValueError(f"ids beyond the model: {these.min()} to {these.max()}")
            text = b"".join(map(self.bytes_of.__getitem__, these.tolist())).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@functools.lru_cache(2)
def coder(path: str) -> PieceCoder:
    """One coder for each Python worker."""
    return PieceCoder(path)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", packed: bool = False, model: str = MODEL) -> DataFrame:
    """Add the ids of a text column, as ``array<int>`` or packed (binary, little-endian 32-bit)."""

    def fn(columns: list[pa.Array]) -> list:
        found = coder(model).encode(columns[0].to_pylist())
        return [found if packed else id_lists(found)]

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    return with_columns(df, [text_col], [T.StructField(out_col, kind)], fn)


def id_lists(found: list[bytes | None]) -> pa.Array:
    """Packed ids as an Arrow list array, without a Python object for each id."""
    ends = np.cumsum([0] + [len(x) // 4 if x is not None else 0 for x in found]).astype(np.int32)
    offsets = pa.array(ends, mask=np.array([x is None for x in found] + [False])) if None in found else pa.array(ends)
    values = pa.array(np.frombuffer(b"".join(x for x in found if x is not None), "<i4"))
    return pa.ListArray.from_arrays(offsets, values)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of an ids column, packed or ``array<int>``."""

    def fn(columns: list[pa.Array]) -> list:
        ids = columns[0].to_pylist()
        return [coder(model).decode([x if x is None or isinstance(x, bytes) else np.array([i for i in x if i is not None], "<i4").tobytes() for x in ids])]

    return with_columns(df, [ids_col], [T.StructField(out_col, T.StringType())], fn)


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encode`` (packed) and ``decode`` in one pass over the rows."""

    def fn(columns: list[pa.Array]) -> list:
        ids = coder(model).encode(columns[0].to_pylist())
        return [ids, coder(model).decode(ids)]

    return with_columns(df, [text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(out_col, T.StringType())], fn)


def packed_length(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document and decode it again.

    n_pieces and ids_sha256 (of the packed ids) are of the encoder's output, decoded_sha256 of the
    decoder's, and round_trip tells whether that is the text; null texts count as empty.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = round_trip(docs)
    return both.select("doc_id", packed_length(F.col("ids")).alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
