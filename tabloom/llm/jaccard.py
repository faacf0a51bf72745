"""Operator 9: n-gram Jaccard join by a prefix-tree join, and the groups it links.

A document's set holds the 64-bit hashes of its distinct word shingles, in the order of the hashes,
which is the global order of all sets. Documents with equal sets form a class; all that follows is
between classes, so copies cost nothing beyond the first pass. Two sets link when their Jaccard
similarity is at least ``num / den``.

1. Survivors, exactly. With sizes n and overlap o, the first n - o + l hashes of two linked sets
   share at least l. Each class posts that many, with o the least overlap any partner must have and
   l = n / 8, in blocks of hashes; a class of whose postings too few are posted by others can have
   no partner and leaves here.
2. Candidates, exactly. The whole sets of the survivors are made anew from one text of each and
   posted, and each class keeps the rarest of its hashes, as many as needed so that two linked
   classes share one (the prefix filter, with the true counts as the order). Hashes that only one
   class has are the rarest of all. A hash that a sample of classes shows to be hot is dealt by class
   in both steps, so none fills a block; it is known to be shared, and its count in the order is the
   sample's, the same for all.
3. Links, by hubs. In each group of classes that share a kept hash, pairs with a few hubs are
   verified first; the links merge components, and a group in one component is done. What is left of
   small groups is verified pair by pair where components differ. Large groups that overlap make
   clusters, which are cut into blocks; each pair of blocks is a task that joins sets with a trie.
4. Verification walks tries. The sets of a block are ranked anew, the hash that most of them have
   first, so that alike sets share long starts. The overlap with a hub is counted once for each node,
   and a subtree is left as soon as the hashes that remain cannot reach the overlap needed.
5. Components come from large-star / small-star rounds over the links, all in tables.

Null and empty texts and texts without words have an empty set, link with nothing and are groups of
their own; fewer words than a shingle make one shingle; repeated rows are copies; a null id can be
in a group but never names one. Equal hashes of different shingles (about 2**-64 a pair) are
taken as equal. Ties do not arise, as a group is named by its smallest id. Sets of very long texts are
made whole; only id and text are read, whatever other columns there are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Cache, chunks, discard, forget, maybe_among, saved, table, with_columns

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, NUM, DEN = 5, 75, 100
#: Postings of one block of hashes, about.
BLOCK = 2_000_000
#: Bits of a posted start.
SHORT = 32
#: Members walked around a hub at once, and of a block of a cluster, about, and hashes of their sets together.
AROUND, SIDE, HASHES = 512, 256, 1_000_000
#: One class in so many shows which hashes are hot: those posted about BLOCK / 16 times and more.
SAMPLE = 1000
#: Hubs of each group in the first rounds; members of a small group.
HUBS, SMALL = (1, 8), 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = Cache(xxhash.xxh3_64_intdigest)
_NO_ID = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _WORDS.trim()
    words = [t.encode().translate(_LOWER).split() for t in texts]  # on the contract's white space
    counts = [len(w) for w in words]
    one = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), np.uint64, sum(counts))
    shingles = np.zeros_like(one)
    for k in range(min(size, len(one))):
        shingles[: len(one) - k] = _mixed(shingles[: len(one) - k] + one[k:] + np.uint64(k))
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(shingles[at : at + n - size + 1]))
        elif n:
            short = np.uint64([0])
            for k in range(n):
                short = _mixed(short + one[at + k : at + k + 1] + np.uint64(k))
            out.append(_mixed(short + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def class_of(hashes: np.ndarray) -> int | None:
    """The number of a set's class."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))) if len(hashes) else None


class Bounds:
    """What a similarity of ``num / den`` asks of sizes, overlaps and starts of sets."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """The overlap that a set of n has at least with any partner, and so a partner's least size."""
        return -(-self.num * n // self.den)

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def posted(self, n: int) -> int:
        return n - self.least(n) + max(1, n // 8)

    def fits(self, n: int, m: int) -> bool:
        return min(n, m) * self.den >= max(n, m) * self.num


def _classes(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """The size and class of each set, and, once a call, the posted hashes of the classes in the sample."""

    def fn(columns: list[pa.Array]) -> list:
        texts = [t or "" for t in columns[0].to_pylist()]
        sizes, classes, starts, seen = [], [], [], set()
        for a, b in chunks(texts):
            for s in shingle_sets(texts[a:b], size):
                c = class_of(s)
                fresh = c is not None and c % SAMPLE == 0 and c not in seen
                if fresh:
                    seen.add(c)
                sizes.append(len(s))
                classes.append(c)
                starts.append(s[: bounds.posted(len(s))].astype(">u8").tobytes() if fresh else None)
        return [sizes, classes, starts]

    fields = [T.StructField("n", T.LongType()), T.StructField("class", T.LongType()), T.StructField("hashes", T.BinaryType())]
    return with_columns(docs, ["text"], fields, fn).drop("text")


def _hot(sampled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that many classes of the sample (class, hashes) post, sorted, and about how many classes of all post them.

    Two classes or more are seen to post each, so it is known to be shared. At most about 16 a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["hash"])

    sampled = sampled.where("hashes is not null").select("class", "hashes").dropDuplicates(["class"]).select("hashes")
    counts = sampled.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("k"))
    found = sorted((r.hash % 2**64, r.k) for r in counts.where(F.col("k") >= max(2, BLOCK // 16 // SAMPLE)).collect())
    return np.array([h for h, _ in found], np.uint64), np.minimum(np.array([k for _, k in found], np.int64) * SAMPLE, 2**31 - 1).astype(np.int32)


class Deal:
    """Which block a posting goes to: one by its hash, or, if the hash is hot, one of as many more by its class."""

    def __init__(self, postings: int, hot: tuple[np.ndarray, np.ndarray]) -> None:
        self.blocks, self.short = max(1, -(-postings // BLOCK)), SHORT
        self.hot, self.held = hot

    @property
    def all(self) -> int:
        return self.blocks * (2 if len(self.hot) else 1)

    def block(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = _range(_mixed(hashes), self.blocks)  # posted starts are low hashes; mixed they fill all blocks
        if len(self.hot):
            hot = self.hot[np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)] == hashes
            out[hot] = self.blocks + _range(_mixed(classes[hot].view(np.uint64)), self.blocks)
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Of hot hashes, about how many classes post them: the same number for every class."""
        return self.held[np.searchsorted(self.hot, hashes)]


def _range(x: np.ndarray, parts: int) -> np.ndarray:
    return (x // np.uint64((2**64 - 1) // parts + 1)).astype(np.int64) if parts > 1 else np.zeros(len(x), np.int64)


_POSTED = "block long, hashes binary, runs binary, classes binary, sizes binary"


def _merged(flat: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Of each owner, how many of its short hashes equal another of its own and will be counted as one."""
    order = np.lexsort((flat, owner))
    same = (flat[order][1:] == flat[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=owners)


def _packed(hashes: list[np.ndarray], classes: list[int], sizes: list[int], deal: Deal, short: bool = False) -> pa.RecordBatch:
    """Postings of some classes as one row for each block of hashes that they reach.

    ``short`` ones have SHORT bits of a hash, and beside the size of a class, in its upper half, how many of its hashes these bits merge.
    """
    counts = [len(h) for h in hashes]
    flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    names, of_size = np.array(classes, np.int64), np.array(sizes, np.int64 if short else np.int32)
    block = deal.block(flat, names[owner])
    order = np.argsort(block, kind="stable")
    flat, owner, block = flat[order], owner[order], block[order]
    flat = (flat & np.uint64((1 << deal.short) - 1)).astype(np.uint32) if short else flat
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    rows = []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(flat)], strict=True):
        of, runs = np.unique(owner[lo:hi], return_counts=True)  # owners rise within a block
        held = of_size[of] + (_merged(flat[lo:hi], np.repeat(np.arange(len(of)), runs), len(of)) << 32) if short else of_size[of]
        rows.append((int(block[lo]), flat[lo:hi].tobytes(), runs.astype(np.int32).tobytes(), names[of].tobytes(), held.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["block", "hashes", "runs", "classes", "sizes"])


def _post_starts(docs: DataFrame, size: int, bounds: Bounds, deal: Deal) -> DataFrame:
    """The first hashes of each class, once for each batch that holds it.

    They only count what is shared, by SHORT bits of a hash within a block. Hashes of two classes that
    agree in these by chance let a class survive that is found to have no partner later; those of one
    class would count once, so their number goes along and is added to what is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2500) for b in batches for i in range(0, b.num_rows, 2500)):
            seen: dict[int, int] = {}
            hashes = []
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts):
                for s in shingle_sets(texts[a:b], size):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen[c] = len(s)
                        hashes.append(s[: bounds.posted(len(s))].copy())
            if seen:
                yield _packed(hashes, list(seen), list(seen.values()), deal, short=True)
        forget()

    return docs.select("text").mapInArrow(run, _POSTED)


def _post_sets(sets: DataFrame, deal: Deal) -> DataFrame:
    """All hashes of some classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2500) for b in batches for i in range(0, b.num_rows, 2500)):
            if batch.num_rows:
                hashes = [np.frombuffer(h, ">u8").astype(np.uint64) for h in batch.column(2).to_pylist()]
                yield _packed(hashes, batch.column(0).to_pylist(), batch.column(1).to_pylist(), deal)

    return sets.select("class", "n", "hashes").mapInArrow(run, _POSTED)


def _shared(posted: DataFrame, deal: Deal, counts_only: bool) -> DataFrame:
    """Of each class, by block, the posted hashes that other classes post too: their number, or they and how many post them.

    Numbers leave packed, a row for each block and range of classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for batch in batches:
            for block, h, r, c, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if block != now and got:
                    yield from shared(got, now >= deal.blocks)
                    got = []
                now, runs = block, np.frombuffer(r, np.int32)
                got.append((np.frombuffer(h, np.uint32 if counts_only else np.uint64), np.repeat(np.frombuffer(c, np.int64), runs), np.repeat(np.frombuffer(s, np.int64 if counts_only else np.int32), runs)))
        if got:
            yield from shared(got, now >= deal.blocks)

    def shared(got: list[tuple], hot: bool) -> Iterator[pa.RecordBatch]:
        """One block at a time, however many a task has."""
        hashes, classes, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(hashes)
        if not hot:
            same = hashes[order][1:] == hashes[order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]
        hashes, classes, sizes = hashes[order], classes[order], sizes[order]
        order = np.lexsort((classes, hashes))
        hashes, classes, sizes = hashes[order], classes[order], sizes[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (classes[1:] != classes[:-1])] if len(hashes) else np.zeros(0, bool)
        hashes, classes, sizes = hashes[new], classes[new], sizes[new]
        if hot:  # all of a class's are here, all classes of a hash are not
            held = np.ones(len(hashes), np.int32) if counts_only else deal.counts(hashes)
        else:
            _, place, held = np.unique(hashes, return_inverse=True, return_counts=True)
            several = held[place] > 1
            hashes, classes, sizes, held = hashes[several], classes[several], sizes[several], held[place][several].astype(np.int32)
        if not len(hashes):
            return
        order = np.argsort(classes, kind="stable")
        hashes, classes, sizes, held = hashes[order], classes[order], sizes[order], held[order]
        cuts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        ends = np.r_[cuts[1:], len(classes)]
        if counts_only:
            names, of_size, number = classes[cuts], (sizes[cuts] & 0xFFFFFFFF).astype(np.int32), (ends - cuts + (sizes[cuts] >> 32)).astype(np.int32)
            part = _range(_mixed(names.view(np.uint64)), deal.blocks)
            order = np.argsort(part, kind="stable")
            names, of_size, number, part = names[order], of_size[order], number[order], part[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            pieces = list(zip(at, np.r_[at[1:], len(part)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), *(pa.array([x[i:j].tobytes() for i, j in pieces], pa.binary()) for x in (names, of_size, number))], names=["part", "classes", "sizes", "shared"])
            return
        for a in range(0, len(cuts), 5000):
            part = list(zip(cuts[a : a + 5000], ends[a : a + 5000], strict=True))
            head = [pa.array(classes[cuts[a : a + 5000]]), pa.array(sizes[cuts[a : a + 5000]].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([x[i:j].tobytes() for i, j in part], pa.binary()) for x in (hashes, held))], names=["class", "n", "hashes", "held"])

    return posted.repartition(deal.all, "block").sortWithinPartitions("block").mapInArrow(run, _COUNTED if counts_only else "class long, n long, hashes binary, held binary")


_COUNTED = "part long, classes binary, sizes binary, shared binary"


def _survivors(counted: DataFrame, bounds: Bounds, parts: int) -> DataFrame:
    """Classes of which enough posted hashes are shared: as many as a partner's must be, at least."""

    def folded(held: list[tuple]) -> tuple:
        classes, sizes, shared = (np.concatenate(x) for x in zip(*held, strict=True))
        classes, at, place = np.unique(classes, return_index=True, return_inverse=True)
        return classes, sizes[at], np.bincount(place, shared).astype(np.int32)

    def enough(held: list[tuple]) -> pa.RecordBatch:
        classes, sizes, shared = folded(held)
        least = -(-bounds.num * sizes.astype(np.int64) // bounds.den)
        return pa.RecordBatch.from_arrays([pa.array(classes[shared >= np.maximum(1, least // 8)])], names=["class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, most = None, [], 0, BLOCK
        for batch in batches:
            for part, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now and held:
                    yield enough(held)
                    held, rows, most = [], 0, BLOCK
                now = part
                held.append(tuple(np.frombuffer(x, kind) for x, kind in zip(row, (np.int64, np.int32, np.int32), strict=True)))
                rows += len(held[-1][0])
                if rows > most:
                    held = [folded(held)]
                    rows, most = len(held[0][0]), max(BLOCK, 2 * len(held[0][0]))
        if held:
            yield enough(held)

    return counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "class long")


def _kept(shared: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows of (hash, class, n): the shared ones among the n - least + 1 rarest hashes of each class."""
    whole = shared.groupBy("class", "n").agg(F.collect_list(F.struct("hashes", "held")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, classes, sizes = [], [], []
            for c, n, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, held = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in (("hashes", np.uint64), ("held", np.int32)))
                room = len(hashes) - bounds.least(n) + 1  # those of this class alone come first and take the rest
                if room > 0:
                    out.append(hashes[np.lexsort((hashes, held))[:room]].astype(np.int64))
                    classes.append(np.full(len(out[-1]), c))
                    sizes.append(np.full(len(out[-1]), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out, classes, sizes)], names=["hash", "class", "n"])

    return whole.mapInArrow(run, "hash long, class long, n long")


def _sets(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(class, n, hashes big-endian) of the classes in (class, id, mark), made anew from the text that id and mark name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            classes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                made = shingle_sets(texts[a:b], size)
                yield pa.RecordBatch.from_arrays([pa.array(classes[a:b], pa.int64()), pa.array([len(s) for s in made], pa.int64()), pa.array([s.astype(">u8").tobytes() for s in made], pa.binary())], names=["class", "n", "hashes"])
        forget()

    both = F.struct("id", "mark")
    texts = docs.select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    once = maybe_among(texts, both, named, both).groupBy("id", "mark").agg(F.first("text").alias("text"))
    return once.join(named, ["id", "mark"]).select("class", "text").mapInArrow(run, "class long, n long, hashes binary")


def by_frequency(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set as rising ranks of its hashes, the most frequent hash of all sets first: alike sets share long starts."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.uint32)
    rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.uint32)
    return [np.sort(x) for x in np.split(rank[place], np.cumsum([len(s) for s in sets])[:-1])] if sets else []


class Trie:
    """Distinct sets of rising ranks as a trie, built from the common starts of neighbours in their order.

    A node holds the ranks between its parent's depth and its own, the set that ends there, if any,
    and the sizes and the last place of all sets below it.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.ranks, self.depth, self.member, self.children = [np.zeros(0, np.uint32)], [0], [-1], [[]]
        path, before = [0], np.zeros(0, np.uint32)
        for place, i in enumerate(self.order):
            now = sets[i]
            k = min(len(before), len(now))
            apart = np.flatnonzero(before[:k] != now[:k])
            shared = int(apart[0]) if len(apart) else k
            while self.depth[path[-1]] > shared:
                x = path.pop()
                up = path[-1]
                if (top := self.depth[up]) < shared:  # the two part within this node
                    middle = self.node(self.ranks[x][: shared - top], shared, -1)
                    self.ranks[x], self.children[middle], self.children[up][-1] = self.ranks[x][shared - top :], [x], middle
                    path.append(middle)
            leaf = self.node(now[shared:], len(now), place)
            self.children[path[-1]].append(leaf)
            path.append(leaf)
            before = now
        self.sizes = [len(sets[i]) for i in self.order]
        n = len(self.depth)
        self.low, self.high, self.last = [1 << 62] * n, [0] * n, [-1] * n
        walk, seen = [0] if sets else [], []
        while walk:
            seen.append(x := walk.pop())
            walk += self.children[x]
        for x in reversed(seen):  # children before parents
            own = [(self.sizes[m], self.sizes[m], m) for m in [self.member[x]] if m >= 0]
            below = own + [(self.low[c], self.high[c], self.last[c]) for c in self.children[x]]
            self.low[x], self.high[x], self.last[x] = min(v[0] for v in below), max(v[1] for v in below), max(v[2] for v in below)

    def node(self, ranks: np.ndarray, depth: int, member: int) -> int:
        self.ranks.append(ranks)
        self.depth.append(depth)
        self.member.append(member)
        self.children.append([])
        return len(self.depth) - 1

    def links(self, hub: np.ndarray, n: int, n_ranks: int, bounds: Bounds, after: int = -1) -> list[int]:
        """Places above ``after`` of the sets that link with a hub: its ranks, rising, and its size.

        The overlap is counted once for each node, and a subtree is left if the ranks that remain,
        in its sets or in the hub, cannot reach the overlap that its smallest set needs.
        """
        held = np.zeros(n_ranks + 1, np.int64)
        held[hub.astype(np.int64) + 1] = 1
        until, out = np.cumsum(held), []  # of the hub's ranks, how many are below each rank
        walk = [(0, 0)] if self.order else []
        while walk:
            x, done = walk.pop()
            ranks, depth = self.ranks[x].astype(np.int64), self.depth[x]
            if len(ranks):
                done += int(held[ranks + 1].sum())
                left = len(hub) - int(until[ranks[-1] + 1])
            else:
                left = len(hub)
            m = self.member[x]
            if m > after and done >= bounds.overlap(n, self.sizes[m]):
                out.append(m)
            walk += [(c, done) for c in self.children[x] if self.last[c] > after and done + min(self.high[c] - depth, left) >= bounds.overlap(n, self.low[c])]
        return out


def linked(hub: np.ndarray, members: list[np.ndarray], bounds: Bounds) -> list[bool]:
    """Which members, distinct sets, link with the hub."""
    ranks = by_frequency([hub, *members])
    trie = Trie(ranks[1:])
    out = [False] * len(members)
    for m in trie.links(ranks[0], len(hub), 1 + max(int(r[-1]) for r in ranks), bounds):
        out[trie.order[m]] = True
    return out


def _parts(members: int) -> Column:
    """Blocks for the rows (class, n) of a group, by their number and by their hashes."""
    return F.ceil(F.greatest(F.count("*") / members, F.sum("n") / HASHES))


def _verified(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (hub, class, n) whose sets link. Around a hub with many or large members, these are dealt into blocks."""
    around = pairs.groupBy("hub").agg(_parts(AROUND).alias("parts"))
    sets = maybe_among(sets, F.col("class"), pairs.select("class").union(pairs.select("hub")), F.col("class"))
    members = pairs.drop("n").join(around, "hub").join(sets, "class").select("hub", F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"), F.lit(1).alias("role"), "class", "hashes")
    hubs = around.join(sets.withColumnRenamed("class", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("class"), "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub, held = None, None, []

        def walk() -> pa.RecordBatch:
            sets_ = [np.frombuffer(h, ">u8").astype(np.uint64) for _, h in held]
            good = [c for (c, _), yes in zip(held, linked(hub, sets_, bounds), strict=True) if yes] if hub is not None else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(good), pa.int64()), pa.array(good, pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, p, role, c, hashes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != (h, p):
                    if held:
                        yield walk()
                    key, hub, held = (h, p), None, []
                if role == 0:
                    hub = np.frombuffer(hashes, ">u8").astype(np.uint64)
                else:
                    held.append((c, hashes))
        if held:
            yield walk()

    both = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of all vertices of the edges (a, b), label the smallest vertex of the component."""
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, saved(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        discard(before)
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == known:
            break
        known = sign
    return now.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(now.select("v", F.col("v").alias("label")).distinct())


def _clusters(groups: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Links (a, b) between components among the classes of large groups (hash, class, label).

    Overlapping groups make a cluster; its m classes are dealt into m / SIDE blocks, and every pair
    of blocks meets in one task. A class goes to as many tasks as there are blocks, not classes.
    """
    of = components(groups.groupBy("hash").agg(F.min("class").alias("a")).join(groups, "hash").select("a", F.col("class").alias("b")))
    members = groups.select("class", "label", "n").distinct().join(of.select(F.col("v").alias("class"), F.col("label").alias("cluster")), "class")
    counts = members.groupBy("cluster").agg(_parts(SIDE).alias("k"))
    dealt = members.drop("n").join(counts, "cluster").withColumn("own", F.pmod(F.xxhash64("class"), F.col("k"))).join(sets, "class")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other")
    sides = dealt.select("cluster", "own", "class", "label", "hashes", other).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "class", "label", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def meet() -> pa.RecordBatch:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            ranks, found = by_frequency([np.frombuffer(r[3], ">u8").astype(np.uint64) for r in rows]), []
            n_ranks, one = 1 + max(int(r[-1]) for r in ranks), key[1] == key[2]
            # Within one block each pair once; between two blocks the left ones are hubs.
            right = [k for k, r in enumerate(rows) if one or not r[0]]
            trie = Trie([ranks[k] for k in right])
            hubs = [(right[i], place) for place, i in enumerate(trie.order)] if one else [(k, -1) for k, r in enumerate(rows) if r[0]]
            for k, place in hubs:
                _, c, label, _ = rows[k]
                if any(root(rows[m][2]) != root(label) for m in right):
                    for m in trie.links(ranks[k], len(ranks[k]), n_ranks, bounds, place):
                        _, other, its, _ = rows[right[trie.order[m]]]
                        if root(its) != root(label):
                            parent[root(its)] = root(label)
                            found.append((c, other))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if key != row[:3]:
                    if rows:
                        yield meet()
                    key, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield meet()

    return sides.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def link_classes(kept: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """(class, label) of all classes with a link, label being one class of the component."""
    spark = kept.sparkSession
    labels = spark.createDataFrame([], "class long, label long")
    edges = spark.createDataFrame([], "a long, b long")
    groups = kept
    for most in (*HUBS, SMALL):
        known = groups.select("hash", "class", "n").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        # Groups of the same classes, as a shared passage makes them for each of its hashes, count once.
        members = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"of{k}") for k in (0, 1)]
        open_ = known.groupBy("hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held"), *members).where("lo != hi")
        groups = saved(known.join(open_.groupBy("held", "of0", "of1").agg(F.min("hash").alias("hash")).select("hash", "held"), "hash"))
        if groups.isEmpty():
            return labels
        tried = groups.where(F.col("held") <= SMALL) if most == SMALL else groups
        if most == 1:
            first = groups.groupBy("hash").agg(F.min(F.struct("class", "label", "n")).alias("h"))
            hubs = first.select("hash", F.col("h.class").alias("hub"), F.col("h.label").alias("hub_label"), F.col("h.n").alias("hub_n"))
        else:
            place = Window.partitionBy("hash").orderBy("class")
            hubs = tried.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("hash", F.col("class").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"))
        fits = (F.least("n", "hub_n") * bounds.den >= F.greatest("n", "hub_n") * bounds.num) & (F.col("label") != F.col("hub_label")) & (F.col("hub") < F.col("class"))
        pairs = tried.join(hubs, "hash").where(fits)
        pairs = pairs.groupBy("class", "n").agg(F.min("hub").alias("hub")) if most == 1 else pairs.select("class", "n", "hub").distinct()
        found = _verified(saved(pairs), sets, bounds)
        if most == SMALL:
            large = groups.where(F.col("held") > SMALL)
            if not large.isEmpty():
                found = found.unionByName(_clusters(large, sets, bounds))
        edges = saved(edges.unionByName(found))
        labels = saved(components(edges).select(F.col("v").alias("class"), "label"))
    return labels


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN, marks: bool = False) -> DataFrame:
    """One row for each row: id, n_shingles and component_id, the smallest id of its group.

    With ``marks`` also ``mark``, xxhash64 of the text, and ``key``, one number for each group (null
    for an empty set), which tell rows of one id or of none apart.
    """
    bounds = Bounds(num, den)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = saved(_classes(docs.withColumn("mark", F.xxhash64("text")), size, bounds))
    hot = _hot(rows)
    rows = rows.drop("hashes")
    n = F.col("n")
    posted = rows.agg(F.sum(n - F.ceil(n * num / den) + F.greatest(F.lit(1), F.floor(n / 8)))).first()[0] or 0
    deal = Deal(int(posted), hot)
    survivors = _survivors(_shared(_post_starts(docs, size, bounds, deal), deal, counts_only=True), bounds, deal.blocks)
    name = F.min(F.struct(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "mark")).alias("name")
    named = saved(rows.where("class is not null").groupBy("class").agg(name).join(saved(survivors), "class").select("class", "name.id", "name.mark"))
    sets = saved(_sets(docs, named, size))
    deal = Deal(int(sets.agg(F.sum("n")).first()[0] or 0), _hot(sets.where(F.col("class") % SAMPLE == 0)))
    kept = saved(_kept(_shared(_post_sets(sets, deal), deal, counts_only=False), bounds))
    labels = link_classes(kept, sets, bounds)
    known = rows.join(labels, "class", "left").withColumn("key", F.coalesce("label", "class"))
    first = known.where("key is not null").groupBy("key").agg(F.min("id").alias("component"))
    out = known.join(first, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), *(["mark", "key"] if marks else []))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingles are 75 % alike, over all whole documents."""
    return near_groups(table(spark, sf_dir, "documents"))


#: The same in DuckDB: the overlaps of all classes of equal sets that share a shingle, and what their links reach.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id::BIGINT AS doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE} + 2, least(len(w) + 1, 2))), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))) AS g FROM d),
of AS (SELECT i, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS c FROM s GROUP BY i),
one AS (SELECT c, any_value(n) AS n, min(i) AS i FROM of GROUP BY c),
g AS (SELECT one.c, one.n, s.g FROM one JOIN s USING (i)),
pairs AS (SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.c < b.c AND {DEN} * least(a.n, b.n) >= {NUM} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE {DEN} * o >= {NUM} * (nx + ny - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT c, c AS r FROM one UNION SELECT reach.c, edges.y FROM reach JOIN edges ON reach.r = edges.x),
named AS (SELECT reach.c, min(d.doc_id) AS component_id FROM reach JOIN of ON of.c = reach.r JOIN d USING (i) GROUP BY reach.c)
SELECT d.doc_id, coalesce(of.n, 0)::BIGINT AS n_shingles, CASE WHEN of.c IS NULL THEN d.doc_id ELSE named.component_id END AS component_id FROM d LEFT JOIN of USING (i) LEFT JOIN named USING (c)
"""
