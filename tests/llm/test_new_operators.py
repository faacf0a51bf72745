"""Operators 11 to 13 against brute force, with collisions, splits, ties and odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ball_kmeans, collocations, exact_dedup
from tests.llm.test_operators import ODD, SCHEMA

# 11


def brute_phrases(docs, most, least, share, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    good = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in good.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in good.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, m, -s) for lang, rows in out.items() for i, (s, a, p, left, right, m) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("chunk", [40, 4_000_000])
def test_phrases_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "é", "of", "The", "x\x00y", "😀", "ab", "u v"]
    docs = [(rng.choice(["en", "en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ":"]) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    docs += [("en", "a b a b a b a b"), ("en", "a b a b a b a b"), ("fr", None), (None, None), ("de", ""), ("de", " .,\n"), ("es", "one")] + [("it", "ad hoc rule")] * 6
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit("clash") for c in ("phrase", "f", "size", "n", "__lang")}).repartition(3)
    for most, least, share, top in ((5, 5, 100, 2000), (5, 3, 60, 7), (2, 2, 100, 50), (3, 1, 100, 20)):
        got = sorted(map(tuple, collocations.collocations(df, most_words=most, least=least, share=share, top=top).collect()))
        assert got == brute_phrases(docs, most, least, share, top) and got
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(spark.createDataFrame(ODD, SCHEMA)).columns[:3] == ["lang", "rank", "phrase"]


def test_phrase_scores_beyond_64_bits(spark):
    a, n = 10**14, 10**16
    frequent = spark.createDataFrame([("en", "x", 1, a), ("en", "y", 1, 3 * a), ("en", "x y", 2, a), ("en", "x y x", 3, a // 3)], "lang string, phrase string, size int, f bigint")
    frequent = frequent.unionByName(spark.createDataFrame([("en", "y x", 2, a // 3)], frequent.schema))
    got = {r.phrase: r for r in collocations.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n bigint")).collect()}
    assert got["x y"].score == 1000 * a * n // (a * 3 * a)
    cuts = [(1000 * (a // 3) * n // (a * (a // 3)), 1), (1000 * (a // 3) * n // (a * a), 2)]
    assert got["x y x"].score == min(cuts)[0] and got["x y x"].r == a


def test_phrase_map_lets_all_frequent_through(spark):
    words = spark.createDataFrame([("en" if i % 2 else "fr", f"w{i}", 1, 100) for i in range(5000)], "lang string, phrase string, size int, f bigint")
    bits = collocations.bits_of(words)
    own = collocations.salted("en", [f"w{i}".encode() for i in range(5000)])
    there = collocations.among(bits, own)
    assert there[1::2].all() and there[::2].mean() < 0.05


# 12


def brute_copies(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: -1 if i is None else i)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


COPIES = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, "one text that very many rows have") for i in range(300)] + [(500, "a"), (501, "A"), (502, "a "), (503, None), (504, ""), (None, "a"), (None, "b"), (None, "b"), (505, "twice"), (505, "twice"), (505, "twice"), (506, "é" * 40_000), (507, "é" * 40_000), (508, "é" * 39_999 + "e")] + [(1000 + i, f"alone {i}") for i in range(200)]


@pytest.mark.parametrize("bits", [0, 2, 5, 64])
def test_copies_against_brute_force(spark, bits):
    # Few bits of hash force collisions, whose chains are told apart by bytes; small buckets force splits.
    df = spark.createDataFrame(COPIES, "doc_id long, text string").withColumns({"h": F.lit("clash"), "n": F.col("doc_id"), "kept": F.lit(7), "tag": F.lit(1)}).repartition(7)
    for capacity in (3, None):
        got = exact_dedup.exact_copies(df, capacity=capacity, bits=bits, keep=["h", "n", "kept"])
        assert got.columns == ["h", "n", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        rows = got.collect()
        assert sorted((tuple(r)[2:] for r in rows), key=repr) == brute_copies(COPIES) and all(r.h == "clash" and r.n == r.doc_id for r in rows)
    assert exact_dedup.exact_copies(df.limit(0), bits=bits).count() == 0


def test_copies_run_without_python(spark):
    df = spark.createDataFrame(COPIES, "doc_id long, text string")
    plan = exact_dedup.exact_copies(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan.split("Physical Plan")[-1])


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(1000).select(F.col("id").alias("h")))  # a thousand keys with equal leading bits
    cells, depth = exact_dedup.directory(keys.where("h <> 0"), 1500, 64)
    assert depth < 10 and cells.count() == 2**depth == cells.select("cell").distinct().count()
    placed = keys.join(cells, exact_dedup.leading(F.col("h"), depth) == F.col("cell")).groupBy("bucket").count()
    assert placed.agg(F.max("count"), F.sum("count")).first()[:] == (placed.agg(F.max("count")).first()[0], 4000) and placed.agg(F.max("count")).first()[0] <= 1500
    assert cells.groupBy("bucket").agg(F.count("*").alias("c"), F.first("depth").alias("d")).where(f"c <> shiftleft(1, {depth} - d)").count() == 0


# 13


def brute_clusters(vectors, k, rounds):
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{v[0]}".encode()).hexdigest(), v[1]))
    centroids = [list(q) for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, q in vectors:
            members.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    return sorted((i, near(q)[1], near(q)[0]) for i, q in vectors), centroids


@pytest.mark.parametrize("size,spread,k,rounds", [(2, 3, 5, 3), (3, 1, 6, 4), (4, 40, 16, 5), (1, 2, 4, 3)])
def test_balls_against_brute_force(spark, size, spread, k, rounds):
    rng = random.Random(size)
    rows = [(i, [rng.randint(-spread, spread) / 64 + rng.choice([0, 0, 2]) for _ in range(size)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * size) for i in range(150)]  # equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("q", "cluster", "distance", "id")})
    state, centroids = ball_kmeans.cluster(df, k=k, rounds=rounds, size=size)
    vectors = [(i, [int(np.floor(np.float32(x) * 64.0)) for x in v]) for i, v in rows]
    want, final = brute_clusters(vectors, k, rounds)
    assert centroids == final and sorted((r.id, r.cluster, r.distance) for r in state.collect()) == want


def test_balls_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, [nan, 0.0]), (3, [0.0, inf]), (4, [None, 1.0]), (5, [1.0]), (6, None), (7, [1.0, 2.0, 3.0]), (8, []), (None, [-0.001, 0.5]), (9, [0.1, 0.2]), (9, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, centroids = ball_kmeans.cluster(df, size=2)
    got = sorted(((r.id, list(r.q)) for r in state.collect()), key=repr)
    assert got == sorted([(1, [6, 12]), (None, [-1, 32]), (9, [6, 12]), (9, [6, 12])], key=repr) and len(centroids) == 4
    none, no_centroids = ball_kmeans.cluster(df.limit(0), size=2)
    assert none.count() == 0 and no_centroids == []
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), size=2)


def test_balls_leave_the_core_alone():
    centroids = [[0, 0], [100, 0], [1000, 1000]]
    near = ball_kmeans.neighbours(centroids, [60, 10, -1])
    assert near == [[(10_000, 1)], [], []]
    v = np.array([[10, 0], [49, 0], [50, 0], [51, 0]], dtype=np.int64)
    best, least = ball_kmeans.within_balls(v, np.zeros(4, dtype=np.int32), np.array(centroids), near)
    assert best.tolist() == [0, 0, 0, 1] and least.tolist() == [100, 49**2, 50**2, 49**2]
