"""Each operator against brute force, a round trip, SQL or held-out accuracy, and on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat, jaccard, langid, licenses, mixing, pii, repetition, sentencepiece_viterbi, simhash, toxicity
from tabloom.llm.common import chunks, with_columns
from tabloom.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA

ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 3),
    (4, "one", None, None, 3),
    (None, "no id here. idiot!", "en", "s", 18),
    (5, "é" * 50_000 + " 1.2.3.4 " + "word " * 20_000, "fr", "t", 150_009),
    (6, "twice the same row", "en", "s", 18),
    (6, "twice the same row", "en", "s", 18),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    # Names of outputs occur as extra columns, with values that must not be read.
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("ids", "score", "kept", "pii", "labels", "lang_pred", "fingerprint", "n", "class")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    assert same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("empty", (False, True))
@pytest.mark.parametrize("name", ("op5_repetition", "op8_licenses", "op9_jaccard"))
def test_odd_same_as_sql(name, empty, spark, tmp_path):
    import duckdb

    words = " ".join(f"w{k % 7}" for k in range(130))
    more = [(7, "Apache License, version\n" * 3 + words, "en", "s", 0), (8, "apache\u00e9 license CC-BY cc by", None, None, 0), (9, " ".join(f"v{k}" for k in range(61)) * 2, "en", "s", 0)]
    rows = spark.createDataFrame([] if empty else ODD + more, SCHEMA)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(names)
    ours = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr) and len(ours) == rows.count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_table(name, spark, docs):
    made = QUERIES[name](spark, DATA)
    assert made.count() == docs.count() and made.select("doc_id").distinct().count() == docs.count()


def texts_of(docs):
    return [r.text for r in docs.orderBy("doc_id").select("text").collect()]


def test_chunks():
    assert list(chunks(["ab", "c", "defg", "h"], 3)) == [(0, 2), (2, 3), (3, 4)]
    assert list(chunks([])) == []


def test_with_columns_replaces_and_keeps(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, text string")
    out = with_columns(df, ["text"], [T.StructField("text", T.StringType())], lambda c: [[(x or "") + "!" for x in c[0].to_pylist()]])
    assert sorted(map(tuple, out.collect())) == [(1, "a!"), (2, "!")]


# 1


def test_sentencepiece_is_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    mine = sentencepiece_viterbi.PieceCoder(sentencepiece_viterbi.MODEL, most_words=500)
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " x ", "\t\n\r\n {\r\n", "▁▁a", "ﬁ①", "日本😀 é", "\x00\x01", "\n\n a\n b"] + [" " * n for n in range(40)]
    texts += ["".join(rng.choice("aebt  \n\r▁é(){};") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + texts_of(docs)
    coded = mine.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in coded] == model.encode(texts)
    assert mine.decode(coded) == [model.decode(x) for x in model.encode(texts)]


def test_sentencepiece_neighbours_and_cuts():
    c = sentencepiece_viterbi.PieceCoder(sentencepiece_viterbi.MODEL)
    made = [p for p in sorted(c.id)[::11] if c.merged(p) == [p]]
    made += ["a", "aa", "aaaa", "--", "----", "▁", "▁▁"]
    made = [p for p in made if p in c.id]
    rng = random.Random(3)
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(20_000)] + [(a, b) for a in made[-7:] for b in made[-7:]]
    pairs += [(p[:i], p[i:]) for p in made for i in range(1, len(p)) if p[:i] in c.id and p[i:] in c.id and c.merged(p[:i]) == [p[:i]] and c.merged(p[i:]) == [p[i:]]]
    assert all(c.stay_apart(a, b) == (c.merged(a + b) == [a, b]) for a, b in pairs)
    words = ["", "a", "▁the", "x一y", "", "一二", "▁" * 4]
    assert ["".join(parts) for parts in c.cut(words)] == words and c.cut([]) == []
    assert sum(c.split(p) is not None for p in made if len(p) > 1) > 2000


def test_sentencepiece_keeps_frequent_words_when_full(docs, monkeypatch):
    texts = [r.text for r in docs.select("text").collect()]
    c = sentencepiece_viterbi.PieceCoder(sentencepiece_viterbi.MODEL, most_words=10)
    whole = sentencepiece_viterbi.PieceCoder(sentencepiece_viterbi.MODEL).encode(texts)
    made = []
    parts = c.encode_parts
    monkeypatch.setattr(c, "encode_parts", lambda words: made.extend(words) or parts(words))
    assert c.encode(texts) == whole and len(made) > 10
    made.clear()
    assert c.encode(texts) == whole and made == []  # the same texts again: all are still known
    monkeypatch.setattr(sentencepiece_viterbi, "MOST_APART", 100)
    for known in (c.packed, c.parts, *c.apart.values()):
        known.clear()
    assert c.encode(texts) == whole and c.known_apart <= 100


def test_inputs_are_sent_once(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "a", "b"), (2, None, "d")], "id int, text string, other string")
    seen = with_columns(df, ["text"], [T.StructField("n", T.LongType())], lambda c: [[len(x or "") for x in c[0].to_pylist()]])
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "__in0" not in plan
    assert sorted(map(tuple, seen.collect())) == [(1, "a", "b", 1), (2, None, "d", 0)]
    over = with_columns(df, ["text", "other", "text"], [T.StructField("text", T.StringType())], lambda c: [[f"{a}{b}{d}" for a, b, d in zip(*[x.to_pylist() for x in c], strict=True)]])
    assert over.columns == ["id", "other", "text"]
    assert sorted(map(tuple, over.collect())) == [(1, "b", "aba"), (2, "d", "NonedNone")]


def test_sentencepiece_frames(odd, none):
    out = sentencepiece_viterbi.encode(odd).select("text", "ids", F.size("ids").alias("n"))
    assert out.where("text is null and ids is not null").count() == 0 and out.where("text = '' and n <> 0").count() == 0
    packed = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd, packed=True))
    assert packed.where("not decoded <=> text").count() == 0
    assert sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd)).where("not decoded <=> text").count() == 0
    assert sentencepiece_viterbi.encode(none).count() == 0


def test_sentencepiece_bad_ids(spark):
    c = sentencepiece_viterbi.coder(sentencepiece_viterbi.MODEL)
    for bad in ([-1, -2], [len(c.pieces)]):
        with pytest.raises(ValueError):
            c.decode([np.array(bad, "<i4").tobytes()])
    ids = np.frombuffer(c.encode(["two words"])[0], "<i4").tolist()
    df = spark.createDataFrame([([ids[0], None, *ids[1:]],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_viterbi.decode(df).collect()] == ["two words", None, ""]


# 2


def test_chat_reads_back(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "<turn>user<says>\\", "\\\\<says>", "a</turn>\n<turn>", "é😀 \x00"]
    for t in hard:
        assert chat.unescape(chat.escape(t or "")) == (t or "")
    turns = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(None, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.assemble(chat.format_turns(turns)).collect()}
    said = "".join(t or "" for k, t in enumerate(hard) if k % 2)
    whole = "".join(f"{'assistant' if k % 2 else 'user'}\n{t or ''}\n" for k, t in enumerate(hard))
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[None].n_turns == 1
    assert chat.assemble(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_clashes_and_long_texts(spark):
    long = "é😀 </turn> word\n" * 20_000
    turns = spark.createDataFrame([(1, 0, "assistant", long, "x"), (1, 1, "user", None, "y")], "conv_id long, turn long, role string, text string, ids string").withColumns({"loss_mask": F.lit(1), "n_turns": F.lit("clash")})
    got = chat.assemble(chat.format_turns(turns)).collect()
    assert len(got) == 1 and got[0].loss_chars == len(long) and got[0].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_chat_segments():
    c = chat.coder(chat.VOCABULARY)
    ids, masks = c.encode(["assistant", "user"], ["</turn>", "hi"], "assistant")
    assert all(list(x).count(i) == 1 for x in ids for i in (c.turn, c.says, c.end))
    assert masks[0].tolist() == [0] * 4 + [1] * (len(ids[0]) - 5) + [0] and masks[1].sum() == 0


# 3


def spans(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return {(s.kind, s.start, s.end) for s in pii.find_spans(df).first().pii}


def test_pii_cases(spark):
    assert spans(spark, "a@b.c_x@d.ee") == {("email", 0, 5), ("email", 5, 12)}
    assert spans(spark, "1.2.3.4.5.6.7.8 10.256.1.1 000255.0.0.001") == {("ip", 0, 7), ("ip", 8, 15), ("ip", 27, 41)}
    assert spans(spark, "😀 4111 1111 1111 1111") == {("card", 2, 21)}
    assert spans(spark, "4111 1111 1111 1112") == set()
    assert spans(spark, "+49 (30) 1234-5678 +1 2") == {("phone", 0, 18)}
    assert ("iban", 0, 27) in spans(spark, "DE89 3704 0044 0532 0130 00") and not any(k == "iban" for k, *_ in spans(spark, "DE88 3704 0044 0532 0130 00"))
    assert spans(spark, "ssn 123-45-6789") == {("ssn", 4, 15)} and spans(spark, "nr 123-45-6789") == set()


def test_pii_long_and_odd(spark, odd, none):
    rows = [("1.2.3.4 " * 3000,), ("9" * 50_000,), ("a" * 50_000 + "@b",), ("+1" + "(" * 50_000,), ("x" * 20_000 + "@y.z",)]
    sizes = [r.n for r in pii.find_spans(spark.createDataFrame(rows, "text string")).select(F.size("pii").alias("n")).collect()]
    assert sizes == [3000, 0, 0, 0, 1]
    assert pii.find_spans(odd).select(F.sum(F.size("pii"))).first()[0] == 1
    assert pii.find_spans(none).count() == 0


def test_pii_redaction(spark):
    df = spark.createDataFrame([("x a@b.cd y +1 10.2.3.4 555 1234 z",), (None,), ("plain",)], "text string")
    assert [r.text for r in pii.redact(pii.find_spans(df)).collect()] == ["x [EMAIL] y [PHONE] z", None, "plain"]


def test_pii_keeps_columns_of_its_own_names(spark):
    names = ["doc_id", "__found_email", "__FOUND_ip", "__s", "__m", "__f", "__s_", "a.b"]
    df = spark.createDataFrame([(k, *names[1:], "mail a@b.cd or 10.2.3.4") for k in (1, 1, None)], [*names, "text"])
    found = pii.find_spans(df)
    hidden = pii.redact(found)
    assert found.columns == [*df.columns, "pii"] == hidden.columns
    assert [tuple(r)[1:9] for r in hidden.collect()] == [(*names[1:], "mail [EMAIL] or [IP]")] * 3
    ours = pii.redact(pii.find_spans(df, out_col="a.c"), spans_col="a.c")
    assert ours.columns == [*df.columns, "a.c"] and {r.text for r in ours.collect()} == {"mail [EMAIL] or [IP]"}


def test_pii_is_native(docs):
    plan = pii.find_spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4


def test_mixing_near_targets(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 97), f"s{i % 7}") for i in range(3000)] + [(9000 + i, "a b", None) for i in range(3)] + [(None, "c d e", "s1"), (1, None, "s0"), (1, "", "s0")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(mixed) == len(rows) and (mixed.taken <= 3 * mixed["size"]).all() and (mixed.taken[mixed["size"] == 0] == 0).all()
    by = mixed.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= 50).all() and (by.target <= 3 * by["size"]).all()
    assert abs(by.target.sum() - mixed["size"].sum()) < 1e-6
    small = by.loc[by.index.isna()].iloc[0]
    assert small.target == 3 * small["size"]


def test_mixing_blocks_do_not_matter(spark, docs, monkeypatch):
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BLOCK", 3)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == one


def test_mixing_draws_by_odds(spark, monkeypatch):
    # Texts of 4 and of 100 words weigh 2 and 10, so the long ones are five times as likely.
    rows = [(i, "w " * (4 if i % 2 else 100), "s" if i < 6000 else "t") for i in range(6200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, weights=(1, 60)).toPandas()
    own = mixed[mixed.source == "s"]
    rate = own.target.iloc[0] / (3000 * (4 * 2 + 100 * 10))
    for size, w in ((4, 2), (100, 10)):
        share = own.copies[own["size"] == size].mean()
        assert 0 < rate * w < 1 and abs(share - rate * w) < 4 * (rate * w / 3000) ** 0.5
    monkeypatch.setattr(mixing, "odds", lambda x: x)
    other = mixing.mix(docs, weights=(1, 60)).toPandas()
    assert sorted(zip(mixed.doc_id, mixed.copies)) != sorted(zip(other.doc_id, other.copies))


def test_mixing_of_equal_rows(spark):
    rows = [(None, "the same four words", "s")] * 3000 + [(i, "w " * 40, "t") for i in range(500)] + [(7, None, None)] * 5
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "block": F.lit("clash")})).toPandas()
    own = mixed[mixed.source == "s"]
    assert len(mixed) == len(rows) and sorted(own["copy"]) == list(range(3000))
    assert abs(own.taken.sum() - own.target.iloc[0]) <= 4 and own.copies.nunique() > 1


def test_mixing_reads_no_clashing_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    clash = docs.withColumns({c: F.lit("clash") for c in ("size", "digest", "w", "n", "copy", "copies", "taken", "target", "source_size", "place", "weight", "words", "q", "u")})
    names = mixing.mix(docs).columns
    assert mixing.mix(clash).columns == names
    assert sorted(map(tuple, mixing.mix(clash).collect()), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)


def test_mixing_odd(odd, none):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0


# 5


def brute_repeats(text):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    n = len(w)
    rep = [max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    covered = {k for i in range(n) if rep[i] >= repetition.MIN_WORDS for k in range(i, i + rep[i])}
    three = {k for i in range(n) if rep[i] >= 3 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return [n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(three), len(covered), max(rep, default=0)]


def test_repetition_is_brute_force():
    rng = random.Random(3)
    texts = ["", " \n", "a", "a a a a", "x\xa0y z　w"] + [" ".join(rng.choice("abc" if k % 3 else "abcdefghijkl") for _ in range(rng.randint(0, 70))) + "\nx y|z " * rng.randint(0, 9) for k in range(80)] + ["a b c d e f g h i j " * 9]
    got = repetition.measure(texts)
    assert [list(x) for x in zip(*list(got.values())[:7], strict=True)] == [brute_repeats(t) for t in texts]
    assert got["repeat_spans"][-1] == [(0, 90)]


def test_repeats_of_long_texts():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(400)), "x y z " * 90, "", "one", "a b " * 200 + "c"] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 50))) for _ in range(40)]
    words = [t.split() for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    first = np.unique([f"{i:03d}{w}" for i, ws in enumerate(words) for w in ws], return_inverse=True)[1]
    assert np.array_equal(repetition.longest_repeats(first, doc), repetition.longest_repeats(first, doc, 0))


def test_repetition_verdicts(spark, odd, none):
    plain = " ".join(f"w{i}" for i in range(300))
    rows = [(1, plain), (2, plain + " q " + " ".join(plain.split()[:70])), (3, "too short")]
    out = {r.doc_id: (r.base_failed, r.kept) for r in repetition.add_repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (False, True), 2: (False, False), 3: (True, False)}
    assert repetition.add_repetition(odd).where("kept").count() == 0 and repetition.add_repetition(none).count() == 0


# 6


def test_toxicity_finds_words_and_sentences(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]

    def text(bad):
        lines = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 30))]
        if bad:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(["vile", "nasty"])
        return ". ".join(lines)

    bags = [(i, i % 4 == 0) for i in range(800)]
    made = [(i, text(bad), int(bad != (rng.random() < 0.03))) for i, bad in bags]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 500] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.add_toxicity(docs, model, locate=True).collect()}
    right = [out[i].predicted == int(bad) for i, bad in bags if i >= 500]
    assert sum(right) / len(right) > 0.97
    hit = next(out[i] for i, bad in bags if bad and out[i].predicted)
    assert len(hit.toxic_sentences) == 1 and re.search("vile|nasty", hit.text[hit.toxic_sentences[0].start : hit.toxic_sentences[0].end])


def test_toxicity_is_a_noisy_or():
    rng = np.random.default_rng(3)
    words = ["vile", "nasty", "kind", "tree", "sky", "road", "a", "b"]
    texts = [". ".join(" ".join(rng.choice(words[2 * (k % 5 > 0) :], 3)) for _ in range(rng.integers(1, 6))) for k in range(400)]
    labels = np.array([int("vile" in t or "nasty" in t) ^ int(rng.random() < 0.05) for t in texts])
    model = toxicity.fit(toxicity.sentence_cells(texts), labels)

    def plain(text, weights, bias):
        clean = 1.0
        for sentence in text.split(". "):
            cells = {c for w in sentence.split() for c in toxicity._cells(w.encode())}
            z = bias + sum(weights.get(c, 0.0) for c in cells)
            clean *= 1 - 1 / (1 + np.exp(-z))
        return 1 - clean

    weights = dict(zip(model.cells.tolist(), model.weights.tolist()))
    assert {toxicity._cells(w)[0] for w in (b"vile", b"nasty")} <= set(weights)
    bags = toxicity.sentence_cells(texts)
    assert np.allclose(toxicity.noisy_or(*toxicity.sentence_logits(bags, model), len(bags)), [plain(t, weights, model.bias) for t in texts])

    def loss(weights, leak):
        p = 1 - (1 - np.array([plain(t, weights, model.bias) for t in texts])) * (1 - leak)
        return -np.mean(np.log(np.where(labels > 0, p, 1 - p).clip(1e-12)))

    best, leak = min((loss(weights, x), x) for x in (0.01, 0.03, 0.05, 0.1))
    for cell in weights:  # no single weight can be moved to fit the labels much better
        for step in (-1.0, 1.0):
            assert loss({**weights, cell: weights[cell] + step}, leak) > best - 0.002
    once = toxicity.fit(toxicity.sentence_cells(texts[::-1]), labels[::-1])
    assert np.allclose(once.weights, model.weights, atol=1e-6)  # the order of rows, and so ties, change nothing


def test_toxicity_learns_rare_words():
    # A word in 1 % of the documents of class 1 is a candidate, one in a few copies with a wrong label is not.
    texts = [f"plain words of document {i}" + " zorgle" * (i < 15) + " common" * (i < 700) + " copied" * (1500 <= i < 1520 or 15 <= i < 25) for i in range(3000)]
    labels = np.array([1] * 1500 + [0] * 1500)
    found = set(toxicity.candidates(toxicity.sentence_cells(texts), labels).tolist())
    assert not set(toxicity._cells(b"copied")) & found and toxicity._cells(b"common")[0] in found
    more = set(toxicity.candidates(toxicity.sentence_cells([t + " zorgle" * (i < 45) for i, t in enumerate(texts)]), labels).tolist())
    assert toxicity._cells(b"zorgle")[0] in more


def test_toxicity_knows_words_by_their_starts(spark):
    rng = random.Random(2)
    ends = ["a", "el", "on", "ich", "est", "ung", "ar", "is"]
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(5)) + (f" grumbel{rng.choice(ends)}{rng.choice(ends)}{rng.choice(ends)}" if i % 4 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.add_toxicity(docs.where("doc_id >= 500"), model).select("doc_id", "predicted").collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out)
    text = dict(rows)
    whole = toxicity.fit(toxicity.sentence_cells([text[i] for i in range(500)]), np.array([int(i % 4 == 0) for i in range(500)]))
    assert np.array_equal(whole.cells, model.cells) and np.allclose(whole.weights, model.weights) and abs(whole.cut - model.cut) < 1e-9


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert {r.score for r in toxicity.add_toxicity(odd, model).collect()} < {0.0} | set(np.linspace(0, 1e-6, 2)) or toxicity.add_toxicity(odd, model).where("score > 0.01").count() == 0
    assert toxicity.add_toxicity(none, model).count() == 0


# 7


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid_result(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.98 and out.where("score < 0 or score > 1").count() == 0


def langid_result(spark, sf):
    return langid.op7_langid(spark, sf)


def test_language_cells_are_brute_force():
    cells, starts = langid.ngram_cells(["Ab", "", "c"])
    assert starts.tolist() == [0, 3, 4]
    one, two, three = cells
    assert (two == langid.CELLS).tolist() == [False, True, True, True, True, True] and (three == langid.CELLS).all()
    assert one[0] == langid.ngram_cells(["a"])[0][0][0]


def test_language_is_naive_bayes(spark):
    from collections import Counter

    rows = [(1, "Ein Haus, ein Baum", "de"), (2, "un arbre et une maison", "fr"), (3, "une MAISON", "fr"), (4, "Der Baum", "de"), (5, "a tree", None), (6, "casa", "it"), (6, "casa", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = langid.train(docs)
    assert langs == ["de", "fr", "it"]

    def grams(text):
        text = text.lower()
        return [langid.ngram_cells([text[i : i + n]])[0][n - 1][0] for n in (1, 2, 3) for i in range(len(text) - n + 1)]

    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in langs}
    tests = ["Haus und Maison", "casa", "Baum ☃", "xyz", "12 ² ½ Ⅷ", "", None, "\n"]
    names, scores = langid.classify(tests, langs, logs)
    for text, name, score in zip(tests, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        sums = np.array([sum(np.log((counts[x][g] + 1) / (sum(counts[x].values()) + langid.CELLS)) for g in grams(text)) for x in langs])
        p = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
        assert name == langs[int(p.argmax())] and abs(score - p.max()) < 1e-3
    tied = np.zeros_like(logs)
    assert langid.classify(["abc"], langs, tied) == (["de"], [pytest.approx(1 / 3)])  # of equals the first


def test_language_draws_by_id_and_text(spark):
    rows = [(k % 3 == 0 and 7 or None, f"a text of number {k}", "en") for k in range(4000)] + [(7, f"un texte {k}", "fr") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = {r.lang: r["count"] for r in langid.training_sample(docs, "lang", "doc_id", "text", 400).groupBy("lang").count().collect()}
    assert 320 < drawn["en"] < 480 and drawn["fr"] == 40
    held = docs.withColumns({"__lang": F.lit("x"), "__share": F.lit(9)})
    assert langid.train(held, per_lang=400)[0] == ["en", "fr"]


def test_language_odd(odd, none):
    langs, logs = langid.train(odd.select("doc_id", "text", "lang"))
    out = langid.add_language(odd, langs, logs).select("text", "lang_pred", "score").collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if not r.text or not r.text.strip())
    assert langid.train(none)[0] == [] and langid.add_language(odd, *langid.train(none)).where("lang_pred <> 'und'").count() == 0


# 8


def test_licenses_are_brute_force(docs):
    n, counts = licenses.document_counts(docs, {b"license", b"apache", b"the"})
    texts = texts_of(docs)
    split = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
    assert n == len(texts) and counts[b"the"] == sum("the" in w for w in split)
    scanner = licenses.Scanner(n, counts)
    for text, words in zip(texts, split, strict=True):
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = scanner.scan(text)
        assert got["n_words"] == len(words) and got["n_base"] == len(places)
        assert got["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_licenses_miss_no_place(docs):
    scanner = licenses.Scanner(*licenses.document_counts(docs, {w for _, t, _ in licenses.TEMPLATES for w in licenses.words_of(t)}))
    rng = random.Random(9)
    texts = texts_of(docs)[:60]
    for label, text, _ in licenses.TEMPLATES:
        w = text.split()
        for _ in range(rng.randint(0, len(w) // 2)):
            w[rng.randrange(len(w))] = rng.choice(["the", "zzz", "license", "software"])
        texts += [" ".join(w), "the software " * 5 + " ".join(w) + " " + text, " ".join(w[2:])]
    for text in texts:
        words = licenses.words_of(text)
        there = {w for w in words}
        real = set()
        for t, (label, template, _) in enumerate(scanner.templates):
            if sum(w in there for w in template) >= scanner.need[t]:
                real |= {(max(start, 0), label, share) for start in range(-len(template), len(words)) if (share := scanner.verify(words, t, start))}
        base = {(i, label, 1.0) for p, label in scanner.phrases for i in licenses.find(words, p)}
        got = scanner.scan(text)
        assert set(got["places"]) == real | base
        assert got["labels"] == ",".join(sorted({x for _, x, _ in real | base}))


def test_licenses_method(spark, odd, none):
    scanner = licenses.Scanner(100, {b"the": 90, b"license": 5})
    assert scanner.scan("Licensed under the Apache License, Version 2.0.")["labels"] == "apache,apache-2.0"
    assert scanner.scan("x Licensed under CC BY-NC 4.0")["labels"] == "cc-by,cc-by-nc-4.0"
    assert scanner.scan("Redistribution and use in source and binary forms, with or without modification, is permitted")["labels"] == "bsd"
    assert scanner.scan("the license of a mozilla")["labels"] == "" and scanner.scan("mit license mit license")["n_base"] == 2
    assert licenses.scan_licenses(odd).where("labels <> '' or score > 0").count() == 0 and licenses.scan_licenses(none).count() == 0


# 9


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def near_rows(seed=4, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 30, 90]))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if i % 5 == 0:
            w = w + passage
        rows.append((i, " ".join(w) if i % 9 else " ".join(w).upper()))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize("small", [64, 2])
def test_near_groups_are_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SIDE", 16 if small == 2 else 256)
    monkeypatch.setattr(jaccard, "HUBS", (1,) if small == 2 else (1, 8))
    rows = near_rows()
    out = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, out.collect())) == brute_groups(rows)


@pytest.mark.parametrize("texts", [["one two"], ["one two three"], ["one two", "long words " * 100_000], ["one two"] * 2 + ["", None]])
def test_near_groups_of_few_words(spark, texts):
    rows = list(enumerate(texts))
    out = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, out.collect())) == brute_groups(rows)


def test_near_groups_of_null_ids(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(800):
        w = list(base)
        for k in rng.sample(range(120), 2):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    made, sets = [], jaccard._sets

    def counted(docs, named, size):
        made.append(sets(docs, named, size).count())
        return sets(docs, named, size)

    monkeypatch.setattr(jaccard, "_sets", counted)
    out = jaccard.near_groups(spark.createDataFrame([(None, t) for t in texts + texts[:50]] + [(9, texts[0])], "doc_id long, text string"), marks=True).collect()
    assert len(out) == 851 and len({r.key for r in out}) == 1 and {r.component_id for r in out} == {9}
    assert made == [len(set(texts))]  # each class once, not once for each row of its id


@pytest.mark.parametrize("sample", [1, 3])
def test_near_groups_with_hot_hashes(spark, monkeypatch, sample):
    monkeypatch.setattr(jaccard, "BLOCK", 320)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rows = near_rows(seed=6, n=160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_groups(df).collect())) == brute_groups(rows)


@pytest.mark.parametrize("bits", [3, 9])
def test_near_groups_when_short_hashes_meet(spark, monkeypatch, bits):
    # Hashes of one class that agree in the bits sent are counted as many, so none of its partners is lost.
    monkeypatch.setattr(jaccard, "SHORT", bits)
    rows = near_rows(seed=8, n=160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_groups(df).collect())) == brute_groups(rows)
    flat, owner = np.array([5, 5, 5, 7, 5, 9], np.uint32), np.array([0, 0, 1, 1, 1, 2])
    assert jaccard._merged(flat, owner, 4).tolist() == [1, 1, 0, 0]


def test_no_block_gets_all_of_a_hot_hash():
    rng = np.random.default_rng(1)
    hot = np.sort(rng.integers(0, 2**63, 30, dtype=np.uint64))
    classes = np.repeat(rng.integers(-(2**62), 2**62, 4000), 30 + 20)
    hashes = np.concatenate([np.r_[hot, rng.integers(0, 2**62, 20, dtype=np.uint64)] for _ in range(4000)])
    deal = jaccard.Deal(20 * jaccard.BLOCK, (hot, np.full(30, 4000, np.int32)))
    block = deal.block(hashes, classes)
    assert np.bincount(block, minlength=deal.all).max() < 1.5 * len(hashes) / 20
    for c in classes[:100:50]:
        assert len(set(block[(classes == c) & np.isin(hashes, hot)])) == 1


def test_trie_walk_is_brute_force():
    rng = np.random.default_rng(2)
    bounds = jaccard.Bounds(75, 100)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) < rng.choice([0.3, 0.8, 0.95])], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]) for _ in range(60)]
    sets = sorted((s for s in sets if len(s)), key=lambda s: s.astype(">u8").tobytes())
    for hub in (base, sets[7]):
        real = [100 * len(np.intersect1d(hub, s)) >= 75 * len(np.union1d(hub, s)) for s in sets]
        assert jaccard.linked(hub, sets, bounds) == real


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, jaccard.components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_near_groups_odd(odd, none):
    out = jaccard.near_groups(odd)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert len(got) == len(ODD) and got.count((6, 1, 6)) == 2 and (1, 0, 1) in got and (None, 1, None) in got
    assert jaccard.near_groups(none).count() == 0


# 10


def brute_fingerprint(text):
    from collections import Counter

    import xxhash

    words = [xxhash.xxh3_64_intdigest(w) for w in text.lower().encode().split()]
    u64 = lambda x: np.array([x % 2**64], np.uint64)
    terms = words if len(words) == 1 else [int((simhash._mixed(u64(a), 0) + u64(b))[0]) for a, b in zip(words, words[1:])]
    votes = np.zeros(simhash.BITS, np.int64)
    for t, n in Counter(terms).items():
        t = simhash._mixed(u64(t), 1)
        bits = np.unpackbits(np.r_[t, simhash._mixed(t, 2)].view(np.uint8)).astype(int)
        votes += (2 * bits - 1) * (1 + int(np.log2(n)))
    return np.packbits(votes > 0)


def test_fingerprints_are_brute_force(docs):
    texts = ["", "one", "a b", "x x x x x y", " \n"] + texts_of(docs)[:40]
    assert np.array_equal(simhash.fingerprints(texts), np.stack([brute_fingerprint(t) for t in texts]))


def test_fingerprints_in_slices(docs, monkeypatch):
    texts = texts_of(docs)[:30] + ["", "x y " * 50]
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "SLICE", 37)
    assert np.array_equal(simhash.fingerprints(texts), whole)


def test_simhash_next_and_edited(spark, docs):
    out = [r for r in simhash.op10_simhash(spark, DATA).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    following = {rows[k][0]: (rows[k][1], rows[(k + 1) % len(rows)][1]) for k in range(len(rows))}
    assert len(out) == len(rows)
    for r in out:
        t, nxt = following[r.doc_id]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in out) > 0.95 * len(out)
    prints = [int(r.fingerprint, 16) for r in out]
    for r in out:
        near = sum((int(r.fingerprint, 16) ^ p).bit_count() <= simhash.RADIUS for p in prints)
        assert r.n_near == (near if r.doc_id % 20 == 0 else None)


@pytest.mark.parametrize("ranges", [3, 12, 400])
def test_simhash_ranges(spark, monkeypatch, ranges):
    import xxhash

    monkeypatch.setattr(simhash, "LOOKED_AT", 10_000)
    rows = [(i // 2 if i < 160 else None if i < 300 else 500 + i, f"t{i} " + "long " * (i % 7)) for i in range(340)] + [(None, "again")] * 5
    total = sum(len(t) + 100 for _, t in rows)
    monkeypatch.setattr(simhash, "RANGE_BYTES", total // ranges)
    dealt = simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"))

    def tie(t):
        return xxhash.xxh64_intdigest(t.encode(), 42) - (2**64 if xxhash.xxh64_intdigest(t.encode(), 42) >= 2**63 else 0)

    order = [t for _, t in sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), tie(r[1]), r[1]))]
    following = sorted((order[k], order[(k + 1) % len(order)]) for k in range(len(order)))
    got, used = [], set()
    for part in dealt.rdd.glom().collect():
        for a, b in zip(part, part[1:]):
            if not a.tail:
                assert a.bucket == b.bucket
                used.add(a.bucket)
                got.append((a.text, b.text))
    assert sorted(got) == following
    assert len({r.bucket for r in dealt.where("doc_id is null and tail = 0").select("bucket").distinct().collect()}) >= ranges // 5  # null ids are split


def test_search_is_brute_force(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(128) for _ in range(30)]
    for p in list(prints):
        for _ in range(4):
            q = p
            for _ in range(rng.randint(0, 6)):
                q ^= 1 << rng.randrange(128)
            prints.append(q)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] * 2 + [(None,)], "fingerprint string")
    for radius in (0, 3, 6):
        real = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}
        got = simhash.search(df, df, radius).collect()
        assert len(got) == len(real) and {tuple(r) for r in got} == real


def test_search_finds_edited_copies(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        rows.append((20 * i, " ".join(w)))
        for k in rng.sample(range(300), 5):
            w[k] = f"x{rng.randrange(50_000)}"
        rows.append((20 * i + 1, " ".join(w)))
    made = simhash.add_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    near = {r.near[0].near_id: {x.near_id for x in r.near} for r in simhash.near_counts(made, F.col("doc_id") % 20 == 0).collect()}
    assert sum(near.get(20 * i) == {20 * i, 20 * i + 1} for i in range(60)) >= 54
    prints = [(r.fingerprint, int(r.fingerprint, 16)) for r in made.collect()]
    real = {(a, b, (x ^ y).bit_count()) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 17}
    for flips in (0, 1, 2):
        got = [tuple(r) for r in simhash.search(made, made, 17, flips).collect()]
        assert len(got) == len(real) and set(got) == real


def test_simhash_of_odd_tables(spark, odd, none):
    out = simhash.edited_fingerprints(odd.select("doc_id", "text"))
    rows = out.collect()
    assert len(rows) == len(ODD) and sum(r.n_chars == 0 for r in rows) == 2 and [r.fingerprint for r in rows if r.doc_id == 6][0] == [r.fingerprint for r in rows if r.doc_id == 6][1]
    assert simhash.edited_fingerprints(none.select("doc_id", "text")).count() == 0


def test_simhash_odd(odd, none):
    assert simhash.add_fingerprint(odd).where("text is null and fingerprint <> repeat('0', 32)").count() == 0
    assert simhash.add_fingerprint(none).count() == 0 and simhash.with_next(none.select("doc_id", "text")).count() == 0
