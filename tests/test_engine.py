"""Properties, statistics and edge cases of profiling, models, sampling and reports."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tabloom.functions.rng import letters, uniform, uniform_here
from tabloom.operators import bayesnet, cpt, distribution, generate, ordered, report
from tabloom.operators import information as info
from tabloom.operators.encode import encode
from tabloom.operators.profile import infer_types, profile
from tabloom.plans.engine import Config, describe, run, sample
from tabloom.plans.model import ColumnModel, TableModel
from tabloom.plans.queries import labelled
from tabloom.sources.tables import drop_empty_columns, empty_columns, read_csv, write_csv
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return labelled(spark, DATA).drop("doc_id").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_random_numbers(spark):
    got = rows(spark.range(50).select(uniform(7, "a:b", F.col("id"))))
    assert [x for (x,) in got] == [uniform_here(7, "a:b", i) for i in range(50)]
    assert rows(spark.range(1).select(letters(1, "t", F.col("id"), F.lit(0)), F.length(letters(1, "t", F.col("id"), F.lit(5))))) == [("", 5)]


def test_types_of_text(spark):
    data = [("2020-01-02", "123-45-6789", "monday", "x1", True, 1.0, 1.5), ("2021-12-31", "000-00-0001", "tuesday", None, False, 2.0, 2.0)]
    df = spark.createDataFrame(data, "d string, s string, w string, t string, b boolean, i double, f double")
    assert infer_types(df) == {"d": "DateTime", "s": "SocialSecurityNumber", "w": "String", "t": "String", "b": "String", "i": "Integer", "f": "Float"}
    with pytest.raises(TypeError):
        infer_types(spark.createDataFrame([([1],)], "a array<int>"))


def test_keys_and_missing(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 3, None), (4, 4, 4)], "a int, b int, c int")
    columns = profile(df, threshold=2).columns
    assert [columns[c].is_candidate_key for c in "abc"] == [True, True, False]
    assert [columns[c].is_categorical for c in "abc"] == [False, False, True]
    assert columns["c"].missing_rate == 0.5


def test_odd_tables(spark):
    names = ["a b", "a'b", "marital-status"]
    df = spark.createDataFrame([(i % 3, f"x{i % 2}", float(i)) for i in range(30)], "x int, y string, z double").toDF(*names)
    model = describe(df, Config(epsilon=0, degree=2, root="a b"))
    assert sample(spark, model).columns == names
    empty = spark.createDataFrame([], "x int, y string")
    assert profile(empty).num_tuples == 0
    assert empty_columns(empty) == ["x", "y"]
    constant = spark.createDataFrame([(5, 7.25)] * 4, "x int, y double")
    made = sample(spark, describe(constant, Config(mode="independent", epsilon=0, categorical={"y": False})))
    assert {r.x for r in made.collect()} == {5} and all(6.75 <= r.y <= 7.75 for r in made.collect())
    with pytest.raises(ValueError):
        describe(spark.createDataFrame([("a",), ("b",)], "x string"), Config(mode="correlated"))
    with pytest.raises(ValueError):
        describe(constant, Config(mode="other"))
    assert sample(spark, model, 0).count() == 0


def test_empty_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert drop_empty_columns(df).columns == ["a"]
    assert list(describe(df, Config(mode="independent")).columns) == ["a"]


@pytest.mark.parametrize("rule,bins", [("auto", 7), ("fd", 4), ("doane", 7), ("scott", 4), ("rice", 8), ("sturges", 7), ("sqrt", 8)])
def test_bin_rules(spark, rule, bins):
    df = spark.range(1, 51)
    assert distribution.auto_bins(df, F.col("id"), rule) == bins


def test_stone_rule(spark):
    df = spark.range(200).select((F.col("id") % 100).cast("double").alias("x"))
    assert 1 <= distribution.auto_bins(df, F.col("x"), "stone") <= 100


def test_stone_rule_tries_up_to_the_root(spark):
    import numpy as np

    x = [i % 20 for i in range(50_000)]
    df = spark.range(50_000).select((F.col("id") % 20).alias("x"))
    stats = distribution.statistics(df, F.col("x"))
    assert distribution.stone_bins(df, F.col("x"), stats) == len(np.histogram_bin_edges(np.array(x, float), "stone")) - 1 == 223
    assert distribution.stone_bins(df, F.col("x"), stats, 205) > 200


def test_probabilities(spark, docs):
    model = describe(docs, Config(epsilon=0.5, degree=2, seed=3))
    for c in model.columns.values():
        assert min(c.distribution_probabilities) >= 0 and math.isclose(sum(c.distribution_probabilities), 1)
    for table in model.conditional.values():
        assert all(min(p) >= 0 and math.isclose(sum(p), 1) for _, p in table)
    children = [c for c, _ in model.network]
    known = {model.network[0][1][0]}
    for child, parents in model.network:
        assert set(parents) <= known and len(parents) <= 2
        known.add(child)
    assert len(set(children)) == len(children) == len(model.network_attributes) - 1
    assert model.epsilon_spent == {"distributions": 0.5, "structure": 0.25, "tables": 0.25}
    shared = describe(docs, Config(epsilon=0.6, degree=1, budget="shared"))
    assert math.isclose(sum(shared.epsilon_spent.values()), 0.6)


def test_same_rows_for_any_partitioning(spark, docs):
    model = describe(docs, Config(epsilon=0, degree=2, root="lang"))
    a = generate.correlated_mode(spark.range(0, 500, 1, 1), 500, model, seed=5)
    b = generate.correlated_mode(spark.range(0, 500, 1, 7), 500, model, seed=5)
    assert sorted(map(str, rows(a))) == sorted(map(str, rows(b)))
    again = describe(docs.repartition(5), Config(epsilon=1, degree=2, seed=9))
    assert again.network == describe(docs, Config(epsilon=1, degree=2, seed=9)).network


def test_model_as_json(docs, tmp_path):
    model = describe(docs, Config(epsilon=0, degree=1))
    model.save(str(tmp_path / "m.json"))
    assert TableModel.load(str(tmp_path / "m.json")).to_json() == json.loads(json.dumps(model.to_json()))
    assert set(model.to_json()) == {"meta", "attribute_description", "bayesian_network", "conditional_probabilities"}
    assert set(model.to_json()["attribute_description"]["lang"]) == {"name", "data_type", "is_categorical", "is_candidate_key", "min", "max", "missing_rate", "distribution_bins", "distribution_probabilities"}


def test_codes(spark, docs):
    model = distribution.fit(docs, profile(docs))
    coded = encode(docs, model)
    for name in coded.columns:
        lo, hi = coded.agg(F.min(name), F.max(name)).first()
        assert lo >= 0 and hi <= len(model.columns[name].distribution_bins)
    assert coded.where(F.col("quality") == len(model.columns["quality"].distribution_bins)).count() == docs.where("quality is null").count()


def test_many_categories_are_joined(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 1500).alias("x"), (F.col("id") % 2).alias("y"))
    model = distribution.fit(df, profile(df, categorical={"x": True}))
    coded = encode(df, model, ["x", "y"])
    assert coded.select("x").distinct().count() == 1500 and coded.agg(F.max("x")).first()[0] == 1499


def test_dictionaries_lose_nothing(spark):
    """Doubles far from and near to zero, times, text and missing values, with 1,500 and 60,000 categories each."""
    for n in (900, 1500, 60_000):
        x = F.col("id") % n
        df = spark.range(2 * n).select((x * F.lit(1e7) + 0.5).alias("large"), (x / 1e5).alias("small"), F.timestamp_seconds(x * 977).alias("time"), F.when(x % 10 > 0, F.concat(F.lit("v"), x)).alias("text"), (F.col("id") % 2).alias("y"))
        model = distribution.fit(df, profile(df, categorical=dict.fromkeys(("large", "small", "time", "text"), True)))
        sizes = {c: model.columns[c].size for c in df.columns}
        assert sizes == {"large": n, "small": n, "time": n, "text": n - n // 10, "y": 2}
        assert (model.columns["large"].dictionary is not None) == (n > 1000)
        coded = encode(df, model, df.columns)
        found = coded.agg(*[F.count_distinct(c) for c in df.columns], *[F.max(c) for c in df.columns]).first()
        assert list(found)[:5] == [n, n, n, n - n // 10 + 1, 2] and list(found)[5:] == [n - 1, n - 1, n - 1, n - n // 10, 1]
        made = sample(spark, model, 500, "independent", seed=3, emit_missing=True, timestamps=True)
        for c in df.columns:
            assert made.select(c).where(f"{c} is not null").join(df.select(c).distinct(), c, "left_anti").count() == 0
        assert 20 < made.where("text is null").count() < 90 and dict(made.dtypes)["time"] == "timestamp"
        flat = sample(spark, distribution.uniform_domain(model, df), 300, "random")
        assert flat.where("small is null").count() == 0 and flat.select("small").distinct().count() > 200


def test_lists_and_dictionaries_agree(spark, monkeypatch):
    df = spark.range(4000).select(((F.col("id") * 37) % 40 / 8).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id") % 17)).alias("c"), F.lit("clash").alias("value"))
    kinds = {"categorical": dict.fromkeys(("x", "c", "value"), True)}
    by_list = distribution.fit(df, profile(df, **kinds), domains={"c": ["zz", "n3"]})
    codes = sorted(rows(encode(df, by_list)), key=str)
    for module in ("tabloom.operators.distribution", "tabloom.operators.encode"):
        monkeypatch.setattr(f"{module}.IN_PLAN", 2)
    assert sorted(rows(encode(df, by_list)), key=str) == codes  # long lists of an old model are joined too
    by_table = distribution.fit(df, profile(df, **kinds), domains={"c": ["zz", "n3"]})
    assert [c.dictionary is not None for c in by_table.columns.values()] == [True, True, False]
    assert sorted(rows(encode(df, by_table)), key=str) == codes
    a, b = (distribution.add_noise(m, df, 0.5, 3) for m in (by_list, by_table))
    for name in ("x", "c"):
        table = a.columns[name]
        got = {r.value: r.p for r in b.columns[name].dictionary.table.collect()}
        assert got == pytest.approx(dict(zip(table.distribution_bins, table.distribution_probabilities, strict=True)))
    made = [sample(spark, m, 2000, "independent", seed=4) for m in (a, b)]
    assert sorted(rows(made[0]), key=str) == sorted(rows(made[1]), key=str)


def test_networks_as_tables_and_lists_agree(spark, docs, monkeypatch, tmp_path):
    from tabloom.sources.store import read_model, write_model

    options = {"epsilon": 1, "degree": 2, "root": "lang", "seed": 4}
    listed = describe(docs, Config(**options))
    monkeypatch.setattr(cpt, "LISTED", 0)
    tabled = describe(docs, Config(**options))
    assert listed.tables is None and not tabled.conditional and tabled.network == listed.network
    want = sorted(rows(sample(spark, listed, 2000, seed=5)), key=str)
    assert sorted(rows(sample(spark, tabled, 2000, seed=5)), key=str) == want
    with pytest.raises(ValueError):
        tabled.save(str(tmp_path / "no.json"))
    for k, model in enumerate((listed, tabled)):
        write_model(spark, model, str(tmp_path / f"model{k}"))
        again = read_model(spark, str(tmp_path / f"model{k}"))
        assert sorted(rows(sample(spark, again, 2000, seed=5)), key=str) == want
        cards = {c: again.codes_of(c) for c in again.sampling_order}
        got = {(r.child, tuple(r.parent_codes), r.code): r.p for r in cpt.spelled(again.tables, again.network, cards).collect()}
        assert got == {(c, tuple(codes), i): p for c, table in listed.conditional.items() for codes, ps in table for i, p in enumerate(ps)}


def test_a_network_of_millions_of_cells(spark, tmp_path):
    from tabloom.sources.store import read_model, write_model

    n = 3000  # two parents of 3,000 and 1,000 codes and a binary child: six million cells, never on the driver
    df = spark.range(6000).select((F.col("id") % n * 1.5).alias("a"), (F.col("id") % 1000).alias("b"), F.when(F.col("id") % 7 < 3, "x").otherwise("y").alias("c"))
    model = distribution.fit(df, profile(df, categorical=dict.fromkeys("abc", True)))
    model.network = [("b", ["a"]), ("c", ["b", "a"])]
    cards = {k: model.codes_of(k) for k in "abc"}
    assert cpt.cells(model.network, cards) == 3000 + 3_000_000 + 6_000_000
    tuples = bayesnet.collapsed(encode(df, model, ["a", "b", "c"]))
    model.tables = cpt.numbered(cpt.tables(tuples, model.network, cards), model.network, cards)
    write_model(spark, model, str(tmp_path / "m"))
    again = read_model(spark, str(tmp_path / "m"))
    assert again.tables.count() == 9_003_000
    made = sample(spark, again, 3000, seed=2)
    # Every instance that was seen has one outcome, so all rows made are rows of the table.
    assert made.count() == 3000 and made.join(df.distinct(), ["a", "b"], "left_anti").count() == 0
    assert made.select("a").distinct().count() > 1500


def test_permutations(spark):
    from tabloom.functions.rng import shuffled

    for n in [*range(1, 40), 1000, 4097]:
        got = [r[0] for r in spark.range(n).select(shuffled(F.col("id"), n, 5, "t")).collect()]
        assert sorted(got) == list(range(n))
    n = 1_000_000
    both = spark.range(n).select(F.col("id"), shuffled(F.col("id"), n, 1, "t").alias("a"), shuffled(F.col("id"), n, 2, "t").alias("b"))
    found = both.agg(F.count_distinct("a"), F.count_distinct("b"), F.min("a"), F.max("b"), F.sum((F.col("a") == F.col("b")).cast("int")), F.corr("a", "b"), F.corr("id", "a")).first()
    assert list(found)[:4] == [n, n, 0, n - 1] and found[4] < 20 and abs(found[5]) < 0.01 and abs(found[6]) < 0.01


def test_kl_and_ks(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, None)], "c string, v double")
    b = spark.createDataFrame([("x", 1.0), ("z", 3.0)], "c string, v double")
    assert info.kl_divergence(a, b, "c").first()[0] == math.inf
    assert info.kl_divergence(a, a, "c").first()[0] == 0
    assert info.ks_statistic(a, b, "v").first()[0] == 0.5 and info.ks_statistic(a, a, "v").first()[0] == 0


def test_degree():
    assert bayesnet.degree(7, 32561) == 3
    assert bayesnet.parent_sets(["r", "a", "b"], 2) == [["a", "r"], ["b", "r"], ["b", "a"]]
    with pytest.raises(ValueError):
        bayesnet.sensitivity(1, True, [])


def test_space_is_bounded(spark):
    with pytest.raises(ValueError):
        cpt.code_space(spark.range(1), {f"c{i}": 100 for i in range(10)})


def test_keys(spark):
    row, n = F.col("id"), 1000
    for c in (ColumnModel("s", "SocialSecurityNumber", False, True), ColumnModel("t", "String", False, True, min=2, max=5), ColumnModel("i", "Integer", False, True), ColumnModel("f", "Float", False, True, min=1.5, max=9.5), ColumnModel("d", "DateTime", False, True, min=0, max=10**6)):
        assert spark.range(n).select(generate.key_values(c, n, 1, row).alias("k")).distinct().count() == n


def test_random_mode_and_missing(spark, docs):
    model = describe(docs, Config(mode="random"))
    made = sample(spark, model, 300, "random", use_domain=True)
    assert made.where("lang is null").count() == 0
    independent = sample(spark, describe(docs, Config(mode="independent", epsilon=0)), 300, "independent", emit_missing=True)
    assert 0 < independent.where("quality is null").count() < 300
    times = spark.createDataFrame([(f"2020-01-{d:02d}",) for d in range(1, 31)], "d string")
    made = sample(spark, describe(times, Config(mode="independent", epsilon=0, keys={"d": False}, categorical={"d": False})), 5, timestamps=True)
    assert dict(made.dtypes)["d"] == "timestamp"


def test_statistics_of_correlated_mode(spark, docs):
    # 200 rows carry little: a budget of 1 would drown them in noise.
    model, made, frames = run(docs, Config(epsilon=200, degree=2, rows=10_000, seed=2))
    assert info.ks_statistic(docs, made, "n_chars").first()[0] < 0.5
    for name in ("lang", "source", "quality", "toxic"):
        assert info.kl_divergence(docs, made, name).first()[0] < 1
    flat = sample(spark, model, 10_000, "random", use_domain=True)
    names = ["lang", "quality", "toxic"]
    assert info.nmi_difference(docs, made, names).first()[0] < 5 * info.nmi_difference(docs, flat, names).first()[0]
    assert set(frames) == {"lang", "source", "n_chars", "quality", "toxic", "nmi"}


def test_acceptance_at_epsilon_one(spark):
    docs = labelled(spark, "/root/testdata/sf0.1").drop("doc_id").cache()
    model, made, _ = run(docs, Config(epsilon=1, degree=2, rows=10_000, seed=1))
    made = made.cache()
    assert info.ks_statistic(docs, made, "n_chars").first()[0] < 0.5
    for name in ("lang", "source", "quality", "toxic"):
        assert info.kl_divergence(docs, made, name).first()[0] < 1
    flat = sample(spark, model, 10_000, "random", use_domain=True)
    assert info.nmi_difference(docs, made).first()[0] < 5 * info.nmi_difference(docs, flat).first()[0]


def test_dates_in_text(spark):
    data = [("2020-01-02", "1/2/2020", "31/12/2020", "2 Jan 2020", "January 2, 2020", "2020-01-02 03:04:05.123", "2020-13-4x", "may"), (None,) * 8]
    df = spark.createDataFrame(data, "a string, b string, c string, d string, e string, f string, g string, h string")
    kinds = infer_types(df)
    assert [c for c, k in kinds.items() if k == "DateTime"] == list("abcdef") and kinds["g"] == kinds["h"] == "String"
    columns = profile(df.where("a is not null")).columns
    assert [columns[c].min for c in "abde"] == [1577923200] * 4 and columns["c"].min == 1609372800 and columns["f"].min == 1577934245


def test_dates_in_free_form(spark):
    from datetime import datetime

    from tabloom.functions.types import parsed_date

    t = datetime(2020, 3, 4)
    same = ["2020-03-04", "2020/3/4", "2020.03.04", "3/4/2020", "03-04-2020", "3.4.2020", "3/4/20", "4 Mar 2020", "4th of".replace("th of", "th") + " March, 2020", "4-MAR-2020", "04mar2020", "March 4, 2020", "mar. 4 2020", "March 4th, 2020", "Wed, 4 Mar 2020", "Wednesday 4 March 2020", "2020 Mar 4", "2020-Mar-04", " 2020-03-04 ", "2020-03-04T00:00:00Z", "2020-03-04 12:00 am", "2020-03-04T01:30+01:30", "2020-03-03 22:00:00 -0200"]
    times = {"2020-03-04 05:06:07.125": datetime(2020, 3, 4, 5, 6, 7, 125000), "3/4/2020 5:06 PM": datetime(2020, 3, 4, 17, 6), "13/4/1999": datetime(1999, 4, 13), "4/13/99": datetime(1999, 4, 13), "2020-13-01": datetime(2020, 1, 13), "29 Feb 2020, 12:30pm": datetime(2020, 2, 29, 12, 30), "2020-03-04 05:06:07,5": datetime(2020, 3, 4, 5, 6, 7, 500000)}
    none = ["2020-02-30", "13/13/2020", "123-45-6789", "20200304", "1.2", "1.2.3.4", "4 mars", "2020-03-04 25:00", "2020-03-04 13:00 am", "12:30", "march", "x 3/4/2020", "3/4/2020 y", "", "99", "v1-2-3"]
    cases = [(x, t) for x in same] + list(times.items()) + [(x, None) for x in none] + [(None, None)]
    got = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string").select("k", F.date_format(parsed_date(F.col("x")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    assert {cases[r.k][0]: r.t for r in got.collect()} == {x: w and w.strftime("%Y-%m-%d %H:%M:%S.%f") for x, w in cases}


def test_running_and_quantiles(spark):
    import statistics

    from tabloom.operators.ordered import quantiles, running

    values = [(i * 7919) % 1000 / 4 for i in range(2500)] + [5.0] * 700
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    q = quantiles(df, F.col("x"), [0.25, 0.5, 0.75])
    assert q == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"))
    assert quantiles(df.limit(0), F.col("x"), [0.5]) == [None]
    counts = spark.range(2000).select((F.col("id") % 50).alias("n"), F.concat(F.lit("v"), "id").alias("value"), F.lit(1).alias("one"))
    got = [tuple(r) for r in running(counts, ["n", "value"], {"place": "one"}, falling=("n",)).orderBy("place").select("n", "value").collect()]
    assert got == sorted(((r.n, r.value) for r in counts.collect()), key=lambda t: (-t[0], t[1]))


def test_quantiles_of_many_columns(spark, monkeypatch):
    import numpy as np

    n = 60_000
    df = spark.range(n).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) / 7).alias(f"x{k}") for k, m in enumerate((10**9, 1000, 3))], F.when(F.col("id") % 2 > 0, F.lit(5.0)).otherwise(F.lit(float("nan"))).alias("x3"), F.lit(None).cast("double").alias("x4"), F.when(F.col("id") < 3, F.col("id")).alias("x5")).repartition(6).cache()
    table = df.toPandas()
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    names = [f"x{k}" for k in range(6)]
    want = {c: [np.quantile(table[c].dropna(), s) for s in shares] if table[c].notna().any() else [None] * 5 for c in names}
    for few in (100_000, 100):  # all values, and those within brackets
        monkeypatch.setattr(ordered, "FEW", few)
        got, more = ordered.quantiles_of(df, {c: F.col(c) for c in names}, shares, {"most": F.max("x1")})
        assert {c: got[c] for c in names if c != "x4"} == {c: pytest.approx(want[c], rel=1e-12) for c in names if c != "x4"}
        assert got["x4"] == [None] * 5 and more["most"] == table.x1.max()
    calls = []
    selected = ordered._selected

    def misses(df, xs, brackets, ranks):
        calls.append(len(xs))
        return selected(df, xs, {k: (b[1], b[1]) if len(calls) == 1 and b[1] != float("inf") else b for k, b in brackets.items()}, ranks)

    monkeypatch.setattr(ordered, "_selected", misses)
    assert ordered.quantiles_of(df, {"x0": F.col("x0")}, [0.5])[0]["x0"] == pytest.approx([want["x0"][2]]) and calls == [1, 1]  # a bracket that misses is widened


def jobs(spark, run):
    """How many jobs of Spark something takes."""
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("one_task", (0, 10**9))
def test_jobs_do_not_grow_with_columns(spark, monkeypatch, one_task):
    monkeypatch.setattr(ordered, "ONE_TASK", one_task)  # few rows are ordered another way, in fewer jobs
    df = spark.range(3000).select(*[((F.col("id") * (2 * k + 1)) % 2999 / 3).alias(f"x{k}") for k in range(12)], F.col("id").alias("o")).cache()
    df.count()
    few, many = (jobs(spark, lambda m=m: report.rank_summary(df, "o", [f"x{k}" for k in range(m)]).collect()) for m in (2, 12))
    assert many == few
    few, many = (jobs(spark, lambda m=m: distribution.auto_bins_of(df, {f"x{k}": F.col(f"x{k}") for k in range(m)})) for m in (2, 12))
    assert many == few


def test_reports_take_the_same_jobs_for_any_columns(spark):
    df = spark.range(500).select(*[(F.col("id") * (k + 3) % 97 / 3).alias(f"x{k}") for k in range(6)], *[F.concat(F.lit("v"), F.col("id") % (k + 2)).alias(f"c{k}") for k in range(6)]).cache()
    df.count()
    taken = []
    for m in (1, 6):
        part = df.select(*[f"x{k}" for k in range(m)], *[f"c{k}" for k in range(m)])
        model = profile(part)
        taken.append([jobs(spark, f) for f in (lambda p=part, x=model: report.charts(p, x), lambda p=part, x=model: report.inspect(p, p, x), lambda p=part, x=model: report.before_after(p, p, x))])
    assert taken[0] == taken[1]


def test_reports_of_all_are_those_of_each(spark, docs):
    df = docs.withColumn("side", F.lit("clash")).withColumn("free", F.concat("lang", "n_chars")).withColumn("none", F.lit(None).cast("double"))
    other = df.where("n_chars > 500 and lang <> 'fr'")
    model = profile(df)
    got = report.inspect(df, other, model)
    assert set(got) == {"lang", "source", "n_chars", "quality", "toxic", "side", "none", "nmi"}
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    same = lambda a, b: sorted(map(key, rows(a)), key=str) == sorted(map(key, rows(b)), key=str)
    assert same(got["lang"], report.compare_bars(df, other, "lang")) and same(got["quality"], report.compare_bars(df, other, "quality"))
    assert same(got["n_chars"], report.compare_densities(df, other, "n_chars", "Integer")) and got["none"].count() == len({*rows(got["none"])}) == 0 or model.columns["none"].is_categorical
    assert "free" not in {r.x for r in got["nmi"].collect()}
    made = report.charts(df, model)
    assert same(made["lang"], report.bars(df, "lang", by_value=False)) and same(made["n_chars"], report.histogram_bars(df, "n_chars")) and same(made["free"], report.top(df, "free"))
    both = report.before_after(df, other, model)
    assert same(both["barchart"]["after:lang"], report.bars(other, "lang")) and same(both["histogram"]["after:n_chars"], report.histogram_bars(other, "n_chars"))


def test_printed_models(docs, capsys, tmp_path):
    from tabloom.sources.tables import read_domains

    model = describe(docs, Config(epsilon=0, degree=1, root="lang"))
    model.show()
    assert json.loads(capsys.readouterr().out)["meta"] == model.meta()
    model.show_network()
    assert [tuple(x.split()) for x in capsys.readouterr().out.splitlines()] == [(c, "<-", *p) for c, p in model.network]
    (tmp_path / "domains.json").write_text('{"lang": ["en", "zz"], "quality": [0, 1, 7]}')
    declared = read_domains(str(tmp_path / "domains.json"))
    known = describe(docs, Config(mode="independent", epsilon=0, domains=declared)).columns
    assert "zz" in known["lang"].distribution_bins and known["quality"].distribution_bins == [0, 1, 7]


@pytest.mark.parametrize("k,epsilon", [(2, 0), (3, 0), (2, 50.0), (2, 2000.0)])
def test_bounded_search_is_the_full_one(spark, monkeypatch, k, epsilon):
    # Columns that depend on each other in part, copies of a column (ties), and a constant.
    noise = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m))
    a, b = noise(0, 6), noise(1, 3)
    columns = [a, b, (a + noise(2, 2)) % 6, (a * 2 + b) % 5, F.when(noise(3, 4) == 0, b).otherwise(a), a, noise(4, 7), F.lit(0), (b + noise(5, 3)) % 3]
    df = spark.range(3000).select(*[c.cast("int").alias(f"c{i}") for i, c in enumerate(columns)])
    tuples = bayesnet.collapsed(df).cache()
    full = bayesnet.learn(df, k=k, epsilon=epsilon, seed=3, root="c1", tuples=tuples)
    asked = []
    scores = bayesnet.scores
    monkeypatch.setattr(bayesnet, "scores", lambda t, c: asked.extend(c) or scores(t, c))
    monkeypatch.setattr(bayesnet, "WHOLE", 0)
    monkeypatch.setattr(bayesnet, "START", 4)
    assert bayesnet.learn(df, k=k, epsilon=epsilon, seed=3, root="c1", tuples=tuples) == full
    if not epsilon:
        assert len(asked) < 0.6 * sum((9 - m) * math.comb(m, min(m, k)) for m in range(1, 9))


def test_bounds_hold(spark):
    import numpy as np

    df = spark.range(500).select(*[F.pmod(F.xxhash64(F.floor(F.col("id") / (i + 1)), F.lit(i % 3)), F.lit(i + 2)).cast("int").alias(f"c{i}") for i in range(5)])
    tuples, names = bayesnet.collapsed(df).cache(), df.columns
    h = bayesnet.pair_entropies(tuples, names)
    for size in (1, 2, 3):
        sets = bayesnet.parent_sets(names[1:], size)
        top = bayesnet.bounds(h, 0, np.array([[names.index(p) for p in ps] for ps in sets]))
        mi = bayesnet.scores(tuples, [("c0", ps) for ps in sets])
        assert all(m <= t for m, t in zip(mi, top, strict=True))
        if size == 1:
            assert mi == pytest.approx(top, abs=1e-8)


def test_two_valued_columns_are_less_sensitive(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("two"), (F.col("id") % 5).cast("int").alias("five"), (F.col("id") % 3).cast("int").alias("three"))
    seen = []
    monkeypatch.setattr(bayesnet, "choose", lambda mi, scales, seed, n: seen.append(scales) or 0)
    bayesnet.learn(df, k=1, epsilon=1.0, root="five")
    low, high = (bayesnet.scale(3, bayesnet.sensitivity(400, two, [False]), 1.0) for two in (True, False))
    assert seen[0] == [low, high] and low < high  # two given five, three given five
    assert seen[1] == [high, low]  # three given five, and given two


def test_stream_of_codes(spark, docs, tmp_path):
    from tabloom.streaming.generate import encode_stream

    model = describe(docs, Config(epsilon=0, degree=1, root="lang"))
    docs.write.parquet(str(tmp_path / "rows"))
    q = encode_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "rows")), model).writeStream.format("memory").queryName("codes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("codes"))) == sorted(rows(encode(docs, model)))


def test_keys_of_many_columns(spark):
    from tabloom.operators.profile import with_repeats

    n = 20_000
    df = spark.range(n).select(*[(F.when(F.col("id") == 5 + k, 6 + k).otherwise(F.col("id")) if k % 3 == 0 else F.concat(F.lit("v"), F.col("id") if k % 3 == 1 else F.floor(F.col("id") / 2)) if k % 3 else F.col("id")).alias(f"c{k}") for k in range(30)])
    assert with_repeats(df, df.columns) == {f"c{k}" for k in range(30) if k % 3 != 1}
    columns = profile(df, threshold=20).columns
    assert [c for c, m in columns.items() if m.is_candidate_key] == [f"c{k}" for k in range(30) if k % 3 == 1]
    assert with_repeats(df.limit(0), df.columns) == set() and with_repeats(df, []) == set()


def test_stone_rule_is_the_library(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for values in (rng.normal(size=40_000), rng.integers(0, 500, 3000).astype(float) / 8, np.r_[np.zeros(900), rng.exponential(size=4100)]):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        stats = distribution.statistics(df, F.col("x"))
        assert distribution.stone_bins(df, F.col("x"), stats) == len(np.histogram_bin_edges(values, "stone")) - 1


def test_draws_of_many(spark):
    p = [1 / 300] * 300
    u = uniform(1, "t", F.col("id"))
    two = spark.range(2000).select(generate.draw_of(generate.cumulative(p), u).alias("a"), generate.draw(generate.numbers(generate.cumulative(p)), u).alias("b"))
    assert two.where("a <> b").count() == 0 and two.agg(F.max("a")).first()[0] > 290


def skewed(n, power):
    p = [1 / (k + 1) ** power for k in range(n)]
    return [x / sum(p) for x in p]


@pytest.mark.parametrize("p", [[1.0], [0.0, 1.0], [0.5, 0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0], [0.2, 0.3], skewed(7, 0), skewed(64, 9), skewed(129, 0), skewed(1000, 3), [1e-18] * 300 + [1.0]], ids=lambda p: str(len(p)))
def test_guided_draws_are_those_of_all_comparisons(spark, p):
    cum = generate.cumulative(p)
    slots = len(generate.guide(cum)) - 1
    ends = [math.nextafter(x, d) for x in {*cum, *(k / slots for k in range(slots))} for d in (0, x, 1)]
    asked = sorted({x for x in [*ends, *(uniform_here(3, "u", i) for i in range(300))] if 0 <= x < 1})
    got = rows(spark.createDataFrame([(x,) for x in asked], "u double").select("u", generate.draw_of(cum, F.col("u"))))
    assert sorted(got) == [(x, min(sum(c <= x for c in cum), len(cum) - 1)) for x in asked]
    # A slot is compared with the sums inside it alone, 1 / GUIDE of one in expectation.
    assert sum(b - a for a, b in zip(generate.guide(cum), generate.guide(cum)[1:], strict=False)) / slots <= 1 / generate.GUIDE + 1e-9 or len(cum) == 1


def test_draws_without_codes(spark):
    assert rows(spark.range(2).select(generate.draw_of([], F.lit(0.5)), F.size(generate.numbers([])))) == [(-1, 0), (-1, 0)]
    got = rows(spark.range(1).select(generate.numbers([0.1, -1e300, 5e-324, 1 / 3, math.inf])))
    assert got == [([0.1, -1e300, 5e-324, 1 / 3, math.inf],)]


def test_reports(spark, docs):
    model = profile(docs)
    assert set(report.charts(docs, model)) == set(docs.columns)
    both = report.before_after(docs, docs, model)
    assert set(both) == {"barchart", "histogram", "heatmap"}
    assert report.compare_matrices(docs, docs).where("original <> synthetic").count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a, b,c\n1, x,NA\n2, ?,3.5\n-, y,4\n")
    df = read_csv(spark, str(tmp_path / "in.csv"), null_values=("?", "-"))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert rows(df) == [(1, "x", None), (2, None, 3.5), (None, "y", 4.0)]
    write_csv(df, str(tmp_path / "out"))
    assert sorted(rows(read_csv(spark, str(tmp_path / "out"))), key=str) == sorted(rows(df), key=str)
    (tmp_path / "old.csv").write_bytes("n\ncaf\xe9\n".encode("latin1"))
    assert rows(read_csv(spark, str(tmp_path / "old.csv"), encoding="ISO-8859-1")) == [("café",)]


def test_stream(spark, docs, tmp_path):
    from tabloom.streaming.generate import sample_stream

    model = describe(docs, Config(epsilon=0, degree=1, root="lang"))
    spark.range(100).write.parquet(str(tmp_path / "numbers"))
    numbers = spark.readStream.schema("id long").parquet(str(tmp_path / "numbers"))
    made = sample_stream(numbers, model, 100, "correlated", seed=4)
    q = made.writeStream.format("memory").queryName("made").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, rows(spark.table("made")))) == sorted(map(str, rows(sample(spark, model, 100, "correlated", 4))))


def test_nested_comparisons_are_the_scan(spark):
    from tabloom.functions.order import NESTED, below

    for edges in ([], [0.5], [0.0, 0.25, 0.25, 0.25, 1.0], [k / NESTED for k in range(NESTED)]):
        xs = sorted({-1.0, 0.0, 0.1, 0.25, 0.5, 0.999, 1.0, 2.0, *edges})
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", below(edges, F.col("x")).alias("n")).collect()
        assert {r.x: r.n for r in got} == {x: sum(e <= x for e in edges) for x in xs}


def test_independent_draws_need_no_lambda(spark):
    df = spark.createDataFrame([(k % 7, float(k % 90), None if k % 3 else "a") for k in range(300)], "a int, x double, t string")
    made = sample(spark, describe(df, Config(mode="independent", epsilon=0)), emit_missing=True)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("md5(") == 5  # a draw for each column, the place within a bin, and what is missing
    n, t = made.agg(F.count("*"), F.count("t")).first()
    assert n == 300 and 50 < t < 150


def test_root_of_a_network_needs_no_window(spark, monkeypatch):
    tuples = spark.createDataFrame([(k, k % 2, 1 + k % 3) for k in range(50)], "a int, b int, n bigint")
    network, cards = [("b", ["a"])], {"a": 51, "b": 2}
    whole = {tuple(map(str, r)) for r in cpt.tables(tuples, network, cards).collect()}
    root = cpt.conditional(cpt.marginal(cpt.joint_counts(tuples, cards), ["a"]), "a", [])
    assert "Window" not in root._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(cpt, "IN_TASK", 10)  # many tasks, the same tables
    assert {tuple(map(str, r)) for r in cpt.tables(tuples, network, cards).collect()} == whole
    monkeypatch.undo()
    nothing = cpt.conditional(spark.createDataFrame([(0, -1.0), (1, 0.0)], "a int, count double"), "a", [])
    assert {r.p for r in nothing.collect()} == {0.5}
