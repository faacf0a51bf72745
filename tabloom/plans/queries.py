"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Every query reads its whole table. Sums of logarithms differ in their last digits between engines,
so doubles that come from them are rounded on both sides.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.rng import laplace_sql, letters_sql, shuffled_sql, uniform_here, uniform_sql
from tabloom.functions.types import DATETIME, FLOAT, INTEGER, SSN, STRING, as_number
from tabloom.operators import bayesnet, cpt, distribution, generate, report
from tabloom.operators import information as info
from tabloom.operators.encode import code_of, encode
from tabloom.operators.profile import binary_columns, categorical_columns, infer_types, meta_frame, missing_rates, numeric_columns, profile, profile_frame
from tabloom.plans.engine import Config, describe, run, sample
from tabloom.plans.model import ColumnModel, TableModel
from tabloom.sources.store import read_model, write_model
from tabloom.sources.tables import empty_columns, preview, read_csv, scratch, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without their texts, with labels where there are any: the fixture for missing values."""
    return read(spark, sf, "documents").drop("text").join(read(spark, sf, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Profiles

_TYPES = {
    "lineitem": {"l_orderkey": INTEGER, "l_partkey": INTEGER, "l_suppkey": INTEGER, "l_linenumber": INTEGER, "l_quantity": INTEGER, "l_extendedprice": FLOAT, "l_discount": FLOAT, "l_tax": FLOAT, "l_returnflag": STRING, "l_linestatus": STRING, "l_shipdate": DATETIME},
    "part": {"p_partkey": INTEGER, "p_name": STRING, "p_brand": STRING, "p_type": STRING, "p_size": INTEGER, "p_retailprice": FLOAT},
    "customer": {"c_custkey": INTEGER, "c_name": STRING, "c_nationkey": INTEGER, "c_acctbal": FLOAT, "c_mktsegment": STRING},
    "orders": {"o_orderkey": INTEGER, "o_custkey": INTEGER, "o_orderstatus": STRING, "o_totalprice": FLOAT, "o_orderdate": DATETIME, "o_orderpriority": STRING},
    LABELLED: {"doc_id": INTEGER, "lang": STRING, "source": STRING, "n_chars": INTEGER, "quality": INTEGER, "toxic": INTEGER},
}


def _number_sql(c: str, kind: str) -> str:
    return f"length({c})" if kind == STRING else f"epoch({c})" if kind == DATETIME else c


def _type_sql(c: str, kind: str) -> str:
    """Integer or Float by the values, for numbers stored as doubles; other types come with the schema."""
    return f"CASE WHEN bool_and({c} = floor({c})) THEN 'Integer' ELSE 'Float' END" if kind in (INTEGER, FLOAT) else f"'{kind}'"


def _columns_sql(table: str) -> str:
    parts = []
    for k, (c, kind) in enumerate(_TYPES[table].items()):
        key = "FALSE" if kind in (FLOAT, DATETIME) else f"(count({c}) > 0 AND count(*) - count({c}) <= 1 AND count(DISTINCT {c}) = count({c}))"
        x = _number_sql(c, kind)
        parts.append(f"SELECT {k} AS ord, '{c}' AS attr, {_type_sql(c, kind)} AS data_type, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 20 AS is_categorical, {key} AS is_candidate_key, count(*) AS n, count({c}) AS n_values, (count(*) - count({c}))::DOUBLE / count(*) AS missing_rate, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max FROM {table} t")
    return " UNION ALL ".join(parts)


def _profile_queries(table: str, short: str, load: Query) -> None:
    columns = _columns_sql(table)

    @query(f"SELECT attr, data_type, is_categorical, is_candidate_key, n_values, missing_rate, min, max FROM ({columns})", f"profile_columns_{short}")
    def _columns(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf)
        return profile_frame(df, profile(df))

    network = "NOT is_candidate_key AND (is_categorical OR data_type <> 'String')"

    @query(
        f"""SELECT max(n) AS num_tuples, count(*) AS num_attributes, count(*) FILTER ({network}) AS num_attributes_in_bn,
        coalesce(string_agg(attr, ',' ORDER BY ord) FILTER (is_candidate_key), '') AS candidate_keys,
        coalesce(string_agg(attr, ',' ORDER BY ord) FILTER (data_type = 'String' AND NOT is_categorical), '') AS non_categorical_strings,
        coalesce(string_agg(attr, ',' ORDER BY ord) FILTER ({network}), '') AS bn_attributes FROM ({columns})""",
        f"profile_meta_{short}",
    )
    def _meta(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf)
        return meta_frame(df, profile(df))

    chart = "n_distinct <= 20 OR data_type IN ('String', 'DateTime')"

    @query(f"SELECT attr, {chart} AS charted_as_bars, n_distinct = 2 AS is_binary FROM ({columns})", f"chart_flags_{short}")
    def _flags(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf)
        model = profile(df)
        bars, two = categorical_columns(model), binary_columns(model)
        return spark.createDataFrame([(c, c in bars, c in two) for c in df.columns], "attr string, charted_as_bars boolean, is_binary boolean")


for _table in ("lineitem", "part", "customer", "orders"):
    _profile_queries(_table, _table, lambda spark, sf, t=_table: read(spark, sf, t))
_profile_queries(LABELLED, "labelled", labelled)


def _with_ssn(spark: SparkSession, sf: str) -> DataFrame:
    z = F.lpad((F.col("c_custkey") % 1600 * 600011 + 1).cast("string"), 9, "0")
    return read(spark, sf, "customer").select("c_custkey", "c_name", F.concat_ws("-", F.substring(z, 1, 3), F.substring(z, 4, 2), F.substring(z, 6, 4)).alias("ssn"), F.date_format(F.timestamp_seconds(F.col("c_custkey") * 86400), "yyyy-MM-dd").alias("day"), (F.col("c_custkey") % 2 == 0).alias("even"))


@query(r"""
WITH t AS (SELECT c_name, lpad((c_custkey % 1600 * 600011 + 1)::VARCHAR, 9, '0') AS z, strftime(to_timestamp(c_custkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM customer)
SELECT 'c_custkey' AS attr, 'Integer' AS data_type UNION ALL SELECT 'even', 'String'
UNION ALL SELECT 'c_name', CASE WHEN bool_and(try_cast(c_name AS TIMESTAMP) IS NOT NULL) THEN 'DateTime' WHEN bool_and(coalesce(try_cast(replace(c_name, '-', '') AS BIGINT) BETWEEN 1 AND 999999999, FALSE)) THEN 'SocialSecurityNumber' ELSE 'String' END FROM t
UNION ALL SELECT 'ssn', CASE WHEN bool_and(coalesce(try_cast(z AS BIGINT) BETWEEN 1 AND 999999999, FALSE)) THEN 'SocialSecurityNumber' ELSE 'String' END FROM t
UNION ALL SELECT 'day', CASE WHEN bool_and(try_cast(day AS TIMESTAMP) IS NOT NULL) THEN 'DateTime' ELSE 'String' END FROM t
""")
def infer_types_of_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(infer_types(_with_ssn(spark, sf)).items()), "attr string, data_type string")


# Text of dates: a name, Spark's pattern and DuckDB's.
_FORMS = {"iso": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), "us": ("M/d/yyyy h:mm a", "%-m/%-d/%Y %-I:%M %p"), "dots": ("MM.dd.yyyy", "%m.%d.%Y"), "spoken": ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y"), "short": ("d-MMM-yy HH:mm", "%-d-%b-%y %H:%M"), "reversed": ("yyyy MMM dd", "%Y %b %d")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS attr, 'DateTime' AS data_type, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, sum(x::HUGEINT)::BIGINT AS total FROM (SELECT epoch(strptime(strftime(to_timestamp(epoch(o_orderdate) + o_orderkey % 86400) AT TIME ZONE 'UTC', '{f}'), '{f}'))::BIGINT AS x FROM orders)" for c, (_, f) in _FORMS.items()))
def dates_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in six ways: their types, ranges and sums of seconds."""
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    df = read(spark, sf, "orders").select(*[F.date_format(t, f).alias(c) for c, (f, _) in _FORMS.items()])
    model = profile(df).columns
    sums = df.agg(*[F.sum(as_number(F.col(c), df.schema[c].dataType, DATETIME)).alias(c) for c in _FORMS]).first()
    rows = [(c, m.data_type, float(m.min), float(m.max), sums[c]) for c, m in model.items()]
    return spark.createDataFrame(rows, "attr string, data_type string, min double, max double, total long")


@query("SELECT attr FROM (VALUES ('c_custkey'), ('c_nationkey'), ('c_acctbal')) t(attr)")
def numeric_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in numeric_columns(read(spark, sf, "customer"))], "attr string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attr, (count(*) - count({c}))::DOUBLE / count(*) AS missing_rate FROM {LABELLED} t" for c in _TYPES[LABELLED]))
def missing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return missing_rates(labelled(spark, sf))


@query("SELECT 'none' AS attr WHERE (SELECT count(*) FROM nation) > 0")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "nation").withColumn("none", F.lit(None).cast("string"))
    return spark.createDataFrame([(c,) for c in empty_columns(df)], "attr string")


# Domains and distributions


@query("SELECT 'p_size' AS attr, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max FROM part UNION ALL SELECT 'p_name', min(length(p_name)), max(length(p_name)) FROM part UNION ALL SELECT 'p_retailprice', 100, 5000")
def domains(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "part")
    return profile_frame(df, profile(df.select("p_size", "p_name", "p_retailprice"), ranges={"p_retailprice": (100, 5000)})).select("attr", "min", "max")


@query("SELECT 'o_orderdate' AS attr, min(epoch(o_orderdate))::DOUBLE AS min, max(epoch(o_orderdate))::DOUBLE AS max FROM orders")
def domain_datetime(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders").select("o_orderdate")
    return profile_frame(df, profile(df)).select("attr", "min", "max")


@query("SELECT min(z)::DOUBLE AS min, max(z)::DOUBLE AS max FROM (SELECT c_custkey % 1600 * 600011 + 1 AS z FROM customer)")
def domain_ssn(spark: SparkSession, sf: str) -> DataFrame:
    df = _with_ssn(spark, sf).select("ssn")
    return profile_frame(df, profile(df)).select("min", "max")


def _categories_sql(x: str, table: str, more: str = "") -> str:
    return f"""WITH c AS (SELECT {x} AS value, count(*) AS n FROM {table} t WHERE {x} IS NOT NULL GROUP BY 1 {more})
    SELECT row_number() OVER (ORDER BY value) - 1 AS bin_idx, value, n, round(n::DOUBLE / sum(n) OVER (), 9) AS p FROM c"""


@query(_categories_sql("l_returnflag", "lineitem"))
def dist_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(distribution.categorical_distribution(read(spark, sf, "lineitem"), "l_returnflag"), "p")


@query(_categories_sql("o_orderpriority", "orders", "UNION ALL SELECT '9-UNUSED', 0"))
def dist_declared_domain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(distribution.categorical_distribution(read(spark, sf, "orders"), "o_orderpriority", domain=["1-URGENT", "9-UNUSED"]), "p")


@query(_categories_sql("quality::BIGINT", LABELLED))
def dist_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(distribution.categorical_distribution(labelled(spark, sf), "quality", INTEGER), "p")


@query(_categories_sql("l_discount", "lineitem"))
def dist_float_categories(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(distribution.categorical_distribution(read(spark, sf, "lineitem"), "l_discount", FLOAT), "p")


def _histogram_sql(x: str, table: str, bins: int = 20, lo: str | None = None, hi: str | None = None) -> str:
    return f"""WITH v AS (SELECT {x}::DOUBLE AS x FROM {table} t WHERE {x} IS NOT NULL),
    b AS (SELECT min({lo or "x"})::DOUBLE AS lo, max({hi or "x"})::DOUBLE AS hi FROM v),
    e AS (SELECT list_transform(range(0, {bins}), lambda i: i * ((hi - lo) / {bins}) + lo) AS e, lo, hi FROM b),
    c AS (SELECT len(list_filter(e, lambda a: a <= x)) - 1 AS k, count(*) AS n FROM v, e WHERE x BETWEEN lo AND hi GROUP BY 1)
    SELECT i AS bin_idx, round(e[i + 1], 6) AS bin_lo, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (), 9) AS p FROM e, range({bins}) r(i) LEFT JOIN c ON k = i"""


def _histogram(df: DataFrame, x: F.Column, lo: float | None = None, hi: float | None = None, bins: int = 20) -> DataFrame:
    if lo is None:
        lo, hi = df.agg(F.min(x), F.max(x)).first()
    return rounded(rounded(distribution.histogram(df, x, lo, hi, bins), "p"), "bin_lo", digits=6)


@query(_histogram_sql("l_quantity", "lineitem"))
def hist_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(read(spark, sf, "lineitem"), F.col("l_quantity"))


@query(_histogram_sql("l_quantity", "lineitem", lo="10", hi="40"))
def hist_range(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(read(spark, sf, "lineitem"), F.col("l_quantity"), 10, 40)


@query(_histogram_sql("length(p_name)", "part"))
def hist_text_length(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(read(spark, sf, "part"), F.char_length("p_name"))


@query(_histogram_sql("epoch(o_orderdate)", "orders"))
def hist_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(read(spark, sf, "orders"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))


@query("""
WITH s AS (SELECT 'l_extendedprice' AS attr, FALSE AS whole, count(*) AS n, max(l_extendedprice) - min(l_extendedprice) AS span, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr, stddev_pop(l_extendedprice) AS sd FROM lineitem
 UNION ALL SELECT 'l_quantity', TRUE, count(*), max(l_quantity) - min(l_quantity), quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), stddev_pop(l_quantity) FROM lineitem),
w AS (SELECT attr, whole, span, unnest([{'rule': 'auto', 'w': least(2 * iqr / n ** (1 / 3.0::DOUBLE), span / (log2(n) + 1))}, {'rule': 'fd', 'w': 2 * iqr / n ** (1 / 3.0::DOUBLE)}, {'rule': 'sturges', 'w': span / (log2(n) + 1)}, {'rule': 'sqrt', 'w': span / sqrt(n)}, {'rule': 'rice', 'w': span / (2 * n ** (1 / 3.0::DOUBLE))}, {'rule': 'scott', 'w': (24 * sqrt(pi()) / n) ** (1 / 3.0::DOUBLE) * sd}]) AS r FROM s)
SELECT attr, r.rule AS rule, ceil(span / CASE WHEN whole THEN greatest(r.w, 1) ELSE r.w END)::BIGINT AS bins FROM w
""")
def auto_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    df, out = read(spark, sf, "lineitem"), []
    for attr, stats in distribution.statistics_of(df, {c: F.col(c) for c in ("l_extendedprice", "l_quantity")}).items():
        out += [(attr, rule, distribution.bin_count(rule, **stats)) for rule in ("auto", "fd", "sturges", "sqrt", "rice", "scott")]
    return spark.createDataFrame(out, "attr string, rule string, bins long")


@query("""
WITH v AS (SELECT 'l_extendedprice' AS attr, FALSE AS whole, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_quantity', TRUE, l_quantity FROM lineitem),
s AS (SELECT attr, whole, count(*)::DOUBLE AS n, min(x) AS lo, max(x) - min(x) AS span, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY ALL),
g AS (SELECT attr, abs(avg(((x - m) / sd) ** 3)) AS g FROM v JOIN s USING (attr) GROUP BY attr),
d AS (SELECT attr, whole, span, span / (1 + log2(n) + log2(1 + g / sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) AS w FROM s JOIN g USING (attr)),
c AS (SELECT attr, x, count(*) AS c FROM v GROUP BY ALL),
k AS (SELECT unnest(range(1, (SELECT greatest(100, floor(sqrt(max(n)))::BIGINT) + 1 FROM s))) AS k),
t AS (SELECT attr, k, least(floor((x - lo) / span * k), k - 1) AS b, sum(q.c)::DOUBLE AS w FROM c AS q JOIN s USING (attr), k GROUP BY attr, k, b),
r AS (SELECT attr, k, (2 - (max(n) + 1) * sum((w / n) * (w / n))) / (max(span) / k) AS r FROM t JOIN s USING (attr) GROUP BY attr, k)
SELECT attr, 'doane' AS rule, ceil(span / CASE WHEN whole THEN greatest(w, 1) ELSE w END)::BIGINT AS bins FROM d UNION ALL SELECT attr, 'stone', arg_min(k, r) FROM r GROUP BY attr
""")
def auto_bin_counts_searched(spark: SparkSession, sf: str) -> DataFrame:
    """The two rules that auto_bin_counts leaves out: Doane's and Stone's."""
    df, out = read(spark, sf, "lineitem"), []
    for attr, stats in distribution.statistics_of(df, {c: F.col(c) for c in ("l_extendedprice", "l_quantity")}).items():
        out += [(attr, "doane", distribution.bin_count("doane", **stats)), (attr, "stone", distribution.stone_bins(df, F.col(attr), stats))]
    return spark.createDataFrame(out, "attr string, rule string, bins long")


_NOISE = laplace_sql(uniform_sql(7, "dist:o_orderpriority", "bin_idx"), "2.0 / (SELECT count(*) FROM orders) * 3 / 0.01")


@query(f"""WITH d AS ({_categories_sql("o_orderpriority", "orders")}), x AS (SELECT bin_idx, value, greatest(n::DOUBLE / (SELECT sum(n) FROM d) + {_NOISE}, 0) AS p FROM d)
SELECT bin_idx, value, round(p / sum(p) OVER (), 9) AS p FROM x""")
def dist_noisy(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders")
    dist = distribution.categorical_distribution(df, "o_orderpriority").drop("n")
    return rounded(distribution.noisy(dist, 0.01, df.count(), 3, 7, "dist:o_orderpriority"), "p")


def _noisy_sql(name: str, inner: str, attr: str, parts: int, epsilon: float, seed: int, n: str) -> str:
    """CTEs that end in ``name``: (bin_idx, p, ...) with noise, the budget shared by ``parts`` columns."""
    noise = laplace_sql(uniform_sql(seed, "dist", f"'{attr}'", "bin_idx"), f"2.0::double / ({n}) * {parts} / {epsilon}")
    return f"""{name}_exact AS ({inner}), {name}_raw AS (SELECT *, greatest(n::DOUBLE / (SELECT sum(n) FROM {name}_exact) + {noise}, 0) AS q FROM {name}_exact),
    {name} AS (SELECT * EXCLUDE (p, q), CASE WHEN sum(q) OVER () > 0 THEN q / sum(q) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END AS p FROM {name}_raw)"""


_ORDER_PARTS = {"o_orderstatus": _categories_sql("o_orderstatus", "orders"), "o_totalprice": _histogram_sql("o_totalprice", "orders"), "o_orderpriority": _categories_sql("o_orderpriority", "orders")}


@query(
    "WITH "
    + ", ".join(_noisy_sql(f"d{k}", sql, c, 3, 0.05, 4, "SELECT count(*) FROM orders") for k, (c, sql) in enumerate(_ORDER_PARTS.items()))
    + " "
    + " UNION ALL ".join(f"SELECT '{c}' AS attr, bin_idx, round(p, 9) AS p FROM d{k}" for k, c in enumerate(_ORDER_PARTS))
)
def dist_noise_all(spark: SparkSession, sf: str) -> DataFrame:
    """Noise on the distributions of all columns."""
    df = read(spark, sf, "orders").select(*_ORDER_PARTS)
    model = distribution.add_noise(_fitted(df), df, 0.05, 4)
    rows = [(c.name, k, float(p)) for c in model.columns.values() for k, p in enumerate(c.distribution_probabilities)]
    return rounded(spark.createDataFrame(rows, "attr string, bin_idx long, p double"), "p")


@query("""WITH d AS (SELECT r_regionkey, greatest(r_regionkey::DOUBLE - 2, 0) AS p FROM region) SELECT r_regionkey::BIGINT AS k, round(CASE WHEN sum(p) OVER () > 0 THEN p / sum(p) OVER () ELSE 1.0 / count(*) OVER () END, 9) AS p FROM d""")
def normalize_clip(spark: SparkSession, sf: str) -> DataFrame:
    p = distribution.normalized(F.col("r_regionkey").cast("double") - 2, distribution.Window.partitionBy())
    return read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.round(p, 9).alias("p"))


# Encoding


def _fitted(df: DataFrame, bins: int = 20, **options: dict) -> TableModel:
    return distribution.fit(df, profile(df, **options), bins)


@query(f"""WITH t AS (SELECT * FROM {LABELLED}), b AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM t),
e AS (SELECT list_transform(range(0, 20), lambda i: i * ((hi - lo) / 20) + lo) AS e FROM b),
l AS (SELECT list_sort(list(DISTINCT lang)) AS ls FROM t), q AS (SELECT list_sort(list(DISTINCT quality)) AS qs FROM t WHERE quality IS NOT NULL)
SELECT doc_id, list_position(ls, lang) - 1 AS lang, len(list_filter(e, lambda a: a <= n_chars)) - 1 AS n_chars, coalesce(list_position(qs, quality) - 1, len(qs)) AS quality FROM t, e, l, q""")
def encode_dataset(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf)
    model = _fitted(df)
    return df.select("doc_id", *[code_of(df, model.columns[c]).alias(c) for c in ("lang", "n_chars", "quality")])


@query("SELECT l_orderkey, l_linenumber, greatest(len(list_filter(list_transform(range(0, 20), lambda i: i * ((40.0::DOUBLE - 10.0) / 20) + 10.0), lambda a: a <= l_quantity)) - 1, 0) AS code FROM lineitem")
def encode_clamped(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem")
    c = ColumnModel("l_quantity", INTEGER, False, False, min=10, max=40, distribution_bins=distribution.edges(10, 40, 20))
    return df.select("l_orderkey", "l_linenumber", code_of(df, c).alias("code"))


@query("""WITH b AS (SELECT min(epoch(o_orderdate))::DOUBLE AS lo, max(epoch(o_orderdate))::DOUBLE AS hi FROM orders), e AS (SELECT list_transform(range(0, 20), lambda i: i * ((hi - lo) / 20) + lo) AS e FROM b)
SELECT o_orderkey, len(list_filter(e, lambda a: a <= epoch(o_orderdate))) - 1 AS code FROM orders, e""")
def encode_datetime(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders")
    return df.select("o_orderkey", code_of(df, _fitted(df.select("o_orderdate")).columns["o_orderdate"]).alias("code"))


_MANY = {"key": "o_orderkey", "large": "o_orderkey * 1e7::DOUBLE + 0.5::DOUBLE", "small": "o_orderkey / 1e5::DOUBLE", "day": "o_orderdate", "name": "'order ' || o_orderkey"}


def _many(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of thousands of values: numbers near and far from zero, times and text."""
    key = F.col("o_orderkey")
    return read(spark, sf, "orders").select(key.alias("key"), (key * F.lit(1e7) + 0.5).alias("large"), (key / F.lit(1e5)).alias("small"), F.col("o_orderdate").alias("day"), F.concat(F.lit("order "), key).alias("name"))


def _many_fitted(df: DataFrame) -> TableModel:
    return _fitted(df, categorical=dict.fromkeys(_MANY, True), keys=dict.fromkeys(_MANY, False), types={"large": FLOAT, "small": FLOAT, "name": STRING, "key": INTEGER})


@query("SELECT " + ", ".join(f"(dense_rank() OVER (ORDER BY {x}) - 1)::INT AS {c}" for c, x in _MANY.items()) + " FROM orders")
def encode_many_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of columns whose categories are dictionaries; each value is found by its own type."""
    df = _many(spark, sf)
    return encode(df, _many_fitted(df), list(_MANY))


def _many_drawn_sql(c: str, x: str, shown: str) -> str:
    """A CTE (id, c) of values drawn by exact running counts, as many as the table has rows."""
    return f"""{c}_c AS (SELECT value, sum(n) OVER (ORDER BY value) - n AS low FROM (SELECT {x} AS value, count(*) AS n FROM orders GROUP BY 1)),
    {c}_r AS (SELECT id, least(floor({uniform_sql(8, f"gen:{c}", "id")} * n), n - 1)::BIGINT AS at FROM rows, s),
    {c}_d AS (SELECT r.id, {shown} AS {c} FROM {c}_r r ASOF JOIN {c}_c d ON r.at >= d.low)"""


@query("WITH s AS (SELECT count(*) AS n FROM orders), rows AS (SELECT range AS id FROM range((SELECT n FROM s))), "
    + ", ".join(_many_drawn_sql(c, x, "epoch(d.value)::BIGINT" if c == "day" else "round(d.value, 6)" if c in ("large", "small") else "d.value") for c, x in _MANY.items())
    + " SELECT " + ", ".join(_MANY) + " FROM rows " + " ".join(f"JOIN {c}_d USING (id)" for c in _MANY))
def gen_many_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Values drawn from dictionaries."""
    df = _many(spark, sf)
    model = _many_fitted(df)
    return rounded(generate.independent_mode(spark.range(model.num_tuples), model.num_tuples, model, seed=8), "large", "small", digits=6)


# Information


def _mi_sql(x: str, ys: list[str], table: str) -> str:
    y = ", ".join(ys)
    return f"""SELECT round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 9) AS mi FROM (SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY {x})::DOUBLE AS nx, sum(n) OVER (PARTITION BY {y})::DOUBLE AS ny FROM (SELECT {x}, {y}, count(*) AS n FROM {table} t GROUP BY ALL))"""


@query("SELECT round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM documents GROUP BY source)")
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.entropy(read(spark, sf, "documents"), "source"), "entropy")


@query(_mi_sql("quality", ["toxic"], LABELLED))
def mi_pair(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.mutual_information(labelled(spark, sf), "quality", ["toxic"]), "mi")


@query(_mi_sql("role", ["turn", "conv_id"], "conversations"))
def mi_several_parents(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.mutual_information(read(spark, sf, "conversations"), "role", ["turn", "conv_id"]), "mi")


@query(_mi_sql("l_returnflag", ["l_linestatus"], "lineitem"))
def mi_independent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.mutual_information(read(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"]), "mi")


def _nmi_sql(names: list[str], table: str, digits: int = 9) -> str:
    names = sorted(names)
    cells = ", ".join(f"coalesce({c}::VARCHAR, 'nan') AS {c}" for c in names)
    parts = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, {x} AS x, {y} AS y, count(*) AS n FROM v GROUP BY ALL" for i, x in enumerate(names) for j, y in enumerate(names))
    known = "[" + ", ".join(f"'{c}'" for c in names) + "]"
    return f"""WITH v AS (SELECT {cells} FROM {table} t), j AS ({parts}),
    w AS (SELECT a, b, n::DOUBLE AS n, sum(n) OVER (PARTITION BY a, b)::DOUBLE AS t, sum(n) OVER (PARTITION BY a, b, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY a, b, y)::DOUBLE AS ny FROM j),
    m AS (SELECT a, b, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM w GROUP BY a, b)
    SELECT {known}[m.a + 1] AS x, {known}[m.b + 1] AS y, m.a::BIGINT AS x_idx, m.b::BIGINT AS y_idx, round(CASE WHEN m.a = m.b OR (p.mi < 1e-15 AND q.mi < 1e-15) THEN 1 ELSE greatest(coalesce(2 * m.mi / nullif(p.mi + q.mi, 0), 0), 0) END, {digits}) AS nmi
    FROM m JOIN m p ON p.a = m.a AND p.b = m.a JOIN m q ON q.a = m.b AND q.b = m.b"""


@query(_nmi_sql(["lang", "source", "quality", "toxic"], LABELLED))
def nmi_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.nmi_matrix(labelled(spark, sf), ["lang", "source", "quality", "toxic"]), "nmi")


_LINE = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(_nmi_sql(_LINE, "lineitem", 7))
def nmi_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(info.nmi_matrix(read(spark, sf, "lineitem"), _LINE), "nmi", digits=7)


def _kl_sql(x: str, a: str, b: str) -> str:
    return f"""WITH a AS (SELECT {x} AS v, count(*) AS n FROM {a} GROUP BY 1), b AS (SELECT {x} AS v, count(*) AS n FROM {b} GROUP BY 1),
    j AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b USING (v))
    SELECT round(sum(CASE WHEN q > 0 THEN CASE WHEN p > 0 THEN q * ln(q / p) ELSE 'Infinity'::DOUBLE END ELSE 0 END), 9) AS kl FROM j"""


@query(_kl_sql("source", "(SELECT * FROM documents WHERE doc_id % 2 = 0)", "(SELECT * FROM documents WHERE doc_id % 2 = 1)"))
def kl(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(info.kl_divergence(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "source"), "kl")


@query("""WITH v AS (SELECT n_chars AS x, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY 1)
SELECT round(max(abs(fa - fb)), 9) AS ks FROM (SELECT sum(a) OVER (ORDER BY x)::DOUBLE / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x)::DOUBLE / sum(b) OVER () AS fb FROM v)""")
def ks(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(info.ks_statistic(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "n_chars"), "ks")


@query(f"""WITH a AS ({_nmi_sql(["lang", "source"], "(SELECT * FROM documents WHERE doc_id % 2 = 0)", 15)}), b AS ({_nmi_sql(["lang", "source"], "(SELECT * FROM documents WHERE doc_id % 2 = 1)", 15)})
SELECT round(sum(abs(a.nmi - b.nmi)), 9) AS nmi_difference FROM a JOIN b USING (x, y)""")
def nmi_difference(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(info.nmi_difference(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), ["lang", "source"]), "nmi_difference")


# Networks and conditional tables


@query("SELECT n, round(CASE WHEN two THEN ln(n) / n + (n - 1.0::DOUBLE) / n * ln(n / (n - 1.0::DOUBLE)) ELSE 2.0::DOUBLE / n * ln((n + 1) / 2.0::DOUBLE) + (n - 1.0::DOUBLE) / n * ln((n + 1.0::DOUBLE) / (n - 1)) END, 12) AS sensitivity, two AS is_binary FROM (SELECT count(*) AS n FROM conversations), (VALUES (TRUE), (FALSE)) t(two)")
def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "conversations").count()
    return rounded(spark.createDataFrame([(n, bayesnet.sensitivity(n, two, [False, False]), two) for two in (True, False)], "n long, sensitivity double, is_binary boolean"), "sensitivity", digits=12)


_SIZED = ("customer", "supplier", "part", "orders", "lineitem", "conversations", "events")


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, (SELECT count(*) FROM (DESCRIBE {t})) AS d, (SELECT count(*) FROM {t}) AS n" for t in _SIZED) + """),
u AS (SELECT tab, d, n, k, n * 0.1::DOUBLE / ((d - k) * 2.0::DOUBLE ** (k + 3)) AS useful FROM s, range(-49, 64) t(k) WHERE k <= d - 2 OR (k = 3 AND d > 3)),
f AS (SELECT tab, d, n, coalesce(max(useful) FILTER (k = 3), 0) AS three, min(k) FILTER (useful < 4) AS k FROM u GROUP BY ALL)
SELECT tab, d::INT AS attributes, n, (CASE WHEN three > 4 OR k IS NULL OR k < 1 THEN 3 ELSE k END)::INT AS k FROM f""")
def degree_k(spark: SparkSession, sf: str) -> DataFrame:
    """The number of parents that each table can afford."""
    tables = {t: read(spark, sf, t) for t in _SIZED}
    sizes = [(t, len(df.columns), df.count()) for t, df in tables.items()]
    return spark.createDataFrame([(t, d, n, bayesnet.degree(d, n)) for t, d, n in sizes], "tab string, attributes int, n long, k int")


_NET = ["lang", "source", "quality", "toxic"]


def _greedy_sql() -> str:
    """The greedy network with one parent, unrolled: three rounds over a table of pair scores."""
    parts = " UNION ALL ".join(f"SELECT '{x}' AS c, '{y}' AS p, {i} AS o, round((SELECT mi FROM ({_mi_sql(x, [y], 'coded')})), 9) AS mi" for i, x in enumerate(_NET) for y in _NET if x != y)
    coded = ", ".join(f"coalesce({c}::VARCHAR, 'nan') AS {c}" for c in _NET)
    sql = f"WITH coded AS (SELECT {coded} FROM {LABELLED} t), m AS ({parts}), v0 AS (SELECT 0 AS pos, 'lang' AS child, '' AS parent)"
    for k in (1, 2, 3):
        sql += f", v{k} AS (SELECT * FROM v{k - 1} UNION ALL (SELECT {k}, m.c, m.p FROM m JOIN v{k - 1} v ON v.child = m.p WHERE m.c NOT IN (SELECT child FROM v{k - 1}) ORDER BY m.mi DESC, m.o, v.pos LIMIT 1))"
    return sql + " SELECT pos::BIGINT AS pos, child, parent FROM v3 WHERE pos > 0"


@query(_greedy_sql())
def bn_greedy(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select(*_NET)
    network = bayesnet.learn(encode(df, _fitted(df), _NET), k=1, root="lang")
    return spark.createDataFrame([(k + 1, c, ",".join(p)) for k, (c, p) in enumerate(network)], "pos long, child string, parent string")


def _greedy_two_sql() -> str:
    """The same with two parents: scores of all sets of one and two parents, then the rounds."""
    sets = [(x,) for x in _NET] + [(x, y) for x in _NET for y in _NET if x < y]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS o, {list(ps)} AS ps, round((SELECT mi FROM ({_mi_sql(c, list(ps), 'coded')})), 9) AS mi" for i, c in enumerate(_NET) for ps in sets if c not in ps)
    coded = ", ".join(f"coalesce({c}::VARCHAR, 'nan') AS {c}" for c in _NET)
    sql = f"WITH coded AS (SELECT {coded} FROM {LABELLED} t), m AS ({parts}), v0 AS (SELECT 0 AS pos, 'lang' AS child, '' AS parent)"
    for k in (1, 2, 3):
        known = f"(SELECT list(child) FROM v{k - 1})"
        place = f"list_transform(ps, lambda p: (SELECT any_value(pos) FROM v{k - 1} WHERE child = p))"
        names = f"(SELECT string_agg(child, ',' ORDER BY pos DESC) FROM v{k - 1} WHERE list_contains(ps, child))"
        sql += f", v{k} AS (SELECT * FROM v{k - 1} UNION ALL (SELECT {k}, c, {names} FROM m WHERE NOT list_contains({known}, c) AND list_has_all({known}, ps) AND len(ps) = {min(k, 2)} ORDER BY mi DESC, o LIMIT 1))"
    return sql + " SELECT pos::BIGINT AS pos, child, parent FROM v3 WHERE pos > 0"


@query(_greedy_two_sql())
def bn_greedy_two_parents(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select(*_NET)
    network = bayesnet.learn(encode(df, _fitted(df), _NET), k=2, root="lang")
    return spark.createDataFrame([(k + 1, c, ",".join(p)) for k, (c, p) in enumerate(network)], "pos long, child string, parent string")


_FROM_LANG = " UNION ALL ".join(f"SELECT '{x}' AS child, (SELECT mi FROM ({_mi_sql(x, ['lang'], 'coded')})) AS mi" for x in _NET[1:])


@query(f"""WITH coded AS (SELECT {", ".join(f"coalesce({c}::VARCHAR, 'nan') AS {c}" for c in _NET)} FROM {LABELLED} t), m AS ({_FROM_LANG}),
s AS (SELECT count(*)::DOUBLE AS n FROM coded), d AS (SELECT 3 * (2 / n * ln((n + 1) / 2) + (n - 1) / n * ln((n + 1) / (n - 1))) / 1.0 AS delta FROM s),
w AS (SELECT child, exp((mi - max(mi) OVER ()) / (2 * delta)) AS w FROM m, d) SELECT child, round(w / sum(w) OVER (), 6) AS p FROM w""")
def exp_mechanism(spark: SparkSession, sf: str) -> DataFrame:
    """The chances of each child in the first round with root lang and a budget of 1; no column is binary, as missing is a code."""
    df = labelled(spark, sf).select(*_NET)
    tuples = bayesnet.collapsed(encode(df, _fitted(df), _NET))
    n = df.count()
    mi = bayesnet.scores(tuples, [(c, ["lang"]) for c in _NET[1:]])
    scales = [bayesnet.scale(len(_NET), bayesnet.sensitivity(n, False, [False]), 1.0)] * len(mi)
    return rounded(spark.createDataFrame(list(zip(_NET[1:], bayesnet.probabilities(mi, scales), strict=True)), "child string, p double"), "p", digits=6)


@query()
def bn_private(spark: SparkSession, sf: str) -> DataFrame:
    """Structure by the exponential mechanism; three parents at most."""
    df = labelled(spark, sf)
    model = _fitted(df)
    network = bayesnet.learn(encode(df, model), k=3, epsilon=1.0, seed=11)
    return spark.createDataFrame([(k + 1, c, ",".join(p)) for k, (c, p) in enumerate(network)], "pos long, child string, parents string")


def _talk(spark: SparkSession, sf: str) -> tuple[TableModel, DataFrame, dict[str, int]]:
    df = read(spark, sf, "conversations").select("turn", "role")
    model = _fitted(df)
    return model, bayesnet.collapsed(encode(df, model, ["turn", "role"])), {c: len(model.columns[c].distribution_bins) for c in ("turn", "role")}


_TALK = """c AS (SELECT dense_rank() OVER (ORDER BY turn) - 1 AS turn, dense_rank() OVER (ORDER BY role) - 1 AS role FROM conversations),
full_space AS (SELECT t.turn, r.role FROM (SELECT DISTINCT turn FROM c) t, (SELECT DISTINCT role FROM c) r),
joint AS (SELECT turn, role, coalesce(n, 0)::DOUBLE AS n FROM full_space LEFT JOIN (SELECT turn, role, count(*) AS n FROM c GROUP BY ALL) USING (turn, role))"""


@query(f"WITH {_TALK} SELECT turn, role, n AS count FROM joint")
def contingency_full(spark: SparkSession, sf: str) -> DataFrame:
    _, tuples, cards = _talk(spark, sf)
    return cpt.joint_counts(tuples, cards)


@query(f"WITH {_TALK} SELECT turn, sum(n) AS count FROM joint GROUP BY turn")
def joint_marginal(spark: SparkSession, sf: str) -> DataFrame:
    _, tuples, cards = _talk(spark, sf)
    return cpt.marginal(cpt.joint_counts(tuples, cards), ["turn"])


def _cpt_frame(table: DataFrame) -> DataFrame:
    return rounded(table.select("child", F.concat_ws(",", F.col("parent_codes").cast("array<string>")).alias("parents"), "code", "p"), "p")


_CPT = """SELECT 'turn' AS child, '' AS parents, turn AS code, round(sum(n) / (SELECT sum(n) FROM joint), 9) AS p FROM joint GROUP BY turn
UNION ALL SELECT 'role', turn::VARCHAR, role, round(CASE WHEN sum(n) OVER (PARTITION BY turn) > 0 THEN n / sum(n) OVER (PARTITION BY turn) ELSE 1.0 / count(*) OVER (PARTITION BY turn) END, 9) FROM joint"""


@query(f"WITH {_TALK} {_CPT}")
def cpt_exact(spark: SparkSession, sf: str) -> DataFrame:
    _, tuples, cards = _talk(spark, sf)
    return _cpt_frame(cpt.tables(tuples, [("role", ["turn"])], cards))


_TALK_NOISY = _TALK.replace("joint AS", "counted AS") + f", joint AS (SELECT turn, role, greatest(n + {laplace_sql(uniform_sql(5, 'cpt:turn', 'turn', 'role'), '(2 - 1) / 0.5::double')}, 0) AS n FROM counted)"


@query(f"WITH {_TALK_NOISY} {_CPT}")
def cpt_noisy(spark: SparkSession, sf: str) -> DataFrame:
    _, tuples, cards = _talk(spark, sf)
    return _cpt_frame(cpt.tables(tuples, [("role", ["turn"])], cards, epsilon=0.5, seed=5))


# A network of two parents: the root and the first two children share a noisy joint table, the third has its own.
_TWO = [("quality", ["lang"]), ("toxic", ["quality", "lang"]), ("source", ["toxic", "quality"])]


def _space_sql(name: str, names: list[str], stream: str) -> str:
    """CTE ``name``: noisy counts over the full space of some code columns."""
    noise = laplace_sql(uniform_sql(6, stream, *names), "(4 - 2) / 0.5::double")
    cells = ", ".join(f"(SELECT unnest(range(0, (SELECT k_{c} FROM cards))) AS {c})" for c in names)
    return f"{name} AS (SELECT {', '.join(names)}, greatest(coalesce(n, 0)::DOUBLE + {noise}, 0) AS n FROM (SELECT * FROM {cells}) LEFT JOIN (SELECT {', '.join(names)}, count(*) AS n FROM coded GROUP BY ALL) USING ({', '.join(names)}))"


def _given_sql(joint: str, child: str, parents: list[str]) -> str:
    by = ", ".join(parents)
    over = f"OVER (PARTITION BY {by})" if parents else "OVER ()"
    shown = f"concat_ws(',', {by})" if parents else "''"
    return f"SELECT '{child}' AS child, {shown} AS parents, {child} AS code, round(CASE WHEN sum(n) {over} > 0 THEN n / sum(n) {over} ELSE 1.0::DOUBLE / count(*) {over} END, 9) AS p FROM (SELECT {', '.join([*parents, child])}, sum(n) AS n FROM {joint} GROUP BY ALL)"


@query(f"""WITH t AS (SELECT * FROM {LABELLED}), known AS (SELECT list_sort(list(DISTINCT lang)) AS ls, list_sort(list(DISTINCT source)) AS ss, list_sort(list(DISTINCT quality) FILTER (quality IS NOT NULL)) AS qs, list_sort(list(DISTINCT toxic) FILTER (toxic IS NOT NULL)) AS ts FROM t),
coded AS (SELECT list_position(ls, lang) - 1 AS lang, list_position(ss, source) - 1 AS source, coalesce(list_position(qs, quality) - 1, len(qs)) AS quality, coalesce(list_position(ts, toxic) - 1, len(ts)) AS toxic FROM t, known),
cards AS (SELECT len(ls) AS k_lang, len(ss) AS k_source, len(qs) + 1 AS k_quality, len(ts) + 1 AS k_toxic FROM known),
{_space_sql("shared", ["lang", "quality", "toxic"], "cpt:lang")}, {_space_sql("own", ["toxic", "quality", "source"], "cpt:source")}
{_given_sql("shared", "lang", [])} UNION ALL {_given_sql("shared", "quality", ["lang"])} UNION ALL {_given_sql("shared", "toxic", ["quality", "lang"])} UNION ALL {_given_sql("own", "source", ["toxic", "quality"])}""")
def cpt_two_parents(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select(*_NET)
    model = _fitted(df)
    cards = {c: len(model.columns[c].distribution_bins) + (model.columns[c].missing_rate > 0) for c in _NET}
    return _cpt_frame(cpt.tables(bayesnet.collapsed(encode(df, model, _NET)), _TWO, cards, epsilon=0.5, seed=6))


# Generation

_U = lambda stream, seed=3: uniform_sql(seed, stream, "id")


def _rows_sql(table: str) -> str:
    """As many row numbers as a table has rows."""
    return f"(SELECT unnest(range(0, (SELECT count(*) FROM {table}))) AS id)"


def _made(spark: SparkSession, model: TableModel, name: str, key: bool = False) -> DataFrame:
    """As many values of a column as its table has rows."""
    c, n, row = model.columns[name], model.num_tuples, F.col("id")
    v = generate.key_values(c, n, 3, row) if key else generate.decoded(c, generate.sampled_code(c, 3, row), 3, row)
    return spark.range(n).select("id", v.alias("value"))


@query(f"SELECT id, id AS value FROM {_rows_sql('part')}")
def gen_key_int(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, profile(read(spark, sf, "part")), "p_partkey", key=True)


@query(f"SELECT id, round(lo + id * ((hi - lo) / n), 9) AS value FROM {_rows_sql('customer')}, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer)")
def gen_key_float(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_made(spark, profile(read(spark, sf, "customer")), "c_acctbal", key=True), "value")


@query(f"""WITH s AS (SELECT count(*) AS n, min(length(c_name)) AS lo, max(length(c_name)) AS hi FROM customer),
p AS (SELECT n, array_to_string(list_transform(range(0, floor(lo + CASE WHEN hi > lo THEN {uniform_sql(3, "key:c_name", "0")} * (hi - lo + 1) ELSE 0 END)::BIGINT), lambda i: chr(97 + floor({uniform_sql(3, "prefix:c_name", "i")} * 26)::INT)), '') AS prefix FROM s)
SELECT range AS id, prefix || range AS value FROM p, range((SELECT n FROM s))""")
def gen_key_string(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, profile(read(spark, sf, "customer").select("c_name"), keys={"c_name": True}), "c_name", key=True)


@query(f"""WITH s AS (SELECT count(*) AS n FROM customer), k AS ({shuffled_sql("range", "SELECT count(*) FROM customer", "range((SELECT count(*) FROM customer))", 3, "key:ssn")})
SELECT id, substr(z, 1, 3) || '-' || substr(z, 4, 2) || '-' || substr(z, 6, 4) AS value FROM (SELECT id, lpad(floor(place * (999999999::DOUBLE / greatest(n - 1, 1)))::BIGINT::VARCHAR, 9, '0') AS z FROM k, s)""")
def gen_key_ssn(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers spread over the whole range, in an order that the seed picks."""
    return _made(spark, profile(_with_ssn(spark, sf).select("ssn"), keys={"ssn": True}), "ssn", key=True)


@query(f"SELECT id, floor(lo + id * ((hi - lo) / n))::BIGINT AS value FROM {_rows_sql('orders')}, (SELECT min(epoch(o_orderdate))::DOUBLE AS lo, max(epoch(o_orderdate))::DOUBLE AS hi, count(*) AS n FROM orders)")
def gen_key_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, profile(read(spark, sf, "orders").select("o_orderdate")), "o_orderdate", key=True)


@query(f"""SELECT id, ps[floor({_U("gen:o_orderpriority")} * len(ps))::BIGINT + 1] AS o_orderpriority, floor({_U("gen:o_custkey")} * 101)::BIGINT AS o_custkey, round({_U("gen:o_totalprice")} * 100, 6) AS o_totalprice,
{letters_sql(3, "text:note", "id", str(int(4 + uniform_here(3, "len:note", 0) * 6)))} AS note FROM {_rows_sql("orders")}, (SELECT list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders)""")
def gen_random(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    model = distribution.uniform_domain(profile(df, types={"o_custkey": INTEGER}, categorical={"o_custkey": False}, keys={"o_custkey": False}), df)
    model.columns["note"] = ColumnModel("note", STRING, False, False, min=4, max=9)
    names = list(model.columns)
    made = generate.random_mode(spark.range(model.num_tuples), model.num_tuples, TableModel(model.num_tuples, {"id": ColumnModel("id", INTEGER, False, True), **model.columns}), seed=3)
    return rounded(made.select("id", *names), "o_totalprice", digits=6)


def _draw_sql(inner: str, u: str, name: str, table: str) -> str:
    """The row of (bin_idx, p, ...) whose range of cumulative probability holds u."""
    return f"""{name} AS (SELECT *, sum(p) OVER (ORDER BY bin_idx) AS hi, sum(p) OVER (ORDER BY bin_idx) - p AS lo, bin_idx = max(bin_idx) OVER () AS is_last FROM ({inner})),
    {name}_drawn AS (SELECT r.id, d.* FROM {_rows_sql(table)} r JOIN {name} d ON {u} >= d.lo AND ({u} < d.hi OR d.is_last))"""


@query(f"WITH {_draw_sql(_categories_sql('o_orderpriority', 'orders'), _U('gen:o_orderpriority'), 'd', 'orders')} SELECT id, value FROM d_drawn")
def gen_indep_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, _fitted(read(spark, sf, "orders").select("o_orderpriority")), "o_orderpriority")


def _bin_sql(x: str, table: str, column: str, value: str) -> str:
    wide = f"SELECT *, coalesce(lead(bin_lo) OVER (ORDER BY bin_idx), (SELECT max({x}) FROM {table})) AS bin_hi FROM ({_histogram_sql(x, table).replace('round(e[i + 1], 6)', 'e[i + 1]')})"
    drawn = f"bin_lo + {_U('val:' + column)} * (bin_hi - bin_lo)"
    return f"WITH {_draw_sql(wide, _U('gen:' + column), 'd', table)} SELECT id, {value.replace('{v}', '(' + drawn + ')')} AS value FROM d_drawn"


@query(_bin_sql("l_extendedprice", "lineitem", "l_extendedprice", "round({v}, 6)"))
def gen_indep_float(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_made(spark, _fitted(read(spark, sf, "lineitem").select("l_extendedprice")), "l_extendedprice"), "value", digits=6)


@query(_bin_sql("l_quantity", "lineitem", "l_quantity", "round_even({v}, 0)::BIGINT"))
def gen_indep_int(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, _fitted(read(spark, sf, "lineitem").select("l_quantity")), "l_quantity")


@query(_bin_sql("epoch(o_orderdate)", "orders", "o_orderdate", "trunc({v})::BIGINT"))
def gen_indep_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, _fitted(read(spark, sf, "orders").select("o_orderdate")), "o_orderdate")


@query(_bin_sql("length(p_name)", "part", "p_name", letters_sql(3, "text:p_name", "id", "trunc({v})")))
def gen_indep_text(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, _fitted(read(spark, sf, "part").select("p_name")), "p_name")


_SSN = "(SELECT c_custkey % 1600 * 600011 + 1 AS ssn FROM customer)"
_SSN_TEXT = "(SELECT substr(z, 1, 3) || '-' || substr(z, 4, 2) || '-' || substr(z, 6, 4) FROM (SELECT lpad(floor({v})::BIGINT::VARCHAR, 9, '0') AS z))"


@query(_bin_sql("ssn", _SSN, "ssn", _SSN_TEXT))
def gen_indep_ssn(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, _fitted(_with_ssn(spark, sf).select("ssn"), keys={"ssn": False}), "ssn")


@query(f"""WITH t AS (SELECT turn, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM conversations GROUP BY turn),
r AS (SELECT turn, role, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY turn) AS p FROM conversations GROUP BY turn, role),
tc AS (SELECT turn, sum(p) OVER (ORDER BY turn) AS hi, sum(p) OVER (ORDER BY turn) - p AS lo, turn = max(turn) OVER () AS is_last FROM t),
rc AS (SELECT turn, role, sum(p) OVER (PARTITION BY turn ORDER BY role) AS hi, sum(p) OVER (PARTITION BY turn ORDER BY role) - p AS lo, role = max(role) OVER (PARTITION BY turn) AS is_last FROM r)
SELECT n.id, tc.turn, rc.role FROM {_rows_sql("conversations")} n JOIN tc ON {_U("gen:turn")} >= tc.lo AND ({_U("gen:turn")} < tc.hi OR tc.is_last) JOIN rc ON rc.turn = tc.turn AND {_U("gen:role")} >= rc.lo AND ({_U("gen:role")} < rc.hi OR rc.is_last)""")
def gen_correlated(spark: SparkSession, sf: str) -> DataFrame:
    model, tuples, cards = _talk(spark, sf)
    model.network = [("role", ["turn"])]
    model.conditional = cpt.collected(cpt.tables(tuples, model.network, cards))
    model.columns = {"id": ColumnModel("id", INTEGER, False, True), **model.columns}
    return generate.correlated_mode(generate.rows_of(spark, model.num_tuples), model.num_tuples, model, seed=3)


@query(f"""WITH l AS (SELECT * FROM {LABELLED}), q AS (SELECT quality, count(*)::DOUBLE / sum(count(*)) OVER () AS p, row_number() OVER (ORDER BY quality NULLS LAST) AS k FROM l GROUP BY quality),
x AS (SELECT quality, toxic, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY quality) AS p, row_number() OVER (PARTITION BY quality ORDER BY toxic NULLS LAST) AS k FROM l GROUP BY quality, toxic),
qc AS (SELECT quality, sum(p) OVER (ORDER BY k) AS hi, sum(p) OVER (ORDER BY k) - p AS lo, k = max(k) OVER () AS is_last FROM q),
xc AS (SELECT quality, toxic, sum(p) OVER (PARTITION BY quality ORDER BY k) AS hi, sum(p) OVER (PARTITION BY quality ORDER BY k) - p AS lo, k = max(k) OVER (PARTITION BY quality) AS is_last FROM x)
SELECT n.id, qc.quality::BIGINT AS quality, xc.toxic::BIGINT AS toxic FROM {_rows_sql(LABELLED)} n JOIN qc ON {_U("gen:quality")} >= qc.lo AND ({_U("gen:quality")} < qc.hi OR qc.is_last) JOIN xc ON xc.quality IS NOT DISTINCT FROM qc.quality AND {_U("gen:toxic")} >= xc.lo AND ({_U("gen:toxic")} < xc.hi OR xc.is_last)""")
def gen_correlated_missing(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select("quality", "toxic")
    model = _fitted(df)
    cards = {c: len(model.columns[c].distribution_bins) + 1 for c in ("quality", "toxic")}
    model.network = [("toxic", ["quality"])]
    model.conditional = cpt.collected(cpt.tables(bayesnet.collapsed(encode(df, model, ["quality", "toxic"])), model.network, cards))
    model.columns = {"id": ColumnModel("id", INTEGER, False, True), **model.columns}
    return generate.correlated_mode(generate.rows_of(spark, model.num_tuples), model.num_tuples, model, seed=3).select("id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def _stored(spark: SparkSession, sf: str) -> TableModel:
    """A network with a parent of thousands of codes, written to the shared folder and opened again."""
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    model = _fitted(df, categorical={"l_orderkey": True}, keys={"l_orderkey": False})
    model.network = [("l_returnflag", ["l_orderkey"])]
    cards = {c: model.codes_of(c) for c in ("l_orderkey", "l_returnflag")}
    tuples = bayesnet.collapsed(encode(df, model, list(cards)))
    model.tables = cpt.numbered(cpt.tables(tuples, model.network, cards), model.network, cards)
    folder = scratch(spark)
    write_model(spark, model, folder)
    return read_model(spark, folder)


_LINES = """c AS (SELECT l_orderkey, l_returnflag, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS u, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS e FROM lineitem),
cells AS (SELECT u, e, l_orderkey, l_returnflag FROM (SELECT DISTINCT u, l_orderkey FROM c), (SELECT DISTINCT e, l_returnflag FROM c)),
j AS (SELECT u, e, any_value(cells.l_orderkey) AS l_orderkey, any_value(cells.l_returnflag) AS l_returnflag, count(c.u)::DOUBLE AS n FROM cells LEFT JOIN c USING (u, e) GROUP BY u, e),
root AS (SELECT u, any_value(l_orderkey) AS l_orderkey, sum(n) / (SELECT sum(n) FROM j) AS p FROM j GROUP BY u),
child AS (SELECT u, e, l_returnflag, n / sum(n) OVER (PARTITION BY u) AS p FROM j)"""


@query(f"WITH {_LINES} SELECT 'l_orderkey' AS child, '' AS parents, u::INT AS code, round(p, 12) AS p FROM root UNION ALL SELECT 'l_returnflag', u::VARCHAR, e::INT, round(p, 12) FROM child")
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """The conditional tables of a stored model, joined from where they lie."""
    model = _stored(spark, sf)
    cards = {c: model.codes_of(c) for c in model.sampling_order}
    found = cpt.spelled(model.tables, model.network, cards)
    return rounded(found.select("child", F.concat_ws(",", F.col("parent_codes").cast("array<string>")).alias("parents"), "code", "p"), "p", digits=12)


def _at_sql(stream: str) -> str:
    return f"least(floor({uniform_sql(9, stream, 'id')} * {generate.POSITIONS}), {generate.POSITIONS - 1})::BIGINT"


@query(f"""WITH {_LINES}, rows AS (SELECT range AS id FROM range((SELECT count(*) FROM lineitem))),
r AS (SELECT l_orderkey, u, sum(w) OVER (ORDER BY u) - w AS low FROM (SELECT *, floor(p * {generate.POSITIONS})::BIGINT AS w FROM root) WHERE w > 0),
k AS (SELECT u, l_returnflag, low FROM (SELECT *, sum(w) OVER (PARTITION BY u ORDER BY e) - w AS low, e = max(e) OVER (PARTITION BY u) AS is_last FROM (SELECT *, floor(p * {generate.POSITIONS})::BIGINT AS w FROM child)) WHERE w > 0 OR (is_last AND low < {generate.POSITIONS})),
a AS (SELECT id, {_at_sql("gen:l_orderkey")} AS at, {_at_sql("gen:l_returnflag")} AS then_at FROM rows),
b AS (SELECT id, then_at, l_orderkey, u FROM a ASOF JOIN r ON a.at >= r.low)
SELECT id, l_orderkey::BIGINT AS l_orderkey, l_returnflag FROM b ASOF JOIN k ON b.u = k.u AND b.then_at >= k.low""")
def synth_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a stored model: codes drawn by joins with its tables, values by joins with its dictionaries."""
    model = _stored(spark, sf)
    model.columns = {"id": ColumnModel("id", INTEGER, False, True), **model.columns}
    return sample(spark, model, seed=9)


@query()
def synth_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated mode from end to end: as many rows as the original, without noise."""
    df = labelled(spark, sf).drop("doc_id")
    return sample(spark, describe(df, Config(epsilon=0, degree=2, root="lang")))


@query()
def synth_private(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a privacy budget of 1."""
    df = labelled(spark, sf).drop("doc_id")
    return sample(spark, describe(df, Config(epsilon=1, degree=2, seed=1)))


_LINEITEM_FEW = ("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _independent_sql() -> str:
    """Every column of lineitem drawn from its own noisy distribution."""
    ctes, columns, joins = [f"rows AS (SELECT unnest(range(0, (SELECT count(*) FROM lineitem))) AS id)"], [], []
    for k, (c, kind) in enumerate(_TYPES["lineitem"].items()):
        x = f"epoch({c})" if kind == DATETIME else c
        if c in _LINEITEM_FEW:
            inner, value = _categories_sql(c, "lineitem"), "value"
        else:
            inner = f"SELECT *, coalesce(lead(bin_lo) OVER (ORDER BY bin_idx), (SELECT max({x}) FROM lineitem)) AS bin_hi FROM ({_histogram_sql(x, 'lineitem').replace('round(e[i + 1], 6)', 'e[i + 1]')})"
            v = f"(bin_lo + {uniform_sql(0, 'val:' + c, 'id')} * (bin_hi - bin_lo))"
            value = f"trunc({v})::BIGINT" if kind == DATETIME else f"round_even({v}, 0)::BIGINT" if kind == INTEGER else f"round({v}, 6)"
        ctes += [_noisy_sql(f"d{k}", inner, c, len(_TYPES["lineitem"]), 0.1, 0, "SELECT count(*) FROM lineitem"), f"c{k} AS (SELECT *, sum(p) OVER (ORDER BY bin_idx) AS hi, sum(p) OVER (ORDER BY bin_idx) - p AS lo, bin_idx = max(bin_idx) OVER () AS is_last FROM d{k})"]
        u = uniform_sql(0, "gen:" + c, "id")
        joins.append(f"(SELECT id, {value} AS {c} FROM rows JOIN c{k} ON {u} >= lo AND ({u} < hi OR is_last)) t{k}")
        columns.append(c)
    joined = joins[0] + "".join(f" JOIN {j} USING (id)" for j in joins[1:])
    return f"WITH {', '.join(ctes)} SELECT {', '.join(columns)} FROM {joined}"


@query(_independent_sql())
def synth_independent(spark: SparkSession, sf: str) -> DataFrame:
    """Independent mode from end to end: as many rows as the original, with noise; suppliers are a range at every scale."""
    made = sample(spark, describe(read(spark, sf, "lineitem"), Config(mode="independent", epsilon=0.1, categorical={"l_suppkey": False})))
    return rounded(made, "l_extendedprice", digits=6)


_U0 = lambda c: uniform_sql(0, "gen:" + c, "id")


@query(f"""WITH rows AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id), known AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS os, list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders)
SELECT id AS o_orderkey, floor({_U0("o_custkey")} * 101)::BIGINT AS o_custkey, os[floor({_U0("o_orderstatus")} * len(os))::BIGINT + 1] AS o_orderstatus, round({_U0("o_totalprice")} * 100, 6) AS o_totalprice,
floor({_U0("o_orderdate")} * 101)::BIGINT AS o_orderdate, ps[floor({_U0("o_orderpriority")} * len(ps))::BIGINT + 1] AS o_orderpriority FROM rows, known""")
def synth_random(spark: SparkSession, sf: str) -> DataFrame:
    """Random mode from end to end: types and categories alone."""
    return rounded(sample(spark, describe(read(spark, sf, "orders"), Config(mode="random")), mode="random"), "o_totalprice", digits=6)


# Reports


@query("SELECT value, n, row_number() OVER (ORDER BY value) AS place FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)")
def barchart(spark: SparkSession, sf: str) -> DataFrame:
    return report.bars(read(spark, sf, "part"), "p_brand")


@query("SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)")
def barchart_by_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return report.bars(read(spark, sf, "part"), "p_brand", by_value=False)


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return report.top(read(spark, sf, "part"), "p_name")


@query(f"SELECT bin_lo, n FROM ({_histogram_sql('c_acctbal', 'customer')})")
def hist20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.histogram_bars(read(spark, sf, "customer"), "c_acctbal"), "bin_lo", digits=6)


@query(_nmi_sql(["c_nationkey", "c_mktsegment"], "customer", 3))
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return report.heatmap(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("""WITH a AS (SELECT lang AS value, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang AS value, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT value, round(coalesce(a.n, 0)::DOUBLE / (SELECT sum(n) FROM a), 9) AS original, round(coalesce(b.n, 0)::DOUBLE / (SELECT sum(n) FROM b), 9) AS synthetic FROM a FULL JOIN b USING (value)""")
def compare_bars(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(report.compare_bars(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "lang"), "original", "synthetic")


@query(" UNION ALL ".join(f"SELECT '{side}' AS side, bin_idx, bin_lo, round(p / ((SELECT max(n_chars) - min(n_chars) FROM documents WHERE doc_id % 2 = {k})::DOUBLE / 15), 12) AS density FROM ({_histogram_sql('n_chars', f'(SELECT * FROM documents WHERE doc_id % 2 = {k})', 15).replace('round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (), 9)', 'coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER ()')})" for k, side in enumerate(("original", "synthetic"))))
def compare_densities(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(rounded(report.compare_densities(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "n_chars", INTEGER), "density", digits=12), "bin_lo", digits=6)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 100")
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    return preview(read(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", F.get_json_object("record", "$.s_name").alias("s_name"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_acctbal AS score FROM supplier")
def rank_points(spark: SparkSession, sf: str) -> DataFrame:
    return report.rank_points(read(spark, sf, "supplier"), "s_suppkey", "s_acctbal")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attr, max({c}) FILTER (k <= 10)::DOUBLE AS top_max, median({c}) FILTER (k <= 10)::DOUBLE AS top_median, min({c}) FILTER (k <= 10)::DOUBLE AS top_min, max({c})::DOUBLE AS all_max, median({c})::DOUBLE AS all_median, min({c})::DOUBLE AS all_min FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)" for c in ("s_acctbal", "s_nationkey")))
def rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.rank_summary(read(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])


# Comparisons, bundles and round trips


@query(f"""WITH a AS ({_nmi_sql(["lang", "source"], "(SELECT * FROM documents WHERE doc_id % 2 = 0)")}), b AS ({_nmi_sql(["lang", "source"], "(SELECT * FROM documents WHERE doc_id % 2 = 1)")})
SELECT x, y, a.nmi AS original, b.nmi AS synthetic FROM a FULL JOIN b USING (x, y)""")
def compare_matrices(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return rounded(report.compare_matrices(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), ["lang", "source"]), "original", "synthetic")


@query(f"SELECT x, y, nmi AS original, nmi AS synthetic FROM ({_nmi_sql(['c_nationkey', 'c_acctbal', 'c_mktsegment'], 'customer')})")
def inspect_without_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The matrices of an inspection: the two keys of the table are left out."""
    df = read(spark, sf, "customer")
    return rounded(report.inspect(df, df, profile(df))["nmi"], "original", "synthetic")


def _chart_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """Charts of several columns as one table: bars have a value, histograms a left edge."""
    out = None
    for name, frame in frames.items():
        has = "value" in frame.columns
        rows = frame.select(F.lit(name).alias("attr"), (F.col("value") if has else F.lit(None).cast("string")).alias("value"), (F.lit(None).cast("double") if has else F.round("bin_lo", 6)).alias("bin_lo"), F.col("n").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


_CHARTS = [f"SELECT '{c}' AS attr, NULL::VARCHAR AS value, bin_lo, n FROM ({_histogram_sql(c, 'customer')})" for c in ("c_custkey", "c_nationkey", "c_acctbal")]
_CHARTS += ["SELECT 'c_mktsegment', c_mktsegment, NULL, count(*) FROM customer GROUP BY ALL", "SELECT * FROM (SELECT 'c_name', c_name, NULL, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_name LIMIT 20)"]


@query(" UNION ALL ".join(_CHARTS))
def charts_of_table(spark: SparkSession, sf: str) -> DataFrame:
    """A chart of each column of a table."""
    df = read(spark, sf, "customer")
    return _chart_rows(report.charts(df, profile(df)))


_HALVES = [(side, f"(SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = {k})") for k, side in enumerate(("before", "after"))]


@query(" UNION ALL ".join([f"SELECT '{s}:lang' AS attr, lang AS value, NULL::DOUBLE AS bin_lo, count(*) AS n FROM {t} GROUP BY ALL" for s, t in _HALVES] + [f"SELECT '{s}:{c}', NULL, bin_lo, n FROM ({_histogram_sql(c, t)})" for s, t in _HALVES for c in ("doc_id", "n_chars")]))
def charts_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Bars and histograms of two tables beside each other."""
    df = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    both = report.before_after(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), profile(df))
    return _chart_rows({**both["barchart"], **both["histogram"]})


@query(f"""WITH {_draw_sql(_categories_sql("o_orderpriority", "orders"), _U("gen:o_orderpriority"), "d", "orders")}, b AS (SELECT value, count(*) AS n FROM d_drawn GROUP BY value)
SELECT d.value, round(d.n::DOUBLE / (SELECT sum(n) FROM d), 9) AS original, round(coalesce(b.n, 0)::DOUBLE / (SELECT count(*) FROM d_drawn), 9) AS synthetic FROM d LEFT JOIN b USING (value)""")
def job_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """One job: model, synthetic table and its comparison with the original."""
    _, _, frames = run(read(spark, sf, "orders").select("o_orderpriority"), Config(mode="independent", epsilon=0, seed=3))
    return rounded(frames["o_orderpriority"], "original", "synthetic")


@query(f"""WITH m AS ({ORACLES["gen_correlated"]}), o AS (SELECT 'turn' AS attr, turn::VARCHAR AS value, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY ALL),
s AS (SELECT 'turn' AS attr, turn::VARCHAR AS value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'role', role, count(*) FROM m GROUP BY ALL)
SELECT attr, value, round(o.n::DOUBLE / (SELECT count(*) FROM conversations), 9) AS original, round(coalesce(s.n, 0)::DOUBLE / (SELECT count(*) FROM m), 9) AS synthetic FROM o LEFT JOIN s USING (attr, value)""")
def job_correlated(spark: SparkSession, sf: str) -> DataFrame:
    """One job with a network: model, synthetic table and the comparison of each column."""
    _, _, frames = run(read(spark, sf, "conversations").select("turn", "role"), Config(epsilon=0, degree=1, root="turn", seed=3))
    parts = [frames[c].select(F.lit(c).alias("attr"), "value", "original", "synthetic") for c in ("turn", "role")]
    return rounded(parts[0].unionByName(parts[1]), "original", "synthetic")


@query("SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS p_type FROM part")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV, with a null token in one column, and read again with its types found."""
    path = scratch(spark)
    df = read(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("1.#QNAN"))
    write_csv(df, path)
    return read_csv(spark, path)


@query(f"SELECT attr, data_type, is_categorical, is_candidate_key, missing_rate, min, max FROM ({_columns_sql(LABELLED)})")
def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A model written as JSON and read again."""
    df = labelled(spark, sf)
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone: a model is plain data there
        profile(df).save(f"{folder}/model.json")
        model = TableModel.load(f"{folder}/model.json")
    return profile_frame(df, model).drop("n_values")
