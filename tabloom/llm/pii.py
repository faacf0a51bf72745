"""Operator 3: personal data, with DataFrame functions alone.

Regular expressions propose spans of each kind (leftmost, not overlapping within the kind), checksum
validators confirm them (Luhn for cards, mod-97 for IBANs, ranges and digit counts for the others),
and context words near a span raise its score. Spans of the four base kinds that pass their check
always stay; those of the kinds added here (iban, ssn) stay from a score of KEEP on.

All work on a text is done within its row: matches come with the texts between them, and starts are
prefix sums over both by doubling steps, so a text with very many matches costs n log n. There is
no shuffle, and a row stays a row. The patterns are the contract's with possessive quantifiers and
anchors that skip starts that cannot match, so that a long run of letters or digits is read once.

A null text is an empty one and has no spans. Positions are code points, from 0, ends exclusive. Of
equal starts no two spans of a kind exist, as matches do not overlap. Repeated rows and ids are
independent. All columns of the input stay, whatever their names, but for one named like the output.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import free_names, table

KEEP = 0.6
#: Code points before and after a span that are searched for its context words.
BEFORE, AFTER = 48, 24


class Kind(NamedTuple):
    name: str
    hint: str  # texts without this pattern have no match
    pattern: str
    valid: Callable[[Column], Column]
    prior: float  # the score of a span that passed its check
    words: str
    base: bool


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"

KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "mail|contact|correo|courriel|write to|schreib", True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, r"\bip\b|host|server|address|adresse|addr", True),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[ \-]?[0-9])++", _card, 0.7, "card|visa|credit|karte|carte|tarjeta|payment", True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9\-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|tel|call|mobil|fax|llam|appel|anruf", True),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.8, "iban|bank|konto|compte|cuenta|account", False),
    Kind("ssn", "[0-9]-[0-9]", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", lambda m: F.lit(True), 0.4, r"\bssn\b|social security|taxpayer|insurance", False),
)


def scan(values: Column, size: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join`` over an array, by doubling steps."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda p: p < size)
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda x, i: join(x, F.get(acc, i - p))))


def _spans(text: Column, kind: Kind, found: Column) -> Column:
    """Scored spans of one kind that stay, in order, from its matches."""
    # Arrays go into the functions as arguments: what a lambda names from outside is computed for each element.
    lengths = F.zip_with(F.split(text, kind.pattern, -1), F.concat(F.array(F.lit("")), found), lambda gap, m: (F.char_length(m) + F.char_length(gap)).cast("long"))
    starts = F.slice(scan(lengths, F.size(found), lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))), 1, F.size(found))

    def span(m: Column, start: Column) -> Column:
        end = start + F.char_length(m)
        near = F.lower(F.concat(F.substring(text, (F.greatest(start - BEFORE, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(BEFORE)).cast("int")), F.lit(" "), F.substring(text, (end + 1).cast("int"), F.lit(AFTER))))
        score = F.when(kind.valid(m), F.lit(kind.prior) + F.when(near.rlike(kind.words), 0.2).otherwise(0.0)).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.round(score, 2).alias("score"))

    scored = F.zip_with(found, starts, span)
    return F.filter(scored, lambda s: s["score"] > 0 if kind.base else s["score"] >= KEEP)


_EMPTY = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)"


def find_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Add ``out_col``: an array of (kind, start, end, score), by kind in the order of KINDS, then start."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    names = free_names(df, [f"__found_{k.name}" for k in KINDS])
    found = df.withColumns({n: F.when(text.rlike(k.hint), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for n, k in zip(names, KINDS, strict=True)})
    each = [F.when(F.size(n) > 0, _spans(text, k, F.col(n))).otherwise(F.expr(_EMPTY)) for n, k in zip(names, KINDS, strict=True)]
    return found.withColumn(out_col, F.concat(*each)).drop(*names)


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replace all spans in the text by ``[KIND]``; spans that overlap are replaced as one, by the first's kind."""
    sorted_, merged, first_ = free_names(df, ["__s", "__m", "__f"])
    text, n = F.col(f"`{text_col}`"), F.size(sorted_)
    out = df.withColumn(sorted_, F.array_sort(F.transform(F.col(f"`{spans_col}`"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))))
    out = out.withColumn(merged, scan(F.transform(sorted_, lambda s: -s["back"]), n, lambda a, b: F.greatest(a, F.coalesce(b, F.lit(0).cast("long")))))
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(sorted_, i)["start"] >= F.get(merged, i - 1)))
    out = out.withColumn(first_, F.when(n > 0, first).otherwise(F.expr("cast(array() as array<int>)")))

    def until(j: Column) -> Column:
        """The end of the j-th merged span."""
        return F.get(merged, F.coalesce(F.get(first_, j + 1), n) - 1)

    def piece(i: Column, j: Column) -> Column:
        start, before = F.get(sorted_, i)["start"], F.when(j > 0, until(j - 1)).otherwise(F.lit(0).cast("long"))
        return F.concat(F.substring(text, (before + 1).cast("int"), (start - before).cast("int")), F.lit("["), F.upper(F.get(sorted_, i)["kind"]), F.lit("]"))

    rest = F.substring(text, (until(F.size(first_) - 1) + 1).cast("int"), F.lit(2**31 - 1))
    made = F.when(F.size(first_) > 0, F.concat(F.array_join(F.transform(first_, piece), ""), rest)).otherwise(text)
    return out.withColumn(text_col, made).drop(sorted_, merged, first_)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document; ``scores`` are those of ``spans``, in their order."""
    docs = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", *map(count, base), F.sha2(shown(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"))


def pii_oracle() -> str:
    """The same spans in DuckDB, whose regular expressions need no anchors against long runs."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    d = f"cast(substr(reverse({digits}), i, 1) AS INT)"
    iban = "replace(m, ' ', '')"
    c = f"ascii(substr(substr({iban}, 5) || substr({iban}, 1, 4), i, 1))"
    context = f"lower(substr(text, greatest(s - {BEFORE}, 0) + 1, least(s, {BEFORE})) || ' ' || substr(text, s + length(m) + 1, {AFTER}))"
    valid = {
        "email": "TRUE",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right('0' || ltrim(p, '0'), 4) AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(range(1, length({iban}) + 1), lambda i: CASE WHEN {c} >= 65 THEN {c} - 55 + 1000 ELSE {c} - 48 END::BIGINT), lambda a, b: CASE WHEN b >= 1000 THEN ((a % 1000) * 100 + b - 1000) % 97 ELSE ((a % 1000) * 10 + b) % 97 END) = 1",
        "ssn": rf"regexp_matches({context}, '\bssn\b|social security|taxpayer|insurance') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    parts = []
    for k, p in patterns.items():
        parts.append(rf"""
m_{k} AS (SELECT r, text, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS gaps FROM d),
s_{k} AS (SELECT r, text, found, list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0)) AS starts FROM m_{k}),
u_{k} AS (SELECT r, text, unnest(found) AS m, unnest(starts)::BIGINT AS s FROM s_{k}),
v_{k} AS (SELECT r, '{k}' AS kind, {list(patterns).index(k)} AS o, s, s + length(m) AS e FROM u_{k} WHERE {valid[k]})""")
    union = " UNION ALL ".join(f"SELECT * FROM v_{k}" for k in patterns)
    base = "('email', 'ip', 'card', 'phone')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    shown = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{",".join(parts)},
a AS ({union})
SELECT d.doc_id, {counts}, sha256(coalesce({shown} FILTER (kind IN {base}), '')) AS base_sha256, coalesce({shown}, '') AS spans
FROM d LEFT JOIN a USING (r) GROUP BY d.r, d.doc_id
"""
