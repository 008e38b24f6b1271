"""One query for each operator over the driver's tables, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.spans import literal_spans
from spanloom.model import SPANS, Referential
from spanloom.operators import audit, detectors, layout, merge, retention
from spanloom.plans import oracle as O
from spanloom.plans.pipeline import Config, anonymize, anonymize_cells, detect, distinct_texts, exploded
from spanloom.rules import Rule, Rules
from spanloom.sources.delimited import delimiter_votes
from spanloom.sources.text_files import encoding_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts derived from keys, the same in Spark and DuckDB.
K = "c_custkey"
KS = f"CAST({K} AS VARCHAR)"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


_NIR_BODY = f"'1' || {_pad(K + ' % 100', 2)} || {_pad('1 + ' + K + ' % 12', 2)} || '75' || {_pad(K + ' % 1000', 3)} || {_pad('37 * ' + K + ' % 1000', 3)}"
DERIVED = {
    "siren": f"'SIREN ' || {_pad(K + ' * 7919 % 1000000000', 9)} || ' fin'",
    "siret": f"'SIRET ' || {_pad(K + ' * 104729', 14)} || ' fin'",
    "nir": f"'NIR ' || {_NIR_BODY} || {_pad(f'97 - CAST({_NIR_BODY} AS BIGINT) % 97 + {K} % 2', 2)} || ' fin'",
    "iban": f"'FR' || lpad(CAST(98 - CAST((CAST({K} * 7919 AS VARCHAR) || '152700') AS DECIMAL(38,0)) % 97 + {K} % 2 AS VARCHAR), 2, '0') || lpad(CAST({K} * 7919 AS VARCHAR), 23, '0')",
    "postal": f"'CP ' || {_pad(K + ' * 61 % 100000', 5)} || ' ville'",
    "bic": f"'code BNPA' || CASE {K} % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' ELSE 'ZZ' END || {_pad(K + ' % 100', 2)} || ' fin'",
    "street": f"'au ' || CAST(1 + {K} % 200 AS VARCHAR) || ' rue des Acacias, puis'",
    "url": f"'voir https://ex.org/p/' || {KS} || '?q=1 et http://a.b fin'",
    "password": f"'mot de passe : Ab' || {_pad(K, 6)} || '!x, fin'",
    "login": f"'login: user' || {KS} || ' ; identifiant u-' || {KS} || ', fin'",
    "shape": f"'jeton (Ab' || {_pad(K, 6)} || '!x). abc' || {KS} || ' ABCDEF12 Aa1 fin'",
    "project": f"'dossier PRJ-' || {_pad(K + ' % 10000', 4)} || ' du client Divers'",
    "nation": "'de ' || n_name || ' vers ' || n_name || 'X'",
    "mixed": f"'Client ' || {KS} || ' mail c' || CAST({K} % 50 AS VARCHAR) || '@ex.fr tel 06' || {_pad(K + ' * 7919 % 100000000', 8)} || ' SIREN ' || {_pad(K + ' * 7919 % 1000000000', 9)} || ' site http://ex.fr/' || {KS}",
}
_CUSTOMER = {n: f"(SELECT {K}, {e} AS text FROM customer)" for n, e in DERIVED.items() if n != "nation"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(K, F.expr(DERIVED[name].replace("VARCHAR", "STRING")).alias("text"))


def _rows(df: DataFrame, key: str, spans: Column, *fields: str) -> DataFrame:
    s = df.select(key, F.explode(spans).alias("s"))
    return s.select(key, *(F.col(f"s.{'end' if f == 'stop' else f}").alias(f) for f in fields))


BASE = ("type", "value", "start", "stop")
_DOCS = "(SELECT doc_id, text FROM documents)"


def _detector(name: str, type_: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(derived(spark, sf_dir, text), K, detectors.deterministic(F.col("text"), type_), *BASE, "confirmed")

    query(name, sql)(run)


def _checked(pattern: str, type_: str, text: str, confirmed: str, keep: str = "true") -> str:
    return f"SELECT {K}, type, value, start, stop, {confirmed} AS confirmed FROM {O.spans(_CUSTOMER[text], K, pattern, type_)} WHERE {keep}"


@query("d1_email_spans", f"SELECT doc_id, type, value, start, stop FROM {O.spans(_DOCS, 'doc_id', O.EMAIL, 'EMAIL')}")
def d1(spark, sf_dir):
    return _rows(table(spark, sf_dir, "documents"), "doc_id", detectors.deterministic(F.col("text"), "EMAIL"), *BASE)


@query("d2_phone_spans", f"SELECT doc_id, type, value, start, stop FROM {O.spans(_DOCS, 'doc_id', O.PHONE, 'PHONE')}")
def d2(spark, sf_dir):
    return _rows(table(spark, sf_dir, "documents"), "doc_id", detectors.deterministic(F.col("text"), "PHONE"), *BASE)


_detector("d3_iban", "IBAN", "iban", _checked(r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{2,4}){2,8}\b", "IBAN", "iban", O.iban("value")))
_detector("d4_bic", "BIC", "bic", _checked(r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "BIC", "bic", "true", "substr(value, 5, 2) IN ('FR', 'DE')"))
_detector("d5_siret", "SIRET", "siret", _checked(r"\b\d{14}\b", "SIRET", "siret", "true", O.luhn("value")))
_detector("d6_siren", "SIREN", "siren", _checked(r"\b\d{9}\b", "SIREN", "siren", "true", O.luhn("value")))
_detector("d7_nir", "NIR", "nir", _checked(r"\b[12]\s?\d{2}\s?\d{2}\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}\b", "NIR", "nir", O.nir("value")))
_detector("d8_address", "ADDRESS", "street", _checked(r"(?i)\b\d{1,4}[,\s]+rue\b(?:[ \t]+[\w'&-]+){0,5}", "ADDRESS", "street", "true"))
_detector("d9_postal", "POSTAL_CODE", "postal", _checked(r"\b\d{5}\b", "POSTAL_CODE", "postal", "true", "CAST(substr(value, 1, 2) AS INTEGER) BETWEEN 1 AND 98"))
_detector("d10_url", "URL", "url", _checked(r"https?://[^\s]+", "URL", "url", "true"))

_SECRET = "'secret' AS source"
_TOKEN = r"([^\s,;)\]]*[^\s,;)\].])"


@query("d11_password_ctx", f"SELECT {K}, type, value, start, stop, {_SECRET} FROM " + O.spans(_CUSTOMER["password"], K, rf"(?i)(mot de passe(?:\s*[:\-(]\s*|\s+)){_TOKEN}", "PASSWORD", group=True))
def d11(spark, sf_dir):
    return _rows(derived(spark, sf_dir, "password"), K, detectors.contextual(F.col("text"), "PASSWORD"), *BASE, "source")


@query("d12_login_ctx", f"SELECT {K}, type, value, start, stop, {_SECRET} FROM " + O.spans(_CUSTOMER["login"], K, rf"(?i)((?:login|identifiant)(?:\s*[:\-(]\s*|\s+)){_TOKEN}", "LOGIN", group=True))
def d12(spark, sf_dir):
    return _rows(derived(spark, sf_dir, "login"), K, detectors.contextual(F.col("text"), "LOGIN"), *BASE, "source")


@query("d13_secret_shape", f"""SELECT {K}, type, value, start, stop FROM {O.spans(_CUSTOMER['shape'], K, r'([\s.,;:()\[\]]*)([^\s.,;:()\[\]](?:[^\s]*[^\s.,;:()\[\]])?)', 'PASSWORD', group=True)}
WHERE length(value) >= 8 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')""")
def d13(spark, sf_dir):
    return _rows(derived(spark, sf_dir, "shape"), K, detectors.secret_shapes(F.col("text")), *BASE)


@query("d15_dictionary_ner", f"""WITH t AS (SELECT n_nationkey, n_name, {DERIVED['nation']} AS text FROM nation), s AS (SELECT n_name AS surface FROM nation),
p AS (SELECT n_nationkey, surface, string_split(text, surface) AS parts FROM t JOIN s ON contains(text, surface)),
x AS (SELECT n_nationkey, surface, generate_subscripts(parts, 1) AS i, unnest(parts) AS p, len(parts) AS n FROM p),
y AS (SELECT n_nationkey, surface, i, n, sum(length(p)) OVER (PARTITION BY n_nationkey, surface ORDER BY i) + (i - 1) * length(surface) AS place FROM x)
SELECT n_nationkey, 'ORG' AS type, surface AS value, CAST(place AS INTEGER) AS start, CAST(place + length(surface) AS INTEGER) AS stop FROM y WHERE i < n""")
def d15(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    names = sorted(r[0] for r in nations.select("n_name").collect())  # 25 rows, a fixed dimension
    found = detectors.DictionaryRecognizer({n: "ORG" for n in names}).spans(F.col("text"), [])
    return _rows(nations.select("n_nationkey", F.expr(DERIVED["nation"]).alias("text")), "n_nationkey", found, *BASE)


RULES = Rules((Rule("simple", "prj-####", "mask"), Rule("simple", "divers", "keep"), Rule("regex", r"client\s+\w+", "mask")))


@query("d17_mask_rules", f"""SELECT {K}, type, value, start, stop FROM {O.spans(_CUSTOMER['project'], K, r'(?i)prj-\d\d\d\d', 'REGLE_INTERNE')}
UNION ALL SELECT {K}, type, value, start, stop FROM {O.spans(_CUSTOMER['project'], K, r'(?i)client\s+\w+', 'REGLE_INTERNE')}""")
def d17(spark, sf_dir):
    return _rows(derived(spark, sf_dir, "project"), K, RULES.forced_spans(F.col("text")), *BASE)


_KEEP = Config(rules=Rules((Rule("simple", "prj-####", "mask"), Rule("simple", "PRJ-00*", "keep"))))


@query("m5_keep_rules", f"SELECT {K}, type, value, start, stop FROM {O.spans(_CUSTOMER['project'], K, r'(?i)prj-\d\d\d\d', 'REGLE_INTERNE')} WHERE NOT regexp_full_match(value, '(?i)PRJ-00.*')")
def m5(spark, sf_dir):
    found = detect(derived(spark, sf_dir, "project"), _KEEP)
    return _rows(found, K, F.col("spans"), *BASE)


@query("d18_chunk_spans", """WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS start, 0 AS stop FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, stop, CASE WHEN stop + 1000 >= length(text) THEN length(text)
  WHEN strpos(reverse(substr(text, stop + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN stop + 1001 - strpos(reverse(substr(text, stop + 1, 1000)), ' ') ELSE stop + 1000 END FROM w WHERE stop < length(text))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM w WHERE stop > 0""")
def d18(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(detectors.chunk_column(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("stop"))


def _flag(name: str, text: str, cut: str, check: Callable[[Column], Column], sql: str) -> None:
    """A validator over every derived value; cut is SQL for the value in the derived text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derived(spark, sf_dir, text).select(K, F.expr(cut).alias("value"))
        return rows.select(K, "value", check(F.col("value")).alias("valid"))

    query(name, f"SELECT {K}, value, {sql} AS valid FROM (SELECT {K}, {cut} AS value FROM {_CUSTOMER[text]})")(run)


_flag("v1_luhn", "siren", "substr(text, 7, 9)", V.luhn_valid, O.luhn("value"))
_flag("v2_iban_mod97", "iban", "text", V.iban_valid, O.iban("value"))
_flag("v3_bic_country", "bic", "substr(text, 6, 8)", V.bic_plausible, "substr(value, 5, 2) IN ('FR', 'DE')")
_flag("v4_nir_key", "nir", "substr(text, 5, 15)", V.nir_valid, O.nir("value"))
_flag("v5_postal_dept", "postal", "substr(text, 4, 5)", V.postal_code_plausible, "CAST(substr(value, 1, 2) AS INTEGER) BETWEEN 1 AND 98")


@query("f1_normalize", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS norm FROM (SELECT doc_id, replace(text, 'ß', 'ß') AS text FROM documents)")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.normalize(F.col("text")).alias("norm"))


@query("f2_looks_structured", r"SELECT o_orderkey, NOT regexp_matches(o_orderpriority, '\p{L}') AS a, NOT regexp_matches(CAST(o_orderkey AS VARCHAR), '\p{L}') AS b FROM orders")
def f2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.looks_structured(F.col("o_orderpriority")).alias("a"), V.looks_structured(F.col("o_orderkey").cast("string")).alias("b"))


@query("f8_column_labels", f"SELECT {K}, CASE {K} % 3 WHEN 0 THEN 'nom' WHEN 1 THEN 'ville' ELSE 'col2' END || ' L' || CAST({K} + 1 AS VARCHAR) AS location FROM customer")
def f8(spark, sf_dir):
    header = F.array(F.lit("nom"), F.lit("ville"))
    label = V.column_label(header, (F.col(K) % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(K, F.concat(label, F.lit(" L"), (F.col(K) + 1).cast("string")).alias("location"))


@query("f9_manual_rect", f"""SELECT {K}, least(a, b) / 2 AS x0, greatest(a, b) / 2 AS x1, least(c, d) / 2 AS y0, greatest(c, d) / 2 AS y1 FROM (
SELECT {K}, CAST({K} % 17 AS DOUBLE) AS a, CAST({K} % 23 AS DOUBLE) AS b, CAST({K} % 7 AS DOUBLE) AS c, CAST({K} % 11 AS DOUBLE) AS d FROM customer) WHERE abs(a - b) >= 2 AND abs(c - d) >= 2""")
def f9(spark, sf_dir):
    side = lambda n: (F.col(K) % n).cast("double")
    rows = table(spark, sf_dir, "customer").select(K, V.page_rect(side(17), side(7), side(23), side(11), F.lit(2.0)).alias("r")).where("r IS NOT NULL")
    return rows.select(K, "r.x0", "r.x1", "r.y0", "r.y1")


@query("k3_output_name", f"SELECT {K}, 'dir.x/f' || {KS} || '.b_ano_20260102030405.csv' AS name FROM customer")
def k3(spark, sf_dir):
    path = F.concat(F.lit("dir.x/f"), F.col(K).cast("string"), F.lit(".b.csv"))
    return table(spark, sf_dir, "customer").select(K, V.output_name(path, F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("name"))


# Resolution, masking and reports.
_TAGS = "CASE type WHEN 'EMAIL' THEN '[EMAIL]' WHEN 'PHONE' THEN '[TEL]' WHEN 'SIREN' THEN '[SIREN]' WHEN 'URL' THEN '[URL]' WHEN 'IBAN' THEN '[IBAN]' ELSE '?' END"
_ONLY = Referential().with_overrides(**{t: t in ("EMAIL", "PHONE", "SIREN", "URL") for t in ("PERSON", "ADDRESS", "ORG", "EMAIL", "PHONE", "IBAN", "SIREN", "SIRET", "NIR", "URL", "LOGIN", "PASSWORD")})
MIXED = Config(_ONLY)
_FIELDS = "type, value, start, stop, 1 AS strong, 1.0 AS confidence, true AS confirmed, tord"


def _found(source: str, key: str) -> str:
    return f"""SELECT {key}, {_FIELDS} FROM {O.spans(source, key, O.EMAIL, 'EMAIL', order=1)} UNION ALL SELECT {key}, {_FIELDS} FROM {O.spans(source, key, O.PHONE, 'PHONE', order=2)}
UNION ALL SELECT {key}, {_FIELDS} FROM {O.spans(source, key, r'\b\d{9}\b', 'SIREN', order=3)} WHERE {O.luhn('value')} UNION ALL SELECT {key}, {_FIELDS} FROM {O.spans(source, key, 'https?://[^ \t\n\x0b\x0c\r]+', 'URL', order=4)}"""


def _with(source: str, key: str) -> str:
    return f"WITH RECURSIVE {O.merged(_found(source, key), key)}, tagged AS (SELECT *, {_TAGS} AS tag FROM kept)"


_MIX = _with(_CUSTOMER["mixed"], K)


def mixed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(detect(derived(spark, sf_dir, "mixed"), MIXED), [K])


_TOY = f"""SELECT {K}, CASE i % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'IBAN' END AS type, CAST(i AS VARCHAR) AS value, CAST(({K} * (i + 3)) % 40 AS INTEGER) AS start,
CAST(({K} * (i + 3)) % 40 + 1 + ({K} + i) % 9 AS INTEGER) AS stop, CASE WHEN ({K} + i) % 3 = 0 THEN 1 ELSE 0 END AS strong, CAST(1 + i % 2 AS DOUBLE) / 2 AS confidence, true AS confirmed, i AS tord
FROM customer, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(i)"""


def toy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    start = lambda i: ((k * (i + 3)) % 40).cast("int")
    one = lambda i: F.struct(
        F.lit(("EMAIL", "PHONE", "IBAN")[i % 3]), F.lit(str(i)), start(i), (start(i) + 1 + (k + i) % 9).cast("int"), F.when((k + i) % 3 == 0, "deterministic").otherwise("ner"),
        F.lit((1 + i % 2) / 2), F.lit(True), F.lit(0))
    return table(spark, sf_dir, "customer").select(K, F.array(*map(one, range(8))).cast(SPANS).alias("spans"))


@query("m2_merge", f"WITH RECURSIVE {O.merged(_TOY, K)} SELECT {K}, type, value, start, stop, confidence FROM kept")
def m2(spark, sf_dir):
    return _rows(toy_spans(spark, sf_dir), K, merge.merge(F.col("spans")), *BASE, "confidence")


@query("j7_conflicts", f"""WITH RECURSIVE {O.merged(_TOY, K)} SELECT c.{K}, c.value AS lost, k.value AS won FROM ranked c JOIN kept k ON c.{K} = k.{K} AND c.start < k.stop AND k.start < c.stop AND c.n <> k.n
WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.{K} = c.{K} AND x.n = c.n)""")
def j7(spark, sf_dir):
    rows = toy_spans(spark, sf_dir).withColumn("kept", merge.merge(F.col("spans"))).withColumn("spans", merge.numbered(F.col("spans")))
    lost = rows.select(K, "kept", F.explode("spans").alias("s")).where(~F.exists("kept", lambda x: x["seq"] == F.col("s.seq")))
    pairs = lost.select(K, F.col("s.value").alias("lost"), F.explode(F.filter("kept", lambda x: merge.overlaps(x, F.col("s")))).alias("w"))
    return pairs.select(K, "lost", F.col("w.value").alias("won"))


@query("m3_mask", f"WITH RECURSIVE {O.merged(_TOY, K)}, t AS (SELECT {K}, repeat('abcdefghij', 5) || {KS} AS text FROM customer), tg AS (SELECT *, {_TAGS} AS tag FROM kept) " + O.masked("t", K).replace("FROM kept k", "FROM tg k"))
def m3(spark, sf_dir):
    rows = toy_spans(spark, sf_dir).withColumn("text", F.concat(F.repeat(F.lit("abcdefghij"), 5), F.col(K).cast("string")))
    rows = rows.withColumn("kept", merge.merge(F.col("spans")))
    return rows.select(K, merge.mask(F.col("text"), F.col("kept"), Referential()).alias("masked"))


@query("m4_pipeline", f"{_with(_DOCS, 'doc_id')} " + O.masked("documents", "doc_id").replace("FROM kept k", "FROM tagged k"))
def m4(spark, sf_dir):
    return anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", MIXED).masked.select("doc_id", "masked")


@query("d16_null_ner", f"{_MIX} SELECT {K}, type, value, start, stop FROM tagged")
def d16(spark, sf_dir):
    """Without a model its types stay active and find nothing; the other detectors do their work."""
    found = detect(derived(spark, sf_dir, "mixed"), Config(_ONLY.with_overrides(PERSON=True, ORG=True), recognizer=detectors.NullRecognizer()))
    return _rows(found, K, F.col("spans"), *BASE)


@query("m4_mixed_spans", f"{_MIX} SELECT {K}, type, value, start, stop FROM tagged")
def m4_mixed(spark, sf_dir):
    return mixed_spans(spark, sf_dir).select(K, "type", "value", "start", F.col("end").alias("stop"))


@query("m7_run_remap", f"""WITH d AS (SELECT doc_id, text FROM documents), s AS (SELECT doc_id, start, stop FROM {O.spans('d', 'doc_id', O.EMAIL, 'EMAIL')}),
c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 40)) AS a FROM d),
r AS (SELECT c.doc_id, a, least(a + 40, length(text)) AS b, text FROM c),
h AS (SELECT r.doc_id, a, b, text, s.start, s.stop FROM r LEFT JOIN s ON s.doc_id = r.doc_id AND s.start < b AND s.stop > a),
g AS (SELECT doc_id, a, b, any_value(text) AS text, string_agg(gap || tag, '' ORDER BY start) AS head, max(CASE WHEN stop IS NOT NULL THEN least(stop, b) END) AS pos FROM (
  SELECT *, substr(text, coalesce(lag(least(stop, b)) OVER (PARTITION BY doc_id, a ORDER BY start), a) + 1, greatest(start - coalesce(lag(least(stop, b)) OVER (PARTITION BY doc_id, a ORDER BY start), a), 0)) AS gap,
         CASE WHEN start >= a THEN '[EMAIL]' ELSE '' END AS tag FROM h) GROUP BY doc_id, a, b)
SELECT doc_id, string_agg(coalesce(head, '') || substr(text, coalesce(pos, a) + 1, b - coalesce(pos, a)), '|' ORDER BY a) AS runs FROM g GROUP BY doc_id""")
def m7(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0)).alias("runs"))
    rows = rows.withColumn("spans", detectors.deterministic(F.col("text"), "EMAIL"))
    return rows.select("doc_id", F.array_join(merge.mask_runs(F.col("runs"), F.col("spans"), Referential()), "|").alias("runs"))


@query("a1_audit", f"""{_MIX} SELECT type, value AS original, any_value(tag) AS tag, count(*) AS occurrences, string_agg({KS}, '; ' ORDER BY {K}, start) AS locations,
CASE WHEN bool_and(confirmed) THEN 'oui' ELSE 'non' END AS confirme FROM tagged GROUP BY type, value""")
def a1(spark, sf_dir):
    return anonymize(derived(spark, sf_dir, "mixed"), K, MIXED).audit


@query("a2_value_counts", f"{_MIX} SELECT type, value, count(*) AS occurrences FROM tagged GROUP BY type, value")
def a2(spark, sf_dir):
    return audit.value_counts(mixed_spans(spark, sf_dir))


POLICY = retention.Policy(types_off=("URL",), values={("EMAIL", "c1@ex.fr"): False})
_RETAINED = "type <> 'URL' AND NOT (type = 'EMAIL' AND value = 'c1@ex.fr')"


@query("a3_retained", f"{_MIX} SELECT type, count(*) AS total, count(*) FILTER ({_RETAINED}) AS retained FROM tagged GROUP BY type")
def a3(spark, sf_dir):
    return audit.retained_per_type(retention.retain(mixed_spans(spark, sf_dir), POLICY))


@query("a5_types", f"{_MIX} SELECT DISTINCT type FROM tagged")
def a5(spark, sf_dir):
    return mixed_spans(spark, sf_dir).select("type").distinct().orderBy("type")


@query("f7_risk", f"{_MIX}, c AS (SELECT {K} FROM customer) SELECT c.{K}, CASE coalesce(max(CASE WHEN type IN ('EMAIL', 'PHONE') THEN 3 WHEN type = 'SIREN' THEN 2 WHEN type = 'URL' THEN 1 END), 0) WHEN 3 THEN 'Élevé' WHEN 2 THEN 'Moyen' ELSE 'Faible' END AS risk FROM c LEFT JOIN tagged t ON t.{K} = c.{K} GROUP BY c.{K}")
def f7(spark, sf_dir):
    return detect(derived(spark, sf_dir, "mixed"), MIXED).select(K, audit.risk_of(F.col("spans"), _ONLY).alias("risk"))


@query("a4_risk_all", f"{_MIX} SELECT CASE WHEN bool_or(type IN ('EMAIL', 'PHONE')) THEN 'Élevé' WHEN bool_or(type = 'SIREN') THEN 'Moyen' ELSE 'Faible' END AS risk FROM tagged")
def a4(spark, sf_dir):
    return audit.risk(mixed_spans(spark, sf_dir), _ONLY)


@query("r6_stats", f"{_MIX} SELECT count(*) AS detected, count(DISTINCT type) AS categories, count(*) FILTER ({_RETAINED}) AS to_mask, count(*) FILTER (NOT ({_RETAINED})) AS to_keep, CASE max(CASE WHEN {_RETAINED} THEN CASE WHEN type IN ('EMAIL', 'PHONE') THEN 3 WHEN type = 'SIREN' THEN 2 ELSE 1 END END) WHEN 3 THEN 'Élevé' WHEN 2 THEN 'Moyen' ELSE 'Faible' END AS risk FROM tagged")
def r6(spark, sf_dir):
    return audit.statistics(retention.retain(mixed_spans(spark, sf_dir), POLICY), _ONLY)


@query("r1_toggles", f"{_MIX} SELECT {K}, start, CASE WHEN type = 'URL' THEN false WHEN {K} % 7 = 0 AND type = 'EMAIL' THEN false ELSE true END AS retained FROM tagged")
def r1(spark, sf_dir):
    spans = mixed_spans(spark, sf_dir)
    toggles = spans.where((F.col(K) % 7 == 0) & (F.col("type") == "EMAIL")).select(K, "start", F.lit(False).alias("keep"))
    return retention.toggled(spans, toggles, [K, "start"], retention.Policy(types_off=("URL",))).select(K, "start", "retained")


@query("r2_cell_retention", f"{_MIX} SELECT {K} AS row_id, type, value, {_RETAINED} AND {K} % 5 <> 0 AS retained FROM tagged")
def r2(spark, sf_dir):
    spans = mixed_spans(spark, sf_dir).withColumnRenamed(K, "row_id").withColumn("column_id", F.lit(0))
    out = table(spark, sf_dir, "customer").where(F.col(K) % 5 == 0).select(F.col(K).alias("row_id"))
    policy = retention.Policy(POLICY.types_off, POLICY.values, (0,))
    return retention.retain(spans, policy, excluded=out, on=["row_id"]).select("row_id", "type", "value", "retained")


@query("r4_value_defaults", f"WITH RECURSIVE {O.merged(_TOY, K)} SELECT type, value, arg_min({K} % 2 = 0, {K}) AS \"on\", bool_and({K} % 2 = 0) AS confirmed FROM kept GROUP BY type, value")
def r4(spark, sf_dir):
    rows = exploded(toy_spans(spark, sf_dir).withColumn("spans", merge.merge(F.col("spans"))), [K]).withColumn("confirmed", F.col(K) % 2 == 0)
    return retention.first_confirmed(rows, [K])


_CELLS = "concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)"


_FIELDS_OF_CUSTOMER = ("CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)", "c_mktsegment")
_PROFILE = " UNION ALL ".join(rf"SELECT {i} AS column_id, bool_or(regexp_matches({c}, '\p{{L}}')) AS maskable FROM customer WHERE c_custkey > 0" for i, c in enumerate(_FIELDS_OF_CUSTOMER))


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer stands where a header would."""
    return table(spark, sf_dir, "customer").select(F.col(K).alias("row_id"), F.array(F.col(K).cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cells"))


@query("p2_maskable_columns", _PROFILE)
def p2(spark, sf_dir):
    return retention.column_profile(customer_cells(spark, sf_dir))


@query("p3_chosen_columns", f"SELECT column_id FROM (VALUES (0), (2), (3)) v(column_id) WHERE column_id <> 2 UNION ALL SELECT column_id + 10 FROM ({_PROFILE}) WHERE maskable AND column_id <> 3")
def p3(spark, sf_dir):
    rows = customer_cells(spark, sf_dir)
    named, default = retention.maskable_columns(rows, include={0, 2, 3}, exclude={2}), retention.maskable_columns(rows, exclude={3})
    return spark.createDataFrame([(c,) for c in named] + [(c + 10,) for c in default], "column_id int")


@query("p4_masked_cells", f"SELECT {K} AS row_id, c_nationkey AS more, {KS} || '|' || CASE WHEN {K} = 0 THEN 'c0@ex.fr' ELSE 'de [EMAIL], [EMAIL]' END || '|c' || {KS} || '@ex.fr' AS cells FROM customer")
def p4(spark, sf_dir):
    mail = F.concat(F.lit("c"), F.col(K).cast("string"), F.lit("@ex.fr"))
    said = F.when(F.col(K) == 0, mail).otherwise(F.concat(F.lit("de "), mail, F.lit(", x.y@z.fr")))
    rows = table(spark, sf_dir, "customer").select(F.col(K).alias("row_id"), F.col("c_nationkey").alias("more"), F.array(F.col(K).cast("string"), said, mail).alias("cells"))
    return anonymize_cells(rows, MIXED, [0, 1]).withColumn("cells", F.array_join("cells", "|"))


@query("p6_metadata_fields", f"SELECT 'META' AS type, value, 'Métadonnées / ' || label AS location FROM (SELECT CASE {K} % 3 WHEN 0 THEN 'Auteur' WHEN 1 THEN 'Titre' ELSE 'Société' END AS label, CASE {K} % 4 WHEN 0 THEN '  ' WHEN 1 THEN '' ELSE c_name END AS value FROM customer) WHERE length(trim(value)) > 0")
def p6(spark, sf_dir):
    label = F.element_at(F.array(F.lit("Auteur"), F.lit("Titre"), F.lit("Société")), (F.col(K) % 3 + 1).cast("int"))
    value = F.when(F.col(K) % 4 == 0, "  ").when(F.col(K) % 4 == 1, "").otherwise(F.col("c_name"))
    return audit.metadata_rows(table(spark, sf_dir, "customer").select(label.alias("label"), value.alias("value"))).select("type", "value", "location")


@query("f6_active_types", "SELECT * FROM (VALUES ('ner', 'PERSON'), ('ner', 'ORG'), ('deterministic', 'EMAIL'), ('deterministic', 'PHONE'), ('deterministic', 'IBAN'), ('deterministic', 'SIREN'), ('deterministic', 'SIRET'), ('deterministic', 'NIR'), ('deterministic', 'URL'), ('contextual', 'LOGIN'), ('contextual', 'PASSWORD')) v(method, code)")
def f6(spark, sf_dir):
    chosen = Referential().with_overrides(URL=True, ADDRESS=False)
    return spark.createDataFrame([(m, c) for m in ("ner", "deterministic", "contextual") for c in chosen.active_by_method(m)], "method string, code string")


@query("s2_encoding", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cp1252' ELSE 'utf-8' END AS encoding FROM documents")
def s2(spark, sf_dir):
    raw = F.col("text").cast("binary")  # a lone lead byte makes the others no UTF-8
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("E9")), raw)).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", encoding_of(content).alias("encoding"))


_KEYED = f"""k AS (SELECT *, {K} % 2 = 0 AS sure FROM tagged)"""


@query("r3_unit_review", f"""{_MIX}, {_KEYED}, f AS (SELECT type, value, arg_min(sure, {K} * 1000 + start) AS first_sure FROM k WHERE {K} % 10 <> 0 GROUP BY type, value)
SELECT {K}, type, start, CASE WHEN {K} % 10 = 0 THEN sure WHEN type = 'URL' THEN false WHEN type = 'EMAIL' AND value = 'c1@ex.fr' THEN false ELSE first_sure END AS retained FROM k LEFT JOIN f USING (type, value)""")
def r3(spark, sf_dir):
    spans = mixed_spans(spark, sf_dir).withColumn("confirmed", F.col(K) % 2 == 0)
    return retention.retain_units(spans, POLICY, F.col(K) % 10 == 0, [K, "start"]).select(K, "type", "start", "retained")


@query("r4_page_review", f"""{_MIX}, {_KEYED}, f AS (SELECT type, value, arg_min(sure, {K} * 1000 + start) AS first_sure FROM k GROUP BY type, value)
SELECT {K}, type, start, NOT ({K} % 5 = 0 AND type = 'PHONE') AND type <> 'URL' AND CASE WHEN type = 'EMAIL' AND value = 'c1@ex.fr' THEN false ELSE first_sure END AS retained FROM k JOIN f USING (type, value)""")
def r4_pages(spark, sf_dir):
    spans = mixed_spans(spark, sf_dir).withColumn("confirmed", F.col(K) % 2 == 0)
    out = spans.where((F.col(K) % 5 == 0) & (F.col("type") == "PHONE")).select(K, "start")
    return retention.retain_occurrences(spans, POLICY, [K, "start"], out, [K, "start"]).select(K, "type", "start", "retained")


@query("r5_reviewed_texts", f"{_MIX}, keepers AS (SELECT * FROM tagged WHERE {_RETAINED}) SELECT m.{K}, m.masked, t.text FROM ({O.masked(_CUSTOMER['mixed'], K).replace('FROM kept k', 'FROM keepers k')}) m JOIN {_CUSTOMER['mixed']} t ON t.{K} = m.{K}")
def r5(spark, sf_dir):
    """The reviewed spans masked in a copy; the text itself stays."""
    found = detect(derived(spark, sf_dir, "mixed"), MIXED)
    kept = F.filter("spans", lambda x: POLICY.type_on(x["type"]) & POLICY.value_on(x["type"], x["value"], x["confirmed"]))
    return found.select(K, "text", merge.mask(F.col("text"), kept, MIXED.referential).alias("masked"))


@query("p7_page", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def p7(spark, sf_dir):
    return retention.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 2, ["o_orderkey"])


@query("p7_page_count", "SELECT CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM orders")
def p7_count(spark, sf_dir):
    return retention.page_count(table(spark, sf_dir, "orders"))


@query("s3_delimiter_vote", "SELECT c_nationkey, CASE c_nationkey % 4 WHEN 0 THEN ';' WHEN 1 THEN '|' WHEN 2 THEN chr(9) ELSE ',' END AS delimiter FROM customer GROUP BY c_nationkey")
def s3(spark, sf_dir):
    sep = F.element_at(F.array(*map(F.lit, (";", "|", "\t", ","))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return delimiter_votes(table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws("#", F.col(K).cast("string"), "c_mktsegment").alias("x"), sep.alias("s")).select("c_nationkey", F.concat("x", "s", F.lit("a"), "s", F.lit("b")).alias("line")), "c_nationkey")


# Pages of words: conversations are documents, turns are pages.
_WORDS = """w AS (SELECT conv_id AS doc_id, turn AS page, i, word AS text, (i - 1) // 50 AS block, ((i - 1) % 50) // 10 AS line, (i - 1) % 10 AS word_no,
  CASE WHEN ((i - 1) // 50) % 3 = 2 THEN 500.0 + 12 * (((i - 1) % 50) // 10) ELSE 50.0 + 40 * ((i - 1) % 10) END AS x0,
  CASE WHEN ((i - 1) // 50) % 3 = 2 THEN 30.0 * ((i - 1) % 10) ELSE 100.0 * (20 - (i - 1) // 50) + 12 * (((i - 1) % 50) // 10) END AS y0
  FROM (SELECT conv_id, turn, unnest(parts) AS word, generate_subscripts(parts, 1) AS i FROM (SELECT conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS parts FROM conversations))),
wb AS (SELECT *, x0 + CASE WHEN block % 3 = 2 THEN 10 ELSE 30 END AS x1, y0 + CASE WHEN block % 3 = 2 THEN 30 ELSE 10 END AS y1 FROM w),
b AS (SELECT *, 2 * coalesce(sum(CASE WHEN length(text) >= 2 THEN CAST(y1 - y0 > x1 - x0 AS INTEGER) END) OVER p, 0) > coalesce(sum(CAST(length(text) >= 2 AS INTEGER)) OVER p, 0) AS vertical,
  min(x0) OVER p AS bx, min(y0) OVER p AS byy FROM wb WINDOW p AS (PARTITION BY doc_id, page, block)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY vertical, CASE WHEN vertical THEN bx ELSE round_even(byy / 10, 0) * 10 END, CASE WHEN vertical THEN byy ELSE bx END, block, line, word_no) AS place FROM b),
s AS (SELECT *, CASE WHEN lag(place) OVER q IS NULL THEN '' WHEN lag(block) OVER q <> block OR lag(line) OVER q <> line THEN chr(10) ELSE ' ' END AS sep FROM o WINDOW q AS (PARTITION BY doc_id, page ORDER BY place)),
c AS (SELECT *, CAST(sum(length(sep) + length(text)) OVER (PARTITION BY doc_id, page ORDER BY place) AS INTEGER) AS char_end FROM s)"""


def page_word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_remove(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), "")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(parts).alias("i", "text"))
    block, line, word = F.floor(F.col("i") / 50), F.floor(F.col("i") % 50 / 10), F.col("i") % 10
    upright = block % 3 == 2
    rows = rows.select("doc_id", "page", "text", block.alias("block"), line.alias("line"), word.alias("word_no"),
                       F.when(upright, 500.0 + 12 * line).otherwise(50.0 + 40 * word).cast("double").alias("x0"), F.when(upright, 30.0 * word).otherwise(100.0 * (20 - block) + 12 * line).cast("double").alias("y0"), upright.alias("u"))
    return rows.withColumns({"x1": F.col("x0") + F.when(F.col("u"), 10).otherwise(30), "y1": F.col("y0") + F.when(F.col("u"), 30).otherwise(10)}).drop("u")


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_words(layout.reading_order(page_word_rows(spark, sf_dir)))


@query("s12_reading_order", f"WITH {_WORDS} SELECT doc_id, page, CAST(place AS INTEGER) AS place, text, vertical FROM o")
def s12(spark, sf_dir):
    return layout.reading_order(page_word_rows(spark, sf_dir)).select("doc_id", "page", "place", "text", "vertical")


@query("s13_page_text", f"WITH {_WORDS} SELECT doc_id, page, string_agg(sep || text, '' ORDER BY place) AS text, count(*) AS n FROM c GROUP BY doc_id, page")
def s13(spark, sf_dir):
    return layout.page_texts(placed_words(spark, sf_dir)).select("doc_id", "page", "text", F.size("words").cast("long").alias("n"))


@query("s11_native_documents", "SELECT conv_id AS doc_id, bool_or(length(trim(text)) >= 10) AS native FROM conversations GROUP BY conv_id")
def s11(spark, sf_dir):
    return layout.native_documents(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))


@query("k7_document_text", "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def k7(spark, sf_dir):
    return layout.document_texts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


_AT = "CAST(CAST(x0 AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(y0 AS INTEGER) AS VARCHAR)"


def _listed(rects: Column) -> Column:
    return F.array_join(F.transform(rects, lambda r: F.concat(r["x0"].cast("int").cast("string"), F.lit(":"), r["y0"].cast("int").cast("string"))), ",")


@query("m8_span_rects", f"WITH {_WORDS} SELECT doc_id, page, string_agg({_AT}, ',' ORDER BY place) AS rects FROM c WHERE char_end - length(text) < 40 + 15 * page AND 10 + 15 * page < char_end GROUP BY doc_id, page")
def m8(spark, sf_dir):
    pages, start = layout.page_texts(placed_words(spark, sf_dir)), F.lit(10) + 15 * F.col("page")
    return pages.select("doc_id", "page", merge.rects_of(F.col("words"), start, start + 30).alias("r")).where(F.size("r") > 0).select("doc_id", "page", _listed(F.col("r")).alias("rects"))


_TWO = "(char_end - length(text) < 40 AND 10 < char_end)", "(char_end - length(text) < 60 AND 30 < char_end)"


def _two_spans(page: Column) -> Column:
    one = lambda a, b: F.struct(F.lit("EMAIL"), F.lit("v"), F.lit(a), F.lit(b), F.lit("manual"), F.lit(1.0), F.lit(True), F.lit(0))
    return F.array(one(10, 40), one(30, 60)).cast(SPANS)


@query("o6_distinct_rects", f"WITH {_WORDS} SELECT doc_id, page, string_agg({_AT}, ',' ORDER BY place) AS rects FROM c WHERE {_TWO[0]} OR {_TWO[1]} GROUP BY doc_id, page")
def o6(spark, sf_dir):
    pages = layout.page_texts(placed_words(spark, sf_dir))
    rects = pages.select("doc_id", "page", merge.rects_of_all(F.col("words"), _two_spans(F.col("page"))).alias("r")).where(F.size("r") > 0)
    return rects.select("doc_id", "page", _listed(F.col("r")).alias("rects"))


@query("a6_rects_by_page", f"""WITH {_WORDS}, q AS (SELECT doc_id, page, place, x0, y0 FROM c WHERE ({_TWO[0]} AND page % 2 = 0) OR {_TWO[1]}
UNION ALL SELECT DISTINCT conv_id, 0, 1000000000, 1.0, 2.0 FROM conversations) SELECT doc_id, page, string_agg({_AT}, ',' ORDER BY place) AS rects FROM q GROUP BY doc_id, page""")
def a6(spark, sf_dir):
    """Rectangles to black out: the first of two spans is retained on even pages only, the first page has a drawn one."""
    spans = layout.page_texts(placed_words(spark, sf_dir)).select("doc_id", "page", "words", F.explode(_two_spans(F.col("page"))).alias("s"))
    rows = spans.select("doc_id", "page", F.col("s.start").alias("start"), merge.rects_of(F.col("words"), F.col("s.start"), F.col("s.end")).alias("rects"), ((F.col("page") % 2 == 0) | (F.col("s.start") == 30)).alias("retained"))
    drawn = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit(0).cast("long").alias("page"), F.struct(F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.0).alias("y1")).alias("rect"))
    found = retention.rects_by_page(rows, drawn, ["start"]).where(F.size("rects") > 0)
    return found.select("doc_id", "page", _listed(F.col("rects")).alias("rects"))


@query("s14_page_counts", "SELECT conv_id AS doc_id, count(DISTINCT turn) AS pages FROM conversations GROUP BY conv_id")
def s14(spark, sf_dir):
    return layout.page_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")))


@query("j3_propagate", f"""WITH {_WORDS}, n AS (SELECT doc_id, page, place, lower(strip_accents(text)) AS k, char_end - length(text) AS a, char_end AS b FROM c),
t AS (SELECT doc_id, k AS k1, k2, arg_min(v, page) AS value FROM (SELECT x.doc_id, x.page, x.k, y.k AS k2, x.v || ' ' || y.v AS v FROM (SELECT n.*, c.text AS v FROM n JOIN c USING (doc_id, page, place)) x
  JOIN (SELECT n.*, c.text AS v FROM n JOIN c USING (doc_id, page, place)) y ON x.doc_id = y.doc_id AND x.page = y.page AND x.place = 1 AND y.place = 2) GROUP BY doc_id, k, k2),
h AS (SELECT x.doc_id, x.page, x.place, t.value, x.a, y.b, t.k1, t.k2 FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.page = y.page AND y.place = x.place + 1 JOIN t ON t.doc_id = x.doc_id AND t.k1 = x.k AND t.k2 = y.k)
SELECT doc_id, page, value, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS stop FROM h WHERE k1 <> k2""")
def j3(spark, sf_dir):
    placed = placed_words(spark, sf_dir)
    pair = placed.where("place <= 2").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda w: w["text"]), " ").alias("value"), F.count("*").alias("n")).where("n = 2")
    pair = pair.where(F.get(F.split(V.normalize(F.col("value")), " "), 0) != F.get(F.split(V.normalize(F.col("value")), " "), 1))
    spans = pair.select("doc_id", "page", F.lit(0).alias("seq"), F.lit("PERSON").alias("type"), "value", F.lit(True).alias("confirmed"))
    found = layout.propagated(placed, layout.propagation_targets(spans))
    return found.select("doc_id", "page", F.col("span.value").alias("value"), F.col("span.start").alias("start"), F.col("span.end").alias("stop"))


@query("j4_types_join", f"{_MIX}, d AS (SELECT * FROM (VALUES ('EMAIL', 'Haute'), ('PHONE', 'Haute'), ('SIREN', 'Moyenne'), ('URL', 'Basse')) v(type, sensitivity)) SELECT sensitivity, count(*) AS n FROM tagged JOIN d USING (type) GROUP BY sensitivity")
def j4(spark, sf_dir):
    types = _ONLY.to_dataframe(spark).select(F.col("code").alias("type"), "sensitivity")
    return mixed_spans(spark, sf_dir).join(F.broadcast(types), "type").groupBy("sensitivity").agg(F.count("*").alias("n"))


@query("o8_distinct_texts", "SELECT md5(text) AS text_md5, count(*) AS units FROM documents GROUP BY text")
def o8(spark, sf_dir):
    return distinct_texts(table(spark, sf_dir, "documents").select("text")).select(F.md5("text").alias("text_md5"), "units")


@query("d20_manual_span", f"SELECT {K}, type, value, start, stop FROM {O.spans(_CUSTOMER['mixed'], K, O.EMAIL, 'EMAIL')} WHERE {K} % 2 = 0 UNION ALL SELECT {K}, 'PERSON', 'x', 0, 40 FROM customer WHERE {K} % 2 = 1 UNION ALL SELECT {K}, 'ORG', 'y', 200, 210 FROM customer")
def d20(spark, sf_dir):
    """Of two hand-drawn spans one meets an address, which is stronger, on every second row."""
    rows = derived(spark, sf_dir, "mixed").withColumn("spans", F.filter(detectors.deterministic(F.col("text"), "EMAIL"), lambda s: F.col(K) % 2 == 0))
    one = lambda t, v, a, b: F.struct(F.lit(t), F.lit(v), F.lit(a), F.lit(b), F.lit("manual"), F.lit(1.0), F.lit(True), F.lit(0))
    return _rows(rows, K, merge.with_manual(F.col("spans"), F.array(one("PERSON", "x", 0, 40), one("ORG", "y", 200, 210)).cast(SPANS)), *BASE)


@query("j1_cached_detection", f"{_with(_DOCS, 'doc_id')} SELECT doc_id, count(*) AS n FROM tagged GROUP BY doc_id")
def j1(spark, sf_dir):
    from spanloom.plans.pipeline import anonymize_distinct

    found = anonymize_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), MIXED)
    return found.where(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("n"))


@query("d10_page_urls", f"SELECT page_id, type, value, start, stop FROM {O.spans('(SELECT page_id, url FROM pages)', 'page_id', 'https?://[^ ]+', 'URL', text='url')}")
def d10_pages(spark, sf_dir):
    return _rows(table(spark, sf_dir, "pages"), "page_id", detectors.deterministic(F.col("url"), "URL"), *BASE)


@query("d19_literals", f"SELECT doc_id, type, value, start, stop FROM {O.spans(_DOCS, 'doc_id', 'the', 'ORG')}")
def literals(spark, sf_dir):
    return _rows(table(spark, sf_dir, "documents"), "doc_id", literal_spans(F.col("text"), "the", "ORG", "ner"), *BASE)


#: All types whose spans need no model.
EVERY = Config(Referential().with_overrides(BIC=True, URL=True, POSTAL_CODE=True))


@query("m4_document_spans")
def m4_documents(spark, sf_dir):
    """Every detector over whole documents; their Unicode patterns are beyond the SQL engine's, so plain Python checks them."""
    return _rows(detect(table(spark, sf_dir, "documents").select("doc_id", "text"), EVERY), "doc_id", F.col("spans"), *BASE, "source", "confirmed")


@query("a1_document_audit")
def a1_documents(spark, sf_dir):
    found = exploded(detect(table(spark, sf_dir, "documents").select("doc_id", "text"), EVERY), ["doc_id"])
    return audit.audit_counts(found, EVERY.referential)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the sensitive spans of documents."""
    return anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", Config()).audit
