"""Registry of the engine's own queries over the standard tables, and the SQL that states each of them.

Every query applies an operator to a whole table; texts that the tables lack (sections, dates, phone numbers) are made from
columns by the same rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as X
from ..operators import confidence, extract, merge, validate
from ..operators.paths import PathError, parse
from ..operators.project import ProjectionConfig, ProjectionField, config_issues, project, read_config
from ..shared import settled
from ..sources import records
from . import pipeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(values: list[str], number: Column) -> Column:
    """One of the values by number modulo their count."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def sql_choice(values: list[str], number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[1 + {number} % {len(values)}]"


# Extraction

_SQL_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_SQL_WS}+|{_SQL_WS}+$', '', 'g')"



def _first_spellings(column: str) -> str:
    """DuckDB: from (doc_id, ms list) the first spelling of each text, lower-cased keys, in order."""
    return f"list_filter({column}, lambda x, i: list_position(list_transform({column}, lambda y: lower(y)), lower(x)) = i)"


@query(rf"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}'), lambda x: {_sql_trim("x")}) AS ms FROM documents),
k AS (SELECT doc_id, {_first_spellings("ms")} AS v FROM d)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n, array_to_string(v, '|') AS emails FROM k WHERE len(v) > 0""")
def extract_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", extract.emails_of(F.col("text")).alias("v")).where(F.size("v") > 0)
    return d.select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("emails"))


@query(rf"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\+?[0-9](?:[0-9().-]|{_SQL_WS}){{7,}}[0-9]'), lambda x: {_sql_trim("x")}) AS ms FROM documents),
k AS (SELECT doc_id, list_filter({_first_spellings("ms")}, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS v FROM d)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n, array_to_string(v, '|') AS phones FROM k WHERE len(v) > 0""")
def extract_phones(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", extract.phones_of(F.col("text")).alias("v")).where(F.size("v") > 0)
    return d.select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("phones"))


@query(rf"""
WITH d AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_trim("x")}), lambda x: x <> '') AS ls FROM conversations)
SELECT conv_id, turn, CAST(len(ls) AS BIGINT) AS n_lines, array_to_string(ls, '|') AS lines FROM d""")
def line_split(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.lines_of(F.col("text")).alias("ls"))
    return d.select("conv_id", "turn", F.size("ls").cast("long").alias("n_lines"), F.array_join("ls", "|").alias("lines"))


@query(rf"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_trim("x")}), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, list_filter(ls[1:12], lambda x: lower(x) NOT IN ('resume','curriculum vitae','contact','experience','education','skills','summary') AND length(x) <= 80
  AND regexp_full_match(x, '[A-Za-z][A-Za-z.''-]*(?:{_SQL_WS}+[A-Za-z][A-Za-z.''-]*){{1,3}}'))[1] AS name FROM d""")
def name_line(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", extract.lines_of(F.col("text")).alias("ls"))
    return d.select("doc_id", extract.name_of(F.col("ls")).alias("name"))


def _resume_lines() -> Column:
    p = F.col("p_name")
    text = F.concat(p, F.lit("\n\n Experience \n"), p, F.lit(" (Mar 2021 - now)\n\nBuilt "), F.col("p_type"), F.lit("\nEducation\nUniversity of "), p, F.lit("\nSkills\n-- "), p, F.lit("; "), F.col("p_brand"), F.lit(" , -x,"), F.lower("p_brand"), F.lit("| "), F.col("p_type"), F.lit("\nReferences\n7"))
    return extract.lines_of(text)


_RESUME_SQL = rf"""
WITH t AS (SELECT p_partkey, p_name || chr(10) || chr(10) || ' Experience ' || chr(10) || p_name || ' (Mar 2021 - now)' || chr(10) || chr(10) || 'Built ' || p_type || chr(10) || 'Education' || chr(10) || 'University of ' || p_name || chr(10)
  || 'Skills' || chr(10) || '-- ' || p_name || '; ' || p_brand || ' , -x,' || lower(p_brand) || '| ' || p_type || chr(10) || 'References' || chr(10) || '7' AS text FROM part),
l AS (SELECT p_partkey, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_trim("x")}), lambda x: x <> '') AS ls FROM t),
s AS (SELECT p_partkey, ls, list_position(list_transform(ls, lambda x: lower(x)), 'experience') AS a, list_position(list_transform(ls, lambda x: lower(x)), 'education') AS b, list_position(list_transform(ls, lambda x: lower(x)), 'skills') AS c FROM l)"""


@query(_RESUME_SQL + r""" SELECT p_partkey, array_to_string(ls[a + 1 : b - 1], chr(10)) AS summary FROM s
WHERE regexp_matches(array_to_string(ls[a + 1 : b - 1], chr(10)), '(?i)\b((19|20)\d{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b')""")
def section_experience(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", _resume_lines().alias("ls"))
    return d.select("p_partkey", F.explode(extract.experience_of(F.col("ls"))).alias("summary"))


@query(_RESUME_SQL + r""" SELECT p_partkey, list_filter(ls[b + 1 : c - 1], lambda x: regexp_matches(x, '(?i)\b(university|college|school|institute|academy|polytechnic)\b'))[1] AS institution FROM s""")
def section_education(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", _resume_lines().alias("ls"))
    return d.select("p_partkey", F.explode(extract.institutions_of(F.col("ls"))).alias("institution"))


@query(
    _RESUME_SQL
    + rf""", k AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(array_to_string(ls[c + 1 :], chr(10)), '[,;|•\n]'),
  lambda x: {_sql_trim("regexp_replace(regexp_replace(x, '^[•*-]+', ''), '" + _SQL_WS + "+', ' ', 'g')")}), lambda x: length(x) BETWEEN 2 AND 48 AND regexp_matches(x, '[A-Za-z]')) AS v FROM s)
SELECT p_partkey, array_to_string({_first_spellings("v")}, '|') AS skills FROM k"""
)
def section_skills(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", _resume_lines().alias("ls"))
    return d.select("p_partkey", F.array_join(extract.skills_of(F.col("ls")), "|").alias("skills"))


def _customer_records(c: DataFrame) -> DataFrame:
    """Structured records of customers, as JSON texts; some lack fields, some are broken."""
    k = F.col("c_custkey")
    record = F.to_json(
        F.struct(
            k.alias("id"),
            F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("full_name"),
            F.concat(F.lit("C "), F.col("c_name")).alias("name"),
            F.when(k % 5 != 0, F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@example.com"))).alias("email"),
            F.concat(F.lit("+1 415 555 "), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
            F.when(k % 2 == 0, F.col("c_mktsegment")).alias("current_company"),
        )
    )
    text = F.when(k % 97 == 0, F.lit("{broken")).when(k % 89 == 0, F.lit('{"id": null}')).when(k % 83 == 0, F.lit(" ")).otherwise(record)
    return c.select(k.cast("string").alias("candidate_key"), F.concat(F.lit("ats:"), k.cast("string"), F.lit(".json")).alias("source_id"), F.lit("ats_json").alias("source_kind"), F.lit(1).alias("source_order"), F.lit("2026-01-01T00:00:00.000Z").alias("ingested_at"), text.alias("text"))


_RECORD_SQL = """
WITH c AS (SELECT *, c_custkey % 97 = 0 AS b1, c_custkey % 89 = 0 AS b2, c_custkey % 83 = 0 AS b3 FROM customer),
g AS (SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, 'ats:' || CAST(c_custkey AS VARCHAR) || '.json' AS source_id, c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'C ' || c_name ELSE c_name END AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE 'full_name' END AS name_field,
  CASE WHEN c_custkey % 5 <> 0 THEN lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.com' END AS email,
  '+1 415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS company
  FROM c WHERE NOT (b1 OR b2 OR b3)),
f AS (SELECT candidate_key, source_id, 1 AS k, 'full_name' AS field_path, full_name AS value, 'ats field ' || name_field AS evidence FROM g
  UNION ALL SELECT candidate_key, source_id, 2, 'emails[0]', email, 'ats field email' FROM g WHERE email IS NOT NULL
  UNION ALL SELECT candidate_key, source_id, 3, 'phones[0]', phone, 'ats field phone' FROM g
  UNION ALL SELECT candidate_key, source_id, 4, 'experience[0].company', company, 'ats field current_company' FROM g WHERE company IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) AS o FROM f)"""


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, 'ATS_JSON_PARSE_FAILED' AS code,
  CASE WHEN c_custkey % 97 = 0 THEN 'ATS input is not valid JSON.' WHEN c_custkey % 89 = 0 THEN 'ATS input schema validation failed: id' ELSE 'ATS input string is empty.' END AS message
FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0 OR c_custkey % 83 = 0""")
def structured_parse_errors(spark, sf_dir):
    _, errors = records.parse_structured(_customer_records(table(spark, sf_dir, "customer")))
    return errors.select("candidate_key", "code", "message")


@query(_RECORD_SQL + """ SELECT candidate_key, source_id || ':' || field_path || ':' || lpad(CAST(o AS VARCHAR), 4, '0') AS fact_id, field_path, value, CAST(o AS INTEGER) AS extraction_order, evidence FROM n""")
def unpivot_facts(spark, sf_dir):
    good, _ = records.parse_structured(_customer_records(table(spark, sf_dir, "customer")))
    return extract.structured_facts(good).select("candidate_key", "fact_id", "field_path", "value", "extraction_order", "evidence")


@query(_RECORD_SQL + """ SELECT candidate_key, candidate_key AS candidate_reference, email, company FROM g""")
def structured_records(spark, sf_dir):
    good, _ = records.parse_structured(_customer_records(table(spark, sf_dir, "customer")))
    return good.select("candidate_key", "candidate_reference", "email", F.col("current_company").alias("company"))


@query("""
WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS candidate_key, 'resume:' || CAST(c_custkey AS VARCHAR) || '.txt' AS source_id FROM customer),
f AS (SELECT candidate_key, source_id, 1 AS o, 'full_name' AS field_path, 'Pat Doe' AS value, 'regex full-name line' AS evidence FROM c
  UNION ALL SELECT candidate_key, source_id, 2, 'emails[]', lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.com', 'regex email' FROM c
  UNION ALL SELECT candidate_key, source_id, 3, 'phones[]', '+1 415-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'regex phone' FROM c
  UNION ALL SELECT candidate_key, source_id, 4, 'experience[0].summary', 'Acme ' || c_mktsegment || ' (Mar 2021 - Present)', 'explicit experience block' FROM c
  UNION ALL SELECT candidate_key, source_id, 5, 'education[0].institution', 'University of ' || c_mktsegment, 'explicit education institution line' FROM c
  UNION ALL SELECT candidate_key, source_id, 6 + i, 'skills[' || CAST(i AS VARCHAR) || '].name', ['JS', 'TS', c_mktsegment][i + 1], 'explicit skills section' FROM c, range(3) r(i))
SELECT candidate_key, source_id || ':' || field_path || ':' || lpad(CAST(o AS VARCHAR), 4, '0') AS fact_id, field_path, value, evidence, CAST(o AS INTEGER) AS extraction_order, 0.45::DOUBLE AS confidence FROM f""")
def resume_emission(spark, sf_dir):
    good, _ = records.parse_resumes(customer_sources(spark, sf_dir))
    return extract.resume_facts(good).select("candidate_key", "fact_id", "field_path", "value", "evidence", "extraction_order", "confidence")


@query(rf"""
WITH t AS (SELECT doc_id, replace(chr(13) || chr(10) || ' ' || coalesce(text, '') || '  ' || chr(13) || chr(10) || chr(9) || 'end ', chr(13) || chr(10), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, {_sql_trim(f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SQL_WS}+$', '')), chr(10))")} AS c FROM t)
SELECT doc_id, CAST(length(c) AS BIGINT) AS n, sha256(c) AS digest FROM l""")
def clean_text(spark, sf_dir):
    text = F.concat(F.lit("\r\n "), F.coalesce("text", F.lit("")), F.lit("  \r\n\tend "))
    d = table(spark, sf_dir, "documents").select("doc_id", records.clean_document(text).alias("c"))
    return d.select("doc_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest"))


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, o_orderkey % 3 AS source_order, 'o' || CAST(o_orderkey AS VARCHAR) AS fact_id FROM orders)
SELECT fact_id, CAST(row_number() OVER (PARTITION BY candidate_key ORDER BY source_order, fact_id) AS INTEGER) AS extraction_order FROM o""")
def fact_ordinal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.select(
        F.col("o_custkey").cast("string").alias("candidate_key"), (F.col("o_orderkey") % 3).cast("int").alias("source_order"), F.lit("s").alias("source_id"), F.lit("ats_json").alias("source_kind"), F.lit(1).alias("extraction_order"),
        F.lit("p").alias("field_path"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("fact_id"),
    )
    return extract.collect_facts(facts).select("fact_id", "extraction_order")


@query("""
SELECT DISTINCT CAST(c_custkey * 2 AS VARCHAR) AS candidate_key, 'PIPELINE_SOURCES_EMPTY' AS code FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey * 2)""")
def source_gate(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("string").alias("candidate_key"))
    loaded = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate_key"))
    return records.missing_sources(asked, loaded).select("candidate_key", "code")


# Merge

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END"


def _fact_rows(rows: DataFrame, key: Column, path: Column, value: Column, order: Column, kind: Column | None = None, conf: Column | None = None) -> DataFrame:
    kind = F.lit("ats_json") if kind is None else kind
    return rows.select(
        key.cast("string").alias("candidate_key"), F.concat_ws(":", F.lit("f"), order.cast("string")).alias("fact_id"), path.alias("field_path"), kind.alias("source_kind"), F.concat(kind, F.lit(":x")).alias("source_id"),
        F.when(kind == "ats_json", "structured_field_map").otherwise("regex_match").alias("extraction_method"), value.alias("original_value"), value.alias("value"), F.lit("primitive").alias("value_kind"),
        (F.lit(0.6) if conf is None else conf).alias("confidence"), F.when(kind == "ats_json", 1).otherwise(2).alias("source_order"), order.cast("int").alias("extraction_order"), F.lit("2026-01-01T00:00:00Z").alias("extracted_at"),
        F.lit("e").alias("evidence"),
    )


def _headlines(o: DataFrame, value: Column) -> DataFrame:
    """Orders as facts that compete for their customer's headline: status decides the source, price the confidence."""
    kind = F.when(F.col("o_orderstatus") == "F", "ats_json").when(F.col("o_orderstatus") == "O", "resume_pdf").otherwise("other")
    merged = merge.merge_facts(_fact_rows(o, F.col("o_custkey"), F.lit("headline"), value, F.col("o_orderkey"), kind, F.col("o_totalprice").cast("double")))
    price = F.get(F.filter("seeds", lambda s: s["path"] == "headline"), F.lit(0))["confidence"]
    return merged.select("candidate_key", F.col("headline").alias("value"), price.alias("price"))


_WINNER = f"""SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, v AS value, CAST(o_totalprice AS DOUBLE) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_STATUS} DESC, o_totalprice DESC, coalesce(v, 'null'), o_orderkey) AS r FROM (SELECT *, {{0}} AS v FROM orders)) WHERE r = 1"""


@query(_WINNER.format("o_orderpriority"))
def winner_scalar(spark, sf_dir):
    return _headlines(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


@query(_WINNER.format("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"))
def winner_null_wins(spark, sf_dir):
    return _headlines(table(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type || ' ' END AS v FROM events),
k AS (SELECT user_id, event_id, trim(v) AS v, lower(trim(v)) AS key FROM e WHERE trim(v) <> ''),
g AS (SELECT user_id, key, min(event_id) AS first, arg_min(v, event_id) AS name, count(*) AS n FROM k GROUP BY user_id, key)
SELECT CAST(user_id AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS slot, name, n FROM g""")
def dedup_first_seen(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    value = F.when(i % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    merged = merge.merge_facts(_fact_rows(e, F.col("user_id"), F.concat(F.lit("skills["), i.cast("string"), F.lit("]")), value, i))
    skills = merged.select("candidate_key", F.posexplode("skills").alias("slot", "s"))
    return skills.select("candidate_key", F.col("slot").cast("long").alias("slot"), "s.name", F.size("s.sources").cast("long").alias("n"))


@query("""
WITH p AS (SELECT page_id, page_id % 7 AS g, CASE WHEN page_id % 2 = 0 THEN url || '//' ELSE url END AS u FROM pages),
k AS (SELECT g, page_id, u, regexp_replace(lower(u), '/+$', '') AS key FROM p WHERE u IS NOT NULL AND trim(u) <> ''),
f AS (SELECT g, key, min(page_id) AS first, arg_min(u, page_id) AS link FROM k GROUP BY g, key)
SELECT CAST(g AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY g ORDER BY first) - 1 AS slot, link FROM f""")
def dedup_links(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(i % 2 == 0, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    merged = merge.merge_facts(_fact_rows(p, i % 7, F.lit("links.other[]"), url, i))
    return merged.select("candidate_key", F.posexplode("links.other").alias("slot", "link")).select("candidate_key", F.col("slot").cast("long").alias("slot"), "link")


@query("""
WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type)
SELECT CAST(user_id AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS slot, event_type AS field FROM e""")
def provenance_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    merged = merge.merge_facts(_fact_rows(e, F.col("user_id"), F.col("event_type"), F.col("event_type"), F.col("event_id")))
    return merged.select("candidate_key", F.posexplode("provenance").alias("slot", "p")).select("candidate_key", F.col("slot").cast("long").alias("slot"), F.col("p.fieldPath").alias("field"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, 'c' || CAST(l_partkey AS VARCHAR) AS company, 't' || CAST(l_suppkey AS VARCHAR) AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
w AS (SELECT l_orderkey, l_linenumber, min(company) AS company, min(title) AS title FROM f GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS slot, company, title FROM w""")
def pivot_experience(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    at = lambda rest: F.concat(F.lit("experience["), (F.col("l_linenumber") * 3).cast("string"), F.lit(f"].{rest}"))
    facts = _fact_rows(line, F.col("l_orderkey"), at("company"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")), F.lit(1))
    facts = facts.unionByName(_fact_rows(line, F.col("l_orderkey"), at("title"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")), F.lit(2)))
    merged = merge.merge_facts(facts).select("candidate_key", F.posexplode("experience").alias("slot", "e"))
    return merged.select("candidate_key", F.col("slot").cast("long").alias("slot"), "e.company", "e.title")


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, min('i' || CAST(l_partkey AS VARCHAR)) AS institution, min(CAST(1990 + l_suppkey % 30 AS VARCHAR)) AS y FROM lineitem GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS slot, institution, CAST(y AS DOUBLE) AS end_year FROM w""")
def pivot_education(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    at = lambda rest: F.concat(F.lit("education["), F.col("l_linenumber").cast("string"), F.lit(f"].{rest}"))
    facts = _fact_rows(line, F.col("l_orderkey"), at("institution"), F.concat(F.lit("i"), F.col("l_partkey").cast("string")), F.lit(1))
    facts = facts.unionByName(_fact_rows(line, F.col("l_orderkey"), at("end_year"), (1990 + F.col("l_suppkey") % 30).cast("string"), F.lit(2)))
    merged = merge.merge_facts(facts).select("candidate_key", F.posexplode("education").alias("slot", "e"))
    return merged.select("candidate_key", F.col("slot").cast("long").alias("slot"), "e.institution", F.col("e.endYear").alias("end_year"))


@query("""
WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END AS id FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, coalesce(CAST(min(id) AS VARCHAR), 'ats_json:x') AS candidate_id FROM f GROUP BY o_custkey""")
def candidate_id_fallback(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    facts = _fact_rows(o, F.col("o_custkey"), F.when(key % 11 == 0, "candidate_id").otherwise("headline"), key.cast("string"), key)
    return merge.merge_facts(facts).select("candidate_key", F.col("candidateId").alias("candidate_id"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, lower(o_orderpriority) AS key, o_orderpriority AS v FROM orders),
b AS (SELECT o_custkey, key, min(o_orderkey) AS first, arg_min(v, o_orderkey) AS name, count(*) AS n FROM f GROUP BY 1, 2)
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, row_number() OVER (PARTITION BY o_custkey ORDER BY first) - 1 AS slot, name, n FROM b""")
def merge_skills(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("skills["), F.col("o_orderkey").cast("string"), F.lit("].name"))
    merged = merge.merge_facts(_fact_rows(o, F.col("o_custkey"), path, F.col("o_orderpriority"), F.col("o_orderkey")))
    skills = merged.select("candidate_key", F.posexplode("skills").alias("slot", "s"))
    return skills.select("candidate_key", F.col("slot").cast("long").alias("slot"), "s.name", F.size("s.sources").cast("long").alias("n"))


@query("""
WITH p AS (SELECT o_custkey, count(DISTINCT lower(o_orderpriority)) AS n FROM orders GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, 'emails[' || CAST(i AS VARCHAR) || ']' AS path FROM p, range(5) r(i) WHERE i < n
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'full_name' FROM p""")
def field_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = _fact_rows(o, F.col("o_custkey"), F.lit("emails[]"), F.col("o_orderpriority"), F.col("o_orderkey"))
    facts = facts.unionByName(_fact_rows(o, F.col("o_custkey"), F.lit("fullName"), F.col("o_orderstatus"), F.col("o_orderkey")))
    return merge.merge_facts(facts).select("candidate_key", F.explode(confidence.scorable_fields()).alias("path"))


# Confidence

_COUNTS = """SELECT user_id, event_type, count(*) AS n, count(DISTINCT event_id % 3) AS sources, count(DISTINCT event_id % 4) AS methods FROM events GROUP BY 1, 2"""
_AGREE = "CASE WHEN n <= 1 THEN 0.65::DOUBLE WHEN sources >= 2 AND n = sources AND methods <= 2 THEN 0.9::DOUBLE WHEN sources = 1 AND n > 1 THEN 0.5::DOUBLE WHEN n > sources OR methods >= 3 THEN 0.35::DOUBLE ELSE 0.65::DOUBLE END"


def _counts(spark, sf_dir) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(i % 3).alias("sources"), F.count_distinct(i % 4).alias("methods"))


@query(f"WITH c AS ({_COUNTS}) SELECT user_id, event_type, {_AGREE} AS factor FROM c")
def agreement_factor(spark, sf_dir):
    return _counts(spark, sf_dir).select("user_id", "event_type", confidence.agreement(F.col("n"), F.col("sources"), F.col("methods")).alias("factor"))


_SOURCE, _METHOD = "(CASE WHEN user_id % 2 = 0 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END)", "(CASE WHEN n % 2 = 0 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END)"
_FIELD = f"floor(least(greatest({_SOURCE} * 0.45::DOUBLE + {_METHOD} * 0.35::DOUBLE + {_AGREE} * 0.2::DOUBLE, 0::DOUBLE), 1::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE"


def _field_scores(spark, sf_dir) -> DataFrame:
    c = _counts(spark, sf_dir)
    source, method = F.when(F.col("user_id") % 2 == 0, 0.85).otherwise(0.7), F.when(F.col("n") % 2 == 0, 0.9).otherwise(0.75)
    agree = confidence.agreement(F.col("n"), F.col("sources"), F.col("methods"))
    return c.select("user_id", "event_type", "n", X.round4(confidence.combined(source, method, agree)).alias("score"))


@query(f"WITH c AS ({_COUNTS}) SELECT user_id, event_type, {_FIELD} AS score FROM c")
def field_score(spark, sf_dir):
    return _field_scores(spark, sf_dir).select("user_id", "event_type", "score")


def _scored_customers(spark, sf_dir) -> DataFrame:
    """Profiles of customers, scored: an email and a full name from each order, in turn from either source."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(key % 2 == 0, "ats_json").otherwise("resume_pdf")
    facts = _fact_rows(o, F.col("o_custkey"), F.concat(F.lit("emails["), key.cast("string"), F.lit("]")), F.col("o_orderpriority"), key, kind)
    facts = facts.unionByName(_fact_rows(o, F.col("o_custkey"), F.lit("full_name"), F.col("o_orderstatus"), key, kind))
    return settled(confidence.score_profiles(settled(merge.merge_facts(facts))))


def _sql_mean(first: str, second: str) -> str:
    """Mean of a times one number and b times another, added up in order."""
    return f"list_reduce(list_concat(list_transform(range(a), lambda x: {first}::DOUBLE), list_transform(range(b), lambda x: {second}::DOUBLE)), lambda acc, x: acc + x) / (a + b)::DOUBLE"


_SUPPORT = f"""
WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS b, count(DISTINCT lower(o_orderpriority)) AS m FROM orders GROUP BY 1),
f AS (SELECT o_custkey, 'emails' AS field, a, b, m FROM o UNION ALL SELECT o_custkey, 'full_name', CAST(a > 0 AS BIGINT), CAST(b > 0 AS BIGINT), 1 FROM o),
c AS (SELECT *, a + b AS n, CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS sources, CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS methods FROM f),
p AS (SELECT *, {_sql_mean("0.85", "0.7")} AS s, {_sql_mean("0.9", "0.75")} AS t, {_AGREE} AS agreement FROM c),
v AS (SELECT *, floor(least(greatest(s * 0.45::DOUBLE + t * 0.35::DOUBLE + agreement * 0.2::DOUBLE, 0::DOUBLE), 1::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score FROM p)"""


@query(
    _SUPPORT
    + """ SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, CASE WHEN field = 'emails' THEN i ELSE (SELECT m FROM o WHERE o.o_custkey = v.o_custkey) END AS slot,
  CASE WHEN field = 'emails' THEN 'emails[' || CAST(i AS VARCHAR) || ']' ELSE field END AS path, score, agreement FROM v, range(5) r(i) WHERE i < m"""
)
def field_confidence(spark, sf_dir):
    fields = _scored_customers(spark, sf_dir).select("candidate_key", F.posexplode("fieldConfidence").alias("slot", "f"))
    return fields.select("candidate_key", F.col("slot").cast("long").alias("slot"), F.col("f.fieldPath").alias("path"), F.col("f.score.value").alias("score"), F.col("f.score.agreementWeight").alias("agreement"))


@query(
    _SUPPORT
    + """, w AS (SELECT e.o_custkey, list_append(list_transform(range(e.m), lambda x: e.score * 0.2::DOUBLE), n.score * 0.22::DOUBLE) AS products, list_append(list_transform(range(e.m), lambda x: 0.2::DOUBLE), 0.22::DOUBLE) AS weights
  FROM v e JOIN v n ON e.o_custkey = n.o_custkey AND e.field = 'emails' AND n.field = 'full_name')
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, floor(list_reduce(products, lambda acc, x: acc + x) / list_reduce(weights, lambda acc, x: acc + x) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS overall FROM w"""
)
def overall_confidence(spark, sf_dir):
    return _scored_customers(spark, sf_dir).select("candidate_key", F.col("overallConfidence.value").alias("overall"))


@query("""
WITH f AS (SELECT DISTINCT event_type AS field FROM events), p AS (SELECT DISTINCT user_id, event_type, event_id % 2 AS src FROM events),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, f.field, count(p.src) AS n FROM u CROSS JOIN f LEFT JOIN p ON p.user_id = u.user_id AND p.event_type = f.field GROUP BY 1, 2""")
def field_provenance_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.select(F.col("event_type").alias("field")).distinct()
    users = e.groupBy("user_id").agg(F.collect_set(F.struct(F.upper("event_type").alias("path"), (F.col("event_id") % 2).alias("src"))).alias("provenance"))
    fields = users.crossJoin(kinds)
    return fields.select("user_id", "field", F.size(F.filter("provenance", lambda p: X.match_path(p["path"]) == X.match_path(F.col("field")))).cast("long").alias("n"))


# Normalisers

_COUNTRY_TEXTS = [" United  States. ", "(UK)", "u.s.a.", "Korea, South", "fr", "Atlantis", "", "U A E", "united-kingdom", "Unitedkingdom", "de", "zz"]
_COUNTRY_WANT = ["US", "GB", "US", "KR", "FR", "", "", "AE", "", "", "DE", ""]


@query(f"SELECT n_nationkey, nullif({sql_choice(_COUNTRY_WANT, 'n_nationkey')}, '') AS code FROM nation")
def norm_country(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", N.country(choice(_COUNTRY_TEXTS, F.col("n_nationkey"))).alias("code"))


_SKILL_TEXTS, _SKILL_WANT = [" js ", "Node_JS", "node.js", "Postgres", "C++  Builder", " ", "TYPESCRIPT", "EcmaScript", "node-js", "Rust"], ["JavaScript", "Node.js", "Node.js", "PostgreSQL", "C++ Builder", "", "TypeScript", "JavaScript", "Node.js", "Rust"]


@query(f"SELECT p_partkey, nullif({sql_choice(_SKILL_WANT, 'p_partkey')}, '') AS skill FROM part")
def norm_skill(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.skill(choice(_SKILL_TEXTS, F.col("p_partkey"))).alias("skill"))


_DATE = "strftime(o_orderdate, '%Y-%m')"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL ELSE {_DATE} END AS month FROM orders""")
def norm_date(spark, sf_dir):
    d = F.col("o_orderdate")
    shapes = ["yyyy-MM", "yyyy/M", "MM-yyyy", "MM.yyyy", "MMM yyyy", "yyyy-MM-dd", "MM/dd/yyyy"]
    text = F.lit("Present")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("o_orderkey") % 8 == i, F.concat(F.lit(" "), F.date_format(d, shape))).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.employment_date(text).alias("month"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '+442071' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') END AS phone FROM customer""")
def norm_phone(spark, sf_dir):
    k = F.col("c_custkey")
    four, six = F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k % 1000000).cast("string"), 6, "0")
    text = F.when(k % 4 == 0, F.concat(F.lit("+1 (415) 555-"), four)).when(k % 4 == 1, F.concat(F.lit(" +44 20 71 "), six)).when(k % 4 == 2, F.concat(F.lit("415-555-"), four)).otherwise(F.lit("not-a-phone"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.phone(text).alias("phone"))


_PATHS, _TARGETS = ["phones[]", "contact.phone", "location.country", "experience[3].start", "to", "skills[2].name", "skills", "name", "education[0].field", "skills.level.name"], ["phone", "phone", "country", "date", "date", "skill", "skill", "", "", "skill"]
_VALUES, _DONE = ["+1 415 555 2671", "x", "India", "Mar 2021", "never", "ts", "Go", " as it is ", "2018", "node"], ["+14155552671", "-", "IN", "2021-03", "-", "TypeScript", "Go", " as it is ", "2018", "Node.js"]


@query(f"SELECT l_orderkey, l_linenumber, nullif({sql_choice(_TARGETS, '(l_orderkey + l_linenumber)')}, '') AS target, nullif({sql_choice(_DONE, '(l_orderkey + l_linenumber)')}, '-') AS value FROM lineitem")
def norm_dispatch(spark, sf_dir):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    target = N.target_of(choice(_PATHS, k))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", target.alias("target"), N.by_target(target, choice(_VALUES, k)).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, 'experience[].end_year[]' AS merge_path, 'experience[].endyear[]' AS match_path FROM lineitem""")
def path_normalise(spark, sf_dir):
    path = F.concat(F.lit(" Experience["), F.col("l_linenumber").cast("string"), F.lit("].End_Year["), F.col("l_orderkey").cast("string"), F.lit("] "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.merge_path(path).alias("merge_path"), X.match_path(path).alias("match_path"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END, 'null') AS text, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN event_id WHEN 2 THEN 1500 WHEN 3 THEN 255 END AS DOUBLE) AS number FROM events""")
def stable_serialise(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.lit("  ")).when(i % 5 == 1, F.concat(F.lit(" "), i.cast("string"))).when(i % 5 == 2, F.lit("1.5e3")).when(i % 5 == 3, F.lit("0xFF")).otherwise(F.lit("Infinity"))
    return table(spark, sf_dir, "events").select("event_id", X.serialised(F.when(i % 4 != 0, F.col("event_type"))).alias("text"), X.to_number(text).alias("number"))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, 'f:' || CAST(o_orderkey AS VARCHAR) AS fact_id, {sql_choice(_VALUES, 'o_orderkey')} AS original_value, nullif({sql_choice(_DONE, 'o_orderkey')}, '-') AS value FROM orders")
def normalise_facts(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = _fact_rows(table(spark, sf_dir, "orders"), F.col("o_custkey"), choice(_PATHS, k), choice(_VALUES, k), k)
    return extract.normalize_facts(facts).select("candidate_key", "fact_id", "original_value", "value")


_WITHIN = ["skills", "phones[]", "location.country", "experience[0].start", "headline"]


@query(rf"""WITH t AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS k, strftime(o_orderdate, '%m/%d/%Y') AS d, strftime(o_orderdate, '%Y-%m') AS m FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, 'f:' || CAST(o_orderkey AS VARCHAR) AS fact_id,
  '[{{country:' || CASE k WHEN 2 THEN 'IN' ELSE 'India' END || ',date:' || CASE k WHEN 3 THEN m ELSE d END || ',level:3,name:' || CASE k WHEN 0 THEN 'TypeScript' ELSE 'ts' END
  || ',phones:[' || CASE k WHEN 1 THEN '+14155552671,null' ELSE '+1 (415) 555-2671,x' END || '],Tags:{{a:' || CAST(o_orderkey AS VARCHAR) || ',name:js}}}},null]' AS value
FROM t""")
def normalise_nested(spark, sf_dir):
    """Lists of records with lists and maps inside, normalised (under the target's own keys only), then serialised."""
    k = F.col("o_orderkey")
    tags = F.create_map(F.lit("name"), F.lit("js"), F.lit("a"), k.cast("string"))
    phones = F.array(F.lit("+1 (415) 555-2671"), F.lit("x"))
    record = F.struct(F.lit("ts").alias("name"), tags.alias("Tags"), F.lit(3).alias("level"), phones.alias("phones"), F.lit("India").alias("country"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"))
    value = F.array(record, F.lit(None).cast("struct<name:string,Tags:map<string,string>,level:int,phones:array<string>,country:string,date:string>"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate_key"), F.concat(F.lit("f:"), k.cast("string")).alias("fact_id"), choice(_WITHIN, k).alias("field_path"), value.alias("value"))
    done = settled(extract.normalize_facts(rows))
    return done.select("candidate_key", "fact_id", X.serialised(F.col("value"), done.schema["value"].dataType).alias("value"))


@query("""WITH t AS (SELECT l_orderkey, list('{id:' || CAST(l_linenumber AS VARCHAR) || ',Mode:' || l_returnflag || ',n:' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',none:null}' ORDER BY l_linenumber, l_quantity, l_returnflag) AS ls FROM lineitem GROUP BY 1)
SELECT l_orderkey, '[' || array_to_string(ls, ',') || ']' AS text FROM t""")
def serialise_nested(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("n"), F.lit(None).cast("string").alias("none"), F.col("l_returnflag").alias("Mode"))
    lines = settled(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines")))
    return lines.select("l_orderkey", X.serialised(F.col("lines"), lines.schema["lines"].dataType).alias("text"))


_BLANKS, _FULL = [" a ", "", "  ", "x\ty", "\u00a0\u3000", "\ufeffz\n", "0"], ["a", "", "", "x\ty", "", "z", "0"]


@query(f"SELECT event_id, nullif({sql_choice(_FULL, 'event_id')}, '') AS value FROM events")
def non_empty_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.non_empty(choice(_BLANKS, F.col("event_id"))).alias("value"))


# Projection and validation


def _order_profiles(spark, sf_dir) -> DataFrame:
    """Customers with their orders as a list: profiles whose list may be empty."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice"))).alias("items"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance")).alias("person"), "items")


_ITEMS = """WITH o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey, o_orderpriority, o_totalprice) AS ps FROM orders GROUP BY 1),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, ps FROM customer LEFT JOIN o ON c_custkey = o_custkey)"""
_QUOTED = """'"' || {0} || '"'"""
_LISTED = """'[' || array_to_string(list_transform(ps, lambda x: '"' || x || '"'), ',') || ']'"""


def _projection(policy: str, required: bool = False) -> ProjectionConfig:
    return ProjectionConfig([ProjectionField("who.name", "string", required, source="person.name"), ProjectionField("all", "string[]", source="items[].o_orderpriority"), ProjectionField("second", "string", source="items[1].o_orderpriority")], on_missing=policy)


@query(f"""{_ITEMS} SELECT c_custkey, '{{"who":{{"name":' || coalesce({_QUOTED.format("name")}, 'null') || '}},"all":' || coalesce({_LISTED}, 'null') || ',"second":' || coalesce({_QUOTED.format("ps[2]")}, 'null') || '}}' AS output FROM p""")
def project_null(spark, sf_dir):
    return project(_order_profiles(spark, sf_dir), _projection("null"), "c_custkey").select("c_custkey", "output")


@query(f"""{_ITEMS} SELECT c_custkey, '{{' || array_to_string(list_filter(['"who":{{"name":' || {_QUOTED.format("name")} || '}}', '"all":' || {_LISTED}, '"second":' || {_QUOTED.format("ps[2]")}], lambda x: x IS NOT NULL), ',') || '}}' AS output FROM p""")
def project_omit(spark, sf_dir):
    return project(_order_profiles(spark, sf_dir), _projection("omit"), "c_custkey").select("c_custkey", "output")


@query(f"""{_ITEMS} SELECT c_custkey, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'PROJECTION_REQUIRED_FIELD_MISSING:who.name' END, CASE WHEN ps IS NULL THEN 'PROJECTION_FIELD_MISSING:all' END,
  CASE WHEN ps[2] IS NULL THEN 'PROJECTION_FIELD_MISSING:second' END], lambda x: x IS NOT NULL), ',') AS errors FROM p""")
def project_error(spark, sf_dir):
    done = project(_order_profiles(spark, sf_dir), _projection("error", required=True), "c_custkey")
    return done.select("c_custkey", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["path"])), ",").alias("errors"))


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1) SELECT o_custkey, ks[1] AS first_key, CAST(len(ks) AS BIGINT) AS n FROM o""")
def path_wildcard(spark, sf_dir):
    from ..operators.paths import resolve

    p = _order_profiles(spark, sf_dir)
    first, every = resolve("items[0].o_orderkey", p.schema), resolve("items[].o_orderkey", p.schema)
    return p.where(F.col("items").isNotNull()).select(F.col("c_custkey").alias("o_custkey"), first.column.alias("first_key"), F.size(every.column).cast("long").alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def path_get(spark, sf_dir):
    from ..operators.paths import resolve

    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return e.select("event_id", resolve("props.k", e.schema).column.alias("k"))


@query(f"""WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone, {sql_choice(_SKILL_WANT, 'c_custkey')} AS skill FROM customer)
SELECT c_custkey, '{{"phone":' || coalesce('"' || phone || '"', 'null') || ',"skills":' || CASE WHEN skill = '' THEN 'null' ELSE '["' || skill || '","JavaScript"]' END || '}}' AS output FROM t""")
def project_directives(spark, sf_dir):
    k = F.col("c_custkey")
    phone = F.when(k % 3 == 0, F.concat(F.lit("+1 (415) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("12")
    people = table(spark, sf_dir, "customer").select("c_custkey", phone.alias("phone"), F.array(choice(_SKILL_TEXTS, k), F.lit("js")).alias("skills"))
    config = ProjectionConfig([ProjectionField("phone", "string", normalize=["E164"]), ProjectionField("skills", "string[]", normalize=["canonical"])])
    return project(people, config, "c_custkey").select("c_custkey", "output")


#: Both spellings of options, keys that do not count, and a directive in other letters.
_RAW = {"fields": [{"path": "name", "type": "string", "from": "c_name", "odd": 1}, {"path": "segment", "type": "string", "from": "c_mktsegment", "normalize": ["CANONICAL"]}], "include_confidence": True, "includeProvenance": True, "on_missing": "omit"}


@query("""SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","overallConfidence":' || CAST((c_custkey % 100)::DOUBLE / 100::DOUBLE AS VARCHAR)
  || ',"provenance":[{"fieldPath":"name","sourceOrder":' || CAST(c_custkey % 3 AS VARCHAR) || '}]}' AS output FROM customer""")
def project_flags(spark, sf_dir):
    k = F.col("c_custkey")
    score = F.struct(((k % 100).cast("double") / 100.0).alias("value"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", score.alias("overallConfidence"), F.array(F.struct(F.lit("name").alias("fieldPath"), (k % 3).alias("sourceOrder"))).alias("provenance"))
    return project(people, read_config(_RAW), "c_custkey").select("c_custkey", "output")


_PATH_CASES = {" a.b[2] ": "a|b|2", "skills[].name": "skills|*|name", "": "PATH_EMPTY:0", "a..b": "PATH_INVALID_IDENTIFIER:2", "a[x]": "PATH_INVALID_INDEX:2", "a[1": "PATH_UNTERMINATED_BRACKET:1", "a-b": "PATH_INVALID_CHARACTER:1"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{path}', '{want}')" for path, want in _PATH_CASES.items()) + ") t(path, tokens)")
def path_parse(spark, sf_dir):
    def told(path: str) -> str:
        try:
            return "|".join(map(str, parse(path)))
        except PathError as e:
            return f"{e.code}:{e.position}"

    return spark.createDataFrame([(p, told(p)) for p in _PATH_CASES], "path string, tokens string")


_BAD_RAW = {"fields": [{"path": "a[]", "type": "text"}, {"path": "b", "type": "string", "mapping": "mapped"}, {"path": "b", "type": "string", "normalize": ["canonical", "canonical", "odd"]}], "onMissing": "never"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{place}')" for place in ("fields.0.path", "fields.0.type", "fields.1.from", "fields.2.normalize", "fields.2.path", "onMissing")) + ") t(place)")
def config_check(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in config_issues(read_config(_BAD_RAW))], "place string").distinct()


@query("""SELECT event_id, event_type IS NOT NULL AS as_text, value IS NOT NULL AS as_number, FALSE AS text_as_number FROM events""")
def type_contract(spark, sf_dir):
    config = ProjectionConfig([ProjectionField("a", "string", source="event_type"), ProjectionField("b", "number", source="value"), ProjectionField("c", "number", source="event_type")], on_missing="error")
    done = project(table(spark, sf_dir, "events"), config, "event_id")
    fails = lambda path: F.exists("errors", lambda e: e["path"] == path)
    return done.select("event_id", (~fails("a")).alias("as_text"), (~fails("b")).alias("as_number"), (~fails("c")).alias("text_as_number"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'person.name: required' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '; n: not string' END WHEN c_custkey % 2 = 1 THEN 'n: not string' ELSE '' END AS issues FROM customer""")
def validate_output_issues(spark, sf_dir):
    config = ProjectionConfig([ProjectionField("person.name", "string", True), ProjectionField("n", "string")])
    k = F.col("c_custkey")
    output = F.concat(F.when(k % 3 == 0, F.lit('{"person":{}')).otherwise(F.lit('{"person":{"name":"x"}')), F.when(k % 2 == 0, F.lit(',"n":"y"}')).otherwise(F.lit(',"n":7}')))
    issues = validate.output_issues(output, config)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(issues, lambda i: F.concat_ws(": ", i["path"], i["reason"])), "; ").alias("issues"))


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS candidate_key, 'emails: not an email' || CASE WHEN o_custkey % 2 = 0 THEN '; location.country: not ISO-3166 alpha-2' ELSE '' END AS issues FROM orders""")
def validate_canonical_issues(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey")
    facts = _fact_rows(o, key, F.lit("emails[]"), F.lit("no mail"), F.col("o_orderkey"))
    facts = facts.unionByName(_fact_rows(o, key, F.lit("location.country"), F.when(key % 2 == 0, "Utopia").otherwise("FR"), F.col("o_orderkey")))
    rows = settled(confidence.score_profiles(settled(merge.merge_facts(facts))))
    return rows.select("candidate_key", F.array_join(F.transform(validate.profile_issues(), lambda i: F.concat_ws(": ", i["path"], i["reason"])), "; ").alias("issues"))


# The whole flow


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured record and a resume text for each customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    resume = F.concat(
        F.lit("Pat Doe\n"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@example.com\n+1 415-555-"), F.lpad((k % 10000).cast("string"), 4, "0"),
        F.lit("\n\nExperience\nAcme "), F.col("c_mktsegment"), F.lit(" (Mar 2021 - Present)\n\nEducation\nUniversity of "), F.col("c_mktsegment"), F.lit("\n\nSkills\nJS, TS, "), F.col("c_mktsegment"),
    )
    resumes = c.select(k.cast("string").alias("candidate_key"), F.concat(F.lit("resume:"), k.cast("string"), F.lit(".txt")).alias("source_id"), F.lit("resume_pdf").alias("source_kind"), F.lit(2).alias("source_order"), F.lit("2026-01-01T00:00:01.000Z").alias("ingested_at"), resume.alias("text"))
    return _customer_records(c).unionByName(resumes)


PROFILE = ProjectionConfig(
    [
        ProjectionField("candidate.id", "string", True, source="candidateId"),
        ProjectionField("candidate.name", "string", True, source="fullName"),
        ProjectionField("contact.email", "string", source="emails[0]"),
        ProjectionField("contact.phone", "string", normalize=["E164"], source="phones[0]"),
        ProjectionField("skills", "string[]", normalize=["canonical"], source="skills[].name"),
        ProjectionField("company", "string", source="experience[0].company"),
    ],
    include_confidence=True,
    on_missing="omit",
)


_FLOW_SQL = """
WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k, NOT (c_custkey % 97 = 0 OR c_custkey % 89 = 0 OR c_custkey % 83 = 0) AS good, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.com' AS email FROM customer),
s AS (SELECT *, good AND c_custkey % 2 = 0 AS employed,
  CASE WHEN good AND c_custkey % 5 <> 0 THEN 0.8175::DOUBLE ELSE 0.7075::DOUBLE END AS email_score, CASE WHEN good THEN 0.8175::DOUBLE ELSE 0.7075::DOUBLE END AS both_score FROM c),
w AS (SELECT *, list_concat([0.7075::DOUBLE * 0.05::DOUBLE, email_score * 0.2::DOUBLE], CASE WHEN employed THEN [0.8275::DOUBLE * 0.08::DOUBLE] ELSE [] END,
    [0.7075::DOUBLE * 0.03::DOUBLE, both_score * 0.22::DOUBLE, both_score * 0.16::DOUBLE], list_transform(range(3), lambda x: 0.6775::DOUBLE * 0.14::DOUBLE)) AS products,
  list_concat([0.05::DOUBLE, 0.2::DOUBLE], CASE WHEN employed THEN [0.08::DOUBLE] ELSE [] END, [0.03::DOUBLE, 0.22::DOUBLE, 0.16::DOUBLE], list_transform(range(3), lambda x: 0.14::DOUBLE)) AS weights FROM s),
o AS (SELECT *, floor(list_reduce(products, lambda acc, x: acc + x) / list_reduce(weights, lambda acc, x: acc + x) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS overall FROM w)
SELECT k AS candidate_key, '{"candidate":{"id":"' || CASE WHEN good THEN 'ats:' || k || '.json' ELSE 'resume:' || k || '.txt' END
  || '","name":"' || CASE WHEN NOT good THEN 'Pat Doe' WHEN c_custkey % 3 = 0 THEN 'C ' || c_name ELSE c_name END || '"},"contact":{"email":"' || email
  || '","phone":"+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '"},"skills":["JavaScript","TypeScript","' || c_mktsegment || '"]'
  || CASE WHEN employed THEN ',"company":"' || c_mktsegment || '"' ELSE '' END || ',"overallConfidence":' || CAST(overall AS VARCHAR) || '}' AS output FROM o"""


@query(_FLOW_SQL)
def full_pipeline(spark, sf_dir):
    return pipeline.run(customer_sources(spark, sf_dir), PROFILE).outputs


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, 'ats:' || CAST(c_custkey AS VARCHAR) || '.json' AS source_id, 'load_ats_json' AS stage, 'ATS_JSON_PARSE_FAILED' AS code,
  CASE WHEN c_custkey % 97 = 0 THEN 'ATS input is not valid JSON.' WHEN c_custkey % 89 = 0 THEN 'ATS input schema validation failed: id' ELSE 'ATS input string is empty.' END AS message
FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0 OR c_custkey % 83 = 0""")
def pipeline_errors(spark, sf_dir):
    return pipeline.run(customer_sources(spark, sf_dir), PROFILE).errors
