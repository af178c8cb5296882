"""The scalar functions that models use, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import compat
from millrace.functions.text import jaro_winkler_similarity
from millrace.queries.base import QuerySet, tables_of
from millrace.shipping import ship_package

QUERIES = QuerySet()

QUERIES.sql(
    "q_string_fns",
    """
    SELECT c_custkey, UPPER(c_mktsegment) AS up, LOWER(c_mktsegment) AS low, INITCAP(LOWER(c_mktsegment)) AS cap, TRIM('  ' || c_name || ' ') AS trimmed,
           TRIM(LEADING 'C' FROM c_name) AS lead, TRIM(TRAILING '0' FROM c_name) AS tail, LENGTH(c_name) AS n, SUBSTR(c_name, 3, 4) AS part, LEFT(c_name, 3) AS l3, RIGHT(c_name, 4) AS r4,
           LPAD(CAST(c_nationkey AS STRING), 5, '0') AS padded, RPAD(CAST(c_nationkey AS STRING), 4, 'x') AS rpadded, REPLACE(c_name, '#', '-') AS replaced, TRANSLATE(c_name, '0123', 'abcd') AS moved,
           CONCAT(c_name, '/', c_mktsegment) AS joined, CONCAT_WS('-', c_name, CAST(NULL AS STRING), c_mktsegment) AS skipped,
           SPLIT_PART(c_name, '#', 2) AS number, CONTAINS(c_name, '99') AS nines, MD5(c_name) AS digest, SHA2(c_name, 256) AS sha, LEVENSHTEIN(c_mktsegment, 'MACHINE') AS edits,
           REPEAT('ab', 2) AS twice, REVERSE(c_mktsegment) AS back, ASCII(c_mktsegment) AS code
    FROM customer
    """,
    ("customer",),
    """
    SELECT c_custkey, UPPER(c_mktsegment) AS up, LOWER(c_mktsegment) AS low, UPPER(c_mktsegment[1]) || LOWER(c_mktsegment[2:]) AS cap, TRIM('  ' || c_name || ' ') AS trimmed,
           LTRIM(c_name, 'C') AS lead, RTRIM(c_name, '0') AS tail, CAST(LENGTH(c_name) AS INTEGER) AS n, SUBSTR(c_name, 3, 4) AS part, LEFT(c_name, 3) AS l3, RIGHT(c_name, 4) AS r4,
           LPAD(CAST(c_nationkey AS VARCHAR), 5, '0') AS padded, RPAD(CAST(c_nationkey AS VARCHAR), 4, 'x') AS rpadded, REPLACE(c_name, '#', '-') AS replaced, TRANSLATE(c_name, '0123', 'abcd') AS moved,
           CONCAT(c_name, '/', c_mktsegment) AS joined, CONCAT_WS('-', c_name, CAST(NULL AS VARCHAR), c_mktsegment) AS skipped,
           SPLIT_PART(c_name, '#', 2) AS number, CONTAINS(c_name, '99') AS nines, MD5(c_name) AS digest, SHA256(c_name) AS sha, CAST(LEVENSHTEIN(c_mktsegment, 'MACHINE') AS INTEGER) AS edits,
           REPEAT('ab', 2) AS twice, REVERSE(c_mktsegment) AS back, ASCII(c_mktsegment) AS code
    FROM customer
    """,
)
QUERIES.sql(
    "q_regex_fns",
    """
    SELECT page_id, REGEXP_SUBSTR(url, 'https?://[^/]+') AS origin, REGEXP_EXTRACT(url, '//([^/]+)/', 1) AS host, REGEXP_REPLACE(url, '[0-9]+', 'N') AS masked,
           url RLIKE '^(?:https?://[^?#]*)$' AS plain, REGEXP_COUNT(html, '<p') AS paragraphs, REGEXP_LIKE(url, 'example[.](com|net)') AS known,
           PARSE_URL(url, 'PROTOCOL') AS protocol, PARSE_URL(url, 'REF') AS ref
    FROM pages
    """,
    ("pages",),
    """
    SELECT page_id, regexp_extract(url, 'https?://[^/]+') AS origin, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_replace(url, '[0-9]+', 'N', 'g') AS masked,
           regexp_full_match(url, 'https?://[^?#]*') AS plain, CAST(len(regexp_extract_all(html, '<p')) AS INTEGER) AS paragraphs, regexp_matches(url, 'example[.](com|net)') AS known,
           split_part(url, ':', 1) AS protocol, CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) END AS ref
    FROM pages
    """,
)
QUERIES.sql(
    "q_math_fns",
    """
    SELECT p_partkey, ROUND(p_retailprice / 7, 2) AS rounded, CEIL(p_retailprice / 7) AS up, FLOOR(p_retailprice / 7) AS down, ABS(p_size - 25) AS distance, MOD(p_size, 7) AS remainder,
           POWER(p_size, 2) AS square, ROUND(SQRT(p_size), 8) AS root, ROUND(LN(p_size), 8) AS log, GREATEST(p_size, 10, NULL) AS most, LEAST(p_size, 10, NULL) AS least,
           NULLIFZERO(p_size % 2) AS odd, ZEROIFNULL(NULLIF(p_size % 3, 1)) AS three, SIGN(p_size - 25) AS direction, p_size DIV 4 AS quarter, ROUND(EXP(p_size / 10), 6) AS grown
    FROM part
    """,
    ("part",),
    """
    SELECT p_partkey, ROUND(p_retailprice / 7, 2) AS rounded, CAST(CEIL(p_retailprice / 7) AS BIGINT) AS up, CAST(FLOOR(p_retailprice / 7) AS BIGINT) AS down, ABS(p_size - 25) AS distance, p_size % 7 AS remainder,
           POWER(p_size, 2) AS square, ROUND(SQRT(p_size), 8) AS root, ROUND(LN(p_size), 8) AS log, GREATEST(p_size, 10, NULL) AS most, LEAST(p_size, 10, NULL) AS least,
           NULLIF(p_size % 2, 0) AS odd, COALESCE(NULLIF(p_size % 3, 1), 0) AS three, CAST(SIGN(p_size - 25) AS DOUBLE) AS direction, CAST(p_size // 4 AS BIGINT) AS quarter, ROUND(EXP(p_size / 10), 6) AS grown
    FROM part
    """,
)
QUERIES.sql(
    "q_conversion_fns",
    """
    SELECT event_id, TRY_CAST(SUBSTR(props, 7, 2) AS INT) AS k, TRY_CAST(event_type AS DOUBLE) AS nothing, CAST(TRY_CAST(CAST(value AS STRING) AS DECIMAL(12, 1)) AS DOUBLE) AS tenth,
           TRY_CAST(IF(value > 50, 'true', 'maybe') AS BOOLEAN) AS flag, CAST(value AS BIGINT) AS whole, DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm') AS minute, CAST(TRY_TO_DATE('2024-13-01') AS STRING) AS bad_day
    FROM events
    """,
    ("events",),
    """
    SELECT event_id, TRY_CAST(SUBSTR(props, 7, 2) AS INT) AS k, TRY_CAST(event_type AS DOUBLE) AS nothing, CAST(TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(12, 1)) AS DOUBLE) AS tenth,
           TRY_CAST(IF(value > 50, 'true', 'maybe') AS BOOLEAN) AS flag, CAST(TRUNC(value) AS BIGINT) AS whole, strftime(ts, '%Y-%m-%d %H:%M') AS minute, CAST(TRY_CAST('2024-13-01' AS DATE) AS VARCHAR) AS bad_day
    FROM events
    """,
)
QUERIES.sql(
    "q_date_fns",
    """
    SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS STRING) AS month_start, CAST(DATE_TRUNC('week', o_orderdate) AS STRING) AS week_start, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, HOUR(o_orderdate) AS h,
           DAYOFWEEK(o_orderdate) - 1 AS dow, WEEKDAY(o_orderdate) + 1 AS iso_dow, WEEKOFYEAR(o_orderdate) AS week, EXTRACT(YEAROFWEEK FROM o_orderdate) AS iso_year, DAYOFYEAR(o_orderdate) AS doy,
           DATEDIFF(DATE'2001-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(LAST_DAY(o_orderdate) AS STRING) AS month_end, CAST(DATE_ADD(CAST(o_orderdate AS DATE), 10) AS STRING) AS later,
           CAST(ADD_MONTHS(o_orderdate, 1) AS STRING) AS next_month, DAYNAME(o_orderdate) AS name, CAST(o_orderdate + INTERVAL 90 MINUTES AS STRING) AS shifted, DATE_PART('DOY', o_orderdate) AS part
    FROM orders
    """,
    ("orders",),
    """
    SELECT o_orderkey, CAST(CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS VARCHAR) AS month_start, CAST(CAST(DATE_TRUNC('week', o_orderdate) AS TIMESTAMP) AS VARCHAR) AS week_start, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(QUARTER(o_orderdate) AS INT) AS q, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(DAY(o_orderdate) AS INT) AS d, CAST(HOUR(o_orderdate) AS INT) AS h,
           CAST(DAYOFWEEK(o_orderdate) AS INT) AS dow, CAST(ISODOW(o_orderdate) AS INT) AS iso_dow, CAST(WEEKOFYEAR(o_orderdate) AS INT) AS week, CAST(ISOYEAR(o_orderdate) AS INT) AS iso_year, CAST(DAYOFYEAR(o_orderdate) AS INT) AS doy,
           CAST(DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS INT) AS days, CAST(LAST_DAY(o_orderdate) AS VARCHAR) AS month_end, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later,
           CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, LEFT(DAYNAME(o_orderdate), 3) AS name, CAST(o_orderdate + INTERVAL 90 MINUTES AS VARCHAR) AS shifted, CAST(DAYOFYEAR(o_orderdate) AS INT) AS part
    FROM orders
    """,
)


@QUERIES.frame(
    "q_date_compat",
    """
    SELECT event_id, date_diff('minute', ts, ts + INTERVAL 100 SECONDS) AS minutes, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours, date_diff('month', TIMESTAMP '2023-11-30 00:00:00', ts) AS months,
           CAST(date_diff('day', TIMESTAMP '2023-12-25 00:00:00', date_trunc('week', ts)) AS BIGINT) // 7 AS weeks, date_diff('quarter', TIMESTAMP '2022-12-31 00:00:00', ts) AS quarters, date_diff('year', TIMESTAMP '2020-12-31 00:00:00', ts) AS years,
           CAST(CAST(DATE '2024-01-01' + to_months(CAST(event_id % 30 - 10 AS INTEGER)) AS DATE) + CAST(event_id % 50 - 11 AS INTEGER) AS VARCHAR) AS rolled, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(isodow(ts) AS INTEGER) AS iso
    FROM events
    """,
)
def date_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    ts = F.col("ts")
    return events.select(
        "event_id",
        compat.date_diff("minute", ts, ts + F.expr("INTERVAL 100 SECONDS")).alias("minutes"),
        compat.date_diff("hour", at("2024-01-01 00:30:00"), ts).alias("hours"),
        compat.date_diff("month", at("2023-11-30 00:00:00"), ts).alias("months"),
        compat.date_diff("week", at("2023-12-31 00:00:00"), ts).alias("weeks"),
        compat.date_diff("quarter", at("2022-12-31 00:00:00"), ts).alias("quarters"),
        compat.date_diff("year", at("2020-12-31 00:00:00"), ts).alias("years"),
        compat.date_from_parts(F.lit(2024), (F.col("event_id") % 30 - 9).cast("int"), (F.col("event_id") % 50 - 10).cast("int")).cast("string").alias("rolled"),
        compat.day_of_week(ts).alias("dow"),
        compat.day_of_week_iso(ts).alias("iso"),
    )


QUERIES.sql(
    "q_timezone_fns",
    "SELECT event_id, unix_micros(CAST(CONVERT_TIMEZONE('UTC', 'America/New_York', ts) AS TIMESTAMP)) AS local_us, unix_micros(CAST(ts AS TIMESTAMP)) AS utc_us FROM events",
    ("events",),
    "SELECT event_id, epoch_us((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS local_us, epoch_us(ts) AS utc_us FROM events",
)
QUERIES.sql(
    "q_array_fns",
    """
    SELECT p_partkey, ARRAY_JOIN(a, ',') AS text, SIZE(a) AS n, ARRAY_CONTAINS(a, 3) AS three, IF(ARRAY_POSITION(a, 3) > 0, ARRAY_POSITION(a, 3) - 1, NULL) AS place, ARRAY_JOIN(ARRAY_SORT(ARRAY_DISTINCT(a)), ',') AS sorted,
           ARRAY_MAX(a) AS most, ARRAY_MIN(a) AS least, ARRAY_JOIN(CONCAT(a, ARRAY(9)), ',') AS longer, ARRAY_JOIN(FLATTEN(ARRAY(a, a)), ',') AS flat, ARRAYS_OVERLAP(a, ARRAY(1, 2)) AS overlaps,
           ARRAY_JOIN(SEQUENCE(1, a[0] + 1), ',') AS seq, SIZE(ARRAY_COMPACT(ARRAY(a[0], NULL))) AS compact, ARRAY_JOIN(SLICE(a, 2, 2), ',') AS middle, ARRAY_JOIN(ARRAY_SORT(ARRAY_EXCEPT(a, ARRAY(3, 4))), ',') AS without
    FROM (SELECT p_partkey, ARRAY(p_size % 5, p_size % 7, p_size % 3) AS a FROM part) t
    """,
    ("part",),
    """
    SELECT p_partkey, array_to_string(a, ',') AS text, CAST(len(a) AS INTEGER) AS n, list_contains(a, 3) AS three, CAST(list_position(a, 3) AS BIGINT) - 1 AS place, array_to_string(list_sort(list_distinct(a)), ',') AS sorted,
           list_max(a) AS most, list_min(a) AS least, array_to_string(list_concat(a, [9]), ',') AS longer, array_to_string(flatten([a, a]), ',') AS flat, list_has_any(a, [1, 2]) AS overlaps,
           array_to_string(range(1, a[1] + 2), ',') AS seq, 1 AS compact, array_to_string(a[2:3], ',') AS middle, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x NOT IN (3, 4)))), ',') AS without
    FROM (SELECT p_partkey, [p_size % 5, p_size % 7, p_size % 3] AS a FROM part) t
    """,
)
QUERIES.sql(
    "q_lambda_fns",
    """
    SELECT p_partkey, ARRAY_JOIN(TRANSFORM(a, (x, i) -> x * 2 + i), ',') AS doubled, ARRAY_JOIN(FILTER(a, x -> x > 2), ',') AS large, AGGREGATE(a, 0, (s, x) -> s + x) AS total, EXISTS(a, x -> x = 0) AS zero, FORALL(a, x -> x < 6) AS small
    FROM (SELECT p_partkey, ARRAY(p_size % 5, p_size % 7, p_size % 3) AS a FROM part) t
    """,
    ("part",),
    """
    SELECT p_partkey, array_to_string(list_transform(a, lambda x, i: x * 2 + i - 1), ',') AS doubled, array_to_string(list_filter(a, lambda x: x > 2), ',') AS large, CAST(list_sum(a) AS INTEGER) AS total, list_contains(a, 0) AS zero, list_max(a) < 6 AS small
    FROM (SELECT p_partkey, [p_size % 5, p_size % 7, p_size % 3] AS a FROM part) t
    """,
)
QUERIES.sql(
    "q_map_fns",
    """
    SELECT event_id, ARRAY_JOIN(ARRAY_SORT(MAP_KEYS(m)), ',') AS names, m['kind'] AS kind, MAP_CONTAINS_KEY(m, 'none') AS none, SIZE(MAP_FILTER(m, (k, v) -> v <> 'click')) AS others,
           ELEMENT_AT(MAP_CONCAT(m, MAP('more', 'yes')), 'more') AS more, TO_JSON(MAP_FROM_ENTRIES(ARRAY_SORT(MAP_ENTRIES(m)))) AS text
    FROM (SELECT event_id, MAP('kind', event_type, 'user', CAST(user_id AS STRING)) AS m FROM events) t
    """,
    ("events",),
    """
    SELECT event_id, 'kind,user' AS names, event_type AS kind, false AS none, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS others, 'yes' AS more, '{"kind":"' || event_type || '","user":"' || user_id || '"}' AS text FROM events
    """,
)
QUERIES.sql(
    "q_json_props",
    """
    SELECT event_id, PARSE_JSON(props):k::INT AS k, GET_JSON_OBJECT(props, '$.k') AS text, TRY_PARSE_JSON('{' || props) IS NULL AS broken, SCHEMA_OF_VARIANT(PARSE_JSON(props):k) = 'BIGINT' AS whole,
           ARRAY_JOIN(JSON_OBJECT_KEYS(props), ',') AS names, TO_JSON(PARSE_JSON(props)) AS canonical, IS_VARIANT_NULL(PARSE_JSON('{"a":null}'):a) AS nothing, TRY_VARIANT_GET(PARSE_JSON(props), '$.missing', 'int') AS missing
    FROM events
    """,
    ("events",),
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS text, true AS broken, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole,
           array_to_string(json_keys(props), ',') AS names, CAST(json(props) AS VARCHAR) AS canonical, true AS nothing, CAST(NULL AS INTEGER) AS missing
    FROM events
    """,
)
QUERIES.sql(
    "q_variant_explode",
    """
    SELECT p_partkey, v.pos, CAST(v.value AS INT) AS item FROM (SELECT p_partkey, PARSE_JSON('[' || p_size || ',' || (p_size + 1) || ']') AS doc FROM part) t, LATERAL VARIANT_EXPLODE(doc) v
    """,
    ("part",),
    "SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST(p_size + i AS INTEGER) AS item FROM part, range(2) g(i)",
)


@QUERIES.frame(
    "q_compat_fns",
    """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE ROUND(p_retailprice / (p_size % 4), 6) END AS ratio, CASE WHEN p_size % 3 <> 0 THEN greatest(p_size, p_size % 3) END AS strict,
           CASE WHEN p_size % 5 = 3 THEN 0 WHEN p_size % 7 = 3 THEN 1 END AS place, CAST(round(jaro_winkler_similarity(p_name, 'blue bolt') * 1000000) AS BIGINT) AS near,
           array_to_string([p_size % 2, 2], ',') AS without,
           '{"size":"' || p_size || '"}' AS picked, p_type AS kind
    FROM part
    """,
)
def compat_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables_of(spark, sf_dir, "part")
    ship_package(spark)
    size = F.col("p_size")
    third = F.when(size % 3 != 0, size % 3)
    entries = F.create_map(F.lit("size"), size.cast("string"), F.lit("none"), F.lit(None).cast("string"), F.lit("Type"), F.col("p_type"))
    return part.select(
        "p_partkey",
        F.round(compat.div0(F.col("p_retailprice"), size % 4), 6).alias("ratio"),
        compat.strict_greatest(size, third).alias("strict"),
        compat.array_position0(F.array(size % 5, size % 7), F.lit(3)).cast("int").alias("place"),
        F.round(jaro_winkler_similarity(F.col("p_name"), F.lit("blue bolt")) * 1000000).cast("bigint").alias("near"),
        F.array_join(compat.array_except_multiset(F.array(size % 2, F.lit(1), F.lit(2)), F.array(F.lit(1))), ",").alias("without"),
        F.to_json(compat.object_pick(compat.object_drop_nulls(entries), "size", "none")).alias("picked"),
        compat.get_ignore_case(compat.object_delete(entries, "none"), "TYPE").alias("kind"),
    )


@QUERIES.frame(
    "q_time_conversion_fns",
    """
    SELECT event_id, event_type = 'click' AS same, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS seconds, epoch_us(ts + INTERVAL 5 HOURS) AS later_us, epoch_us(date_trunc('second', ts)) AS ntz_us,
           epoch_us(date_trunc('second', ts) - INTERVAL 2 HOURS) AS tz_us, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) END AS try_ntz_us, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts) - INTERVAL 2 HOURS) END AS try_tz_us,
           CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M:%S') END AS time_of_day, CAST(user_id AS BIGINT) AS number,
           epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(event_id % 50 - 11 AS INTEGER)) + INTERVAL 26 HOURS + INTERVAL 65 SECONDS) AS parts_us
    FROM events
    """,
)
def time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    odd = F.when(F.col("event_id") % 2 == 0, text).otherwise("no time")
    zoned = lambda c: F.concat(c, F.lit("+02:00"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    parts = [F.lit(2024), F.lit(1), (F.col("event_id") % 50 - 10).cast("int"), F.lit(26), F.lit(0), F.lit(65)]
    return events.select(
        "event_id",
        F.equal_null(F.nullif(F.col("event_type"), F.lit("click")), F.lit(None).cast("string")).alias("same"),
        compat.date_diff("second", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("seconds"),
        micros(F.expr("TIMESTAMPADD(HOUR, 5, ts)")).alias("later_us"),
        micros(F.to_timestamp_ntz(text)).alias("ntz_us"),
        micros(F.to_timestamp_ltz(zoned(text))).alias("tz_us"),
        micros(odd.try_cast("timestamp_ntz")).alias("try_ntz_us"),
        micros(F.try_to_timestamp(zoned(odd))).alias("try_tz_us"),
        compat.try_to_time(F.split_part(odd, F.lit(" "), F.lit(2))).alias("time_of_day"),
        F.to_number(F.col("user_id").cast("string"), F.lit("999999999")).cast("bigint").alias("number"),
        micros(compat.timestamp_from_parts(*parts)).alias("parts_us"),
    )


@QUERIES.frame("q_hash", "SELECT event_type, COUNT(DISTINCT (user_id, value)) AS distinct_rows, true AS stable FROM events GROUP BY event_type")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit hash tells rows apart, and gives equal rows the same."""
    (events,) = tables_of(spark, sf_dir, "events")
    own = F.xxhash64("user_id", "value")
    again = F.xxhash64(F.col("user_id").cast("string").cast(dict(events.dtypes)["user_id"]), "value")
    return events.groupBy("event_type").agg(F.count_distinct(own).alias("distinct_rows"), F.bool_and(own == again).alias("stable"))


@QUERIES.frame(
    "q_variant_types",
    """
    SELECT event_id, k = 0 AS is_array, k = 1 AS is_object, k IN (2, 3) AS is_decimal, k IN (2, 3, 4) AS is_double, CASE k WHEN 1 THEN CAST(event_id AS VARCHAR) END AS member, k = 1 AS had_null FROM (SELECT event_id, event_id % 6 AS k FROM events) t
    """,
)
def variant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    forms = ("concat('[', event_id, ']')", "concat('{\"a\":null,\"b\":', event_id, '}')", "concat(event_id, '.5')", "cast(event_id as string)", "concat(event_id, 'e-3')", "concat('\"', event_id, '\"')")
    doc = F.parse_json(F.element_at(F.array(*(F.expr(f) for f in forms)), (F.col("event_id") % 6 + 1).cast("int")))
    gone, kept = (F.try_variant_get("doc", f"$.{name}", "variant") for name in ("a", "b"))
    return events.select("event_id", doc.alias("doc")).select(
        "event_id",
        *(getattr(compat, name)(F.col("doc")).alias(name) for name in ("is_array", "is_object", "is_decimal", "is_double")),
        F.to_json(compat.strip_null_value(kept)).alias("member"),
        (F.coalesce(F.is_variant_null(gone), F.lit(False)) & compat.strip_null_value(gone).isNull()).alias("had_null"),
    )
