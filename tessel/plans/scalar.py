"""Scalar functions over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.catalog import query, table
from tessel.functions import scalars as S

NOW = "2024-01-31 12:00:00"


@query(f"""WITH t AS (SELECT event_id, ts, epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' min ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' h ago'
WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || ' d ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago,
CASE WHEN CAST(ts AS DATE) = DATE '2024-01-31' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m.%d') END AS short FROM t""")
def relative_times(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return table(spark, d, "events").select("event_id", S.relative_time(F.col("ts"), now).alias("ago"), S.short_date(F.col("ts"), now).alias("short"))


@query("""SELECT event_id, CAST(floor(value) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS length FROM events WHERE value >= 0""")
def durations(spark, d):
    return table(spark, d, "events").filter("value >= 0").select("event_id", S.minutes(F.col("value")).alias("length"))


@query("""SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' ELSE printf('%.1f', round(n / 1048576, 1)) || ' MB' END AS size
FROM (SELECT page_id, length(html) * (1 + page_id % 400) AS n FROM pages)""")
def byte_sizes(spark, d):
    n = F.char_length("html").cast("bigint") * (1 + F.col("page_id") % 400)
    return table(spark, d, "pages").select("page_id", S.byte_size(n).alias("size"))


@query("""SELECT page_id, CASE WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' ELSE printf('%.2f', round(n / 1048576, 2)) || ' MB' END AS size
FROM (SELECT page_id, length(html) * (1 + page_id % 4000) + 1024 AS n FROM pages)""")
def byte_sizes_fine(spark, d):
    n = F.char_length("html").cast("bigint") * (1 + F.col("page_id") % 4000) + 1024
    return table(spark, d, "pages").select("page_id", S.byte_size(n, 2).alias("size"))


@query("""WITH f AS (SELECT p_partkey, p_name || '.' || (['png', 'JPG', 'tiff', 'webp'])[1 + p_partkey % 4] AS file FROM part)
SELECT p_partkey, CASE lower(split_part(file, '.', -1)) WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG' WHEN 'webp' THEN 'WebP' ELSE upper(split_part(file, '.', -1)) END AS label,
regexp_replace(file, '\\.[^.]+$', '') AS stem, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'mp3' ELSE 'bin' END AS ext FROM f""")
def file_formats(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["png", "JPG", "tiff", "webp"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    file = F.concat("p_name", F.lit("."), ext)
    media = F.element_at(F.array(*map(F.lit, ["image/png", "audio/mpeg", "text/odd"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.format_label(file).alias("label"), S.without_extension(file).alias("stem"), S.extension(media).alias("ext"))


@query("""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n_tags, array_to_string(l, '|') AS tags FROM t""")
def tag_lists(spark, d):
    made = S.tags(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(made).cast("bigint").alias("n_tags"), F.concat_ws("|", made).alias("tags"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.name'), CAST(json_extract(props, '$.k') AS VARCHAR), 'user_' || left(CAST(event_id AS VARCHAR), 8)) AS name,
coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'none') AS shown, upper(left(event_type, 1)) || substr(event_type, 2) AS title,
split_part(event_type || '@example.org', '@', 1) AS local FROM events""")
def names(spark, d):
    e = table(spark, d, "events")
    blank = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    default = F.concat(F.lit("user_"), F.left(F.col("event_id").cast("string"), F.lit(8)))
    return e.select("event_id", S.json_or(F.col("props"), ["$.name", "$.k"], default).alias("name"), S.first_filled(blank, default="none").alias("shown"), S.capitalised(F.col("event_type")).alias("title"), S.local_part(F.concat("event_type", F.lit("@example.org"))).alias("local"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS line FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '## ' || text ELSE text END, chr(10)) AS x FROM documents))
SELECT doc_id, CAST(place AS INTEGER) AS place, CASE WHEN starts_with(line, '### ') THEN 'h3' WHEN starts_with(line, '## ') THEN 'h2' ELSE 'p' END AS kind, left(line, 160) AS head FROM l""")
def text_blocks(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.select("doc_id", "place", S.block_kind(F.col("line")).alias("kind"), S.truncated(F.col("line")).alias("head"))


@query("""SELECT doc_id, CASE WHEN starts_with(l, 'de') THEN 'de' WHEN starts_with(l, 'fr') THEN 'fr' ELSE 'en' END AS chosen, lang IN ('de', 'es') AS listed
FROM (SELECT doc_id, lang, lower(lang || '-XX') AS l FROM documents)""")
def languages(spark, d):
    locale = F.concat("lang", F.lit("-XX"))
    return table(spark, d, "documents").select("doc_id", S.language(locale, ["de", "fr"], "en").alias("chosen"), S.listed(F.col("lang"), F.lit("de, es")).alias("listed"))


@query("""SELECT vec_id, CAST(floor(x * 10 + 0.5) AS BIGINT) AS rounded, CAST(ceil(x) AS BIGINT) AS up, greatest(-0.5, least(0.5, x)) AS held FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""")
def roundings(spark, d):
    x = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").select("vec_id", S.half_up(x * 10).alias("rounded"), F.ceil(x).alias("up"), S.clamp(x, -0.5, 0.5).alias("held"))


@query("""SELECT user_id, CAST(json_extract(c, '$.sub') AS BIGINT) AS sub, CAST(json_extract(c, '$.exp') AS BIGINT) > 1700000000 AS valid FROM
(SELECT DISTINCT user_id, '{"sub":' || user_id || ',"exp":' || (1699999000 + user_id * 10) || '}' AS c FROM events)""")
def token_claims(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    body = F.concat(F.lit('{"sub":'), "user_id", F.lit(',"exp":'), 1699999000 + F.col("user_id") * 10, F.lit("}"))
    b64 = F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    token = F.concat(F.lit("e30."), b64, F.lit(".sig"))
    got = S.claims(token, "sub bigint, exp bigint")
    return users.select("user_id", got["sub"].alias("sub"), (got["exp"] > 1700000000).alias("valid"))


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'site' END AS aud, CASE user_id % 2 WHEN 0 THEN 'member' ELSE 'guest' END AS role, user_id % 3 = 0 AND user_id % 2 = 0 AS accepted FROM (SELECT DISTINCT user_id FROM events)""")
def token_audiences(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    aud = F.when(F.col("user_id") % 3 == 0, F.lit(',"aud":"site"')).otherwise("")
    body = F.concat(F.lit('{"role":"'), F.when(F.col("user_id") % 2 == 0, "member").otherwise("guest"), F.lit('"'), aud, F.lit("}"))
    token = F.concat(F.lit("e30."), F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("=")), F.lit(".sig"))
    got = users.withColumn("c", S.claims(token, "aud string, role string"))
    return got.select("user_id", "c.aud", "c.role", F.coalesce((F.col("c.aud") == "site") & (F.col("c.role") == "member"), F.lit(False)).alias("accepted"))


@query("""SELECT event_id, nullif(regexp_replace(regexp_replace(t, '^[\\s\\x{A0}\\x{2003}\\x{3000}]+', ''), '[\\s\\x{A0}\\x{2003}\\x{3000}]+$', ''), '') AS title
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN chr(12288) || chr(9) || chr(160) WHEN 1 THEN chr(8195) || event_type || chr(160) || ' ' ELSE event_type || chr(10) END AS t FROM events)""")
def wide_blanks(spark, d):
    """White space beyond ASCII is trimmed too."""
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.lit("\u3000\t\u00a0")).when(kind == 1, F.concat(F.lit("\u2003"), "event_type", F.lit("\u00a0 "))).otherwise(F.concat("event_type", F.lit("\n")))
    return table(spark, d, "events").select("event_id", S.blank_to_null(raw).alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'type' WHEN p_size * 200000 > 5242880 THEN 'size' END AS fault,
CASE WHEN p_size * 200000 > 5242880 THEN 'size' WHEN p_size % 3 = 0 THEN 'type' END AS fault_size_first,
CASE WHEN p_size * 200000 > 5242880 THEN 'too large' WHEN p_size % 3 = 0 THEN 'unsupported' ELSE 'ok' END AS message FROM part""")
def upload_faults(spark, d):
    media = F.when(F.col("p_size") % 3 == 0, F.lit("text/html")).otherwise(F.lit("image/png"))
    size = F.col("p_size") * 200000
    rule = lambda first: S.upload_fault(media, size, ["image/png", "image/jpeg"], 5 * 1024 * 1024, first)
    words = S.lookup(rule(True), {"size": "too large", "type": "unsupported"}, F.lit("ok"))
    return table(spark, d, "part").select("p_partkey", rule(False).alias("fault"), rule(True).alias("fault_size_first"), words.alias("message"))


@query("SELECT event_id, nullif(trim(CASE event_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN '  ' || event_type || ' ' ELSE event_type END), '') AS title FROM events")
def blank_to_null(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "   ").when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), "event_type", F.lit(" "))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.blank_to_null(raw).alias("title"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.iso_date(F.col("o_orderdate")).alias("day"))


@query()
def random_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.random_id().alias("id"))
