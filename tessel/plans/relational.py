"""Listings, joins, counters and guarded changes on the test tables: orders stand for content,
customers for authors, line items for likes, events for logs, conversations for comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query, table
from tessel.operators import engagement, listing
from tessel.operators.listing import ListQuery
from tessel.shared import new_folder
from tessel.sources import files
from tessel.sources.versions import VersionedTable

LIST = ListQuery(equal={"o_orderstatus": "O"}, search="urgent", search_in="o_orderpriority", sort=["o_totalprice", "o_orderdate"], key="o_orderkey", page=1)
AUTHOR = ["c_name", "c_mktsegment", "c_acctbal"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def flat(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "author"), F.col("author.c_name").alias("author_name"), F.col("author.c_mktsegment").alias("author_segment"))


@query("""SELECT o.*, c_name AS author_name, c_mktsegment AS author_segment FROM (SELECT * FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20) o
LEFT JOIN customer ON o_custkey = c_custkey""")
def list_page(spark, d):
    return flat(listing.page_with_authors(orders(spark, d), table(spark, d, "customer"), LIST, "o_custkey", "c_custkey", AUTHOR))


@query("SELECT count(*) AS total_count FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%'")
def list_total(spark, d):
    return listing.total(orders(spark, d), LIST)


@query("SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def list_recent(spark, d):
    return listing.page(orders(spark, d), ListQuery(equal={"o_orderstatus": "all"}, sort=["o_orderdate"], key="o_orderkey"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND text ILIKE '%und%' ORDER BY n_chars DESC, doc_id LIMIT 20")
def list_by_language(spark, d):
    q = ListQuery(equal={"lang": "de"}, search=" und ", search_in="text", sort=["n_chars"], key="doc_id")
    return listing.page(table(spark, d, "documents"), q).select("doc_id", "lang", "n_chars")


@query("""WITH n AS (SELECT l_partkey, count(*) AS likes FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2)
SELECT p_partkey, p_name, likes FROM n JOIN part ON l_partkey = p_partkey ORDER BY likes DESC, p_partkey LIMIT 8""")
def showcase(spark, d):
    likes = engagement.counts(table(spark, d, "lineitem"), "l_partkey", "likes").withColumnRenamed("l_partkey", "p_partkey")
    top = listing.page(likes, ListQuery(least={"likes": 2}, sort=["likes"], key="p_partkey", limit=8))
    found = table(spark, d, "part").join(F.broadcast(top), "p_partkey").select("p_partkey", "p_name", "likes")
    return found.orderBy(F.desc("likes"), "p_partkey").limit(8)


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def detail(spark, d):
    return listing.one(orders(spark, d), "o_orderkey", 7)


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 3 AND l_linenumber = 1 LIMIT 2")
def optional_row(spark, d):
    return listing.probe(table(spark, d, "lineitem"), l_orderkey=3, l_linenumber=1).select("l_orderkey", "l_partkey")


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS liked FROM orders""")
def liked_flags(spark, d):
    marks = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return listing.flagged(orders(spark, d).select("o_orderkey"), marks, ["o_orderkey"], "liked")


@query("""SELECT id, s_name FROM (SELECT s_suppkey + s_suppkey % 2 AS id, replace(s_name, 'Supplier', 'CUSTOMER') AS s_name FROM supplier) s
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE lower(c_name) = lower(s.s_name) AND c_custkey <> s.id)""")
def free_names(spark, d):
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") + F.col("s_suppkey") % 2).alias("id"), F.regexp_replace("s_name", "Supplier", "CUSTOMER").alias("s_name"))
    taken = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("s_name"))
    return listing.free_names(wanted, taken, "s_name", "id")


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def comments_of(spark, d):
    return table(spark, d, "conversations").orderBy("conv_id", F.col("turn").asc_nulls_last()).select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, count(*) AS comments, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def comment_threads(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("comments"), F.concat_ws(",", F.transform(turns, lambda x: x["role"])).alias("roles"))


@query("""WITH p AS (SELECT lang, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages, count(*) // 40 AS here FROM documents GROUP BY lang)
SELECT lang, pages, unnest(range(greatest(0, least(here - 4, pages - 10)), least(pages, greatest(0, least(here - 4, pages - 10)) + 10))) AS button FROM p""")
def page_buttons(spark, d):
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    pages = n.select("lang", listing.page_count(F.col("n"), 20).alias("pages"), F.floor(F.col("n") / 40).alias("here"))
    return listing.page_buttons(pages, "pages", "here").select("lang", "pages", "button")


@query("""SELECT n_nationkey, coalesce(t, n_name) AS label FROM nation LEFT JOIN (VALUES ('FRANCE', 'La France'), ('GERMANY', 'Deutschland')) v(k, t) ON n_name = k""")
def dictionary_lookup(spark, d):
    words = spark.createDataFrame([("FRANCE", "La France"), ("GERMANY", "Deutschland")], "key string, text string")
    return listing.translated(table(spark, d, "nation"), F.broadcast(words), "n_name", "label").select("n_nationkey", "label")


@query("SELECT lang, r_name AS route FROM (VALUES ('en'), ('de'), ('fr')) v(lang), region")
def language_routes(spark, d):
    langs = spark.createDataFrame([("en",), ("de",), ("fr",)], "lang string")  # two tables of a few rows
    return langs.crossJoin(table(spark, d, "region").select(F.col("r_name").alias("route")))


STEPS = "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 END"


def steps(spark, d):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1)
    return table(spark, d, "events").withColumn("step", step).filter("step is not null")


@query(f"""WITH s AS (SELECT event_id, user_id, ts, sum({STEPS}) OVER w AS s FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS counter FROM s""")
def counter_history(spark, d):
    by_day = steps(spark, d).withColumn("day", F.to_date("ts"))
    return engagement.saturating(by_day, "user_id", ["ts", "event_id"], "step", "day").select("event_id", "user_id", "counter")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {STEPS} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'error')),
f AS (SELECT user_id, i, greatest(0, v) AS c FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, greatest(0, f.c + e.v) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, CAST(arg_max(c, i) AS BIGINT) AS counter FROM f GROUP BY user_id""")
def counter_final(spark, d):
    by_day = steps(spark, d).withColumn("day", F.to_date("ts"))
    return engagement.final_counter(by_day, "user_id", ["ts", "event_id"], "step", "day")


@query("SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY user_id")
def view_counts(spark, d):
    return engagement.counts(table(spark, d, "events").filter("event_type = 'view'"), "user_id", "views")


@query("SELECT l_suppkey, l_returnflag, count(*) % 2 = 1 AS is_on FROM lineitem GROUP BY l_suppkey, l_returnflag")
def like_toggles(spark, d):
    return engagement.toggled(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_versions(spark, d):
    return engagement.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 2 = 0 THEN 'edited' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def owner_update(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority")
    # changes by even users count; by others they name the wrong owner
    changes = o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1).alias("o_custkey"), F.lit("edited").alias("o_orderpriority"))
    earlier = changes.withColumns({"o_orderpriority": F.lit("zzz"), "at": F.lit(1)})  # of two changes the later one counts
    both = earlier.unionByName(changes.withColumn("at", F.lit(2)))
    return engagement.updated(o, both, "o_orderkey", "o_custkey", ["o_orderpriority"], ["at"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_custkey % 3 = 0)")
def owner_delete(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_custkey")
    gone = o.filter("o_orderkey % 5 = 0").withColumn("o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(-1))
    return engagement.deleted(o, gone, ["o_orderkey", "o_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0)")
def cascade_delete(spark, d):
    users = table(spark, d, "customer").filter("c_acctbal >= 0")
    posts = engagement.cascade(users, orders(spark, d), "c_custkey", "o_custkey")
    return engagement.cascade(posts, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id + 1000000000, user_id, 'view' FROM events WHERE event_type = 'click'")
def append_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    new = e.filter("event_type = 'click'").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "user_id", F.lit("view").alias("event_type"))
    return e.unionByName(new)


@query("SELECT event_type, event_id, user_id FROM events WHERE event_type <> 'error' UNION ALL SELECT 'view', event_id + 1000000000, user_id FROM events WHERE event_type = 'click'")
def append_table(spark, d):
    """Rows written to a table in partitions by type, more of them added later, and some types read back."""
    folder = new_folder(spark, "events")
    e = table(spark, d, "events").select("event_type", "event_id", "user_id")
    files.append(e, folder, ["event_type"])
    files.append(e.filter("event_type = 'click'").select(F.lit("view").alias("event_type"), F.col("event_id") + 1_000_000_000, "user_id").toDF(*e.columns), folder, ["event_type"])
    return spark.read.schema(e.schema).parquet(folder).filter("event_type <> 'error'").select("event_type", "event_id", "user_id")


@query("SELECT o_orderkey, true AS can_read, coalesce(o_custkey = 5, false) AS can_write, false AS can_purge FROM orders")
def row_policies(spark, d):
    rules, me = {"select": "all", "update": "owner"}, F.lit(5)
    can = {name: engagement.allowed(op, F.col("o_custkey"), me, rules).alias(name) for name, op in (("can_read", "select"), ("can_write", "update"), ("can_purge", "purge"))}
    return orders(spark, d).select("o_orderkey", *can.values())


@query("""SELECT doc_id, CAST(NOT length(text) BETWEEN 1 AND 5000 AS INTEGER) + CAST(lang NOT IN ('en', 'de', 'fr') AS INTEGER) AS n_failed,
length(text) BETWEEN 1 AND 5000 AND lang IN ('en', 'de', 'fr') AS valid FROM documents""")
def check_constraints(spark, d):
    rules = {"length": F.char_length("text").between(1, 5000), "lang": F.col("lang").isin("en", "de", "fr")}
    return engagement.checked(table(spark, d, "documents"), rules).select("doc_id", F.size("failed").alias("n_failed"), "valid")


@query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '^[A-Za-z]+#[0-9]+5$')")
def identifier_filter(spark, d):
    return table(spark, d, "supplier").filter(F.col("s_name").rlike("^[A-Za-z]+#[0-9]+5$")).select("s_suppkey", "s_name")


@query("SELECT vec_id, label FROM embeddings e WHERE vec_id % 4 = 0 OR NOT EXISTS (SELECT 1 FROM embeddings f WHERE f.label = e.label AND f.vec_id % 4 = 0)")
def selected_or_all(spark, d):
    from tessel.operators import sequences

    e = table(spark, d, "embeddings").select("vec_id", "label")
    return sequences.active(e, e.filter("vec_id % 4 = 0"), "label", "vec_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS done, count(*) AS total FROM conversations GROUP BY conv_id")
def finished_jobs(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("done"), F.count("*").alias("total"))


@query("SELECT count(*) FILTER (length(html) >= 3000) AS succeeded, count(*) FILTER (length(html) < 3000) AS failed FROM pages")
def outcome_tally(spark, d):
    big = F.char_length("html") >= 3000
    return table(spark, d, "pages").agg(F.count_if(big).alias("succeeded"), F.count_if(~big).alias("failed"))


@query("SELECT max(o_orderkey) + 1 AS next_id, max(o_totalprice) AS most FROM orders")
def next_id(spark, d):
    return orders(spark, d).agg((F.max("o_orderkey") + 1).alias("next_id"), F.max("o_totalprice").alias("most"))


@query("""SELECT 'now' AS version, o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 2 = 0 THEN 'last' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_custkey % 3 = 0)
UNION ALL SELECT 'first', o_orderkey, o_custkey, o_orderpriority FROM orders""")
def versioned_orders(spark, d):
    """A table with changes, two of some keys and some by others than the owner, and deletions, compacted; and its first version."""
    o = orders(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority")
    kept = VersionedTable(spark, new_folder(spark, "orders"), "o_orderkey")
    first = kept.put(o)
    some = o.filter("o_orderkey % 7 = 0").withColumn("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1))
    twice = some.withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("o_orderpriority", F.when(F.col("at") == 2, "last").otherwise("zzz"))
    kept.change(twice, "o_custkey", ["o_orderpriority"], order="at")
    kept.delete(o.filter("o_orderkey % 5 = 0").withColumn("o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(-1)), "o_custkey")
    kept.compact()
    named = lambda df, name: df.select(F.lit(name).alias("version"), *o.columns)
    return named(kept.read(), "now").unionByName(named(kept.read(first), "first"))
