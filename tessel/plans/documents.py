"""Documents: the pages table, and routes from regions and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.catalog import query, table
from tessel.operators import documents as D
from tessel.shared import new_folder
from tessel.sources import files

BASE, DAY, LANGS = "https://example.org", "2024-01-31", ["en", "de", "fr"]


def routes(spark, d):
    langs = spark.createDataFrame([(x,) for x in LANGS], "lang string")
    return langs.crossJoin(table(spark, d, "region").select(F.lower("r_name").alias("route")))


ROUTES = "r AS (SELECT lang, lower(r_name) AS route FROM (VALUES ('en'), ('de'), ('fr')) v(lang), region)"


@query(f"""WITH {ROUTES}, l AS (SELECT lang, route, unnest(['en', 'de', 'fr', 'x-default']) AS alt FROM r)
SELECT lang, route, alt, '{BASE}/' || CASE alt WHEN 'x-default' THEN 'en' ELSE alt END || '/' || route AS href FROM l""")
def route_alternates(spark, d):
    alt = F.explode(D.alternates(BASE, F.col("route"), LANGS, "en")).alias("a")
    return routes(spark, d).select("lang", "route", alt).select("lang", "route", F.col("a.lang").alias("alt"), F.col("a.href").alias("href"))


#: In SQL: a route's entry of the site map.
ENTRIES = f"""{ROUTES}, e AS (SELECT lang, route, '{BASE}/' || lang || '/' || route AS loc, '<url><loc>{BASE}/' || lang || '/' || route || '</loc><lastmod>{DAY}</lastmod><changefreq>' || CASE WHEN route = 'asia' THEN 'weekly' ELSE 'monthly' END || '</changefreq><priority>' ||
CASE WHEN route = 'asia' THEN '0.8' ELSE '0.5' END || '</priority>' || string_agg('<xhtml:link rel="alternate" hreflang="' || alt || '" href="{BASE}/' || CASE alt WHEN 'x-default' THEN 'en' ELSE alt END || '/' || route || '"/>', '' ORDER BY k) || '</url>' AS xml
FROM (SELECT lang, route, unnest(['en', 'de', 'fr', 'x-default']) AS alt, unnest([1, 2, 3, 4]) AS k FROM r) GROUP BY lang, route)"""


def entries(spark, d):
    weekly = F.col("route") == "asia"
    rows = routes(spark, d).withColumn("changes", F.when(weekly, "weekly").otherwise("monthly")).withColumn("weight", F.when(weekly, 0.8).otherwise(0.5))
    return D.sitemap_entries(rows, BASE, DAY, LANGS, "en")


@query(f"WITH {ENTRIES} SELECT * FROM e")
def sitemap(spark, d):
    return entries(spark, d)


@query(f"""WITH {ENTRIES} SELECT lang, 0 AS part, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">' || string_agg(xml, '' ORDER BY loc) || '</urlset>' AS xml,
string_agg(loc, chr(10) ORDER BY loc) AS txt FROM e GROUP BY lang""")
def sitemap_documents(spark, d):
    return D.sitemap_documents(entries(spark, d))


@query(f"WITH {ENTRIES} SELECT lang || '/' || route || '/index.html' AS route, loc AS value FROM e")
def localized_files(spark, d):
    """Writes a file for each language and route, and reads them back."""
    folder = new_folder(spark, "pages")
    files.put(entries(spark, d).select(F.concat("lang", F.lit("/"), "route", F.lit("/index.html")).alias("key"), F.encode("loc", "UTF-8").alias("content")), folder).count()
    back = files.files(spark, folder, "index.html")
    return back.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("route"), F.decode("content", "UTF-8").alias("value"))


PUBLISHER = "{'@type': 'Organization', 'name': 'Example', 'url': 'https://example.org', 'logo': 'https://example.org/logo.png'}"


@query(f"""WITH {ROUTES}, a AS (SELECT *, '{BASE}/' || lang || '/' || route AS u FROM r) SELECT lang, route, CAST(CASE route
WHEN 'asia' THEN to_json({{'@context': 'https://schema.org', '@type': 'Article', 'headline': route, 'url': u, 'datePublished': '{DAY}', 'dateModified': '{DAY}', 'publisher': {PUBLISHER}}})
WHEN 'africa' THEN to_json({{'@context': 'https://schema.org', '@type': 'FAQPage', 'mainEntity': [{{'@type': 'Question', 'name': 'What is ' || route || '?', 'acceptedAnswer': {{'@type': 'Answer', 'text': 'A region.'}}}}]}})
WHEN 'america' THEN to_json({{'@context': 'https://schema.org', '@type': 'SoftwareApplication', 'name': route, 'url': u, 'applicationCategory': 'DesignApplication', 'operatingSystem': 'Web', 'offers': {{'@type': 'Offer', 'price': '0', 'priceCurrency': 'USD'}}}})
WHEN 'europe' THEN to_json({{'@context': 'https://schema.org', '@type': 'Blog', 'name': route, 'url': u, 'publisher': {PUBLISHER}}})
ELSE to_json({{'@context': 'https://schema.org', '@type': 'WebPage', 'name': route, 'url': u}}) END AS VARCHAR) AS data,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'Organization', 'name': 'Example', 'url': 'https://example.org', 'logo': 'https://example.org/logo.png'}}) AS VARCHAR) AS publisher,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'BreadcrumbList', 'itemListElement': [{{'@type': 'ListItem', 'position': 1, 'name': lang}}, {{'@type': 'ListItem', 'position': 2, 'name': route}}]}}) AS VARCHAR) AS crumbs FROM a""")
def structured_data(spark, d):
    route, address, day = F.col("route"), D.url(BASE, F.col("lang"), F.col("route")), F.lit(DAY)
    org = D.organization("Example", BASE, f"{BASE}/logo.png")
    asked = F.array(F.struct(F.concat(F.lit("What is "), route, F.lit("?")).alias("q"), F.lit("A region.").alias("a")), F.struct(F.lit("Unanswered?").alias("q"), F.lit("").alias("a")))
    data = F.when(route == "asia", D.article(route, address, day, day, org)).when(route == "africa", D.faq(asked)).when(route == "america", D.application(route, address, "DesignApplication")).when(route == "europe", D.blog(route, address, org)).otherwise(D.web_page(route, address))
    return routes(spark, d).select("lang", "route", data.alias("data"), D.linked_data("Organization", *org).alias("publisher"), D.breadcrumb([F.col("lang"), route]).alias("crumbs"))


@query(f"""WITH {ROUTES}, a AS (SELECT *, '{BASE}/' || lang || '/' || route AS u, length(route) AS n FROM r), p AS (SELECT *, [{{'name': route || ' 1', 'url': u || '/1'}}, {{'name': route || ' 2', 'url': u || '/2'}}] AS parts FROM a)
SELECT lang, route,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'BlogPosting', 'headline': route, 'url': u, 'datePublished': '{DAY}', 'author': {{'@type': 'Person', 'name': lang}}, 'wordCount': n}}) AS VARCHAR) AS posting,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'CollectionPage', 'name': route, 'url': u, 'hasPart': list_transform(parts, lambda x: {{'@type': 'WebPage', 'name': x.name, 'url': x.url}})}}) AS VARCHAR) AS collection,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'ContactPage', 'name': route, 'url': u}}) AS VARCHAR) AS contact,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'ImageGallery', 'name': route, 'url': u, 'image': list_transform(parts, lambda x: {{'@type': 'ImageObject', 'name': x.name, 'contentUrl': x.url}})}}) AS VARCHAR) AS gallery,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'MusicPlaylist', 'name': route, 'url': u, 'numTracks': 2, 'track': list_transform(parts, lambda x: {{'@type': 'MusicRecording', 'name': x.name, 'duration': 'PT' || (n * 20 // 60) || 'M' || (n * 20 % 60) || 'S'}})}}) AS VARCHAR) AS playlist,
CAST(to_json({{'@context': 'https://schema.org', '@type': 'DiscussionForumPosting', 'headline': route, 'url': u, 'author': {{'@type': 'Person', 'name': lang}}, 'datePublished': '{DAY}', 'commentCount': 2, 'comment': list_transform(parts, lambda x: {{'@type': 'Comment', 'author': {{'@type': 'Person', 'name': x.name}}, 'text': x.url}})}}) AS VARCHAR) AS thread FROM p""")
def structured_pages(spark, d):
    route, lang, day = F.col("route"), F.col("lang"), F.lit(DAY)
    address, n = D.url(BASE, lang, route), F.char_length("route")
    parts = F.array(*(F.struct(F.concat(route, F.lit(f" {i}")).alias("name"), F.concat(address, F.lit(f"/{i}")).alias("url")) for i in (1, 2)))
    tracks = F.transform(parts, lambda p: F.struct(p["name"].alias("name"), (n * 20).alias("seconds")))
    comments = F.transform(parts, lambda p: F.struct(p["name"].alias("author"), p["url"].alias("text")))
    made = {"posting": D.blog_posting(route, address, day, lang, n), "collection": D.page_of("CollectionPage", route, address, parts), "contact": D.page_of("ContactPage", route, address), "gallery": D.image_gallery(route, address, parts), "playlist": D.music_playlist(route, address, tracks), "thread": D.forum_posting(route, address, lang, day, comments)}
    return routes(spark, d).select("lang", "route", *(c.alias(k) for k, c in made.items()))


def rewritten_sql() -> str:
    """The whole page by RE2's replacements, a step for each tag."""
    esc = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    values = {"title": "title", "about": "'about ' || page_id", "address": f"'{BASE}/' || page_id", "locale": "'fr_FR'"}
    kinds = [("name", "description", "about"), ("property", "og:title", "title"), ("property", "og:description", "about"), ("property", "og:url", "address"), ("property", "og:locale", "locale"), ("name", "twitter:title", "title"), ("name", "twitter:description", "about")]
    tags = [("<title>.*?</title>", f"'<title>' || {esc('title')} || '</title>'")]
    tags += [(f'<meta\\s+{kind}="{name}"[^>]*>', f"""'<meta {kind}="{name}" content="' || {esc(values[v])} || '">'""") for kind, name, v in kinds]
    tags += [('<link\\s+rel="canonical"[^>]*>', f"""'<link rel="canonical" href="' || {esc(values['address'])} || '">'""")]
    out = """regexp_replace(regexp_replace(head, '(?is)^(.*?<html)(?:\\s+lang="[^"]*")?', '\\1 lang="fr"'), '(?is)<link\\s+rel="alternate"\\s+hreflang="[^"]*"[^>]*>', '', 'g')"""
    for pattern, tag in tags:
        out = f"regexp_replace({out}, '(?is)^(.*?){pattern}', '\\1' || replace({tag}, '\\', '\\\\'))"
    missing = " || ".join(f"CASE WHEN regexp_matches(head, '(?is){pattern}') THEN '' ELSE {tag} END" for pattern, tag in tags)
    links = " || ".join(f"""'<link rel="alternate" hreflang="{x}" href="{BASE}/{'en' if x == 'x-default' else x}/' || page_id || '">'""" for x in [*LANGS, "x-default"])
    cut = "length(regexp_extract(html, '(?is)^(.*?)</head>', 1))"
    return f"""WITH t AS (SELECT page_id, 'Page ' || page_id || ' & more $1' AS title, html, regexp_matches(html, '(?i)</head>') AS cut FROM pages),
h AS (SELECT *, CASE WHEN cut THEN left(html, {cut}) ELSE html END AS head, CASE WHEN cut THEN substr(html, {cut} + 8) END AS tail FROM t)
SELECT page_id, CASE WHEN cut THEN {out} || {missing} || {links} || '</head>' || tail ELSE {out} END AS page FROM h"""


@query(rewritten_sql())
def head_rewrite(spark, d):
    title = F.concat(F.lit("Page "), "page_id", F.lit(" & more $1"))
    number = F.col("page_id").cast("string")
    made = D.head_rewritten(F.col("html"), F.lit("fr"), title, F.concat(F.lit("about "), number), F.concat(F.lit(f"{BASE}/"), number), D.alternates(BASE, number, LANGS, "en"), F.lit("fr_FR"))
    return table(spark, d, "pages").select("page_id", made.alias("page"))


@query("""SELECT page_id, contains(url, 'shop') OR contains(url, 'example.net') OR contains(html, 'track(0)') AS blocked, length(replace(html, '</body>', '<p>end</p></body>')) AS n FROM pages""")
def page_filters(spark, d):
    hit = D.blocked(F.col("url"), ["shop", "example.net"]) | D.blocked(F.col("html"), ["track(0)"])
    return table(spark, d, "pages").select("page_id", hit.alias("blocked"), F.char_length(D.filled(F.col("html"), "</body>", F.lit("<p>end</p></body>"))).alias("n"))


@query("""SELECT '/' || lower(n_name) AS path, CASE WHEN n_nationkey % 5 = 0 THEN '/moved/' || n_nationkey WHEN n_nationkey % 5 = 1 THEN '/' || lower(n_name) WHEN n_nationkey % 5 = 2 THEN '/' || lower(n_name) || '/index.html' ELSE '/404.html' END AS target FROM nation""")
def path_fallback(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("/"), F.lower("n_name")).alias("path"))
    redirects = n.filter("n_nationkey % 5 = 0").select("path", F.concat(F.lit("/moved/"), "n_nationkey").alias("target"))
    files = n.filter("n_nationkey % 5 = 1").select("path").unionByName(n.filter("n_nationkey % 5 = 2").select(F.concat("path", F.lit("/index.html")).alias("path")))
    return D.resolved(n.select("path"), files, redirects, "/404.html")


@query("""SELECT conv_id, count(*) FILTER (text <> '' AND turn % 3 <> 2) AS kept FROM conversations GROUP BY conv_id""")
def complete_answers(spark, d):
    entry = F.struct(F.col("text").alias("q"), F.when(F.col("turn") % 3 != 2, "x").otherwise("").alias("a"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(entry).alias("e")).select("conv_id", F.size(D.complete_entries(F.col("e"))).cast("bigint").alias("kept"))
