"""Web documents: metadata of routes, head rewriting, structured data, site maps, blocklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(replacement: Column) -> Column:
    """For regexp_replace: back-slashes and dollars taken literally."""
    return F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def escaped(x: Column) -> Column:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url(base: str, lang: Column, route: Column) -> Column:
    """``base/lang/route``; the empty route is the language's home."""
    return F.concat_ws("/", F.lit(base), lang, F.nullif(route, F.lit("")))


def alternates(base: str, route: Column, langs: list[str], default: str) -> Column:
    """An array of (lang, href) for each language and the default."""
    each = [F.struct(F.lit(x).alias("lang"), url(base, F.lit(x), route).alias("href")) for x in langs]
    return F.array(*each, F.struct(F.lit("x-default").alias("lang"), url(base, F.lit(default), route).alias("href")))


def meta(kind: str, name: str, value: Column) -> tuple[str, Column]:
    """A pattern for a meta tag, and the tag."""
    return f'<meta\\s+{kind}="{name}"[^>]*>', F.concat(F.lit(f'<meta {kind}="{name}" content="'), escaped(value), F.lit('">'))


def alternate_links(links: Column) -> Column:
    """The link tags of an array of (lang, href)."""
    tag = lambda x: F.concat(F.lit('<link rel="alternate" hreflang="'), x["lang"], F.lit('" href="'), escaped(x["href"]), F.lit('">'))
    return F.concat_ws("", F.transform(links, tag))


def head_rewritten(html: Column, lang: Column, title: Column, description: Column, canonical: Column, links: Column, locale: Column) -> Column:
    """A page with its language, title, description, addresses and their copies for shares in the
    head: the first tag of a kind is replaced, and what is missing goes to the head's end, then the
    ``links`` to its other languages, in place of those it had. The head is cut off once, and each
    tag takes one pass over it, so the expression grows by a tag with each tag. A page without an
    end of the head gets no new tags."""
    parts = F.split(html, "(?i)</head>", 2)
    head = F.get(parts, F.lit(0))
    tags = [
        ("<title>.*?</title>", F.concat(F.lit("<title>"), escaped(title), F.lit("</title>"))),
        meta("name", "description", description),
        meta("property", "og:title", title),
        meta("property", "og:description", description),
        meta("property", "og:url", canonical),
        meta("property", "og:locale", locale),
        meta("name", "twitter:title", title),
        meta("name", "twitter:description", description),
        ('<link\\s+rel="canonical"[^>]*>', F.concat(F.lit('<link rel="canonical" href="'), escaped(canonical), F.lit('">'))),
    ]
    out = F.regexp_replace(head, r'(?is)^(.*?<html)(?:\s+lang="[^"]*")?', F.concat(F.lit('$1 lang="'), quoted(lang), F.lit('"')))
    out = F.regexp_replace(out, r'(?is)<link\s+rel="alternate"\s+hreflang="[^"]*"[^>]*>', F.lit(""))
    for pattern, tag in tags:
        out = F.regexp_replace(out, f"(?is)^(.*?){pattern}", F.concat(F.lit("$1"), quoted(tag)))
    missing = [F.when(head.rlike(f"(?is){pattern}"), "").otherwise(tag) for pattern, tag in tags]
    rest = F.concat(*missing, alternate_links(links), F.lit("</head>"), F.get(parts, F.lit(1)))
    return F.concat(out, F.when(F.size(parts) > 1, rest).otherwise(""))


def typed(kind: str, *fields: Column) -> Column:
    """A schema.org object."""
    return F.struct(F.lit(kind).alias("@type"), *fields)


def linked_data(kind: str, *fields: Column) -> Column:
    """schema.org data of a page as JSON."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *fields))


def organization(name: str, address: str, logo: str) -> list[Column]:
    return [F.lit(name).alias("name"), F.lit(address).alias("url"), F.lit(logo).alias("logo")]


def web_page(name: Column, address: Column) -> Column:
    return linked_data("WebPage", name.alias("name"), address.alias("url"))


def article(headline: Column, address: Column, published: Column, changed: Column, publisher: list[Column]) -> Column:
    dates = [published.alias("datePublished"), changed.alias("dateModified")]
    return linked_data("Article", headline.alias("headline"), address.alias("url"), *dates, typed("Organization", *publisher).alias("publisher"))


def blog(name: Column, address: Column, publisher: list[Column]) -> Column:
    return linked_data("Blog", name.alias("name"), address.alias("url"), typed("Organization", *publisher).alias("publisher"))


def person(name: Column) -> Column:
    return typed("Person", name.alias("name"))


def blog_posting(headline: Column, address: Column, published: Column, author: Column, words: Column) -> Column:
    return linked_data("BlogPosting", headline.alias("headline"), address.alias("url"), published.alias("datePublished"), person(author).alias("author"), words.alias("wordCount"))


def page_of(kind: str, name: Column, address: Column, parts: Column | None = None) -> Column:
    """A CollectionPage, ContactPage or the like, with the pages that it lists, an array of (name, url)."""
    listed = [] if parts is None else [F.transform(parts, lambda p: typed("WebPage", p["name"].alias("name"), p["url"].alias("url"))).alias("hasPart")]
    return linked_data(kind, name.alias("name"), address.alias("url"), *listed)


def image_gallery(name: Column, address: Column, images: Column) -> Column:
    """``images``: an array of (name, url)."""
    return linked_data("ImageGallery", name.alias("name"), address.alias("url"), F.transform(images, lambda i: typed("ImageObject", i["name"].alias("name"), i["url"].alias("contentUrl"))).alias("image"))


def music_playlist(name: Column, address: Column, tracks: Column) -> Column:
    """``tracks``: an array of (name, seconds); durations are in ISO 8601."""
    length = lambda s: F.format_string("PT%dM%dS", F.floor(s / 60), (s % 60).cast("bigint"))
    made = F.transform(tracks, lambda t: typed("MusicRecording", t["name"].alias("name"), length(t["seconds"]).alias("duration")))
    return linked_data("MusicPlaylist", name.alias("name"), address.alias("url"), F.size(tracks).alias("numTracks"), made.alias("track"))


def forum_posting(headline: Column, address: Column, author: Column, published: Column, comments: Column) -> Column:
    """``comments``: an array of (author, text)."""
    made = F.transform(comments, lambda c: typed("Comment", person(c["author"]).alias("author"), c["text"].alias("text")))
    return linked_data("DiscussionForumPosting", headline.alias("headline"), address.alias("url"), person(author).alias("author"), published.alias("datePublished"), F.size(comments).alias("commentCount"), made.alias("comment"))


def faq(entries: Column) -> Column:
    """``entries``: an array of (q, a); those without a question or an answer are left out."""
    question = lambda e: typed("Question", e["q"].alias("name"), typed("Answer", e["a"].alias("text")).alias("acceptedAnswer"))
    return linked_data("FAQPage", F.transform(complete_entries(entries), question).alias("mainEntity"))


def application(name: Column, address: Column, category: str) -> Column:
    """A free application that runs in a browser."""
    offer = typed("Offer", F.lit("0").alias("price"), F.lit("USD").alias("priceCurrency"))
    return linked_data("SoftwareApplication", name.alias("name"), address.alias("url"), F.lit(category).alias("applicationCategory"), F.lit("Web").alias("operatingSystem"), offer.alias("offers"))


def breadcrumb(names: list[Column]) -> Column:
    items = [typed("ListItem", F.lit(i).alias("position"), n.alias("name")) for i, n in enumerate(names, 1)]
    return linked_data("BreadcrumbList", F.array(*items).alias("itemListElement"))


def sitemap_entries(routes: DataFrame, base: str, day: str, langs: list[str], default: str) -> DataFrame:
    """A row for each url of ``routes`` (lang, route, changes, weight), with its XML."""
    address = url(base, F.col("lang"), F.col("route"))
    link = lambda x: F.concat(F.lit('<xhtml:link rel="alternate" hreflang="'), x["lang"], F.lit('" href="'), escaped(x["href"]), F.lit('"/>'))
    links = F.concat_ws("", F.transform(alternates(base, F.col("route"), langs, default), link))
    xml = F.concat(F.lit("<url><loc>"), escaped(address), F.lit(f"</loc><lastmod>{day}</lastmod><changefreq>"), "changes", F.lit("</changefreq><priority>"), F.format_number("weight", 1), F.lit("</priority>"), links, F.lit("</url>"))
    return routes.select("lang", "route", address.alias("loc"), xml.alias("xml"))


#: Urls of one site map, as its protocol limits them.
SITEMAP_URLS = 50_000


def sitemap_documents(entries: DataFrame) -> DataFrame:
    """(lang, part, xml, txt): for each language its site map, in parts of ``SITEMAP_URLS``, as XML
    and as a list of lines. Parts are ranges of a hash, so that no task has to number all of a language;
    should a range still hold too many, it is cut by order into further parts."""
    n = entries.groupBy("lang").agg(F.ceil(F.count("*") / (0.9 * SITEMAP_URLS)).cast("int").alias("_parts"))
    dealt = entries.join(n, "lang").withColumn("_range", F.pmod(F.xxhash64("loc"), F.col("_parts")).cast("int"))
    at = F.row_number().over(Window.partitionBy("lang", "_range").orderBy("loc"))
    parts = dealt.withColumn("part", (F.col("_range") + F.col("_parts") * F.floor((at - 1) / SITEMAP_URLS)).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("loc", "xml")))
    joined = lambda name, between: F.concat_ws(between, F.transform("rows", lambda x: x[name]))
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">'
    made = F.concat(F.lit(head), joined("xml", ""), F.lit("</urlset>"))
    return parts.groupBy("lang", "part").agg(rows.alias("rows")).select("lang", "part", made.alias("xml"), joined("loc", "\n").alias("txt"))


def blocked(x: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def filled(html: Column, placeholder: str, body: Column) -> Column:
    return F.replace(html, F.lit(placeholder), body)


def resolved(paths: DataFrame, files: DataFrame, redirects: DataFrame, fallback: str) -> DataFrame:
    """(path, target): a redirect, else the file of that name, else its index, else the fallback.
    ``redirects`` (path, target) and ``files`` (path)."""
    r = redirects.select("path", F.col("target").alias("_r"))
    f = files.select("path", F.col("path").alias("_f"))
    i = files.filter(F.col("path").endswith("/index.html")).select(F.regexp_replace("path", "/index\\.html$", "").alias("path"), F.col("path").alias("_i"))
    return paths.join(r, "path", "left").join(f, "path", "left").join(i, "path", "left").select("path", F.coalesce("_r", "_f", "_i", F.lit(fallback)).alias("target"))


def complete_entries(entries: Column) -> Column:
    """Entries with a question and an answer."""
    return F.filter(entries, lambda e: (F.coalesce(e["q"], F.lit("")) != "") & (F.coalesce(e["a"], F.lit("")) != ""))
