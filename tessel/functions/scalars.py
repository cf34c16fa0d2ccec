"""Scalar functions as Column expressions. Rounding is half up: floor(x + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: The words of relative times.
AGO = {
    "en": ("just now", " min ago", " h ago", " d ago"),
    "de": ("gerade eben", " Min. her", " Std. her", " T. her"),
    "fr": ("à l'instant", " min", " h", " j"),
}


def relative_time(ts: Column, now: Column, lang: str = "en") -> Column:
    """Below a minute, an hour, a day, 30 days, else the date. ``now`` is given, not read."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    words = AGO[lang]
    part = lambda size, word: F.concat(F.floor(s / size).cast("string"), F.lit(word))
    return F.when(s < 60, words[0]).when(s < 3600, part(60, words[1])).when(s < 86400, part(3600, words[2])).when(s < 30 * 86400, part(86400, words[3])).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def short_date(ts: Column, now: Column) -> Column:
    """The time if it is today, else month and day."""
    return F.when(F.to_date(ts) == F.to_date(now), F.date_format(ts, "HH:mm")).otherwise(F.date_format(ts, "MM.dd"))


def minutes(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def byte_size(n: Column, decimals: int = 1) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.round(kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string(f"%.{decimals}f", F.round(mb, decimals)), F.lit(" MB")))


#: Labels of extensions, and extensions of media types.
LABELS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "gif": "GIF", "webp": "WebP", "bmp": "BMP", "ico": "ICO", "svg": "SVG"}
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "audio/mpeg": "mp3", "audio/wav": "wav", "audio/ogg": "ogg"}


def lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise)


def format_label(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    return lookup(ext, LABELS, F.upper(ext))


def extension(media: Column, fallback: str = "bin") -> Column:
    return lookup(media, EXTENSIONS, F.lit(fallback))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def trimmed(x: Column) -> Column:
    """Without white space at the ends, by Unicode's idea of it."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def first_filled(*columns: Column, default: str) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default))


def tags(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), trimmed), lambda t: t != "")


def json_or(document: Column, paths: list[str], otherwise: Column) -> Column:
    return F.coalesce(*(F.get_json_object(document, p) for p in paths), otherwise)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))


def truncated(x: Column, n: int = 160) -> Column:
    """The first ``n`` code points."""
    return F.left(x, F.lit(n))


def local_part(mail: Column) -> Column:
    return F.substring_index(mail, "@", 1)


def language(locale: Column, known: list[str], default: str) -> Column:
    low, out = F.lower(locale), F.lit(default)
    for k in reversed(known):
        out = F.when(low.startswith(k), k).otherwise(out)
    return out


def listed(value: Column, csv: Column) -> Column:
    """Whether a comma list names the value, or is a wildcard."""
    items = F.transform(F.split(csv, ","), trimmed)
    return F.array_contains(items, F.lit("*")) | F.array_contains(items, value)


def block_kind(line: Column) -> Column:
    return F.when(line.startswith("### "), "h3").when(line.startswith("## "), "h2").otherwise("p")


def claims(token: Column, schema: str) -> Column:
    """The payload of a three-part token as a struct, null if it has another shape. The
    signature isn't verified, so this parses data and decides nothing about access."""
    parts = F.split(token, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), (F.lit(4) - F.length(body) % 4) % 4))
    return F.when(F.size(parts) == 3, F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), schema))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def colour_channel(colour: Column, at: int) -> Column:
    return F.conv(F.substring(colour, 2 + 2 * at, 2), 16, 10).cast("int")


def upload_fault(media: Column, size: Column, allowed: list[str], most: int, size_first: bool = False) -> Column:
    """The first rule that fails (null: none); which one is asked first is the caller's choice."""
    kind, big = (~media.isin(allowed), "type"), (size > most, "size")
    (c1, n1), (c2, n2) = (big, kind) if size_first else (kind, big)
    return F.when(c1, n1).when(c2, n2)


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def random_id() -> Column:
    """A new random identifier for each row: another one whenever a row is worked out again, so it
    is to be written before it is used twice."""
    return F.uuid()
