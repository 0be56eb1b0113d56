"""Normalisation, redaction and validation of text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits in characters.
EVENT_FIELD, EVENT_MESSAGE, PROGRESS_MESSAGE, ERROR_MESSAGE = 160, 300, 240, 500
# Fixed patterns: what is redacted, document ids and addresses, windows of days.
BEARER = r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+"
SECRET = r"(?i)(access_token|refresh_token|client_secret|authorization)\s*[:=]\s*[^\s,;]+"
DOCUMENT_HOST, DOCUMENT_PATH, DOCUMENT_PART, DOCUMENT_ID = "docs.google.com", r"(^|/)document(/|$)", r"(?:^|/)d/([^/]+)", r"^[A-Za-z0-9_-]{10,200}$"
WINDOW, WINDOW_DAYS = r"^([1-9][0-9]*)d$", 90
# Fixed image types; any other becomes .png.
IMAGE_SUFFIXES = {"image/gif": ".gif", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def redact(text: Column) -> Column:
    """Bearer tokens first, then key and value pairs of secrets; letters match in either case."""
    return F.regexp_replace(F.regexp_replace(text, BEARER, "Bearer [redacted]"), SECRET, "$1=[redacted]")


def truncate(text: Column, length: int) -> Column:
    """The first characters (not bytes); redact before."""
    return F.substring(text, 1, length)


def diagnostic(text: Column, length: int) -> Column:
    return truncate(redact(text), length)


def sanitize_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9_\-]", "")


def sanitize_text(text: Column) -> Column:
    """Without tags, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\r\n\t ]+", " "))


def whole_number(text: Column) -> Column:
    """The number of a text of digits alone; null for others and beyond a long."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("long"))


def normalized(text: Column, length: int) -> Column:
    """Without control and other invisible characters, but for tabs and line ends; trimmed, then cut; null is empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}&&[^\t\n\r]]", "")
    return F.substring(F.regexp_replace(plain, r"^\s+|\s+$", ""), 1, length)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def parse_document_id(kind: Column, value: Column) -> Column:
    """The id from a picker, a plain id or a document address; null where it isn't valid."""
    host, path = F.try_parse_url(value, F.lit("HOST")), F.try_parse_url(value, F.lit("PATH"))
    from_url = F.when((host == DOCUMENT_HOST) & path.rlike(DOCUMENT_PATH), F.regexp_extract(path, DOCUMENT_PART, 1))
    found = F.when(kind == "url", from_url).when(kind.isin("picker", "file_id"), F.trim(value))
    return F.when(found.rlike(DOCUMENT_ID), found)


def site_hash(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Fa-f0-9]{64}$"), F.lower(text))


def window_days(text: Column) -> Column:
    """Days of a window such as 30d; null unless from 1 to 90."""
    days = F.regexp_extract(text, WINDOW, 1).try_cast("int")
    return F.when(days <= WINDOW_DAYS, days)


def short_id(seed: Column, counter: Column) -> Column:
    """The first eight hex digits of SHA-256 of seed:counter."""
    return F.substring(F.sha2(F.concat(seed, F.lit(":"), counter.cast("string")), 256), 1, 8)


def image_suffix(content_type: Column) -> Column:
    plain = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    pairs = [F.lit(x) for pair in IMAGE_SUFFIXES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), plain), F.lit(".png"))


def image_path(source: Column) -> Column:
    """A local image's path without query and fragment, decoded; null where it leaves its folder or is remote."""
    plain = F.try_url_decode(F.regexp_replace(source, r"[?#].*$", ""))
    outside = plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^/|(^|/)\.\.(/|$)|\\") | (plain == "")
    return F.when(~outside, F.regexp_replace(plain, r"^(\./)+", ""))


def image_source(source: Column) -> Column:
    """A source of an image as kind (remote, unsafe or local) and path: remote ones and inline data have no path, nor has an empty one, which counts as remote."""
    for name, char in (("&quot;", '"'), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        source = F.replace(source, F.lit(name), F.lit(char))
    source = F.trim(source)
    remote = source.rlike(r"(?i)^(https?:)?//|^(data|blob):") | (source == "")
    path = image_path(F.regexp_replace(F.regexp_replace(source, "^file://[^/]*", ""), "^/+", ""))
    kind = F.when(remote, "remote").when(path.isNull(), "unsafe").otherwise("local")
    return F.struct(kind.alias("kind"), F.when(~remote, path).alias("path"))


def natural_key(name: Column) -> Column:
    """Sorts names with numbers by value and letters in lower case: before the digits of a number stands how many they are, in ten places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)), "")


def contains_any(fields: list[Column], needle: str) -> Column:
    """Whether any field contains the needle, in lower case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(f.cast("string")).contains(needle.lower()), F.lit(False)) for f in fields])
