"""Column functions on HTML source: title, text, meta, links, linked data, and the course record of a page."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.classify import evidence, level
from millrace.functions.text import SPACE, decode_entities, decoded, once

#: Text that is read for a level.
LEVEL_CHARS = 4000


def page_text(html: Column) -> Column:
    """What is left without scripts, styles and tags; references stay."""
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        html = F.regexp_replace(html, p, " ")
    return F.trim(F.regexp_replace(html, f"{SPACE}+", " "))


def title(html: Column) -> Column:
    """The longest part of the title between |, middle dots and dashes that stand free; the first of equals."""
    raw = decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))

    def longest(whole: Column) -> Column:
        # not F.trim itself: it takes two columns, and its second would be the place of the part
        parts = F.filter(F.transform(F.split(whole, f"{SPACE}+[|·–—]{SPACE}+"), lambda x: F.trim(x)), lambda x: x != "")
        best = F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
        return F.when(F.size(parts) < 2, whole).otherwise(best)

    return once(raw, longest)


def meta(html: Column, name: str) -> Column:
    """The content of the first kind of meta element that is there, by property before name."""
    key, content = "\\Q" + name + "\\E", r"content=[\"']([^\"']*)[\"']"
    found = None
    for attribute in ("property", "name"):
        named = rf"{attribute}=[\"']{key}[\"']"
        for p in (rf"(?i)<meta[^>]*{named}[^>]*{content}", rf"(?i)<meta[^>]*{content}[^>]*{named}"):
            value = decoded(F.regexp_extract(html, p, 1))
            found = F.when(html.rlike(p), value) if found is None else found.when(html.rlike(p), value)
    return found


def hrefs(html: Column) -> Column:
    """Decoded targets of links without fragments, scripts and mail; repeats stay."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]*href=[\"']([^\"'#]+)[\"']"), 1)
    plain = F.transform(found, lambda x: F.trim(F.when(F.contains(x, F.lit("&")), decode_entities(x)).otherwise(x)))
    return F.filter(plain, lambda x: (x != "") & ~F.startswith(x, F.lit("javascript:")) & ~F.startswith(x, F.lit("mailto:")))


def absolute(href: str, base: str) -> str | None:
    """href against base, serialised as browsers do for http(s); null if that makes no URL."""
    try:
        parts = urlsplit(urljoin(base, href))
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        if parts.scheme not in ("http", "https"):
            return urlunsplit(parts)
        port = "" if parts.port in (None, {"http": 80, "https": 443}[parts.scheme]) else f":{parts.port}"
        user = parts.netloc.rpartition("@")[0]
        host = parts.hostname if parts.hostname.isascii() else parts.hostname.encode("idna").decode()
        place = f"{user}@{host}{port}" if user else f"{host}{port}"
        safe = "/%:@!$&'()*+,;=-._~|[]^"
        return urlunsplit((parts.scheme, place, quote(parts.path, safe) or "/", quote(parts.query, safe + "?`{}"), quote(parts.fragment, safe + "?")))
    except ValueError:
        return None


@F.arrow_udf(ArrayType(StringType()))
def _resolved(links: pa.Array, bases: pa.Array) -> pa.Array:
    out = []
    for found, base in zip(links.to_pylist(), bases.to_pylist(), strict=True):
        whole = [absolute(x, base or "") for x in found or []]
        out.append(list(dict.fromkeys(x for x in whole if x is not None)))
    return pa.array(out, pa.list_(pa.string()))


def links(html: Column, base: Column) -> Column:
    """Absolute links in order of first appearance."""
    return _resolved(hrefs(html), base)


def json_ld(html: Column) -> Column:
    """The entities of all linked-data blocks, as array<variant>; malformed blocks are skipped, lists and graphs flattened."""
    block = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    parsed = F.transform(F.regexp_extract_all(html, F.lit(block), 1), lambda x: F.try_parse_json(F.trim(x)))
    as_list = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    items = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), as_list))
    objects = F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.flatten(
        F.transform(objects, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v)))
    )


def course_entity(blocks: Column) -> Column:
    """The first entity of type Course, or null."""

    def is_course(v: Column) -> Column:
        types = F.try_variant_get(v, "$['@type']", "array<string>")
        one = F.try_variant_get(v, "$['@type']", "string")
        return F.coalesce(F.array_contains(types, "Course"), one == "Course", F.lit(False))

    return F.try_element_at(F.filter(blocks, is_course), F.lit(1))


def course_parts(html: Column) -> list[Column]:
    """What course_record() reads: the linked data, its course and the text, to be projected before it."""
    return [json_ld(html).alias("blocks"), course_entity(json_ld(html)).alias("entity"), page_text(html).alias("text")]


def course_record(html: Column, url: Column, blocks: Column, entity: Column, text: Column) -> list[Column]:
    """The fields of a page's record: linked data first, then Open Graph, then title and text."""
    said = lambda key: F.try_variant_get(entity, f"$.{key}", "string")
    provider = F.try_variant_get(entity, "$.provider.name", "string")
    language = F.coalesce(decoded(said("inLanguage")), meta(html, "og:locale"))
    plain_provider = F.when(F.schema_of_variant(F.try_variant_get(entity, "$.provider", "variant")) == "STRING", said("provider"))
    return [
        F.coalesce(meta(html, "og:url"), url).alias("url_official"),
        F.coalesce(decoded(said("name")), meta(html, "og:title"), title(html)).alias("title"),
        F.coalesce(decoded(said("description")), meta(html, "og:description"), meta(html, "description")).alias("description"),
        F.coalesce(plain_provider, decoded(provider)).alias("institution"),
        decoded(said("courseCode")).alias("course_code"),
        once(language, lambda x: F.when(x.isNotNull(), F.array(F.lower(F.left(x, F.lit(2)))))).alias("language"),
        F.coalesce(level(said("educationalLevel")), level(F.left(text, F.lit(LEVEL_CHARS)))).alias("level"),
        F.struct(
            (F.size(blocks) > 0).alias("has_json_ld"), entity.isNotNull().alias("has_course_entity"), *evidence(text)
        ).alias("evidence"),
    ]

