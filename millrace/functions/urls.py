"""Column functions on URLs: validity, canonical form, hosts, allow lists, and what a path tells of a page.

Anything but an absolute http(s) URL gives null or false."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, decoded, once, says

#: Query parameters that do not change what a page is.
TRACKING = """utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid
ref referrer source""".split()
#: What the crawl leaves out.
SKIPPED_SUFFIXES = """.pdf .zip .tar .gz .mp4 .mp3 .avi .mov .png .jpg .jpeg .gif .svg .ico .css .js .woff
.woff2 .ttf .eot .xml .rss""".split()
SKIPPED_PARTS = """/login /signin /sign-in /register /signup /checkout /cart /account /profile /password
/logout /admin /search? /print/ /share facebook.com twitter.com linkedin.com instagram.com
youtube.com/watch""".split()
#: Paths of listings and of single offers, and names of listings and of teaching material.
LISTING_PATH = r"/(search|courses|cursos|catalog|catalogo|browse|explore|index|all)$"
LISTING_NAME = r"^(search|courses?|cursos?|catalog|catálogo|browse|explore|all courses|home)\b"
COURSE_PATH = r"/(course|courses|curso|cursos|learn|class|classes|program|training|mooc)s?/"
COURSE_PARTS = r"course_templates|course-v1"
FILE_NAME = r"\.(pdf|ppt|pptx|doc|docx|xls|xlsx|zip)$"
PART_NAMES = (
    r"^(week|lecture|session|unit|module|chapter|part|lec)\s+[0-9ivx]+",
    r"\bslides?\s+[0-9]",
    r"\bpart\s+[ivx]+\s+of\b",
    r"\b(problem set|pset[0-9]|handout|transcript|lecture notes)\b",
)

# scheme, user, host, port, path, query, fragment of what is left after control characters go
_URL = r"^(?i)(https?):/{2,}([^/?#@\\]*@)?([^/?#:@\\\s\[\]<>^|%]+|\[[0-9a-fA-F:.]+\])(:[0-9]*)?([/\\][^?#]*)?(\?[^#]*)?(#.*)?$"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_trimmed(url), _URL, group)


def is_http_url(url: Column) -> Column:
    return F.coalesce(_trimmed(url).rlike(_URL), F.lit(False))


def host(url: Column) -> Column:
    """The host in lower case, without a leading www."""
    return F.when(is_http_url(url), F.regexp_replace(F.lower(_part(url, 3)), r"^www\.", ""))


def origin(url: Column) -> Column:
    """Scheme, host and port, in lower case."""
    return F.when(is_http_url(url), F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 3), _part(url, 4))))


def path(url: Column) -> Column:
    """The path with / for \\ and without dot segments; / if empty."""
    plain = F.replace(_part(url, 5), F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
        .when(x == ".", seen)
        .otherwise(F.concat(seen, F.array(x))),
    )
    last_dots = plain.rlike(r"/\.{1,2}$")
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(last_dots & (F.size(walked) > 0), "/").otherwise(""))
    full = F.when(plain.rlike(r"/\.{1,2}(/|$)"), joined).otherwise(plain)
    return F.when(is_http_url(url), F.when(full == "", "/").otherwise(full))


def _parameters(url: Column) -> Column:
    """name=value, coded as forms are, without tracking parameters, in order of names."""
    recode = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    pairs = F.filter(F.split(F.substring(_part(url, 6), 2, 1 << 30), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            recode(F.substring_index(p, "=", 1)).alias("key"),
            i.alias("at"),
            F.when(F.instr(p, "=") > 0, recode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("value"),
        ),
    )
    kept = F.filter(named, lambda p: ~F.lower(p.key).isin(TRACKING))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p.key, F.lit("="), p.value)), "&")


def canonical(url: Column) -> Column:
    """https, host without www., no port, fragment or tracking parameters, sorted parameters, and no final
    slash but the root's."""
    short = once(path(url), lambda p: F.when((F.length(p) > 1) & F.endswith(p, F.lit("/")), F.left(p, F.length(p) - 1)).otherwise(p))
    query = once(_parameters(url), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(is_http_url(url), F.concat(F.lit("https://"), _part(url, 2), host(url), short, query))


def canonical_or_raw(url: Column) -> Column:
    return F.coalesce(canonical(url), url)


def is_allowed_host(url: Column, domains: Column) -> Column:
    """The host is one of domains or below one."""

    def fits(h: Column, domain: Column) -> Column:
        plain = F.regexp_replace(F.lower(domain), r"^www\.", "")
        return (h == plain) | F.endswith(h, F.concat(F.lit("."), plain))

    return F.coalesce(once(host(url), lambda h: F.exists(domains, lambda d: fits(h, d))), F.lit(False))


@dataclass(frozen=True)
class Skips:
    """Ends and parts of addresses, in lower case, that the crawl leaves out."""

    suffixes: tuple[str, ...] = tuple(SKIPPED_SUFFIXES)
    parts: tuple[str, ...] = tuple(SKIPPED_PARTS)


def is_relevant(url: Column, skips: Skips = Skips()) -> Column:
    """Neither a skipped suffix nor a skipped part."""
    low = F.lower(url)
    skipped = F.lit(False)
    for suffix in skips.suffixes:
        skipped = skipped | F.endswith(low, F.lit(suffix))
    for part in skips.parts:
        skipped = skipped | F.contains(low, F.lit(part))
    return F.coalesce(~skipped, F.lit(False))


def is_course_like(url: Column) -> Column:
    return says(url, COURSE_PATH, COURSE_PARTS)


def is_index_page(url: Column, title: Column) -> Column:
    place = F.regexp_replace(F.coalesce(once(url, path), url), "/$", "")
    return says(place, LISTING_PATH) | says(decoded(title), LISTING_NAME)


def is_course_material(title: Column) -> Column:
    return says(decoded(title), FILE_NAME, *PART_NAMES)


def may_open(url: Column, most: int = 2000) -> Column:
    """https and not too long, once trimmed."""
    trimmed = blank_to_null(F.trim(url))
    return F.coalesce((F.length(trimmed) <= most) & trimmed.rlike("(?i)^https://"), F.lit(False))
