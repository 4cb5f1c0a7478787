"""URL algebra and fetch decisions as columns.

All functions give NULL for NULL and never fail on malformed text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
#: Schemes whose URLs always carry an authority when written out.
WITH_AUTHORITY = ("http", "https", "file", "ftp", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    """The path without parameters after the last segment's semicolon."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 3), r";[^/]*$", "")


def normalize_url(url: Column) -> Column:
    """Scheme (https where absent) and host in lower case, no default port, no trailing slash, no parameters, query and fragment."""
    s = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    host = F.when(s == "http", F.regexp_replace(netloc(url), ":80$", "")).when(s == "https", F.regexp_replace(netloc(url), ":443$", "")).otherwise(netloc(url))
    p = F.when(path(url) == "", "/").otherwise(path(url))
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    rooted = F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((host != "") | s.isin(*WITH_AUTHORITY), F.concat(s, F.lit("://"), host, rooted)).otherwise(F.concat(s, F.lit(":"), p))


def origin(url: Column) -> Column:
    """Scheme and host in lower case; ports are kept."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def ensure_scheme(url: Column) -> Column:
    """A seed with https:// before it unless it names http or https (in small letters)."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def slug(text: Column, most: int, empty: str = "") -> Column:
    """Letters and digits in lower case, everything else as single underscores, at most so long."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(clean == "", F.lit(empty)).otherwise(clean), 1, most)


def log_dir(url: Column, normalized: Column, parent: Column | None = None, depth: int = 12) -> Column:
    """A readable folder of a URL (slug and hash), under its parent's, the last `depth` levels of it."""
    leaf = F.concat(slug(F.concat(netloc(url), path(url)), 60, "root"), F.lit("-"), F.substring(F.sha2(normalized, 256), 1, 8))
    if parent is None:
        return leaf
    parts = F.concat(F.when(F.coalesce(parent, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(parent, "/")), F.array(leaf))
    return F.array_join(F.when(F.size(parts) > depth, F.slice(parts, -depth, depth)).otherwise(parts), "/")


def run_folder(pipeline_id: Column, name: Column) -> Column:
    """The id, and the slug of the name where there is one."""
    s = slug(F.coalesce(name, F.lit("")), 40)
    return F.when(s == "", pipeline_id).otherwise(F.concat(pipeline_id, F.lit("__"), s))


# Media types that have a parser.
SUPPORTED_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/xml", "application/xml")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def extension(content_type: Column) -> Column:
    """xml where the media type has it, else html, else txt."""
    m = F.coalesce(media_type(content_type), F.lit(""))
    return F.when(m.contains("xml"), "xml").when(m.contains("html"), "html").otherwise("txt")


def type_allowed(content_type: Column, allowed: list[str]) -> Column:
    """Whether a media type is on the list; an empty list allows all."""
    return F.coalesce(media_type(content_type).isin(*[a.strip().lower() for a in allowed]), F.lit(False)) if allowed else F.lit(True)


def failure_class(status: Column) -> Column:
    """transient for 429 and 5xx, permanent for other codes from 400, NULL for none."""
    return F.when((status == 429) | status.between(500, 599), "transient").when(status >= 400, "permanent")


def tls_relaxed(url: Column, hosts: list[str]) -> Column:
    """Whether the host (without port and user) is on the list of hosts with relaxed TLS."""
    host = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", "")
    return F.coalesce(host.isin(*[h.lower() for h in hosts]), F.lit(False)) if hosts else F.lit(False)
