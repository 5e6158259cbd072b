"""Column functions over URLs, HTML, responses and cookies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sniff import first_of

# Path parts of log-in pages and marks of challenge pages.
VERIFICATION_FIRST = ("login", "two-factor", "two_factor", "2fa", "mfa", "verify", "verification", "identity-verification")
VERIFICATION_ANY = ("two-factor", "two_factor", "2fa", "mfa")
CHALLENGES = ("cf-challenge", "challenge-platform", "just a moment", "hcaptcha", "g-recaptcha", "cf-turnstile", "cdn-cgi/challenge", "captcha")
SECOND_FACTOR = ("two-factor", "two factor", "2fa", "verification code", "identity verification", "enter the code")
HREF = r"""(?i)href\s*=\s*["'](https?://[^"'>\s]+)["']"""
ANY_HREF = r"""(?i)href\s*=\s*["']([^"'>\s]+)["']"""


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null if the text is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def hrefs(html: Column, pattern: str = HREF) -> Column:
    """Link targets in order; repeats stay."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def document_hrefs(text: Column) -> Column:
    """``"href"`` values at any depth of a JSON document's text, absolute ones only."""
    return F.filter(F.regexp_extract_all(text, F.lit(r'"href"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda u: u.rlike("^https?://"))


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(F.split(F.split(url, r"\?")[0], "#")[0], "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension of one to seven letters or digits; empty for others."""
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,7})$", 1))


def under_domain(name: Column, root: Column) -> Column:
    """Whether a host is the domain or lies below it; ``notsite.com`` is not under ``site.com``."""
    name, root = F.ltrim(F.lower(name), F.lit(".")), F.ltrim(F.lower(root), F.lit("."))
    return (name == root) | name.endswith(F.concat(F.lit("."), root))


def media_kind(name: Column, source: Column, mime: Column) -> Column:
    mime = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    lower = F.lower(name)
    return (
        F.when(lower.endswith(".zip") | mime.isin("application/zip", "application/x-zip-compressed"), "zip")
        .when((source == "image") | mime.startswith("image/") | lower.rlike(r"\.(png|jpg|jpeg|gif|webp)$"), "loose-media")
        .otherwise("other")
    )


def path_of(url: Column) -> Column:
    bare = F.split(F.split(F.coalesce(url, F.lit("")), r"\?")[0], "#")[0]
    return F.lower(F.when(bare.contains("://"), F.regexp_replace(bare, "^[^:]*://[^/]*", "")).otherwise(bare))


def is_verification(url: Column) -> Column:
    """A log-in or second-factor page; never an ``/api/`` address."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    return F.coalesce((first != "api") & (first.isin(*VERIFICATION_FIRST) | F.exists(parts, lambda p: p.isin(*VERIFICATION_ANY))), F.lit(False))


def loggable(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def response_kind(status: Column, content_type: Column, body: Column, url: Column, location: Column, mitigated: Column) -> Column:
    """challenge, rate, verification, auth or null (fine): status and headers first, body marks on HTML only."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    blob = F.lower(F.coalesce(body, F.lit("")))
    has = lambda marks: reduce(lambda a, b: a | b, [blob.contains(m) for m in marks])
    json = kind.isin("application/json", "application/vnd.api+json") | kind.endswith("+json")
    html = kind.startswith("text/html") | F.ltrim(blob).startswith("<!doctype html") | F.ltrim(blob).startswith("<html")
    fine = status.between(200, 299)
    return first_of(
        [
            (F.lower(F.coalesce(mitigated, F.lit(""))) == "challenge", F.lit("challenge")),
            (status == 429, F.lit("rate")),
            (status.between(300, 399) & is_verification(location), F.lit("verification")),
            (is_verification(url) & ~(json & fine), F.lit("verification")),
            (status.isin(403, 503) & html & has(CHALLENGES), F.lit("challenge")),
            (~fine & html & blob.contains("cdn-cgi/challenge"), F.lit("challenge")),
            (status.isin(401, 403), F.lit("auth")),
            (fine & json, F.lit(None)),
            (html & ~fine & has(SECOND_FACTOR), F.lit("verification")),
            (html & ~fine & has(CHALLENGES), F.lit("challenge")),
        ]
    )
