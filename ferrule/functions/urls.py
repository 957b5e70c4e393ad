"""Hosts, domains and paths of URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without www.; empty if the URL can't be parsed."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def registrable(host_: Column) -> Column:
    """The last two labels, or three where the last but one has two letters at most (co.uk)."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    keep = F.when((n >= 3) & (F.length(F.get(labels, n - 2)) <= 2), 3).otherwise(2)
    return F.when(n <= 2, host_).otherwise(F.array_join(F.slice(labels, F.greatest(n - keep, F.lit(0)) + 1, keep), "."))


def base_token(host_: Column) -> Column:
    return F.get(F.split(registrable(host_), r"\."), 0)


def in_domain(host_: Column, domain: Column) -> Column:
    return (host_ == domain) | host_.endswith(F.concat(F.lit("."), domain))


def normalized(url: Column) -> Column:
    """http(s) only, scheme and host in lower case, no fragment, no user, no default port; null otherwise."""
    pattern = r"(?i)^(https?)://(?:[^/@?#]*@)?([^/:?#]+)(:\d+)?([^#]*)"
    scheme, name, port, rest = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(url.rlike(pattern), F.concat(scheme, F.lit("://"), F.lower(name), port, rest))


def path_parts(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(path, "/"), lambda p: p != "")


def depth_below(url: Column, root: Column) -> Column:
    """Path parts below the root's; -1 out of its scope."""
    u, r = path_parts(url), path_parts(root)
    inside = (host(url) == host(root)) & (F.slice(u, 1, F.size(r)) == r)
    return F.when(inside & (F.size(u) >= F.size(r)), F.size(u) - F.size(r)).otherwise(-1)


def image_key(url: Column) -> Column:
    """Path in lower case without a slash at its end: by which images are told apart."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)), "/+$", "")


def resolved(link: Column, base: Column) -> Column:
    """A link against the URL of its page; no dot segments are removed."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | link.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


def usable_image(url: Column) -> Column:
    h = host(url)
    return url.rlike("(?i)^https?://") & (h != "") & ~h.isin("localhost", "127.0.0.1", "0.0.0.0") & ~h.endswith(".localhost")
