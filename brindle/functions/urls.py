"""URL, host and hash functions as Column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track a visit, and labels that with a country make a public suffix.
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref"]
TRACKING_PREFIX = "utm_"
SECOND_LEVEL = ["ac", "co", "com", "edu", "gob", "gov", "net", "ne", "or", "org"]
# Sellers by kind.
MARKETPLACES = ["amazon.ca", "amazon.co.jp", "amazon.co.uk", "amazon.com", "amazon.com.au", "amazon.com.mx", "amazon.de", "amazon.fr", "amazon.in", "amazon.it", "ebay.ca", "ebay.co.uk", "ebay.com", "ebay.com.au", "ebay.de", "ebay.fr", "ebay.in", "ebay.it", "etsy.com", "flipkart.com"]
# Fixed value: what may stand between two addresses of one text.
BEFORE_URL = [" ", "\t", "\n", ",", ";", ")", "]", "}", ">"]

_SUFFIX = rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)"


def authority(url: Column) -> Column:
    """Host and port in lower case, without user info; a URL without a scheme is read as if it began with //."""
    low = F.lower(F.trim(url))
    full = F.when(low.rlike(r"^([a-z][a-z0-9+.-]*:)?//"), low).otherwise(F.concat(F.lit("//"), low))
    return F.regexp_extract(full, _HOST, 1)


def normalize_domain(url: Column) -> Column:
    """Lower-case host without www. and without the scheme's default port; blank gives ''."""
    low, host = F.lower(F.trim(url)), authority(url)
    host = F.when(low.startswith("https://"), F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    return F.regexp_replace(host, r"^www\.", "")


def host_of(url: Column) -> Column:
    """Host without port and without one leading www."""
    return F.regexp_replace(F.regexp_replace(authority(url), r":[0-9]+$", ""), r"^www\.", "")


def registrable_host(url: Column) -> Column:
    """The last two labels of the host, three if the last two are a public suffix; an IPv4 address stays."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    two, three = (F.array_join(F.slice(parts, -n, n), ".") for n in (2, 3))
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | (F.size(parts) < 3), host).when(two.rlike(_SUFFIX), three).otherwise(two)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; the order of the others and the fragment stay."""
    kept = F.filter(F.split(url_query(url), "&"), lambda p: ~(F.lower(F.substring_index(p, "=", 1)).isin(TRACKING_KEYS) | F.lower(p).startswith(TRACKING_PREFIX) | (p == "")))
    query = F.array_join(kept, "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.regexp_extract(url, r"#.*$", 0))


def canonical_url(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slash."""
    bare = F.regexp_replace(strip_tracking(url), r"#.*$", "")
    return F.regexp_replace(bare, r"/$", "")


def record_identity(url: Column) -> Column:
    """SHA-256 of the trimmed URL; blank gives null."""
    return F.when(F.trim(url) != "", F.sha2(F.trim(url), 256))


def is_special_use(host: Column) -> Column:
    """Local and reserved names."""
    return host.rlike(r"^localhost$|(^|\.)(example|invalid|localhost|test)$")


def navigation_safe(url: Column, blocked: tuple[str, ...] = ("/login", "/cart", "/checkout", "/account")) -> Column:
    """An http(s) URL of at most 2048 characters whose path has none of the blocked parts."""
    path, safe = F.lower(url_path(url)), url.rlike("^https?://") & (F.length(url) <= 2048)
    for part in blocked:
        safe = safe & ~F.contains(path, F.lit(part))
    return safe


def is_concatenated(url: Column) -> Column:
    """Two URLs glued together: a second scheme with none of ``BEFORE_URL`` before it, as a URL in a query has."""
    before = F.regexp_extract_all(F.lower(F.trim(url)), F.lit("(?s)(.)https?:/+"), 1)
    return F.exists(before, lambda c: ~c.isin(BEFORE_URL))


# Endings of hosts that are written without a scheme, too.
BARE_ENDS = ["ca", "co.uk", "com", "de", "fr", "in", "io", "net", "org"]
_BARE_HOST = rf"(?i)^(?:www\.[a-z0-9-]+(?:\.[a-z0-9-]+)+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{'|'.join(e.replace('.', chr(92) + '.') for e in BARE_ENDS)}))(?:[/?#].*)?$"


def absolute_url(base: Column, link: Column) -> Column:
    """A link resolved against the URL it stands in (RFC 3986); a blank one gives ''. A host that begins with www., or ends with one
    of ``BARE_ENDS``, is an address without its scheme."""
    text = F.trim(link)
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(url_path(base), "^.*/", 0)
    path = F.regexp_extract(text, "^[^?#]*", 0)
    tail = F.substring(text, F.length(path) + 1, F.lit(1 << 20))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    kept = F.aggregate(
        F.split(merged, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    clean = F.concat(F.array_join(kept, "/"), F.when(merged.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    bare = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(text == "", F.lit("")).when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).when(text.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), text))
        .when(text.rlike(_BARE_HOST), F.concat(F.lit("https://"), text)).when(text.startswith("#"), F.concat(bare, text)).when(text.startswith("?"), F.concat(F.regexp_replace(bare, r"[?].*$", ""), text)).otherwise(F.concat(origin, clean, tail))
    )


def same_host(url: Column, other: Column) -> Column:
    """Whether two URLs have one host, ports aside."""
    host = lambda u: F.regexp_replace(authority(u), ":[0-9]+$", "")
    return (host(other) != "") & (host(url) == host(other))


def target_url(value: Column) -> Column:
    """A pasted address: entities read, tracking removed; '' if it is blank or has white space inside."""
    text = F.trim(value)
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.when(text.rlike(r"\s"), F.lit("")).otherwise(strip_tracking(text))


def source_type(host: Column, brand_domain: Column, aggregators: list[str], retailers: list[str]) -> Column:
    """brand_dtc, marketplace, aggregator, retailer or unknown: the first list with the host or a domain above it."""
    host = F.regexp_replace(F.lower(host), r"^www\.", "")

    def under(names: list[str]) -> Column:
        labels = F.split(host, r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.arrays_overlap(tails, F.array(*map(F.lit, names)))

    own = (host == brand_domain) | host.endswith(F.concat(F.lit("."), brand_domain))
    return F.when(own, "brand_dtc").when(under(MARKETPLACES), "marketplace").when(under(aggregators), "aggregator").when(under(retailers), "retailer").otherwise("unknown")


SQL = {
    # the same expressions for DuckDB, over a column named url
    "authority": r"regexp_extract(CASE WHEN regexp_matches(lower(trim(url)), '^([a-z][a-z0-9+.-]*:)?//') THEN lower(trim(url)) ELSE '//' || lower(trim(url)) END, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)",
}
SQL["host"] = rf"regexp_replace(regexp_replace({SQL['authority']}, ':[0-9]+$', ''), '^www\.', '')"
SQL["domain"] = rf"regexp_replace(CASE WHEN lower(trim(url)) LIKE 'https://%' THEN regexp_replace({SQL['authority']}, ':443$', '') ELSE regexp_replace({SQL['authority']}, ':80$', '') END, '^www\.', '')"
SQL["path"] = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
SQL["query"] = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
SQL["registrable"] = (
    f"CASE WHEN regexp_matches({SQL['host']}, '^[0-9]+(\\.[0-9]+){{3}}$') OR len(string_split({SQL['host']}, '.')) < 3 THEN {SQL['host']} "
    f"WHEN regexp_matches(array_to_string(string_split({SQL['host']}, '.')[-2:], '.'), '{_SUFFIX}') THEN array_to_string(string_split({SQL['host']}, '.')[-3:], '.') "
    f"ELSE array_to_string(string_split({SQL['host']}, '.')[-2:], '.') END"
)
SQL["kept"] = f"list_filter(string_split({SQL['query']}, '&'), lambda p: NOT (lower(split_part(p, '=', 1)) IN ({', '.join(repr(x) for x in TRACKING_KEYS)}) OR lower(p) LIKE 'utm\\_%' ESCAPE '\\' OR p = ''))"
SQL["stripped"] = f"regexp_extract(url, '^[^?#]*') || CASE WHEN len({SQL['kept']}) > 0 THEN '?' || array_to_string({SQL['kept']}, '&') ELSE '' END || regexp_extract(url, '#.*$')"
SQL["canonical"] = f"regexp_replace(regexp_replace({SQL['stripped']}, '#.*$', ''), '/$', '')"
