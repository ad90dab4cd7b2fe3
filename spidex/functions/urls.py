"""URL canonical form, hosts, and safety of what would be fetched."""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST, DEEPEST, MOST_REPEATS, MOST_PARAMETERS = 255, 10, 2, 5
ASSETS = "avi css dmg exe gif gz ico jpeg jpg js mp3 mp4 pdf png svg webp zip".split()
TRACKING = "fbclid gclid jsessionid phpsessid ref sessionid sid utm_campaign utm_content utm_medium utm_source utm_term".split()
_ASSET = re.compile(rf"\.(?:{'|'.join(ASSETS)})$", re.IGNORECASE)
_PARTS = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?P<authority>[^/?#]*)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?")
_LEGAL = re.compile(r"(?:[A-Za-z0-9\-_.!~*'();/?:@&=+$,\[\]#]|%[0-9A-Fa-f]{2}|[^\x00-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])*")
_NAME = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?")
_ADDRESS4 = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_HOST_PORT = re.compile(r"(?:[^@]*@)?(?P<host>\[[0-9A-Fa-f:.]+\]|[^:\[\]@]*)(?::(?P<port>\d*))?")
_IN_PATH, _IN_QUERY = "-_.!~*'();/:@&=+$,", "-_.!~*'();/?:@&=+$,[]"


def _encoded(text: str, kept: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in kept) or ord(c) > 0xA0 and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _without_dots(path: str) -> str:
    """. and .. resolved and empty segments dropped; .. that has nothing before it stays."""
    if not path:
        return path
    ends = path.endswith(("/", "/.", "/.."))
    out: list[str] = []
    for s in path.split("/"):
        if s == ".." and out and out[-1] != "..":
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    body = "/".join(out)
    return "/" + body + ("/" if ends and body and out[-1] != ".." else "")


def _host_of(authority: str) -> tuple[str, int] | None:
    found = _HOST_PORT.fullmatch(authority)
    if not found or not found["host"]:
        return None
    host = found["host"]
    if not (host.startswith("[") or _ADDRESS4.fullmatch(host) or _NAME.fullmatch(host)):
        return None
    return host, int(found["port"]) if found["port"] else -1


def canonical(raw: str | None) -> str | None:
    """The canonical form of an http(s) URL, or None where it isn't to be crawled."""
    if raw is None or not raw.strip() or len(raw) > LONGEST:
        return None
    found = _PARTS.fullmatch(raw.strip())
    if not found or not _LEGAL.fullmatch(raw.strip()) or found["scheme"] not in ("http", "https") or re.search(r"[\[\]]", found["path"]):
        return None
    place = _host_of(found["authority"])
    if place is None:
        return None
    host, port = place
    path = unquote(_without_dots(found["path"]), errors="replace") or "/"
    if _ASSET.search(path):
        return None
    pieces = path.rstrip("/").split("/") if path.strip("/") else []
    if len(pieces) > DEEPEST or any(n > MOST_REPEATS for s, n in Counter(pieces).items() if s):
        return None
    query = ""
    if found["query"] is not None:
        kept = []
        pairs = unquote(found["query"], errors="replace").split("&")
        while len(pairs) > 1 and not pairs[-1]:
            pairs.pop()
        for p in pairs:
            if p and not p.strip("="):
                return None  # a parameter without a name
            if p.split("=")[0].lower() not in TRACKING:
                kept.append(p)
        if len(kept) > MOST_PARAMETERS:
            return None
        query = "?" + _encoded("&".join(sorted(kept)), _IN_QUERY) if kept else ""
    shown = "" if port == -1 or (found["scheme"], port) in (("http", 80), ("https", 443)) else f":{port}"
    return f"{found['scheme']}://{host.lower()}{shown}{_encoded(path, _IN_PATH)}{query}"


@F.pandas_udf(T.StringType())
def _canonical(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in urls:
        yield pd.Series([canonical(u) for u in batch], dtype=object)


def normalize_url(url: Column | str) -> Column:
    """Canonical form, null where the URL isn't to be crawled. One Arrow batch a call; URLs are short."""
    return _canonical(F.col(url) if isinstance(url, str) else url)


def host_of(url: Column | str) -> Column:
    """The host in lower case; null where there is none."""
    return F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))


def path_of(url: Column | str) -> Column:
    """The decoded path, as robots rules are written; "/" where there is none."""
    raw = F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("PATH"))
    # a plus sign is itself in a path
    found = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(found.isNull() | (found == ""), F.lit("/")).otherwise(found)


def has_asset_extension(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(rf"(?i)\.({'|'.join(ASSETS)})$")


def repeats_a_segment(path: Column | str) -> Column:
    """Whether a segment of the path occurs more than twice."""
    segments = F.filter(F.split(F.col(path) if isinstance(path, str) else path, "/", -1), lambda s: s != "")
    return F.exists(segments, lambda s: F.size(F.filter(segments, lambda x: x == s)) > MOST_REPEATS)


LOOPBACK = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "127.0.0.1", "0.0.0.0", "::1", "[::1]"]
METADATA = ["169.254.169.254", "metadata.google.internal", "metadata.goog", "100.100.100.200"]


def blocked(address: str | None) -> bool:
    """Whether an address isn't one of the public network."""
    try:
        a = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return True
    mapped = getattr(a, "ipv4_mapped", None)
    a = mapped or a
    shared = a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10")
    local = a.is_private and any(a in n for n in map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "fec0::/10")) if n.version == a.version)
    return shared or local or a.is_loopback or a.is_link_local or a.is_unspecified or a.is_multicast


@F.pandas_udf(T.BooleanType())
def _blocked(addresses: pd.Series) -> pd.Series:
    return addresses.map(blocked, na_action=None).astype(bool)


def blocked_address(ip: Column | str) -> Column:
    return _blocked(F.col(ip) if isinstance(ip, str) else ip)


def public_literal(host: Column) -> Column:
    """Whether a host is a name, or an address that is written out and public. A number in another form than four decimals isn't a name."""
    v4 = F.regexp_extract(host, r"^(?:\[(?:0*:)*:?ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\]?$", 1)
    octet = F.transform(F.split(v4, r"\."), lambda x: x.cast("int"))
    a, b = F.get(octet, 0), F.get(octet, 1)
    inside = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    v4_public = ~F.exists(octet, lambda x: x > 255) & ~inside & ~host.rlike(r"^0\d|\.0\d")
    v6_public = host.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:.]*\]$")  # 2000::/3 is all that is given out
    numeric = host.rlike(r"(?:^|\.)(?:0x[0-9a-f]*|\d+)\.?$")
    return F.when(v4 != "", v4_public).when(host.startswith("["), v6_public).otherwise(~numeric)


def literally_safe(url: Column | str) -> Column:
    """The part of safety that the URL alone tells: exactly https, with a host that is no loopback or metadata name and no address of a private network."""
    c = F.col(url) if isinstance(url, str) else url
    host = host_of(c)
    named = host.isNotNull() & ~F.regexp_replace(host, r"\.$", "").isin(LOOPBACK + METADATA)
    return F.coalesce((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & c.startswith("https:") & named & public_literal(host), F.lit(False))


def with_safety(urls: DataFrame, dns: DataFrame | None = None, column: str = "url", into: str = "safe") -> DataFrame:
    """``urls`` with a boolean: safe by its letters and, with a table dns(host, ip), known and public by every address."""
    if dns is None:
        return urls.withColumn(into, literally_safe(column))
    known = dns.groupBy(F.lower("host").alias("_host")).agg(F.bool_and(~blocked_address("ip")).alias("_public"))
    joined = urls.withColumn("_h", host_of(column)).join(known, F.col("_h") == F.col("_host"), "left")
    return joined.withColumn(into, literally_safe(column) & F.coalesce("_public", F.lit(False))).drop("_h", "_host", "_public")
