"""Source addresses: one key for all variants of a page, and a text check for addresses that aren't public."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import strip

# Query parameters that only track; any that begin with utm_ do too.
TRACKING = ("fbclid", "gclid", "gbraid", "wbraid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "si", "_ga", "_gl", "amp")
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_key(url: Column) -> Column:
    """What two addresses of one page share; empty for what can't be imported.

    Scheme, ``www.`` and ``amp.``, default ports, extra slashes, a last ``/amp``, tracking parameters
    and fragments don't count; other parameters are sorted. Host, path and its case do count.
    """
    u = strip(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(u, PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"\.+$", ""), r"^www\.", ""), r"^amp\.", "")
    number = part(3).try_cast("int")
    sound = F.lower(part(1)).isin("http", "https") & (host != "") & ((part(3) == "") | (part(3).rlike("^[0-9]+$") & number.between(0, 65535)))
    port = F.when(number.isNotNull() & ~number.isin(0, 80, 443), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), part(4)), "/+", "/"), "/$", ""), "(?i)(/amp)+$", "")
    pairs = F.transform(F.filter(F.split(part(5), "&"), lambda q: q != ""), lambda q: F.struct(_decoded(F.substring_index(q, "=", 1)).alias("k"), F.when(q.contains("="), _decoded(F.regexp_replace(q, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(sound, F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise("")


def is_private_host(url: Column) -> Column:
    """Whether an address names this machine or a network that isn't public, judged from its text alone."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"\.$", "")
    octet = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    four = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    six = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:(10|127|192\.168)\..*)\]$")
    return F.coalesce((host == "localhost") | host.endswith(".localhost") | six, F.lit(False)) | F.coalesce(four, F.lit(False))

