"""Addresses and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track a visitor; hosts of manufacturers, benchmarks and reviews; priorities of sources.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url",
    "source", "spm", "from", "shared", "share_id",
)
MANUFACTURERS = (
    "apple.com", "samsung.com", "asus.com", "rog.asus.com", "lenovo.com", "hp.com", "dell.com", "acer.com", "msi.com", "xiaomi.com", "mi.com",
    "realme.com", "motorola.com", "lg.com", "sony.com", "nokia.com", "intel.com", "amd.com", "nvidia.com", "qualcomm.com", "mediatek.com",
)
BENCHMARKS = (
    "geekbench.com", "browser.geekbench.com", "notebookcheck.net", "3dmark.com", "3dmark.benchmarks.ul.com", "benchmarks.ul.com", "passmark.com",
    "cpubenchmark.net", "videocardbenchmark.net", "anandtech.com", "spec.org", "opendata.geekbench.com",
)
REVIEWS = (
    "rtings.com", "techradar.com", "theverge.com", "techspot.com", "cnet.com", "pcmag.com", "tomshardware.com", "androidauthority.com",
    "gsmarena.com", "xataka.com",
)
PRIORITY = {"catalog": 60, "manufacturer": 50, "benchmark": 40, "review": 30, "document": 25, "web": 20}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def normal_url(url: Column) -> Column:
    """https, host in lower case, no usual port, no slash at the end, no tracking or empty parameters, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    port = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*:([0-9]+)(?:[/?]|$)", 1)
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    names = F.array(*map(F.lit, TRACKING))
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.array_contains(names, F.lower(F.regexp_extract(p, "^([^=]*)", 1))))
    return F.concat(F.lit("https://"), host(bare), F.when(~port.isin("", "80", "443"), F.concat(F.lit(":"), port)).otherwise(""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_tags(html: Column) -> Column:
    """Lower-case property or name -> content. The last property wins; a name fills in only what no property gives."""
    tag = r'(?is)<meta\s+{}="([^"]*)"\s+content="([^"]*)"'
    pairs = lambda kind: F.arrays_zip(F.regexp_extract_all(html, F.lit(tag.format(kind)), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(tag.format(kind)), F.lit(2)).alias("v"))

    def latest(acc, p):
        key = F.lower(p["k"])
        return F.map_concat(F.map_filter(acc, lambda k, _: k != key), F.create_map(key, p["v"]))

    empty = F.create_map().cast("map<string,string>")
    props, names = (F.aggregate(pairs(kind), empty, latest) for kind in ("property", "name"))
    return F.map_concat(props, F.map_filter(names, lambda k, _: ~F.map_contains_key(props, k)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    """The addresses in a sitemap, with the five entities of XML as the characters that they stand for."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    entities = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
    return F.transform(found, lambda x: reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities, x))


def json_ld_blocks(html: Column) -> Column:
    """The parsed JSON-LD blocks of a page, lists taken apart and unreadable ones left out."""
    raw = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    parsed = F.filter(F.transform(raw, lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def page_text(html: Column) -> Column:
    """What a page says: no scripts, styles, comments or tags; entities for the commonest marks decoded; white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for mark, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(mark), F.lit(plain))
    return F.trim(F.regexp_replace(body, "[ \t\n\r]+", " "))


def source_type(url: Column) -> Column:
    """By the host, without its www."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    kinds = (("manufacturer", name.isin(*MANUFACTURERS) | name.endswith(".asus.com")), ("benchmark", name.isin(*BENCHMARKS)), ("review", name.isin(*REVIEWS)))
    return F.coalesce(*[F.when(test, kind) for kind, test in kinds], F.when(url.isNotNull(), "web"))


def source_priority(kind: Column) -> Column:
    return F.when(kind.isNull(), 0).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[kind], F.lit(20)))


def source_confidence(priority: Column) -> Column:
    return F.when(priority >= 50, 0.9).when(priority >= 40, 0.8).when(priority >= 30, 0.7).otherwise(0.5)


#: Ranges of addresses that are not public, as (first, bits).
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3))


def host_number(name: Column) -> Column:
    """The address that a host of one to four numbers stands for, decimal, octal or hexadecimal, the last of which fills the rest; null if it
    is no such host, -1 if its numbers do not fit."""
    parts = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    digits = lambda p: F.when(p.rlike("^0x"), F.substring(p, 3, 16)).when(p.rlike("^0[0-9]"), F.substring(p, 2, 32)).otherwise(p)
    base = lambda p: F.when(p.rlike("^0x"), 16).when(p.rlike("^0[0-9]"), 8).otherwise(10)
    short = lambda p: F.regexp_replace(digits(p), "^0+(?=.)", "")
    read = lambda p: F.when(base(p) == 16, F.conv(F.concat(F.lit("0"), short(p)), 16, 10)).when(base(p) == 8, F.conv(short(p), 8, 10)).otherwise(short(p)).try_cast("bigint")
    sound = F.forall(parts, lambda p: p.rlike("^(0x[0-9a-f]{0,16}|0[0-7]*|[1-9][0-9]{0,15})$"))
    last = F.size(parts)
    values = F.transform(parts, read)
    fits = F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, 1, last - 1), lambda v: v < 256)
    front = F.aggregate(F.slice(values, 1, last - 1), F.lit(0).cast("bigint"), lambda s, v: s * 256 + v)
    rest = F.element_at(F.array(*[F.lit(256 ** n) for n in (4, 3, 2, 1)]), last)
    number = front * rest + F.element_at(values, -1)
    numeric = name.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}\.?$")
    return F.when(numeric, F.when(sound & fits & (F.element_at(values, -1) < rest), number).otherwise(F.lit(-1).cast("bigint")))


def safe_to_fetch(url: Column) -> Column:
    """http or https, and a host that is public by its name or number: no local names, no private or loopback addresses in any spelling, no
    addresses in brackets."""
    name = F.regexp_replace(host(url), r"\.$", "")
    local = name.rlike(r"^(localhost|\[.*|.*\.(local|internal|localhost|localdomain))$")
    number = host_number(name)
    value = lambda a: sum(int(p) << 8 * (3 - i) for i, p in enumerate(a.split(".")))
    private = reduce(Column.__or__, [(number >= value(a)) & (number < value(a) + (1 << 32 - bits)) for a, bits in PRIVATE], number < 0)
    return F.coalesce(url.rlike("(?i)^https?://") & (name != "") & ~local & ~F.coalesce(private, F.lit(False)), F.lit(False))


def platform(html: Column, meta: Column) -> Column:
    """The shop system with the most signs, as (name, confidence); null under 0.3. The first of equals wins."""
    low = F.lower(html)
    named = lambda word: F.exists(F.map_values(meta), lambda v: F.lower(v).contains(word))
    points = lambda *signs: F.least(F.lit(1.0), sum((F.when(test, value).otherwise(0.0) for test, value in signs), F.lit(0.0)))
    scores = {
        "Shopify": points((low.contains("shopify"), 0.3), (named("shopify"), 0.2), (low.contains("cdn.shopify.com"), 0.2)),
        "VTEX": points((low.contains("vtex"), 0.3), (low.contains("vtexstore") | low.contains("vtex-search"), 0.3), (named("vtex"), 0.2), (low.contains("/api/catalog_system/") | low.contains("/api/io/"), 0.2)),
        "Next.js": points((low.rlike('<script[^>]*id="__next_data__"'), 0.5), (low.contains("nextjs") | low.contains("_next/static"), 0.3), (F.lower(meta["generator"]).startswith("next"), 0.3)),
        "WooCommerce": points((low.contains("woocommerce"), 0.3), (low.contains("wp-content") | low.contains("wp-includes"), 0.3), (named("woocommerce"), 0.2)),
    }
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("minus"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())]))
    best = ranked[0]
    return F.when(-best["minus"] >= 0.3, F.struct(best["name"].alias("name"), F.round(-best["minus"], 2).alias("confidence")))
