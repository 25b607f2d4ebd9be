"""Sources: sitemaps and product pages, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import urls as u

#: Keys of a page's embedded state, in the order they are tried.
STATES = ("__NEXT_DATA__", "__INITIAL_STATE__", "__NUXT__")


def sitemaps(spark: SparkSession, path: str, *, index: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The addresses in sitemap files (``file``, ``url``); of an index those that end in .xml. Files are split over tasks, addresses are not held together."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    found = files.select("file", F.explode(u.sitemap_locations(F.col("value"))).alias("url"))
    if index:
        found = found.where(F.col("url").endswith(".xml"))
    for part in exclude:
        found = found.where(~F.col("url").contains(part))
    return found


def discovered(urls: DataFrame) -> DataFrame:
    """Each normal address once, with the address that comes first by order of text and how often it was met."""
    return urls.withColumn("normal", u.normal_url(F.col("url"))).groupBy("normal").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))


def _typed(block: Column, kind: str) -> Column:
    said = F.coalesce(F.try_variant_get(block, "$['@type']", "array<string>"), F.array(F.try_variant_get(block, "$['@type']", "string")))
    return F.coalesce(F.array_contains(said, kind), F.lit(False))


def products(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One record a page: JSON-LD before meta tags, the first that is not null. Prices are numbers as written, with points for thousands only where that is the only reading."""
    html = F.col(html_col)
    blocks = F.filter(u.json_ld_blocks(html), lambda v: _typed(v, "Product"))
    first = F.try_element_at(blocks, F.lit(1))
    get = lambda path, kind="string": F.try_variant_get(first, path, kind)
    meta = u.meta_tags(html)
    tag = lambda *names: F.coalesce(*[F.when(meta[n] != "", meta[n]) for n in names])
    offers = F.coalesce(get("$.offers", "array<variant>"), F.when(get("$.offers", "variant").isNotNull(), F.array(get("$.offers", "variant"))), F.array().cast("array<variant>"))
    shaped = F.transform(offers, lambda o: F.struct((~F.coalesce(F.try_variant_get(o, "$.availability", "string").contains("InStock"), F.lit(False))).alias("sold_out"), F.try_variant_get(o, "$.price", "string").try_cast("double").alias("price"), F.try_variant_get(o, "$.priceCurrency", "string").alias("currency"), F.try_variant_get(o, "$.availability", "string").alias("availability")))
    # The cheapest offer in stock, else the cheapest; a page without offers has none.
    best = F.array_min(F.filter(shaped, lambda o: o["price"].isNotNull()))
    return pages.select(
        *[c for c in pages.columns if c != html_col],
        F.coalesce(get("$.name"), tag("og:title"), F.when(u.page_title(html) != "", u.page_title(html))).alias("name"),
        F.coalesce(get("$.brand.name"), get("$.brand"), tag("product:brand")).alias("brand"), F.coalesce(get("$.sku"), tag("product:retailer_item_id")).alias("sku"),
        F.coalesce(get("$.gtin13"), get("$.gtin")).alias("gtin"), get("$.mpn").alias("mpn"),
        F.coalesce(best["price"], tag("product:price:amount", "og:price:amount").try_cast("double")).alias("price"), F.coalesce(best["currency"], tag("product:price:currency", "og:price:currency")).alias("currency"),
        F.coalesce(best["availability"], tag("product:availability", "og:availability")).alias("availability"), F.coalesce(get("$.image[0]"), get("$.image"), tag("og:image")).alias("image"),
    )


def embedded_state(html: Column) -> Column:
    """The JSON that a page's scripts carry, parsed; null without a readable one."""
    script = F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    assigned = [F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1) for name in STATES[1:]]
    json_script = F.regexp_extract(html, r'(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1)
    return F.coalesce(*[F.try_parse_json(F.when(x != "", x)) for x in (script, *assigned, json_script)])
