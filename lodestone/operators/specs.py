"""Reading specifications from words, and settling which of several values holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import unmarked
from lodestone.operators.substrings import held

# Spellings of units with their factor, kinds of memory, and names of resolutions, in the order they are looked for.
UNITS = {"GB": (("gb|gbyte|gigabytes?", 1), ("tb|terabytes?", 1024)), "MHz": (("mhz|mt/s", 1),), "Hz": (("hz", 1),), "W": (("w", 1),), "Wh": (("wh", 1),), "MP": (("mp|megapixels?", 1),), "g": (("g|gr|gramos", 1),), '"': (("\"|''|pulgadas?|inch(?:es)?|in", 1),)}
MEMORY = ("LPDDR5X", "LPDDR5", "DDR5", "LPDDR4X", "LPDDR4", "DDR4", "DDR3")
RESOLUTIONS = (("fhd", "1920 × 1080"), ("full hd", "1920 × 1080"), ("hd", "1366 × 768"), ("wuxga", "1920 × 1200"))
HINT_UNITS = {"tb": ("gb", 1024), "pulgadas": ('"', 1), "inch": ('"', 1), "'": ('"', 1)}
VARIANT_MARKERS = (
    "pro", "promax", "plus", "mini", "max", "ultra", "super", "fe", "lite", "se", "ti", "evo", "xt", "b", "c", "e", "s", "slim", "elite", "gaming",
    "oc",
)


def plain(col: Column) -> Column:
    """Lower case without marks; other characters than letters and digits become single spaces."""
    return F.trim(F.regexp_replace(unmarked(col), "[^a-z0-9]+", " "))


def number_in(col: Column, unit: str | None) -> Column:
    """The first number of a text that has the unit (any number without one), in that unit."""
    number = r"(?i)(?<![0-9])([0-9]+(?:[.,][0-9]+)?)"
    read = lambda pattern: F.replace(F.regexp_extract(col, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    if unit is None:
        return read(number)
    return F.coalesce(*[read(rf"{number}\s*(?:{spelling})(?![a-z0-9])") * F.lit(float(factor)) for spelling, factor in UNITS[unit]])


def yes_no(col: Column) -> Column:
    said = plain(col)
    return F.when(said.isin("si", "yes", "true", "incluye", "con"), True).when(said.isin("no", "false", "sin", "no incluye"), False)


def storage_type(col: Column) -> Column:
    said = plain(col)
    return F.when(said.contains("ssd") | said.contains("estado solido"), "SSD").when(said.contains("hdd") | said.contains("disco duro"), "HDD").when(said.contains("emmc"), "eMMC")


def memory_type(col: Column) -> Column:
    said = F.replace(plain(col), F.lit(" "), F.lit(""))
    return F.coalesce(*[F.when(said.contains(m.lower()), m) for m in MEMORY])


def resolution(col: Column) -> Column:
    """Width × height, else a name's; a name counts inside other words, too, so that QHD reads as HD."""
    pattern = "(?i)([0-9]{3,4})\\s*[x×]\\s*([0-9]{3,4})"
    wide = F.regexp_extract(col, pattern, 1)
    return F.coalesce(F.when(wide != "", F.concat_ws(" × ", wide, F.regexp_extract(col, pattern, 2))), *[F.when(plain(col).contains(name), size) for name, size in RESOLUTIONS])


def usb_ports(col: Column) -> Column:
    """The ports of a list ("2 x USB 3.2 Gen 2 Type-C; 4 USB 2.0"): kind, version, connector, count."""

    def port(p: Column) -> Column:
        x = unmarked(p)
        rules = ((r"usb\s*4", "USB4", "4.0"), (r"gen\s*2\s*x\s*2", "USB", "3.2 Gen 2x2"), (r"gen\s*2\b", "USB", "3.2 Gen 2"), (r"gen\s*1\b", "USB", "3.2 Gen 1"), (r"usb\s*3\.0", "USB", "3.0"), (r"usb\s*2(\.0)?", "USB", "2.0"), (r"usb\s*1\.1", "USB", "1.1"))
        kind = F.coalesce(*[F.when(x.rlike(r), k) for r, k, _ in rules])
        version = F.coalesce(*[F.when(x.rlike(r), v) for r, _, v in rules])
        connector = F.when(x.rlike("type-?c"), "Type-C").when(x.rlike("type-?a"), "Type-A")
        count = F.regexp_extract(x, r"^\s*([0-9]+)\s*(?:x|×|\*|\s)", 1).try_cast("int")
        return F.struct(F.coalesce(kind, F.trim(p)).alias("kind"), version.alias("version"), connector.alias("connector"), count.alias("count"))

    return F.transform(F.filter(F.split(F.coalesce(col, F.lit("")), "[;,]"), lambda p: F.trim(p) != ""), port)


def title_specs(title: Column) -> Column:
    """What a graphics card's title says: chipset, memory in GB, and bus width in bits."""
    chip = F.upper(F.regexp_replace(F.regexp_extract(title, r"(?i)\b((?:rtx|gtx|rx|arc)\s*[ab]?[0-9]{3,4}(?:\s*(?:ti|super|xt|xtx))*)\b", 1), r"\s+", " "))
    return F.struct(F.when(chip != "", chip).alias("chipset"), number_in(title, "GB").alias("memory_gb"), F.regexp_extract(title, r"(?i)([0-9]{2,3})\s*-?\s*bits?\b", 1).try_cast("int").alias("bus_bits"))


def hints(name: Column) -> Column:
    """(value, unit) pairs in a product's name. Units match without an end to the word, and w before wh."""
    pattern = r"""([0-9]+(?:[.,][0-9]+)?)\s*(gb|tb|mb|ghz|mhz|hz|w|wh|mah|mp|g|["']|pulgadas|inch)"""
    low = F.lower(name)
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("v"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("u"))
    unit = lambda u: F.coalesce(*[F.when(u == k, n) for k, (n, _) in HINT_UNITS.items()], u)
    factor = lambda u: F.when(u == "tb", 1024.0).otherwise(1.0)
    return F.transform(pairs, lambda p: F.struct((F.replace(p["v"], F.lit(","), F.lit(".")).cast("double") * factor(p["u"])).alias("value"), unit(p["u"]).alias("unit")))


def resolved(values: DataFrame) -> DataFrame:
    """One value for each (product_id, key), from rows with ``value``, ``place`` (order), ``multi`` and ``hinted`` (whether the product's name hints at the value).

    The only one, or the first of a multiple key, or the only hinted one; else the key is ambiguous. Aggregates only: a key with many values is no hot group.
    """
    distinct = values.groupBy("product_id", "key", "value").agg(F.min("place").alias("place"), F.max("multi").alias("multi"), F.max("hinted").alias("hinted"))
    all_ = distinct.groupBy("product_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"), F.count_if("hinted").alias("h"), F.min(F.struct("place", "value"))["value"].alias("first"), F.min(F.when(F.col("hinted"), F.col("value"))).alias("hint"))
    value = F.when((F.col("n") == 1) | F.col("multi"), F.col("first")).when(F.col("h") == 1, F.col("hint"))
    return all_.select("product_id", "key", value.alias("value"), F.col("n").alias("candidates"), value.isNull().alias("ambiguous"))


def cross_validated(values: DataFrame, important: list[str]) -> DataFrame:
    """Per (product_id, key), from (source, priority, value): the value of the source with the smallest priority number, and whether another source disagrees about an important key."""
    best = values.groupBy("product_id", "key").agg(F.min(F.struct("priority", "source", "value")).alias("best"), F.count_distinct("source").alias("sources"), F.count_distinct("value").alias("variants"))
    conflict = F.col("key").isin(important) & (F.col("sources") > 1) & (F.col("variants") > 1)
    return best.select("product_id", "key", "best.value", "best.source", "sources", conflict.alias("conflict"))


def grounded(found: DataFrame, allowed: list[str]) -> DataFrame:
    """Extracted (key, value, evidence, context) rows that may be believed: an allowed key, at most 200 characters, and the evidence or the value in the context."""
    within = lambda part: (plain(F.col(part)) != "") & plain(F.col("context")).contains(plain(F.col(part)))
    return found.where(F.col("key").isin(allowed) & (F.length("value") <= 200) & (within("evidence") | within("value")))


def collected(items: DataFrame) -> DataFrame:
    """Several labelled values of one definition as one text, "label: value; ..."; a single one stays as it is."""
    pairs = items.groupBy("product_id", "definition").agg(F.array_sort(F.collect_set(F.struct("label", "value"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(": ", x["label"], x["value"])), "; ")
    return pairs.select("product_id", "definition", F.when(F.size("all") == 1, F.col("all")[0]["value"]).otherwise(text).alias("value"))


def by_alias(products: DataFrame, aliases: DataFrame, *cols: str) -> DataFrame:
    """(id, source) where a product's text (the columns ``cols``, else name) holds an alias (alias, source) of the source, both as plain() has them, inside words too."""
    text = F.concat_ws(" ", *[F.col(c) for c in cols or ("name",)])
    wanted = aliases.select(plain(F.col("alias")).alias("term"), "source").where("term <> ''")
    found = held(products.select("id", plain(text).alias("said")), wanted, text_col="said", keep=["id"])
    return found.join(wanted, "term").select("id", "source").distinct()


def enriched(products: DataFrame, components: DataFrame, known: DataFrame, *cols: str) -> DataFrame:
    """(product_id, label, value) that components (alias, section, label, value), found in a product's text by their aliases, add: only labels
    that the product has not yet (product_id, section, label, without case); of several components for a label the first by alias."""
    aliases = components.select("alias", F.col("alias").alias("source")).distinct()
    found = by_alias(products, aliases, *cols).join(components.withColumnRenamed("alias", "source"), "source")
    each = found.groupBy(F.col("id").alias("product_id"), "section", "label").agg(F.min(F.struct("source", "value"))["value"].alias("value"))
    return missing_labels(known, each)


def missing_labels(known: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed (product_id, section, label, value) rows for labels that a product has not yet in the section, without case and marks."""
    key = lambda df: df.select("product_id", plain(F.col("section")).alias("_s"), plain(F.col("label")).alias("_l"))
    marked = proposed.withColumns({"_s": plain(F.col("section")), "_l": plain(F.col("label"))})
    return marked.join(key(known).distinct(), ["product_id", "_s", "_l"], "left_anti").select(*proposed.columns)


def same_variant(target: Column, text: Column) -> Column:
    """All words of the target stand in the text, and no word there that marks another variant."""
    words = lambda c: F.array_distinct(F.filter(F.split(plain(c), " "), lambda w: w != ""))
    extra = F.array_except(words(text), words(target))
    markers = F.array(*map(F.lit, VARIANT_MARKERS))
    return (F.size(words(target)) > 0) & (F.size(F.array_except(words(target), words(text))) == 0) & ~F.arrays_overlap(extra, markers)


def lowest_manufacturer_source(sources: DataFrame) -> DataFrame:
    """Per product the manufacturer's source with the smallest priority, else the first of any kind."""
    order = F.struct((F.col("kind") != "manufacturer").alias("other"), F.when(F.col("kind") == "manufacturer", F.col("priority")).otherwise(F.lit(0)).alias("p"), F.col("place"), F.col("url"))
    return sources.groupBy("product_id").agg(F.min(order)["url"].alias("url"))


def ranked_within(df: DataFrame, keys: list[str], score: str, tie: str, top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
