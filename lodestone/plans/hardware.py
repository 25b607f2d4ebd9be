"""Queries of component sheets. A part's columns are written out as a sheet's lists; the same words are read by Spark and by the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import hardware as h
from lodestone.registry import query

# Lists in the words of a store, made from a part's key, size and brand. The text is valid in both dialects.
_PCIE = "concat(CAST(1 + p_size % 4 AS STRING), 'x PCIe ', CAST(3 + p_partkey % 3 AS STRING), '.0 x', CASE p_partkey % 4 WHEN 0 THEN '16' WHEN 1 THEN '8' WHEN 2 THEN '4' ELSE '1' END, ', 2 PCI Express Gen', CAST(2 + p_size % 4 AS STRING), ' slot; ', p_brand, ' riser ')"
_M2 = "concat('1x M.2 ', CASE WHEN p_partkey % 2 = 0 THEN '2280' ELSE '2242/22110' END, CASE p_size % 4 WHEN 0 THEN ' (PCIe 5.0 x4)' WHEN 1 THEN ' (SATA)' WHEN 2 THEN ' NVMe Gen 4' ELSE '' END, ', ', p_type)"
_PORTS = "concat(CAST(1 + p_size % 6 AS STRING), 'x USB ', CASE p_partkey % 5 WHEN 0 THEN '3.2 Gen 1 Type-A' WHEN 1 THEN '3.2 Gen 2x2 Type-C' WHEN 2 THEN '2.0' WHEN 3 THEN '4 TypeC' ELSE '3.2 Gen 2' END, ', 1x HDMI 2.', CAST(p_size % 2 AS STRING), ', DisplayPort 1.4; 2 x RJ 45, ', p_name)"
_POWER = "concat('1x ', CAST(4 + p_size % 5 AS STRING), '+4-pin ', CASE p_partkey % 4 WHEN 0 THEN 'EPS' WHEN 1 THEN 'ATX 12V' WHEN 2 THEN 'PCIe' ELSE 'plug' END, ', 24-pin ', p_type)"
_FANS = "concat(CAST(1 + p_size % 3 AS STRING), 'x 4-pin ', CASE p_partkey % 5 WHEN 0 THEN 'CPU_FAN' WHEN 1 THEN 'CPU Opt' WHEN 2 THEN 'AIO pump' WHEN 3 THEN 'Chassis fan' ELSE p_brand END, ', sys_fan')"
_SPLIT = "list_filter([trim(x, ' .') FOR x IN string_split_regex(regexp_replace(lower({}), '\\s+', ' ', 'g'), '[;,]')], lambda x: x <> '')"
_ITEMS = "WITH t AS (SELECT p_partkey AS id, " + _SPLIT + " AS own FROM part), i AS (SELECT id, unnest(own) AS p, generate_subscripts(own, 1) AS place FROM t) SELECT id, CAST(place AS INTEGER) AS place, {} FROM i"
_READ = lambda pattern, as_=None: f"nullif(regexp_extract(p, '{pattern}', 1), '')" + (f"::{as_}" if as_ else "")
_COUNT = "coalesce(" + _READ("^\\s*([0-9]+)", "INTEGER") + ", 1) AS count"
_GEN = "coalesce(" + _READ("(?:pcie|pci[\\s-]express)\\s*([0-9]+\\.[0-9]+)") + ", " + _READ("\\bgen(?:er(?:ation)?)?\\s*([0-9]+)") + " || '.0')"
_LANES = _READ("[x×]([0-9]{1,2})\\b", "INTEGER")
_CASE = lambda rules, pick: "CASE " + " ".join(f"WHEN regexp_matches(p, '{r[0]}') THEN {pick(r)}" for r in rules) + " END"
_USB_KIND, _USB_VERSION = _CASE(h.USB, lambda r: f"'{r[1]}'"), _CASE(h.USB, lambda r: f"'{r[2]}'")
_PINS = _READ("([0-9]+)(?:\\s*\\+\\s*([0-9]+))?[\\s-]*pin", "INTEGER") + " + coalesce(nullif(regexp_extract(p, '([0-9]+)(?:\\s*\\+\\s*([0-9]+))?[\\s-]*pin', 2), '')::INTEGER, 0)"


def _parts(spark, sf_dir):
    """Parts dealt out by key: a part takes few bytes, so a scan alone would leave the reading of all sheets to a task or two."""
    return b.table(spark, sf_dir, "part").repartition("p_partkey")


def _items(spark, sf_dir, text: str, read, *fields):
    found = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.posexplode(read(F.expr(text))).alias("at", "item"))
    return found.select("id", (F.col("at") + 1).alias("place"), *[F.col(f"item.{f}") for f in fields])


@query(_ITEMS.format(_PCIE, f"CASE WHEN NOT regexp_matches(p, 'pcie|pci[\\s-]*express') THEN p WHEN contains(p, 'x16') AND NOT contains(p, 'x8') THEN 'PCIe x16' WHEN contains(p, 'x8') THEN 'PCIe x8' WHEN contains(p, 'x4') AND NOT contains(p, 'x16') THEN 'PCIe x4' WHEN contains(p, 'x1') AND NOT contains(p, 'x16') THEN 'PCIe x1' ELSE 'PCIe' END AS type, CASE WHEN regexp_matches(p, 'pcie|pci[\\s-]*express') THEN {_GEN} END AS generation, CASE WHEN regexp_matches(p, 'pcie|pci[\\s-]*express') THEN {_LANES} END AS lanes, {_COUNT}"))
def sheet_pcie_slots(spark, sf_dir):
    return _items(spark, sf_dir, _PCIE, h.pcie_slots, "type", "generation", "lanes", "count")


@query(_ITEMS.format(_M2, f"CASE WHEN NOT regexp_matches(p, 'm\\.?2|m_2') THEN p WHEN regexp_matches(p, 'nvme|pcie|pci[\\s-]*express') THEN 'PCIe' WHEN regexp_matches(p, '\\bsata\\b') THEN 'SATA' END AS interface, CASE WHEN regexp_matches(p, 'm\\.?2|m_2') THEN {_GEN} END AS generation, CASE WHEN regexp_matches(p, 'm\\.?2|m_2') THEN {_LANES} END AS lanes, array_to_string(CASE WHEN regexp_matches(p, 'm\\.?2|m_2') THEN regexp_extract_all(p, '\\b([0-9]{{4}})\\b', 1) ELSE [] END, '/') AS form_factors"))
def sheet_m2_slots(spark, sf_dir):
    return _items(spark, sf_dir, _M2, h.m2_slots, "interface", "generation", "lanes", "form_factors").withColumn("form_factors", F.array_join("form_factors", "/"))


@query(_ITEMS.format(_PORTS, "coalesce(" + _USB_KIND + ", " + _CASE(h.PORTS, lambda r: f"'{r[1]}'") + f", p) AS kind, CASE WHEN {_USB_KIND} IS NOT NULL THEN {_USB_VERSION} ELSE " + _CASE(h.PORTS, lambda r: _READ(r[2]) if r[2] else "NULL") + f" END AS version, CASE WHEN {_USB_KIND} IS NOT NULL THEN CASE WHEN regexp_matches(p, 'type-?c') THEN 'Type-C' WHEN regexp_matches(p, 'type-?a') THEN 'Type-A' END END AS connector, " + _COUNT))
def sheet_rear_ports(spark, sf_dir):
    return _items(spark, sf_dir, _PORTS, h.rear_ports, "kind", "version", "connector", "count")


@query(_ITEMS.format(_PORTS, f"coalesce({_USB_KIND}, p) AS kind, {_USB_VERSION} AS version, CASE WHEN regexp_matches(p, 'type-?c') THEN 'Type-C' WHEN regexp_matches(p, 'type-?a') THEN 'Type-A' END AS connector, " + _COUNT))
def sheet_usb_headers(spark, sf_dir):
    return _items(spark, sf_dir, _PORTS, h.usb_headers, "kind", "version", "connector", "count")


@query(_ITEMS.format(_POWER, "coalesce(" + _CASE(h.POWER, lambda r: f"'{r[1]}'") + f", 'ATX12V') AS type, {_PINS} AS pins, coalesce(" + _READ("^\\s*([0-9]+)\\s*[x×]", "INTEGER") + ", 1) AS count"))
def sheet_power_connectors(spark, sf_dir):
    return _items(spark, sf_dir, _POWER, lambda c: h.power_connectors(c, "ATX12V"), "type", "pins", "count")


@query("WITH t AS (SELECT p_partkey AS id, lower(" + _PORTS + ") AS p FROM part) SELECT id, " + _READ("hdmi\\s*([0-9]+\\.[0-9]+)") + " AS hdmi, " + _READ("(?:display\\s*port|dp)\\s*([0-9]+\\.[0-9]+)") + " AS displayport, coalesce(" + _READ("([0-9]+)\\s*[x×]\\s*(?:hdmi|display\\s*port)", "INTEGER") + ", 1) AS count FROM t")
def sheet_video_outputs(spark, sf_dir):
    text = F.expr(_PORTS)
    hdmi, display = h.video_outputs(text, "hdmi")[0], h.video_outputs(text, "displayport")[0]
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), hdmi["version"].alias("hdmi"), display["version"].alias("displayport"), hdmi["count"].alias("count"))


_FAN_OWN = "array_to_string(list_filter(string_split(p, ' '), lambda w: NOT regexp_matches(w, '^[0-9]*(x|-?pins?)?$')), ' ')"


@query(_ITEMS.format(_FANS, "coalesce(CASE WHEN NOT regexp_matches(p, 'fan|pump|\\bopt\\b') THEN NULL " + " ".join(f"WHEN regexp_matches(p, '{r}') THEN '{n}'" for r, n in h.FANS) + f" END, nullif({_FAN_OWN}, ''), p) AS name, {_COUNT}"))
def sheet_fan_headers(spark, sf_dir):
    return _items(spark, sf_dir, _FANS, h.fan_headers, "name", "count")


@query(_ITEMS.format(f"concat({_POWER}, ', 24-pin ', p_type, ', SATA')", "p AS type, " + _COUNT + ", " + _READ("([0-9]+)(?:\\s*\\+\\s*[0-9]+)?[\\s-]*pin", "INTEGER") + " AS pins").replace("FROM i", "FROM (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY min(place)) AS place FROM i GROUP BY id, p)"))
def sheet_connector_headers(spark, sf_dir):
    return _items(spark, sf_dir, f"concat({_POWER}, ', 24-pin ', p_type, ', SATA')", h.connector_headers, "type", "count", "pins")


_SPEED = "concat(CASE p_size % 6 WHEN 0 THEN 'SATA III' WHEN 1 THEN '6 Gbps' WHEN 2 THEN 'SATA2' WHEN 3 THEN '3 Gb/s' WHEN 4 THEN '6G' ELSE 'serial' END, ' ', p_name)"


@query(f"WITH t AS (SELECT p_partkey AS id, lower({_SPEED}) AS p FROM part) SELECT id, " + _CASE(h.SATA, lambda r: f"'{r[1]}'") + " AS speed FROM t")
def sheet_sata_speed(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), h.sata_speed(F.expr(_SPEED)).alias("speed"))


_KEY = "CASE p_partkey % 4 WHEN 0 THEN 'pcie_slot_list' WHEN 1 THEN 'rgb_features' WHEN 2 THEN 'other' ELSE 'sata_headers' END"
_VALUE = "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN concat('[{\"type\": \"PCIe x16\", \"count\": ', CAST(p_size AS STRING), '}, {\"type\": \"PCIe x16\", \"count\": ', CAST(p_size AS STRING), '}]') WHEN p_partkey % 4 = 3 THEN '4x SATA 7-pin' ELSE concat(p_name, '; ', p_brand) END"


@query(
    f"WITH t AS (SELECT p_partkey AS id, p_size AS n, {_KEY} AS key, {_VALUE} AS v, lower(p_name) AS a, lower(p_brand) AS b, p_name || '; ' || p_brand AS own FROM part) "
    "SELECT id, key, CASE WHEN v = '' THEN '[]' WHEN key = 'pcie_slot_list' THEN '[{\"type\":\"PCIe x16\",\"generation\":null,\"lanes\":16,\"count\":1}]' WHEN key = 'sata_headers' THEN '[{\"type\":\"4x sata 7-pin\",\"count\":4,\"pins\":7}]' "
    "WHEN key = 'rgb_features' THEN '[{\"feat\":\"' || a || '\"},{\"feat\":\"' || b || '\"}]' ELSE '[{\"value\":\"' || own || '\"}]' END AS items FROM t"
)
def sheet_values(spark, sf_dir):
    """Values of four definitions, some of them JSON already, as JSON."""
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_KEY).alias("key"), F.expr(_VALUE).alias("value"))
    return part.select("id", "key", h.structured(F.col("key"), F.col("value")).alias("items"))


_SECTION = "CASE p_size % 4 WHEN 0 THEN 'Procesador' WHEN 1 THEN 'Cámara' WHEN 2 THEN 'RAM' ELSE 'Otros' END"
_LABEL = "CASE p_partkey % 5 WHEN 0 THEN 'Núcleos' WHEN 1 THEN 'Resolución' WHEN 2 THEN 'Capacidad' WHEN 3 THEN 'Frecuencia  base' ELSE 'Peso (g)' END"
_DEFS = "SELECT * FROM (VALUES ('ECONOMY', 'processor_cores', 'Cores', 1), ('ECONOMY', 'ram_capacity', 'Memoria', 2), ('ECONOMY', 'weight', 'Peso g', 4), ('ECONOMY', 'mass', 'Peso: g', 3), ('SMALL', 'rear_camera_megapixels', 'MP', 1), ('SMALL', 'cores', 'nucleos', 2), ('SMALL', 'capacity', 'CAPACIDAD', 3)) AS d(category, key, label, sort_order)"
_PLAIN = lambda c: f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g'))"
_MEANS = "CASE " + " ".join(f"WHEN sec = '{s}' AND lab = '{n}' THEN '{k}'" for s, labels in h.SECTION_LABELS.items() for n, k in labels.items()) + " END"


@query(
    f"WITH d AS ({_DEFS}), t AS (SELECT p_partkey AS id, p_type AS category, {_SECTION} AS section, {_LABEL} AS label FROM part), n AS (SELECT *, {_PLAIN('section')} AS sec, {_PLAIN('label')} AS lab FROM t), m AS (SELECT *, {_MEANS} AS meant FROM n) "
    f"SELECT id, category, section, label, coalesce((SELECT d.key FROM d WHERE d.category = m.category AND d.key = m.meant), (SELECT arg_min(d.key, d.sort_order) FROM d WHERE d.category = m.category AND {_PLAIN('d.label')} = m.lab)) AS key FROM m"
)
def sheet_definitions(spark, sf_dir):
    """Which definition of its category each label means."""
    items = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.expr(_SECTION).alias("section"), F.expr(_LABEL).alias("label"))
    return h.defined(items, spark.sql(_DEFS))


@query("SELECT page_id, round(CASE WHEN length(html) > 0 THEN (len(string_split(lower(html), 'the')) - 1 + len(string_split(lower(html), 'die')) - 1) * 1000.0::DOUBLE / length(lower(html)) ELSE 0 END, 6) AS density, length(CASE WHEN instr(lower(html), '<article') > 0 THEN substr(html, greatest(1, instr(lower(html), '<article') - 200), instr(lower(html), '<article') - greatest(1, instr(lower(html), '<article') - 200) + 200) ELSE substr(html, 1, 400) END) AS window_length FROM pages")
def page_density(spark, sf_dir):
    """How dense signal words are in a page, and how much of it lies around its article."""
    return b.table(spark, sf_dir, "pages").select("page_id", F.round(h.density(F.col("html"), ("the", "die")), 6).alias("density"), F.length(h.around(F.col("html"), "<article", 200)).alias("window_length"))


_AMOUNT = "concat('desde $', CAST(p_size AS STRING), '.', CAST(100 + p_partkey % 900 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN ',50' ELSE '' END)"


@query(f"WITH t AS (SELECT p_partkey AS id, p_size AS whole, {_AMOUNT} AS said FROM part) SELECT id, said, try_cast(replace(replace(regexp_extract(said, '(-?[0-9][0-9.]*(?:,[0-9]+)?)', 1), '.', ''), ',', '.') AS DOUBLE) AS number, try_cast(regexp_replace(said, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM t".replace("p_size AS whole, ", ""))
def sheet_numbers(spark, sf_dir):
    """Amounts as people write them, read with a point as the thousands mark, and by their digits alone."""
    said = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_AMOUNT).alias("said"))
    return said.select("id", "said", h.locale_number(F.col("said")).alias("number"), h.digits_price(F.col("said")).alias("digits"))


@query("WITH t AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS n FROM t) SELECT id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug, regexp_full_match(slug, '[a-z0-9]+(?:-[a-z0-9]+)*') AS valid FROM n")
def unique_slugs(spark, sf_dir):
    from lodestone.functions.text import slug

    names = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
    return h.numbered_slugs(names).withColumn("valid", h.is_slug(F.col("slug")))
