"""Component sheets, candidate lists and memories against cases and brute force."""

import json
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.operators import browse, hardware, knowledge, memory, specs
from lodestone.streaming import changes


def read(spark, key, value):
    return json.loads(spark.createDataFrame([(key, value)], "key string, value string").select(hardware.structured(F.col("key"), F.col("value")).alias("r")).first()["r"])


def test_sheets(spark):
    assert read(spark, "pcie_slot_list", "1x PCIe 5.0 x16, 2x PCIe 4.0 x1") == [{"type": "PCIe x16", "generation": "5.0", "lanes": 16, "count": 1}, {"type": "PCIe x1", "generation": "4.0", "lanes": 1, "count": 2}]
    m2 = read(spark, "m2_slot_list", "1x M.2 2280 (PCIe 5.0 x4), 1x M.2 2280 (SATA), M.2 2242")
    assert [(x["interface"], x["generation"], x["lanes"], x["form_factors"]) for x in m2] == [("PCIe", "5.0", 4, ["2280"]), ("SATA", None, None, ["2280"]), (None, None, None, ["2242"])]
    ports = {(p["kind"], p["version"], p["count"]) for p in read(spark, "rear_ports", "2x USB 3.2 Gen 1, 1x HDMI 2.1, 1x DisplayPort 1.4")}
    assert ports == {("USB", "3.2 Gen 1", 2), ("HDMI", "2.1", 1), ("DisplayPort", "1.4", 1)}
    assert read(spark, "motherboard_power_connector", "24-pin") == [{"type": "ATX", "pins": 24, "count": 1}]
    assert read(spark, "cpu_power_connector_types", "1x 8-pin EPS + 1x 4-pin")[0] == {"type": "EPS", "pins": 8, "count": 1}
    assert read(spark, "hdmi", "2x HDMI 2.1") == [{"version": "2.1", "count": 2}]
    assert read(spark, "fan_header_list", "1x CPU_FAN, 2 x chassis fan; 4-pin RGB") == [{"name": "CPU_FAN", "count": 1}, {"name": "CHA_FAN", "count": 2}, {"name": "rgb", "count": 4}]
    assert read(spark, "usb_headers", '["USB 2.0", "USB 2.0"]') == [{"kind": "USB", "version": "2.0", "connector": None, "count": 1}]
    assert read(spark, "pcie_slot_list", "{'type': 'PCIe x8', 'count': 1}") == [{"type": "PCIe x8", "generation": None, "lanes": 8, "count": 1}]
    assert [read(spark, "other", x) for x in (None, " ", "text")] == [[], [], [{"value": "text"}]]
    one = lambda col, x: spark.createDataFrame([(x,)], "x string").select(col(F.col("x")).alias("r")).first()["r"]
    assert [one(hardware.locale_number, x) for x in ("$1.299.990", "6.1", "3,5 kg", "x", None)] == [1299990.0, 61.0, 3.5, None, None]
    assert [one(hardware.is_slug, x) for x in ("a-b1", "A", "a--b", None)] == [True, False, False, False]


def test_categories(spark):
    tree = spark.createDataFrame([(1, None, "todo", "Todo"), (2, 1, "celulares", "Teléfonos"), (3, 2, "android", "Android"), (4, 1, "notebooks-gamer", "Notebooks gamer")], "id long, parent_id long, slug string, name string")
    ids = lambda term: sorted(r["id"] for r in browse.below(tree, term).collect())
    assert [ids(t) for t in ("celulares", "Android", "smartphone", "laptop", "todos", "mouse", " ")] == [[2, 3], [3], [2, 3], [4], [1, 2, 3, 4], [], []]


def test_model_candidates(spark):
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(["red", "blue", "bolt", "ring", "gear", "small"]) for _ in range(3))
    products = [(i, rng.choice(["A", "b"]), rng.choice([None, f"MP-{i % 9}"]), rng.choice([None, "", f"m{i % 7}"]), name()) for i in range(60)]
    offers = [(i, rng.choice(["a", "B"]), rng.choice([None, f"mp {i % 9}"]), rng.choice([None, f"M{i % 7} "]), name()) for i in range(30)]
    want = {}
    flat = lambda x: re.sub(r"[\s\-_./\\]+", "", (x or "").upper())
    for o, b, m, d, n in offers:
        own = [p for p in products if p[1].lower() == b.lower()]
        found = {}
        for p in own:
            ratio = SequenceMatcher(None, n, p[4]).ratio()
            if flat(m) and flat(m) == flat(p[2]):
                found[p[0]] = (0, -1.0, p[0])
            elif d and d.strip() and d.strip().lower() == (p[3] or "").strip().lower():
                found[p[0]] = (1, -1.0, p[0])
            elif ratio >= 0.5:
                found[p[0]] = (2, -ratio, p[0])
        want[o] = [(x[2], x[0]) for x in sorted(found.values())[:8]]
    schema = "id long, brand string, mpn string, model string, name string"
    out = knowledge.model_candidates(spark.createDataFrame(offers, schema).withColumnRenamed("id", "offer_id"), spark.createDataFrame(products, schema).withColumnRenamed("id", "product_id"))
    got = {o: [] for o in want}
    for r in out.orderBy("offer_id", "rank").collect():
        got[r["offer_id"]].append((r["product_id"], r["strategy"]))
    assert got == want


def test_memories_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(memory, "BLOCK", 7)
    rng = np.random.default_rng(2)
    bases = rng.normal(size=(6, 8))
    rows = []
    for i in range(160):
        v = bases[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.15, 0.5])
        rows.append((int(rng.integers(2)), str(rng.integers(2)), i, f" Text  {rng.integers(60)}" if i % 3 else f"own {i}", [float(x) for x in v], int(rng.integers(1, 6))))
    want, kept = {}, []
    for user, kind, seq, content, vector, importance in rows:
        text, v = " ".join(content.split()).lower(), np.array(vector) / np.linalg.norm(vector)
        hit = next((m for m in kept if m["user"] == user and m["text"] == text), None) or next((m for m in kept if m["user"] == user and m["kind"] == kind and float(m["v"] @ v) >= memory.SAME), None)
        if hit is None:
            hit = {"user": user, "kind": kind, "text": text, "v": v, "seq": seq, "importance": importance}
            kept.append(hit)
        hit["importance"] = max(hit["importance"], importance)
        want[seq] = (hit["seq"], hit["seq"] == seq, hit["importance"])
    df = spark.createDataFrame(rows, "user_id long, kind string, seq long, content string, vector array<double>, importance int").repartition(3)
    assert {r["seq"]: (r["kept_seq"], r["created"], r["importance"]) for r in memory.added(df).collect()} == want
    assert len(kept) < 120


def test_preferred_source_and_batches(spark, tmp_path):
    rows = [(1, "web", 0, 0, "w"), (1, "manufacturer", 5, 9, "m5"), (1, "manufacturer", 2, 9, "m2"), (2, "web", 0, 3, "later"), (2, "review", 9, 1, "first")]
    got = specs.lowest_manufacturer_source(spark.createDataFrame(rows, "product_id long, kind string, priority long, place long, url string"))
    assert {r["product_id"]: r["url"] for r in got.collect()} == {1: "m2", 2: "first"}
    spark.createDataFrame([(1, 5), (2, 6)], "id long, n long").write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(2, 9), (3, 1)], "id long, n long").write.parquet(f"{tmp_path}/in/b")
    versions = [spark.createDataFrame([], "id long, n long")]

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{batch}")
        versions.append(spark.read.parquet(f"{tmp_path}/v{batch}"))

    merge = lambda old, new: old.unionByName(new).groupBy("id").agg(F.max("n").alias("n"))
    stream = spark.readStream.schema("id long, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = changes.upsert_batches(stream, lambda: versions[-1], write, merge).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["n"] for r in versions[-1].collect()} == {1: 5, 2: 9, 3: 1}
