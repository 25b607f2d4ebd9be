"""Long-term memories: near duplicates, episodes and what is always recalled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cosine from which a memory refreshes an older one of its kind.
SAME = 0.93


#: Vectors of a user and kind that are compared with each other in one task at a time.
BLOCK = 2048


def _near(classes: DataFrame) -> DataFrame:
    """(user_id, kind, cls, vector), each vector of a user and kind once -> (cls, near): pairs at a cosine of SAME or more, both ways.

    The vectors of a user and kind are dealt into blocks by their number, and every two blocks meet in a task of their own.
    """
    sizes = classes.groupBy(F.col("user_id").alias("_u"), F.col("kind").alias("_k")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    met = classes.join(sizes, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("kind").eqNullSafe(F.col("_k"))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = met.select("user_id", "kind", "cls", "vector", "own", others).select("user_id", "kind", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "vector")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for _, same in pdf.groupby(pdf["vector"].map(len)):
            x = np.stack(same["vector"].to_numpy()).astype(float)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x /= np.where(length > 0, length, 1.0)
            ids, own = same["cls"].to_numpy(), same["own"].to_numpy()
            side = own == pdf["i"].iloc[0]
            a, b = (np.flatnonzero(side), np.flatnonzero(~side)) if not side.all() else (np.arange(len(x)),) * 2
            for at in range(0, len(a), 512):
                p, q = np.nonzero(x[a[at : at + 512]] @ x[b].T >= SAME)
                out.append(np.stack([ids[a[at : at + 512][p]], ids[b[q]]], axis=1))
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame(found[found[:, 0] != found[:, 1]], columns=["cls", "near"])

    one_way = dealt.groupBy("user_id", "kind", "i", "j").applyInPandas(pairs, "cls long, near long")
    return one_way.unionByName(one_way.select(F.col("near").alias("cls"), F.col("cls").alias("near"))).distinct()


def added(memories: DataFrame) -> DataFrame:
    """Memories (user_id, kind, seq, content, vector, importance) as they come in: each either new or a refresh of the first one like it.

    Equal texts (white space and case aside) of a user are one whatever their kind; so are vectors of one kind at a cosine of SAME or more. The kept memory takes
    the greater importance; each row shows it as it then is. ``seq`` is unique. A null text is empty, a null vector resembles none.

    Equal vectors of a user and kind are a class, named by its smallest seq, of which one memory at most is ever kept. Classes that resemble each other are found
    block by block; then a user's memories pass by in order with the classes near theirs, and only what was kept is remembered.
    """
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")))
    rows = memories.select("user_id", "kind", "seq", F.struct(F.xxhash64(text), F.xxhash64(F.lit(3), text)).cast("struct<a:bigint,b:bigint>").alias("text"), "vector", F.col("importance").cast("int").alias("importance"))
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0)
    classes = rows.where(whole).groupBy("user_id", "kind", "vector").agg(F.min("seq").alias("cls"))
    near = _near(classes).groupBy("cls").agg(F.array_sort(F.collect_set("near")).alias("near"))
    named = classes.join(near, "cls", "left").select(F.col("user_id").alias("_u"), F.col("kind").alias("_k"), F.col("vector").alias("_v"), "cls", "near")
    same = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("kind").eqNullSafe(F.col("_k")) & (F.col("vector") == F.col("_v"))
    met = rows.join(named, same, "left").select("user_id", "seq", "text", "importance", F.coalesce("cls", F.lit(None).cast("long")).alias("cls"), "near")
    schema = "user_id long, seq long, kept_seq long, created boolean, importance int"

    def fold(batches):
        user, texts, kept, weight = object(), {}, {}, {}
        for pdf in batches:
            out = []
            for who, seq, text, importance, cls, near in zip(*[pdf[c] for c in ("user_id", "seq", "text", "importance", "cls", "near")], strict=True):
                if who != user:
                    user, texts, kept, weight = who, {}, {}, {}
                text = (text["a"], text["b"])
                none = cls is None or cls != cls
                hit = texts.get(text)
                if hit is None and not none:
                    hit = min((kept[c] for c in (cls, *(near if near is not None else ())) if c in kept), default=None)
                if hit is None:
                    hit = texts[text] = int(seq)
                    if not none:
                        kept[cls] = hit
                    weight[hit] = importance
                weight[hit] = max(weight[hit], importance)
                out.append((who, seq, hit, hit == seq, weight[hit]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return met.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInPandas(fold, schema)


def episodes(tasks: DataFrame) -> DataFrame:
    """The last outcome of each goal (its first 160 characters), from (user_id, goal, seq, content)."""
    last = tasks.groupBy("user_id", F.substring(F.trim(F.regexp_replace("goal", r"\s+", " ")), 1, 160).alias("goal")).agg(F.max(F.struct("seq", "content")).alias("last"), F.count(F.lit(1)).alias("times"))
    return last.select("user_id", "goal", "last.seq", "last.content", "times")


def core(memories: DataFrame, k: int = 3, least: int = 4) -> DataFrame:
    """Each user's most important preferences, the newest of equals first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("memory_id"))
    return memories.where((F.col("kind") == "preference") & (F.col("importance") >= least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recalled(core_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Core memories first, then what was found and is not among them: user_id, memory_id, place."""
    both = core_rows.select("user_id", "memory_id", F.col("rank").alias("place")).unionByName(found.select("user_id", "memory_id", (F.col("rank") + 1000).alias("place")))
    order = Window.partitionBy("user_id").orderBy("place")
    return both.groupBy("user_id", "memory_id").agg(F.min("place").alias("place")).withColumn("place", F.row_number().over(order))
