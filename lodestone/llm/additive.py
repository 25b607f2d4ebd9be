"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of
several codebooks, found by a beam search over residuals. The codebooks start as k-means on
residuals and are then fitted jointly by least squares. A code is stored with the norms of the vector and of
what the code stands for. A query's inner product with every code comes from a table of its products with all
codewords, and is scaled by the two norms, as a code is shorter than its vector. Blocks hold codes only; the
originals are fetched for the shortlists, which are then ranked exactly.

Equal vectors form one class, which is encoded and scored once, so a vector with
a third of all rows costs what one row costs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import remove, written

#: Codebooks, codewords in each, beams, and the different vectors at most that the codebooks are fitted on.
BOOKS, WORDS, BEAMS, SAMPLE = 16, 256, 8, 8192
#: Classes and queries in a block; classes that are ranked by their original vectors for each query, and how many times
#: its even share of these a block may name.
BLOCK, QUERIES, SHORTLIST, LEEWAY = 8192, 4096, 512, 4


class Quantiser(NamedTuple):
    words: np.ndarray  # books x words x dimensions

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books), and the stored norm of each: the vector's length over that of what its code stands for."""
        m, k, d = self.words.shape
        words, squares = self.words.astype(np.float32), (self.words**2).sum(axis=2).astype(np.float32)
        codes, norms = np.empty((len(x), m), np.uint8), np.empty(len(x))
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = np.arange(len(part))[:, None]
            left = part.astype(np.float32)[:, None, :]  # what each beam has not yet explained
            error = (left**2).sum(axis=2)
            chosen = np.zeros((len(part), 1, 0), np.uint8)
            for b in range(m):
                dots = (left.reshape(-1, d) @ words[b].T).reshape(len(part), -1, k)
                cost = (error[:, :, None] + squares[b] - 2 * dots).reshape(len(part), -1)
                width = min(BEAMS, cost.shape[1])
                best = np.argpartition(cost, width - 1, axis=1)[:, :width]
                beam, word = best // k, best % k
                error = cost[n, best]
                left = left[n, beam] - words[b][word]
                chosen = np.concatenate([chosen[n, beam], word[:, :, None].astype(np.uint8)], axis=2)
            codes[at : at + 1024] = chosen[n[:, 0], error.argmin(axis=1)]
            made = np.linalg.norm(self.decode(codes[at : at + 1024]), axis=1)
            norms[at : at + 1024] = np.linalg.norm(part, axis=1) / np.where(made > 0, made, 1.0)
        return codes, norms

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> Quantiser:
    """Residual k-means, then two rounds of encoding and joint least squares."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    residual, found = x.copy(), np.empty((books, words, x.shape[1]))
    for b in range(books):
        centres = residual[rng.choice(len(x), words, replace=False)].copy()
        for _ in range(8):
            near = ((centres**2).sum(axis=1) - 2 * residual @ centres.T).argmin(axis=1)
            sizes = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, residual)
            centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        found[b] = centres
        residual -= centres[((centres**2).sum(axis=1) - 2 * residual @ centres.T).argmin(axis=1)]
    made = Quantiser(found)
    for _ in range(2):
        codes, _ = made.encode(x)
        at = codes.astype(np.int64) + np.arange(books) * words
        ata, atx = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(atx, at[:, i], x)
            for j in range(books):
                np.add.at(ata, (at[:, i], at[:, j]), 1.0)
        ata[np.diag_indices_from(ata)] += 1e-2
        ridge = 1e-2 * made.words.reshape(books * words, -1)
        made = Quantiser(np.linalg.solve(ata, atx + ridge).reshape(made.words.shape))
    return made


def usable(col: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    return col.isNotNull() & F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(col, lambda v: v != 0)


def fit_on(classes: DataFrame, *, sample: int = SAMPLE) -> Quantiser:
    """A quantiser for different vectors (vec) of one dimension, fitted on about ``sample`` of them, those with the least hashes."""
    n = classes.count()
    key = F.pmod(F.xxhash64("vec"), F.lit(1 << 40))
    some = classes.where(key < int((1 << 40) * min(1.0, sample / max(1, n)))).select("vec").collect()  # ``sample`` vectors, give or take a few roots of that
    x = np.array([r["vec"] for r in some], np.float64)
    return fit(x[np.lexsort(x.T)])


def _dimension(rows: DataFrame) -> int | None:
    """The dimension of most rows; of equal ones the larger."""
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d")).alias("best")).first()["best"]
    return best["d"] if best else None


def search(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by inner product of each row that the condition ``queries`` holds for.

    Returns query_id, rank (from 1), vec_id, score (in double precision, of the original vectors). Ties go to the smaller
    id; a row is not its own candidate. Rows with a null id, or an unusable vector, or a vector of another dimension than
    most rows, take no part; repeated rows count once. Every class with a code is scored for every query; what is
    approximate is which SHORTLIST classes are ranked exactly. An empty table gives an empty table.
    """
    found = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), found.alias("vec"), queries.alias("asked"))
    spark = vectors.sparkSession
    dims = _dimension(rows)
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.where(F.size("vec") == dims).distinct(), "vectors")
    classes = written(rows.groupBy("vec").agg(F.min("id").alias("cls"), F.min(F.when(F.col("asked"), F.col("id"))).alias("query")), "vector-classes")
    model = fit_on(classes)
    wanted = classes.where("query is not null").select("query", "vec")
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((classes, BLOCK), (wanted, QUERIES)))
    coded = written(_encoded(classes.select("vec", "cls"), model), "vector-codes")
    best = written(_ranked(_named(coded, wanted, model, blocks, query_blocks, max(SHORTLIST, k + 1)), classes, wanted, blocks, query_blocks, k + 1), "vector-scores")
    remove(coded)
    # The k + 1 first rows of each class are all that a result can hold.
    order = Window.partitionBy("cls").orderBy("id")
    named = rows.join(classes.select(F.col("vec").alias("_vec"), "cls", "query"), F.col("vec") == F.col("_vec")).select("id", "cls", "query", "asked")
    members = named.select("id", "cls").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = best.join(members, "cls").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("query", "id", "score")
    answers = named.where("asked").select(F.col("id").alias("query_id"), "query").join(lists, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _encoded(classes: DataFrame, model: Quantiser) -> DataFrame:
    """(vec, cls) -> (cls, codes, norm)."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                codes, norms = model.encode(np.stack(pdf["vec"].to_numpy()))
                yield pd.DataFrame({"cls": pdf["cls"], "codes": [c.tobytes() for c in codes], "norm": norms})

    return classes.mapInPandas(run, "cls long, codes binary, norm double")


def _cell(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _named(coded: DataFrame, wanted: DataFrame, model: Quantiser, blocks: int, query_blocks: int, short: int) -> DataFrame:
    """(query, cls): the ``short`` classes of each query whose codes score best. Every block of queries meets every block of codes, and only codes travel."""
    left = coded.select("cls", "codes", "norm", _cell("cls", blocks).alias("block"), _every(query_blocks).alias("qblock"))
    right = wanted.select("query", "vec", _cell("query", query_blocks).alias("qblock"), _every(blocks).alias("block"))
    share = max(1, min(short, -(-LEEWAY * short // blocks)))

    def score(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(queries):
            return pd.DataFrame({"query": np.array([], np.int64), "cls": np.array([], np.int64), "rough": np.array([], np.float32)})
        codes = codes.sort_values("cls")
        m, words, _ = model.words.shape
        at = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(-1, m).astype(np.int64) + np.arange(m) * words
        ids, norms = codes["cls"].to_numpy(np.int64), codes["norm"].to_numpy(np.float32)
        asked, names = np.stack(queries["vec"].to_numpy()), queries["query"].to_numpy(np.int64)
        flat, out = model.words.reshape(m * words, -1).astype(np.float32), []
        width = min(share, len(ids))
        for first in range(0, len(asked), 64):
            table = (asked[first : first + 64].astype(np.float32) @ flat.T).T.copy()  # codewords x queries
            rough = table[at[:, 0]]
            for b in range(1, m):
                rough += table[at[:, b]]
            rough = (rough * norms[:, None]).T
            some = np.argpartition(-rough, width - 1, axis=1)[:, :width]
            out.append((np.repeat(names[first : first + 64], width), ids[some].ravel(), np.take_along_axis(rough, some, axis=1).ravel()))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query", "cls", "rough"), zip(*out, strict=True), strict=True)})

    near = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(score, "query long, cls long, rough float")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rough"), "cls"))
    return near.withColumn("n", place).where(F.col("n") <= short).select("query", "cls")


def _ranked(pairs: DataFrame, classes: DataFrame, wanted: DataFrame, blocks: int, query_blocks: int, k: int) -> DataFrame:
    """(query, cls, score): the k best of the named classes by their original vectors, which come once to each block of queries that names them."""
    asked = pairs.groupBy(_cell("query", query_blocks).alias("qblock"), "cls").agg(F.collect_list("query").alias("queries"))  # at most QUERIES, or what of them has one hash
    left = asked.join(classes.select("cls", "vec"), "cls").select(_cell("cls", blocks).alias("block"), "qblock", "cls", "vec", "queries")
    right = wanted.select("query", "vec", _cell("query", query_blocks).alias("qblock"), _every(blocks).alias("block"))

    def score(named: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(named) or not len(queries):
            return pd.DataFrame({"query": np.array([], np.int64), "cls": np.array([], np.int64), "score": np.array([], np.float64)})
        ids, originals = named["cls"].to_numpy(np.int64), np.stack(named["vec"].to_numpy())
        queries = queries.sort_values("query")
        names, vectors = queries["query"].to_numpy(np.int64), np.stack(queries["vec"].to_numpy())
        row = np.repeat(np.arange(len(ids)), named["queries"].map(len))
        query = np.searchsorted(names, np.concatenate(named["queries"].to_list()))
        exact = np.concatenate([(originals[row[i : i + 65536]] * vectors[query[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)])
        order = np.lexsort((ids[row], -exact, query))
        sizes = np.bincount(query, minlength=len(names))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = order[place < k]
        return pd.DataFrame({"query": names[query[top]], "cls": ids[row[top]], "score": exact[top]})

    return left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(score, "query long, cls long, score double")
