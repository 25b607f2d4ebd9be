"""Chunks of documents as a table function: rows that keep their document's columns, and where in its text each begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators.retrieval import _stretches

# Characters of a chunk, of its overlap with the next one, and chunks of a document at most.
SIZE, OVERLAP, MOST = 900, 120, 24

_ROW = T.StructType([
    T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("approx_tokens", T.IntegerType()),
])


@F.udtf
class chunk_rows:  # noqa: N801
    """chunk_rows(text, size, overlap, most): chunk_index, start (code points before it in the text), content, approx_tokens.

    ``size``, ``overlap`` and ``most`` are constants, at least 1, from 0 to below ``size``, and at least 0. A text is cut lazily: what lies past its last
    chunk is not looked at for places to cut. Null and blank texts have no chunk.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("the text of chunk_rows is a string")
        for name, arg in (("size", size), ("overlap", overlap), ("most", most)):
            if not arg.isConstantExpression or arg.value is None or not isinstance(arg.dataType, T.IntegralType):
                raise ValueError(f"{name} of chunk_rows is a whole constant")
        if not (size.value >= 1 and 0 <= overlap.value < size.value and most.value >= 0):
            raise ValueError("chunk_rows takes a size of 1 or more, an overlap from 0 to below it, and a number of chunks of 0 or more")
        return AnalyzeResult(schema=_ROW)

    def eval(self, text, size, overlap, most):
        whole = (text or "").strip()
        before = len(text or "") - len((text or "").lstrip())
        index = 0
        for a, b in [(0, len(whole))] if 0 < len(whole) <= size else _stretches(whole, size, overlap):
            if index >= most:
                return
            piece = whole[a:b]
            content = piece.strip()
            if content:
                yield index, before + a + len(piece) - len(piece.lstrip()), content, max(1, round(len(content) / 4))
                index += 1


def chunked(docs: DataFrame, text_col: str = "text", *, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """The chunks of each document in a lateral join: the document's other columns (address, title, product and so on) with chunk_index, start,
    content and approx_tokens. Columns of the documents with such a name are left out; repeated rows have their chunks each."""
    own: list[Column] = [F.col(c) for c in docs.columns if c != text_col and c not in _ROW.names]
    found = chunk_rows(F.col("_text").outer(), F.lit(size), F.lit(overlap), F.lit(most))
    return docs.select(*own, F.col(text_col).alias("_text")).lateralJoin(found).drop("_text")
