"""Chunkers as table functions of SQL: ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 'sentences', 200, 20) c``."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.operators import chunks as K
from millrace.session import ship


def word_cut(size: int = 500, overlap: int = 50):
    """Windows of ``size`` words that step by size - overlap, as ``chunks.word_windows`` cuts them."""

    def cut(text: str) -> list[str]:
        words = [w for w in re.split(r"\s+", text) if w]
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]

    return cut


#: (chunker of a size and an overlap, default size, default overlap, what its size counts)
KINDS = {
    "words": (word_cut, 500, 50, "words"),
    "paragraphs": (lambda size, _: lambda t: K.pack_paragraphs(t, size), 24_000, 0, "chars"),
    "tokens": (K.token_cut, 1000, 100, "words"),
    "sentences": (K.sentence_cut, 1000, 100, "words"),
    "tail": (K.tail_cut, 1000, 200, "chars"),
    "recursive": (K.recursive_cut, 1250, 250, "chars"),
}


class Chunk:
    """``chunk_idx, chunk`` and the chunk's size in what its kind counts (``n_words`` or ``n_chars``): the call gives the schema.
    Null and empty texts have no chunks."""

    @staticmethod
    def analyze(text: AnalyzeArgument, how: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not how.isConstantExpression or how.value not in KINDS:
            raise ValueError(f"the second argument is one of {', '.join(KINDS)}")
        for given in (size, overlap):
            if given is not None and (not given.isConstantExpression or given.value is None or int(given.value) < 0):
                raise ValueError("size and overlap are constant whole numbers")
        if size is not None and (int(size.value) == 0 or int(overlap.value if overlap is not None else 0) >= int(size.value)):
            raise ValueError("the size is above the overlap")
        unit = KINDS[how.value][3]
        return AnalyzeResult(T.StructType([T.StructField("chunk_idx", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField(f"n_{unit}", T.IntegerType())]))

    def __init__(self):
        self.cut, self.asked, self.words = None, None, False

    def eval(self, text, how, size=None, overlap=None):
        if (how, size, overlap) != self.asked:
            make, default, over, unit = KINDS[how]
            size_, over_ = default if size is None else int(size), over if overlap is None else int(overlap)
            self.cut, self.asked, self.words = make(size_, min(over_, size_ - 1)), (how, size, overlap), unit == "words"
        for i, piece in enumerate(self.cut(text) if text else []):
            yield i, piece, len(piece.split()) if self.words else len(piece)


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Makes ``chunk`` known to the session's SQL, the guarded surface included."""
    ship(spark)
    spark.udtf.register(name, udtf(Chunk))
