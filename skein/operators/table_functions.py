"""Chunkers and block readers as table functions of SQL, with schemas worked out when a query is analysed.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 'recursive', 128) c
    SELECT d.doc_id, b.* FROM documents d, LATERAL markdown_blocks(d.text) b
    SELECT * FROM stitch_parts(TABLE(parts) PARTITION BY document_id ORDER BY chunk_index)

Strategies are looked up by name among chunking.CHUNKERS and those given to `register`; a name that is not known fails the query before it runs. What a
strategy returns beyond start and end becomes columns if it is registered with their types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException, udtf  # noqa: F401
from pyspark.sql.types import DataType, IntegerType, LongType, Row, StringType, StructType

from . import chunking
from .matching import stitch

Chunker = Callable[..., list[dict]]


def _chunk_text(chunkers: dict[str, Chunker], extra: dict[str, StructType]):
    """The class of chunk_text over these strategies."""

    class ChunkText:
        """text, strategy (a constant), then the strategy's own numbers by name or the size: one row for each chunk."""

        @staticmethod
        def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument, size: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError("chunk_text: the text must be a string")
            if not strategy.isConstantExpression or strategy.value not in chunkers:
                raise ValueError(f"chunk_text: no strategy {strategy.value!r}; there are {', '.join(sorted(chunkers))}")
            schema = StructType().add("chunk_index", IntegerType()).add("start_offset", IntegerType()).add("end_offset", IntegerType()).add("content", StringType())
            for f in extra.get(strategy.value, StructType()).fields:
                schema = schema.add(f)
            return AnalyzeResult(schema=schema)

        def eval(self, text, strategy, size=None, **options):
            more = [f.name for f in extra.get(strategy, StructType()).fields]
            if size is not None:
                options["size"] = size
            for i, c in enumerate(chunkers[strategy](text or "", **options)):
                yield (i, c["start"], c["end"], (text or "")[c["start"]:c["end"]], *(c.get(m) for m in more))

    return ChunkText


class MarkdownBlocks:
    """text: one row for each block: position, kind, start_offset, end_offset."""

    def eval(self, text: str):
        for b in chunking.blocks(text or ""):
            yield b["position"], b["kind"], b["start"], b["end"]


class StitchParts:
    """A table of parts (document_id, chunk_index, content) by document: one row for each document, its text put together at the overlaps."""

    @staticmethod
    def analyze(parts: AnalyzeArgument) -> AnalyzeResult:
        if not parts.isTable or not {"document_id", "chunk_index", "content"} <= set(parts.dataType.names):
            raise ValueError("stitch_parts: a table with document_id, chunk_index and content is needed")
        kind: DataType = parts.dataType["document_id"].dataType
        return AnalyzeResult(schema=StructType().add("document_id", kind if isinstance(kind, LongType | IntegerType | StringType) else StringType()).add("parts", IntegerType()).add("text", StringType()))

    def __init__(self):
        self.document, self.rows = None, []

    def eval(self, row: Row):
        self.document = row["document_id"]
        self.rows.append((row["chunk_index"], row["content"] or ""))

    def terminate(self):
        if self.rows:
            yield self.document, len(self.rows), stitch([x for _, x in sorted(self.rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))])


def register(spark: SparkSession, chunkers: dict[str, Chunker] | None = None, extra: dict[str, StructType] | None = None) -> None:
    """Make chunk_text, markdown_blocks and stitch_parts known to SQL; chunkers: strategies of the caller's own beside those of the library."""
    spark.udtf.register("chunk_text", udtf(_chunk_text(chunking.CHUNKERS | (chunkers or {}), extra or {})))
    spark.udtf.register("markdown_blocks", udtf(MarkdownBlocks, returnType="position int, kind string, start_offset int, end_offset int"))
    spark.udtf.register("stitch_parts", udtf(StitchParts))
