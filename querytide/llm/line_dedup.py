"""Lines that many documents share: counted by hash over the corpus, dropped everywhere but in one document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import SPACE_BYTES, filled, passes, without
from querytide.session import staged

MIN_CHARS = 20
MIN_DOCUMENTS = 3
# So many of the most frequent keys are joined by broadcast; any other one stands in a thousandth of all rows at most.
FREQUENT_KEYS = 1000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the stripped, A-Z lower-cased line; None if that has fewer code points."""
    line = line.strip(SPACE_BYTES).lower()  # bytes.lower() leaves all but A-Z
    # A code point has at most four bytes, so only lines between need to be counted.
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _holders(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist()):
                own = {k for line in text.encode().split(b"\n") if (k := line_key(line, min_chars))}
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(0).type)], ["key", "doc"])

    return run


def _rewrite(min_chars: int, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, text_col):
            texts, lines, dropped = [], [], []
            for text, drop in zip(filled(batch.column(text_col)).to_pylist(), batch.column("_drop").to_pylist()):
                parts = text.encode().split(b"\n")
                kept = parts
                if drop:
                    gone = set(drop)
                    kept = [p for p in parts if line_key(p, min_chars) not in gone]
                texts.append(b"\n".join(kept).decode() if drop else text)
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            own = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], columns)

    return run


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` with the text less its shared lines, and ``n_lines`` (before), ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and stands in ``min_documents`` documents or
    more stays in the largest ``id_col`` that holds it alone (there with all its copies).

    A null text is an empty one: one empty line. Rows with one id are one document. A row without an id
    is no document: it counts for nothing and keeps its lines. A document that loses every line has an
    empty text. Columns named ``n_lines`` or ``n_dropped`` are replaced, all others stay. No row is lost.
    """
    docs = without(docs, "n_lines", "n_dropped", "_drop")
    kind = docs.schema[id_col].dataType
    held = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    held = held.mapInArrow(_holders(min_chars), T.StructType().add("key", T.BinaryType()).add("doc", kind))
    # One row per key and document first: a key that a third of the corpus shares is spread by document.
    shared = (
        held.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_documents)
    )
    shared = staged(shared, "shared_lines")
    frequent = shared.orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).select("key", F.col("keeper").alias("known"))
    # Rows of a frequent key have their keeper, so they are dealt by document: no other key has these bytes.
    held = held.join(F.broadcast(frequent), "key", "left").withColumn(
        "dealt", F.when(F.col("known").isNull(), F.col("key")).otherwise(F.concat("key", F.col("doc").cast("string").cast("binary"), F.lit(b"\x00")))
    )
    held = held.join(shared.select(F.col("key").alias("dealt"), "keeper"), "dealt", "left")
    drops = (
        held.where(F.col("doc") != F.coalesce("known", "keeper"))
        .groupBy("doc").agg(F.collect_set("key").alias("_drop"))  # at most the lines of one document
    )
    joined = docs.join(drops, docs[id_col] == drops["doc"], "left").drop("doc")
    columns = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rewrite(min_chars, text_col, columns), schema)
