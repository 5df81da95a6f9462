"""Suffix-array deduplication: bytes that repeat an earlier passage go.

Texts are UTF-8 bytes, windows have 100 of them by default. The suffixes that start at anchors are range
partitioned by their leading bytes and sorted in buckets, see ``repeats``; a window goes if an equal one starts
earlier: in a document with a smaller id, or before it in the same document. Windows may overlap, and all
are judged on the input.

Null texts are empty; texts shorter than a window keep every byte. A null id sorts before all others. Rows
that repeat id and text are one document and get equal answers, texts that share an id are ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.repeats import BYTE_SYMBOLS, by_bytes, numbered, repeated, with_runs

WIDTH = 100
GRAM = 44


def byte_sequence(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(text, dtype=np.uint8)
    padded = np.zeros(len(values) + 3, dtype=np.uint32)
    padded[: len(values)] = values
    heads = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    return BYTE_SYMBOLS[values], heads


def marked(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` symbols lie in any of the runs."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Where maximal runs of true values start and end, alternating."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """Id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (first byte, end) and the ``kept`` bytes."""
    texts = numbered(docs, id_col, text_col)
    covered = repeated(texts, byte_sequence, width, gram, "suffixes")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            ids, sizes, removed, spans, kept = batch.column(0), [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer()
                sizes.append(text.size)
                first = batch.column(2)[i]
                if not first.is_valid:
                    removed.append(0)
                    spans.append([])
                    kept.append(text.to_pybytes())
                    continue
                mask = marked(
                    text.size, first.values.to_numpy(), batch.column(3)[i].values.to_numpy() + width
                )
                edges = runs(mask)
                removed.append(int(mask.sum()))
                spans.append(edges.tolist())
                kept.append(np.frombuffer(text, dtype=np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                    pa.array(kept, pa.binary()),
                ],
                names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    kind = texts.schema["_id"].dataType.simpleString()
    both = with_runs(texts.withColumn("_text", F.col("_text").cast("binary")), covered, "suffix-documents")
    return (
        both.select("_id", "_text", "_first", "_last")
        .mapInArrow(cut, f"_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
        .withColumnRenamed("_id", id_col)
    )
