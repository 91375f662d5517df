"""Documents in blocks that can be sent whole to where a shard's answers about them arrive.

A block holds about `size` bytes of text, compressed, and the rows' other columns. Blocks are built where the
rows lie, so a block asks a shard for each of its keys once, however often they occur; its digest names it. They are
built twice (to ask, and to meet the answers), so the rows must come in the same order both times: stored() sees to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .common import lean, tidy, trim

BLOCKS = "block long, fold int, n int, n_bytes long, texts binary, sizes binary, others binary"


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes in planes, compressed."""
    wide = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, wide).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * wide, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, n).T).view(kind).ravel()


def columns(schema: str) -> list[str]:
    """The names of a schema of plain types."""
    return [c.split()[0] for c in schema.split(", ")]


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """rows as a batch of a schema of int, long, double, string and binary."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=columns(schema))


def _pack(batches: list[pa.RecordBatch], fold: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    text = pa.chunked_array(table.column(0)).cast(pa.large_string()).combine_chunks().fill_null("")
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
    sizes = pc.binary_length(text).to_numpy().astype(np.int64)
    raw = b"".join(buf.tobytes() for _, _, buf, _ in W.chunks(text, 1 << 26))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.drop_columns([table.column_names[0]]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.drop_columns([table.column_names[0]]))
    others = sink.getvalue().to_pybytes()
    # Most of what is moved is text: a higher level than elsewhere.
    texts = pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)
    name = int.from_bytes(hashlib.blake2b(texts + others, digest_size=8).digest(), "little") >> 1
    return batch_of(BLOCKS, [(name, fold, len(sizes), len(raw), texts, squeeze(sizes), others)])


Batches = Iterator[pa.RecordBatch]


def packed(docs: DataFrame, size: int, fold: str | None = None, then: tuple[Callable[[Batches], Batches], str] | None = None) -> DataFrame:
    """docs (text first; null is empty) -> BLOCKS. fold: a column of 0 and 1 that is the same in all rows of a block.

    then: what the same workers make of the blocks, and its schema.
    """
    place = docs.columns.index(fold) if fold else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
        full = {0: 0, 1: 0}
        for batch in batches:
            for f in (0, 1) if fold else (0,):
                some = batch.filter(pc.equal(batch.column(place), f)) if fold else batch
                at = 0
                while at < len(some):
                    # Rows up to the block's bound; a longer text is a block of its own.
                    ends = np.cumsum(pc.binary_length(some.column(0).slice(at)).fill_null(0).to_numpy())
                    n = max(1, int(np.searchsorted(ends, size - full[f], "right")))
                    held[f].append(some.slice(at, n))
                    full[f] += int(ends[min(n, len(ends)) - 1])
                    at += n
                    if full[f] >= size or at < len(some):
                        yield _pack(held[f], f)
                        held[f], full[f] = [], 0
        for f, rest in held.items():
            if rest:
                yield _pack(rest, f)

    if then is None:
        return docs.mapInArrow(tidy(run), BLOCKS)
    return docs.mapInArrow(tidy(lambda batches: then[0](run(batches))), then[1])


def unpacked(row: dict) -> tuple[pa.Array, pa.Table]:
    """(texts, the other columns) of a block."""
    ends = np.concatenate([[0], np.cumsum(unsqueeze(row["sizes"], row["n"], np.int64))])
    raw = pa.decompress(row["texts"], row["n_bytes"], codec="zstd", asbytes=True)
    texts = pa.LargeStringArray.from_buffers(row["n"], pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
    return texts, pa.ipc.open_stream(row["others"]).read_all()


def meet(blocks: DataFrame, answers: DataFrame, use: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """use(block, its answers) -> rows of schema, for every block. Equal blocks share their answers."""

    def run(mine: pa.Table, got: pa.Table) -> pa.Table:
        lean()
        told = got.to_pylist()
        out = [use(r, told) for r in mine.to_pylist()]
        trim()
        return pa.concat_tables(out).combine_chunks() if out else pa.table([pa.array([], pa.int64()) for _ in columns(schema)], columns(schema))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
