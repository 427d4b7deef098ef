"""Vector bin packing of training examples: tokens, segments and loss-bearing tokens are limited at once.

Each sequence is filled by the dot-product rule: of the examples that fit all remaining limits, take
the one whose demand has the largest weighted dot product with what is left. Examples are packed in
even random parts of bounded size, each by itself; a part wastes at most its last few sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written
from .tokens import chunks, worker_encoder

PART = 40_000


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sequence number of each example; `demand` is (examples, dimensions) in whole units.

    An example beyond a limit by itself gets a sequence of its own. Equal demands are taken in order.
    """
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    next_of = np.concatenate([[0], left.cumsum()[:-1]]) if len(left) else left
    out = np.full(len(demand), -1, np.int64)
    scaled = kinds / limits
    weight = (scaled * left[:, None]).sum(0) / max(1, len(demand))  # scarce dimensions count for more
    sequence = 0
    for k in np.flatnonzero((kinds > limits).any(1)):
        for i in order[next_of[k] : next_of[k] + left[k]]:
            out[i], sequence = sequence, sequence + 1
        left[k] = 0
    remaining, alive, kept = int(left.sum()), np.empty(0, np.int64), 0
    while remaining:
        rest = limits.copy()
        # Kinds that are gone are dropped from the arrays once they are half of them.
        if 2 * kept <= len(alive):
            alive = np.flatnonzero(left)
            kept = len(alive)
            first, *others = np.ascontiguousarray(kinds[alive].T)
            have, gain = np.ones(kept, bool), np.ascontiguousarray((scaled[alive] * weight).T)
        while True:
            # Kinds are in order of the first dimension, so those that fit it come first.
            m = int(first.searchsorted(rest[0], "right"))
            if not m:
                break
            fits = have[:m]
            for size, room in zip(others, rest[1:].tolist(), strict=True):
                fits = fits & (size[:m] <= room)
            best = int(np.where(fits, (rest / limits) @ gain[:, :m], -1.0).argmax())
            if not fits[best]:
                break
            k = alive[best]
            out[order[next_of[k]]] = sequence
            next_of[k] += 1
            left[k] -= 1
            remaining -= 1
            if not left[k]:
                have[best], kept = False, kept - 1
            rest = rest - kinds[k]
        sequence += 1
    return out


def place(examples: DataFrame, tokens: int, segments: int, loss: int) -> DataFrame:
    """Add `sequence_id` and `offset` to examples with `length` and `loss_tokens`.

    Sequence ids are unique, not dense. Within a sequence examples lie without gaps in the order of
    their remaining columns. The count of parts follows the data; no row is left out.
    """
    parts = max(1, -(-examples.count() // PART))
    limits = np.array([tokens, segments, loss], np.int64)
    names = examples.columns
    schema = StructType([*examples.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = pd.concat(list(frames) or [pd.DataFrame(columns=names)], ignore_index=True)
        if not len(held):
            return
        demand = np.stack([held["length"], np.ones(len(held), np.int64), held["loss_tokens"]], 1).astype(np.int64)
        held["sequence_id"] = (TaskContext.get().partitionId() << 33) + fill(demand, limits)
        held = held.sort_values(["sequence_id", "length"], ascending=[True, False], kind="stable")
        held["offset"] = held.groupby("sequence_id")["length"].cumsum() - held["length"]
        yield held

    return examples.repartition(parts).mapInPandas(pack, schema)


def document_pieces(docs: DataFrame, tokenizer: str, end: int, tokens: int) -> DataFrame:
    """Cut each document's ids, `end` included, into pieces of at most `tokens` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, loss_tokens. Full pieces come first, the rest
    last. The first id of a piece has nothing before it to be predicted from and bears no loss. A null or
    empty text is the end id alone; repeated rows are cut alike.
    """

    def cut(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows, at = [], 0
            for part in chunks(texts):
                for ids in encoder.encode(part, end):
                    data = memoryview(ids.astype("<u4").tobytes())
                    for start in range(0, len(ids), tokens):
                        stop = min(start + tokens, len(ids))
                        rows.append((doc_ids[at], start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), len(ids), stop - start - 1))
                    at += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int, tokens: int = 2048, segments: int = 256, loss: int = 2048
) -> DataFrame:
    """Pieces of all documents with their sequence and offset. See `document_pieces` and `place`."""
    # A piece bears one token less than its length, so pieces of this length keep to both limits.
    pieces = written(document_pieces(docs, tokenizer, end, min(tokens, loss + 1)))
    return place(pieces, tokens, segments, loss)


def conversation_examples(turns: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Instruction data: one example per conversation; only what the assistant says bears loss.

    Turns are encoded one by one, each followed by `end`. Returns conv_id, length, loss_tokens. Null texts
    are empty, a null role bears no loss.
    """

    def measure(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            lengths = [len(e) for part in chunks(batch.column("text").to_pylist()) for e in encoder.encode(part, end)]
            said = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array([n * s for n, s in zip(lengths, said, strict=True)], pa.int64())],
                ["conv_id", "length", "loss_tokens"],
            )

    counted = turns.select("conv_id", "role", "text").mapInArrow(measure, "conv_id long, length long, loss_tokens long")
    return written(counted.groupBy("conv_id").agg(F.sum("length").alias("length"), F.sum("loss_tokens").alias("loss_tokens")))


def sequence_tensors(placed: DataFrame, ids: DataFrame, tokens: int, pad: int) -> DataFrame:
    """Assemble sequences from placed pieces and their ids (doc_id, start, ids): one row per sequence.

    Returns sequence_id, input_ids and segments of `tokens` entries; padding has segment -1. A sequence
    holds at most `tokens` ids, so its group is bounded.
    """
    piece = F.struct("offset", "length", "ids")
    rows = placed.join(ids, ["doc_id", "start"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    flat = F.flatten("pieces.ids")
    numbered = F.flatten(F.transform("pieces", lambda p, i: F.array_repeat(i, p["length"].cast("int"))))
    gap = (F.lit(tokens) - F.size(flat)).cast("int")
    return rows.select(
        "sequence_id",
        F.concat(flat, F.array_repeat(F.lit(pad).cast("long"), gap)).alias("input_ids"),
        F.concat(numbered, F.array_repeat(F.lit(-1), gap)).alias("segments"),
    )
