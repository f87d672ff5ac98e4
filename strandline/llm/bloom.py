"""A Bloom filter built over the cluster, for broadcasts of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

#: Largest filter: 32 MB. One of a table has ten bits a row or more below that.
MOST_BITS = 28


class Bloom:
    """Bloom filter of longs with two places each; at any fill it only lets more through."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data

    @staticmethod
    def places(f: np.ndarray, bits: int) -> np.ndarray:
        f = f.view(np.uint64)
        return np.stack([wordhash.mix(f ^ np.uint64(k)) >> np.uint64(64 - bits) for k in (1, 2)]).astype(np.int64)

    @classmethod
    def of(cls, ids: DataFrame, count: int) -> Bloom:
        """The filter of the longs in column f of ``ids``, of which there are about ``count``."""
        bits = min(MOST_BITS, max(16, (10 * count).bit_length()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = cls.places(batch.column(0).to_numpy(), bits).ravel()
                masks = np.uint64(1) << (at & 63).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(masks.view(np.int64))], names=["word", "mask"])

        words = ids.select("f").mapInArrow(work, "word bigint, mask bigint")
        table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (MOST_BITS - 6) rows
        out = np.zeros(2**bits // 64, np.int64)
        out[table["word"].to_numpy()] = table["mask"].to_numpy()
        return cls(bits, out.tobytes())

    def held(self, f: np.ndarray) -> np.ndarray:
        at, words = self.places(f, self.bits), np.frombuffer(self.data, np.uint64)
        return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=0)
