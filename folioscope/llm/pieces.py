"""A bounded cache of the ids of text pieces, held in Arrow and numpy buffers.

Pieces are looked up many at once; those that the cache lacks are encoded
together. When the buffers exceed their bytes, the older half gives way, which
never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class PieceCache:
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        """encode: distinct pieces to their ids in a row and how many each has; limit: bytes of pieces, ids and offsets."""
        import pyarrow as pa

        self.encode, self.limit = encode, limit
        self.pieces, self.ids, self.ends = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def places(self, words) -> np.ndarray:
        """Indexes, for ``begins`` and ``ends``, of an Arrow array of pieces; they hold until the next call."""
        import pyarrow as pa
        import pyarrow.compute as pc

        place = pc.index_in(words, value_set=self.pieces)
        if place.null_count:
            if self.pieces.nbytes + self.ids.nbytes + self.ends.nbytes > self.limit:
                half = len(self.pieces) // 2
                first = self.ends[half - 1]
                self.pieces, self.ids, self.ends = self.pieces.slice(half), self.ids[first:], self.ends[half:] - first
                place = pc.index_in(words, value_set=self.pieces)
            missing = words.filter(pc.is_null(place)).unique()
            ids, counts = self.encode(missing.to_pylist())
            self.ends = np.concatenate([self.ends, np.cumsum(counts) + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.pieces = pa.concat_arrays([self.pieces, missing])
            place = pc.index_in(words, value_set=self.pieces)
        return place.to_numpy(zero_copy_only=False).astype(np.int64)

    def gather(self, codes: np.ndarray, per_text: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has; ``per_text`` says how many of the places belong to each text."""
        ends, flat = self.ends, self.ids
        if end_id is not None:  # one more piece, after each text's own
            codes = np.insert(codes, np.cumsum(per_text), len(ends))
            ends, flat, per_text = np.append(ends, len(flat) + 1), np.append(flat, np.uint32(end_id)), per_text + 1
        begins = np.append(0, ends[:-1])
        counts = (ends - begins)[codes] if len(codes) else np.empty(0, np.int64)
        stops = np.cumsum(counts)
        where = np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins[codes] - (stops - counts), counts)
        before = np.append(0, stops)[np.append(0, np.cumsum(per_text))]
        return flat[where], np.diff(before)
