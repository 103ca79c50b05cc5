"""Words of a slice as numbers, by an exact dictionary of the slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tradewind.llm.text import Texts, Words


def numbered(t: Texts, w: Words, by: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words of a slice, bytes replaced by the table `by`, and each word's place among them."""
    length = w.end - w.start
    offsets = np.append(0, np.cumsum(length))
    at = np.repeat(w.start - offsets[:-1], length) + np.arange(offsets[-1])
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(by[t.data[at]])]
    )
    coded = column.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64)
