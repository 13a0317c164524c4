"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from figtrace.llm.chunks import Chunks, Merges
from figtrace.llm.texts import from_texts


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of each text; texts are whole, of any length.

    ``vocabulary`` is the path of a byte-level BPE vocabulary (JSON) that every executor can read. Pre-tokens
    are held as ragged arrays; each round merges the lowest-ranked pair of every one of them at once. The
    string of a special token counts as that token. A null or empty text has no bytes and no tokens. Rows
    are kept as they are, repeated ones too; columns called like the new ones are replaced.
    """

    def make():
        merges = Merges(vocabulary)
        chunks = Chunks(merges.specials)
        count = np.zeros(0, dtype=np.int64)
        of_chunk = np.zeros(0, dtype=np.int64)

        def compute(texts):
            nonlocal count, of_chunk
            anew, numbers, new = chunks.batch(texts)
            if anew:
                count, of_chunk = count[:0], of_chunk[:0]
            if new:
                plain = [b"" if isinstance(p, int) else p.encode("utf-8") for p in new]
                merged = merges.encode(plain)[1]
                merged[[i for i, p in enumerate(new) if isinstance(p, int)]] = 1
                count = np.concatenate([count, merged])
            done, sizes = len(of_chunk), chunks.sizes
            if len(sizes) > done:
                ends = np.concatenate([[0], np.cumsum(count[chunks.parts[int(sizes[:done].sum()) :]])])
                bounds = np.concatenate([[0], np.cumsum(sizes[done:])])
                of_chunk = np.concatenate([of_chunk, ends[bounds[1:]] - ends[bounds[:-1]]])
            return [len(t) if t else 0 for t in texts], [int(of_chunk[n].sum()) for n in numbers]

        return compute

    return from_texts(docs, "n_bytes long, n_tokens long", make, text=text, keep=keep)
