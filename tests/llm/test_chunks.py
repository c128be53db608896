"""Parts of texts that are worked on at once."""

from __future__ import annotations

import pyarrow as pa

from formweave.llm.bytewords import text_chunks


def test_chunks_are_small_and_whole():
    texts = [chr(97 + i % 26) * 4000 for i in range(600)] + ["x" * 1_500_000, None, "", "end"]
    rows, got = 0, []
    for first, offsets, data in text_chunks(pa.array(texts)):
        assert first == rows and (len(offsets) == 2 or len(data) <= 1 << 19)
        rows += len(offsets) - 1
        got += [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [t or "" for t in texts]
