"""Token counts by byte-pair merging with a heap over a linked list.

The symbols of a word are a doubly linked list.  A heap holds the adjacent
pairs that can be merged, lowest rank first, leftmost first among equals.
The top pair is merged if both its symbols still stand, and the new
neighbours enter the heap.  The count is the number of initial symbols less
the number of merges; ids are never put together.  A word of n bytes costs
n log n, however long it is.

Counting needs no shuffle: it is a pass over the texts, with a bounded
memory of words met before.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special
strings inside a text count as one token each, as the tokenizer's default
is; repeated rows are counted each; an empty table gives an empty result;
other columns are carried unread.
"""

from __future__ import annotations

import re
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.vocabulary import BYTE_LEVEL_WORDS, WordCache, byte_letters, plain_specials, read_json

LIMIT = 1024


class MergeCounter:
    """merges: pairs of symbols in rank order, each symbol written in byte letters."""

    def __init__(self, merges: list):
        letters = byte_letters()
        numbers = {letter: b for b, letter in letters.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = numbers.setdefault(a + b, len(numbers))
            self.pairs.setdefault((numbers[a], numbers[b]), (rank, new))

    def count(self, word: str) -> int:
        symbols = list(word.encode())
        n = len(symbols)
        find = self.pairs.get
        heap = []
        for i in range(n - 1):
            pair = find((symbols[i], symbols[i + 1]))
            if pair:
                heap.append((pair[0], i, symbols[i], symbols[i + 1], pair[1]))
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            # a symbol that was merged away is -1
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            merges += 1
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = find((new, symbols[k]))
                if pair:
                    heappush(heap, (pair[0], i, new, symbols[k], pair[1]))
            h = before[i]
            if h >= 0:
                pair = find((symbols[h], new))
                if pair:
                    heappush(heap, (pair[0], h, symbols[h], new, pair[1]))
        return n - merges


def counter(spec: dict):
    """text -> number of tokens, by the tokenizer's json."""
    import regex

    pre, model = spec["pre_tokenizer"], spec["model"]
    plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    if not plain or spec["normalizer"] or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE")
    cache = WordCache(MergeCounter(model["merges"]).count)
    find = regex.compile(BYTE_LEVEL_WORDS).findall
    specials = re.compile("|".join(map(re.escape, plain_specials(spec))) or r"(?!)")
    size = cache.__getitem__

    def count(text: str) -> int:
        parts = specials.split(text)
        return len(parts) - 1 + sum(sum(map(size, find(part))) for part in parts)

    return count


def _counted(batches, spec: dict):
    count = counter(spec)
    for batch in batches:
        found = [count(t or "") for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit, by the byte-level BPE tokenizer in the json file at `path`."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    counted = docs.mapInArrow(partial(_counted, spec=read_json(path)), schema)
    return counted.withColumns({
        "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "over_limit": F.col("n_tokens") > limit,
    })
