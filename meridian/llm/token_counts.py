"""Operator 9: token counts by byte-pair merging with a heap and a linked list.

The symbols of a pre-token form a linked list; a heap holds the adjacent pairs that the vocabulary merges, by rank and
place. The pair of least rank is popped again and again, unless one of its symbols is gone, and its merge may bring
two new pairs. A count is the number of symbols at first less that of merges; no ids are made.

Null texts count as empty: 0 tokens. A vocabulary's special strings count as one token each where a text has them, as
the tokenizers library does by default. Rows are kept one for one; other columns are not carried. Texts are counted
whole, of any length. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import quoted, small_batches, tidy, whole_text
from meridian.llm.tokens import Segments, mapped, vocabulary

VOCABULARY = "byte_bpe_50k.json"


class Counter:
    """Counts by a byte-level vocabulary in the format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.number = model["vocab"]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((self.number[a], self.number[b]), (rank, self.number[a + b]))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.segments = Segments(self.merged, sum)

    def merged(self, word: str) -> int:
        """The number of symbols that are left of a pre-token."""
        symbols = [self.number[c] for c in mapped(word.encode("utf-8", "surrogatepass"))]
        n = left = len(symbols)
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heappush(heap, (m[0], i, m[1], new, symbols[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heappush(heap, (m[0], h, m[1], symbols[h], new))
        return left

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(self.segments.values(p)) for p in parts)
        return sum(self.segments.values(text))


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every text."""
    path = path or vocabulary(VOCABULARY)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in small_batches(batches):
            texts = b.column("text").to_pylist()
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), sizes, pa.array([c.count(t) for t in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long")
