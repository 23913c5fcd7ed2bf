"""Token counts by byte-pair merging with a heap and a linked list; no identifier is ever emitted.

count = initial symbols - merges. A symbol that the vocabulary lacks counts as many tokens as it has UTF-8 bytes,
because the model falls back to bytes. The ranks come from a sentencepiece BPE model file whose path is a parameter.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bound_batches

SPACE = "▁"


def merge_count(symbols: str, rank: dict[str, int]) -> int:
    """Merges made when the adjacent pair of lowest rank is merged again and again, the leftmost of equals first.

    A heap entry is the pair's rank and its left position in one integer; a linked list of symbols gives neighbours.
    """
    n = len(symbols)
    sym, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    get, heap = rank.get, []
    for i in range(n - 1):
        if (r := get(symbols[i : i + 2])) is not None:
            heap.append(r << 40 | i)
    heapify(heap)
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFFFF
        left = sym[i]
        if left is None or (j := after[i]) >= n:
            continue
        pair = left + sym[j]
        # Stale: one of the pair's symbols has grown or gone since.
        if get(pair) != entry >> 40:
            continue
        sym[i], sym[j] = pair, None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := get(pair + sym[k])) is not None:
                heappush(heap, r << 40 | i)
        if (h := before[i]) >= 0 and (r := get(sym[h] + pair)) is not None:
            heappush(heap, r << 40 | h)
    return merges


class Memo(dict):
    """A cache that starts anew when it is full, so that its memory is bounded; results never depend on it."""

    def __init__(self, make, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class PieceCounter:
    """Counts tokens as the sentencepiece BPE model at path does (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, pairs, glued = {}, set(), False
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                pieces[piece] = -model.get_score(i)
                pairs.update(zip(piece, piece[1:]))
                glued |= SPACE in piece.lstrip(SPACE)
        if glued:
            raise ValueError("pieces of this model cross word starts")
        self.pairs = pairs
        order = {x: r for r, x in enumerate(sorted(set(pieces.values())))}
        self.rank = {piece: order[x] for piece, x in pieces.items()}
        self.part = Memo(self._part)
        self.word = Memo(self._word)

    def _part(self, part: str) -> int:
        return sum(1 if c in self.rank else len(c.encode()) for c in part) - (merge_count(part, self.rank) if len(part) > 1 else 0)

    def _chunk(self, chunk: str) -> int:
        """No piece holds the two characters around a cut, so no merge crosses it and the parts count apart."""
        total, start, pairs = 0, 0, self.pairs
        for i, pair in enumerate(zip(chunk, chunk[1:]), 1):
            if pair not in pairs:
                total += self.part[chunk[start:i]]
                start = i
        return total + self.part[chunk[start:]]

    def _word(self, word: str) -> int:
        return self._chunk(SPACE + word)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.word.__getitem__, words))
        total, run = 0, ""
        for w in words:
            run += SPACE
            if w:
                total += self._chunk(run + w)
                run = ""
        return total + (self._chunk(run) if run else 0)


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of a whole text (null: 0), without begin, end or added special tokens."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        c = counter(model_path)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) added in place of columns of those names.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay; other columns pass through.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(text, model_path)}).withColumn("over_limit", F.col("n_tokens") > limit)
