"""Token counts of byte-pair vocabularies, without making tokens.

A text is cut at added special strings, then into pre-tokens; each pre-token's bytes form a linked list, and a heap
gives the adjacent pair of the lowest rank to merge, again and again. The count is the initial symbols less the
merges. Counts of distinct pre-tokens are kept in a bounded table per Python worker.

Defined cases: a null or empty text has no bytes and no tokens; long pre-tokens cost n log n; rows are independent, so
repeated ids and ties change nothing; other columns aren't carried; an empty table gives an empty result. A vocabulary that
isn't plain byte-level BPE (another model, splitter or normaliser, merges ignored or dropped, added strings with their own
space rules) is refused. Ids may be of any type.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens kept by a worker, each of at most KEPT_CHARS; the table starts anew when it is full.
KEPT, KEPT_CHARS = 400_000, 40


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_count(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols that are left when no adjacent pair has a rank."""
    last = len(symbols) - 1
    after, before = list(range(1, last + 2)), list(range(-1, last))
    heap = [(r, i) for i in range(last) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j > last or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has changed since
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        k = after[i] = after[j]
        if k <= last:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return last + 1 - merges


def refuse_others(spec: dict) -> None:
    """Raises unless the vocabulary is one that Counter counts as the library does."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    ends = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if model.get("type", "BPE") != "BPE" or any(ends):
        raise ValueError("not a plain BPE model")
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("not the plain byte-level splitter")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added strings have their own space rules")
    if not set(byte_names()) <= set(model["vocab"]):
        raise ValueError("not all bytes are in the vocabulary")


class Counter(dict):
    """Pre-token -> tokens, counted when first asked for."""

    def __init__(self, vocabulary: bytes):
        import regex

        spec = json.loads(vocabulary)
        refuse_others(spec)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.single = [bytes([b]) for b in range(256)]
        self.words = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        data = word.encode()
        n = merge_count([self.single[b] for b in data], self.ranks) if len(data) > 1 else 1
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n

    def tokens(self, text: str) -> int:
        get = self.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(get, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.words(p))) for p in parts)


_loaded: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). The vocabulary (a tokenizers .json of a byte-level model, a few MB
    whatever the data) is read on the driver and broadcast."""
    vocabulary = Path(vocabulary_path).read_bytes()
    refuse_others(json.loads(vocabulary))
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), hashlib.sha256(vocabulary).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Counter(shared.value)
        tokens = _loaded[key].tokens
        for batch in batches:
            found = [tokens(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = named(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
