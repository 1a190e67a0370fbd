"""Operator 10: order-preserving packing of documents into token sequences.

Documents are tokenised and end with id ``end_id``.  Their ids, in the order of
the rows of a partition, form a stream that is cut into sequences of at most
``length`` ids, so that each id lies in exactly one piece.  Cuts may fall at the
end of a document (free), after a token that ends a sentence (a small penalty)
or, every ``grid`` ids of a stretch without either, inside a sentence (a larger
penalty).  A sequence is padded to ``length`` unless its size is a power of two.
Dynamic programming over the cut positions minimises padding plus penalties;
``f(j) = min f(i) + length - (p_j - p_i)`` over the window ``p_j - p_i <= length``
is a sliding minimum of ``f(i) + p_i``, kept in a monotone queue, and the sizes
that are powers of two are looked up by position.

There is no shuffle: a task packs its own rows in blocks of about ``block`` ids
and holds one block in memory (one document more, if it is longer).  Sequence
ids carry the partition number, so they are unique over all tasks.

Defined results: a null or empty text is the end id alone; repeated documents
are packed once per row; a text longer than a sequence is cut into several; no
rows give no pieces; other columns are left aside.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import read

LENGTH, BLOCK, GRID = 1024, 1 << 18, 128
SENTENCE_COST, INNER_COST, SEQUENCE_COST = 4, 32, 64
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")

#: the pre-tokenizer of byte-level BPE files (a fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a text with so many characters in a row without a space, or of white space, goes
#: through the tokenizer file's own library, whose time does not grow with their square
RUN = 2048


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1
    characters stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Bytes of each token -> id, if the file is plain byte-level BPE whose merges are
    numbered in their order, so that the ids say which merge comes first; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or spec.get("normalizer") or model.get("dropout")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or model.get("byte_fallback") or model.get("ignore_merges")):
        return None
    byte = {letter: b for b, letter in byte_letters().items()}
    vocabulary, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    plain = {w: k for w, k in vocabulary.items() if w not in special}
    if len(plain) != 256 + len(made) or made != sorted(made) or not all(c in byte for w in plain for c in w):
        return None
    if made and max(vocabulary[letter] for letter in byte) > made[0]:
        return None
    return {bytes(byte[c] for c in w): k for w, k in plain.items()}


def even(text: str) -> bool:
    """Whether no aligned stretch of RUN characters is without a space or all white space."""
    return all(text.find(" ", k, k + RUN) >= 0 and not text[k:k + RUN].isspace()
               for k in range(0, len(text) - RUN + 1, RUN))


class Encoder:
    """Ids of texts by a tokenizer file.

    A plain byte-level BPE file is also a table of ranks, by which another library
    finds the same ids in half the time; all other files, texts with a special
    token's string and texts with very long words go through the file's own library."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        ranks = ranks_of(path)
        self.ranked = None if ranks is None else tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the file's own library."""
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            if self.ranked is None or (self.special is not None and self.special.search(text)) or not even(text):
                out += self._whole([text])
            else:
                out.append(np.array(self.ranked.encode_ordinary(text), dtype="<u4").tobytes())
        return out

    def sentence_ends(self) -> np.ndarray:
        """Which ids end a sentence or a line."""
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, k in vocabulary.items():
            ends[k] = token.rstrip("Ġ")[-1:] in (".", "!", "?", "Ċ")  # U+010A: the byte \n
        return ends


_ENCODERS: dict[str, tuple[Encoder, np.ndarray]] = {}


def encoder(path: str) -> tuple[Encoder, np.ndarray]:
    if path not in _ENCODERS:
        own = Encoder(path)
        _ENCODERS[path] = own, own.sentence_ends()
    return _ENCODERS[path]


def cut_positions(ends: np.ndarray, sentences: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall (0 and the total included) and their costs:
    document ends, sentence ends, and every ``grid`` ids between two of these."""
    total = int(ends[-1])
    cost = np.full(total + 1, -1, dtype=np.int64)
    cost[sentences] = SENTENCE_COST
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    for i in np.flatnonzero(gaps > grid):
        cost[np.arange(at[i] + grid, at[i + 1], grid)] = INNER_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cut positions, from 0 to the total, that minimise padding plus costs."""
    where = {p: i for i, p in enumerate(at.tolist())}
    powers = [1 << k for k in range(5, length.bit_length()) if 1 << k < length]
    positions, costs = at.tolist(), cost.tolist()
    best, came = [0] * len(positions), [0] * len(positions)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p_i, i), values rising
    for j in range(1, len(positions)):
        p = positions[j]
        while positions[queue[0][1]] < p - length:
            queue.popleft()
        value, source = queue[0][0] + length - p, queue[0][1]
        for size in powers:
            i = where.get(p - size)
            if i is not None and best[i] < value:
                value, source = best[i], i
        value += costs[j] + SEQUENCE_COST
        best[j], came[j] = value, source
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [positions[-1]], len(positions) - 1
    while j:
        j = came[j]
        cuts.append(positions[j])
    return cuts[::-1]


def pack_block(doc_ids: list, encoded: list[bytes], ends_sentence: np.ndarray, first_sequence: int,
               length: int = LENGTH, end_id: int = 0) -> pa.RecordBatch:
    """The pieces of some documents packed on their own."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    data = b"".join(x for ids in encoded for x in (ids, tail))
    ids = np.frombuffer(data, dtype="<u4")
    sizes = np.array([len(x) // 4 + 1 for x in encoded], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at, cost = cut_positions(ends, np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1)
    cuts = np.array(best_cuts(at, cost, length), dtype=np.int64)
    first = np.union1d(starts, cuts[:-1])
    size = np.diff(np.append(first, ends[-1]))
    doc = np.searchsorted(starts, first, side="right") - 1
    sequence = np.searchsorted(cuts, first, side="right") - 1
    view = memoryview(data)
    crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), size.tolist())]
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, type=pa.int64()).take(pa.array(doc)), pa.array(first - starts[doc]), pa.array(size),
        pa.array(crc, type=pa.int64()), pa.array(sizes[doc]), pa.array(first_sequence + sequence),
        pa.array(first - cuts[sequence])], schema=PIECES)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents: see the module's docstring and PIECES."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends_sentence = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        names, encoded, held = [], [], 0
        for part in parts:
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for name, ids in zip(some.column(0).to_pylist(), encode.encode(texts)):
                    names.append(name)
                    encoded.append(ids)
                    held += len(ids) // 4 + 1
                    if held >= block:
                        out = pack_block(names, encoded, ends_sentence, sequence, length, end_id)
                        sequence = out.column(5)[-1].as_py() + 1
                        yield out
                        names, encoded, held = [], [], 0
        if names:
            yield pack_block(names, encoded, ends_sentence, sequence, length, end_id)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES_DDL)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
