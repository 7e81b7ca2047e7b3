"""Packing by power-of-two decomposition.

A document's token ids, closed by one end id, are cut into pieces whose lengths are the
powers of two of the binary form of their number: as many pieces of the largest length
as fit, then one for each remaining bit, longest first. A piece is a whole sequence, so
no sequence crosses documents and none needs padding; sequences of one length form a bucket.

Tokenization is exact for the file's library. Texts whose characters all lie in a range
where the two regular-expression engines agree go through a table from pre-token to ids
(a pre-token's ids don't depend on its neighbours), filled by a second implementation of
the same merges if the file's ids are in merge order, as it takes a third of the time; the
library encodes all other texts whole, and the tests hold every kind of text against it.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import arrow_slices, byte_letters, modest_batches, tokenizer_path, worker_state

#: Pre-token pattern of byte-level BPE, for texts that FAST accepts.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Tab, LF, CR, printable ASCII and the letters of Latin-1, as its bytes; then all Latin letters
#: (no superscripts, fractions or ordinals).
_LATIN_1 = bytes([9, 10, 13, *range(0x20, 0x7F), 0xA1, 0xAB, 0xBB, *range(0xBF, 0x100)])
_FAST = re.compile(r"[\t\n\r\x20-\x7eÀ-ɏß¡¿«»]*")
#: Pre-tokens that a worker remembers at most, half of them new and half from before.
CACHE = 300_000


def _fast(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _LATIN_1)
    except UnicodeEncodeError:
        return _FAST.fullmatch(text) is not None


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # another pattern or normalizer: the library encodes all texts
        self.known = file.get("normalizer") is None and {k: (file.get("pre_tokenizer") or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.special = sorted(x.content for x in self.model.get_added_tokens_decoder().values())
        self.merge = _merger(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token of a fast text."""
        if (ids := self.older.get(piece)) is None:
            found = self.merge(piece) if self.merge else self.model.encode(piece, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self.cache[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.known or not _fast(text) or any(s in text for s in self.special):
            return self._encode(text)
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        pieces = _PIECE.findall(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            get, make = self.cache.get, self._piece
            found = [ids if ids is not None else get(piece) or make(piece) for piece, ids in zip(pieces, found, strict=True)]
        return b"".join(found)


def _merger(path: str):
    """The file's merges over one pre-token, from a faster implementation; None if its ids are not in merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    at = {letter: b for b, letter in enumerate(byte_letters())}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if model.get("end_of_word_suffix") or model.get("ignore_merges") or made != sorted(made) or not all(letter in vocab for letter in at):
        return None
    ranks = {bytes(at[c] for c in token): i for token, i in vocab.items() if all(c in at for c in token)}
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def binary_lengths(n: int, limit: int) -> list[int]:
    """``n`` as a sum of powers of two up to ``limit``, longest first."""
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if n % limit >> b & 1]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", max_length: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: the id column, start, length, ids (binary, ``<u4``), doc_tokens, sequence_id, offset, bucket.

    A null text counts as empty (one piece: the end id). Rows that repeat, also whole
    documents, are packed each by itself. Only the two named columns are read, so other
    columns can have any names. An empty table gives no pieces. ``max_length`` must be a
    power of two. Nothing is shuffled: a piece is a sequence, so numbering needs no
    knowledge of other documents; ``sequence_id`` is unique and grows within an input split.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    modest_batches(docs.sparkSession)
    path, kind = tokenizer_path(tokenizer), docs.schema[id_column].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(ByteBpe, path)
        for part in arrow_slices(batches, "text", 256, 4 << 20):
            rows, start, length, total, ids = [], [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                data = bpe.ids(text or "") + end
                n, at = len(data) // 4, 0
                for size in binary_lengths(n, max_length):
                    rows.append(row), start.append(at), length.append(size), total.append(n), ids.append(data[4 * at : 4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                names=["id", "start", "length", "ids", "doc_tokens"],
            )

    pieces = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("id").alias(id_column), "start", "length", "ids", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").cast("int").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store sequences by length: one folder a bucket, so a batch reader meets equal lengths only."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
