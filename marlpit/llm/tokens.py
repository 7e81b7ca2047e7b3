"""Token counts without token ids.

Documents are cut into blocks. A block writes down each of its distinct pre-tokens once,
with the places of the documents that hold it and how often, and deals them by hash into
parts. The parts of all blocks meet by hash: all that concerns one pre-token lies in one
partition, so its pieces are counted once in the whole job and looked up for every block.
Count times frequency is summed by document there, and a block's sums of all parts are
added up. A frequent pre-token costs one entry a block and two numbers a document.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import arrow_slices, byte_letters, modest_batches, tokenizer_path, worker_state

BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Pre-tokens whose count a task remembers at least, and half of those at most; beyond that one may be counted again.
REMEMBERED = 1_000_000
#: Texts of white space, printable ASCII and Latin letters, for which Python's expressions and the library's agree.
_FAST = re.compile(r"[\t-\r\x20-\x7eÀ-ɏß¡¿«»]*")
#: The vocabulary's pre-token pattern for those texts, after lower-casing.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


# The normalizer and pre-tokenizer of the files that _PIECE stands for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordBpe:
    """Pre-tokens and piece counts of a word-end BPE file: lower case, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        if file["model"].get("type") != "BPE" or not byte_level or steps[0].get("type") != "Split" or steps[0].get("behavior") != "Removed" or not steps[0].get("invert"):
            raise ValueError("the file is no byte-level BPE over the matches of a split pattern, for which pieces can be counted by pre-token")
        #: Whether the file splits as _PIECE does; if not, the library splits all texts.
        self.known = file.get("normalizer") == _NORMALIZER and steps[0].get("pattern") == {"Regex": _SPLIT}
        #: String and whether a match takes the place of ordinary text, longest first.
        special = sorted((x.content for x in self.model.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.byte = byte_letters()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens in normal form, repeats included, in no order; special strings stay whole and start with NUL here."""
        if self.known and "<|" not in text and "İ" not in text and _FAST.fullmatch(text):
            return _PIECE.findall(text.lower())  # such letters are composed already and stay one letter each
        found, parts, at = [], [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts.append(text[at : m.start()])
            found.append("\0" + m[0])
            at = m.end()
        for part in [*parts, text[at:]]:
            normal = self.model.normalizer.normalize_str(part) if self.model.normalizer else part
            found.extend(normal[a:b] for _, (a, b) in self.model.pre_tokenizer.pre_tokenize_str(normal))
        return found

    def count(self, piece: str) -> int:
        """Pieces of one pre-token; its letters are bytes to the model."""
        if piece.startswith("\0") and self.special and self.special.fullmatch(piece, 1):
            return 1
        return len(self.model.model.tokenize("".join(map(self.byte.__getitem__, piece.encode("utf-8", "surrogatepass")))))


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat are counted each by
    itself, null ids too: inside, a row is known by its block and place. Only the two named
    columns are read. An empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    path, kind = tokenizer_path(tokenizer), docs.schema[id_column].dataType.simpleString()
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    whole, of = pa.list_(_arrow_type(docs, id_column)), pa.list_(pa.int64())
    kinds = {"block": pa.int64(), "part": pa.int32(), "pieces": pa.string(), "holders": pa.binary(), "places": pa.binary(), "times": pa.binary(), "ids": whole, "sizes": of}
    met_kinds = {"block": pa.int64(), "places": pa.binary(), "sums": pa.binary(), "ids": whole, "sizes": of}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, block = worker_state(WordBpe, path), TaskContext.get().partitionId() << 32
        for rows in arrow_slices(batches, "text", BLOCK_ROWS, BLOCK_BYTES):
            index: defaultdict[str, int] = defaultdict()
            index.default_factory = index.__len__
            keys, sizes = [], []
            for row, text in enumerate(rows.column("text").to_pylist()):
                text = text or ""
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                keys.append(np.array([index[x] for x in bpe.pieces(text)], np.int64) * BLOCK_ROWS + row)
            yield _batch(kinds, block=[block], part=[parts], ids=[rows.column("id").to_pylist()], sizes=[sizes])
            if index:
                # entries (part, pre-token, place) in order, with how often each occurs
                names = list(index)
                dealt = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % parts for x in names), np.int64, len(names))
                keys, times = np.unique(np.concatenate(keys), return_counts=True)
                piece = keys // BLOCK_ROWS
                order = np.argsort(dealt[piece], kind="stable")
                piece, place, times = piece[order], (keys % BLOCK_ROWS)[order], times[order]
                ends = np.cumsum(np.bincount(dealt[piece], minlength=parts))
                for part in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                    at = slice(int(ends[part - 1]) if part else 0, int(ends[part]))
                    own, holders = np.unique(piece[at], return_counts=True)
                    times_kind = "<u1" if times[at].max() < 256 else "<u4"
                    yield _batch(
                        kinds, block=[block], part=[part], pieces=[" ".join([names[i] for i in own.tolist()])], holders=[holders.astype("<u2").tobytes()],
                        places=[place[at].astype("<u2").tobytes()], times=[times[at].astype(times_kind).tobytes()],
                    )
            block += 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts, older = worker_state(WordBpe, path), {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    yield _batch(met_kinds, block=[row["block"]], ids=[row["ids"]], sizes=[row["sizes"]])
                    continue
                names = row["pieces"].split(" ")
                if len(counts) > REMEMBERED:
                    counts, older = {}, counts
                for name in names:
                    if name not in counts:
                        counts[name] = older[name] if name in older else bpe.count(name)
                place = np.frombuffer(row["places"], "<u2")
                times = np.frombuffer(row["times"], "<u1" if len(row["times"]) == len(place) else "<u4")
                each = np.repeat(np.fromiter(map(counts.__getitem__, names), np.int64, len(names)), np.frombuffer(row["holders"], "<u2")) * times
                total = np.zeros(BLOCK_ROWS, np.int64)
                np.add.at(total, place, each)
                at = np.flatnonzero(total)
                yield _batch(met_kinds, block=[row["block"]], places=[at.astype("<u2").tobytes()], sums=[total[at].astype("<u4").tobytes()])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["ids"].notna()].iloc[0]
        total = np.zeros(len(own["sizes"]), np.int64)
        for places, sums in zip(part["places"], part["sums"], strict=True):
            if places is not None:
                total[np.frombuffer(places, "<u2")] += np.frombuffer(sums, "<u4")
        return pd.DataFrame({"id": own["ids"], "n_bytes": own["sizes"], "n_tokens": total})

    own = f"ids array<{kind}>, sizes array<long>"
    rows = held.mapInArrow(split, f"block long, part int, pieces string, holders binary, places binary, times binary, {own}")
    # entries of one part come one after the other, so what a task remembers is of use however many there are
    met = rows.repartition("part").sortWithinPartitions("part").mapInArrow(weigh, f"block long, places binary, sums binary, {own}")
    out = met.groupBy("block").applyInPandas(add, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _batch(kinds: dict[str, pa.DataType], **values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values.get(k, [None]), kind) for k, kind in kinds.items()], names=list(kinds))


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)
