"""Byte-level BPE by DuckDB's recursive queries, and its inverse by ordered aggregation.

A task cuts its texts into words by the vocabulary's pattern and hands each different word
that it has not met to DuckDB, once. A word that is a token is done. Any other starts as a row (word, position,
token) for each byte; each step of the recursion joins neighbours with the merge table, finds a
word's smallest rank and contracts its leftmost pair, until no word has a pair left. If no token that
a merge makes can take part in a merge of a smaller rank, the sequential rule contracts all
other pairs of this rank next, left to right, so the step contracts them at once: a long run takes as many steps as
it has ranks, not as many as it has tokens. Texts are then read off word by word. Decoding joins ids with the
vocabulary and aggregates bytes by position.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from marlpit.llm.common import arrow_slices, modest_batches, tokenizer_path, worker_state

#: Rows and bytes of a slice of texts; rows of a recursion, and ids, that DuckDB gets at a time.
SLICE_ROWS, SLICE_BYTES, STEP_ROWS, IDS = 1024, 2 << 20, 1 << 19, 1 << 18
#: Words that a worker remembers at most, half of them new and half from before.
CACHE = 400_000
#: Words longer than LONG characters are not remembered; words of up to SHORT bytes are contracted pair by pair.
LONG, SHORT = 256, 128
#: White space, printable ASCII and Latin letters, for which Python's expressions and the vocabulary's pattern agree.
_FAST = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ɏß¡¿«»]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

#: A word's tokens at positions from 0, step by step: the leftmost pair of the smallest rank becomes one token. A word's last step holds its ids.
_CONTRACT = """
WITH RECURSIVE state(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM start
  UNION ALL
  (WITH best AS (SELECT a.word, min(m.made * 65536 + a.pos) AS pick FROM state a JOIN state b ON b.word = a.word AND b.pos = a.pos + 1 JOIN merges m ON m.l = a.tok AND m.r = b.tok GROUP BY a.word)
   SELECT s.step + 1, s.word, CASE WHEN s.pos > pick % 65536 THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = pick % 65536 THEN pick // 65536 ELSE s.tok END
   FROM state s JOIN best USING (word) WHERE s.pos != pick % 65536 + 1)
)
SELECT word, pos, tok FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) ORDER BY word, pos"""
#: The same for long words, of which only the present rows are kept, by word and position: a contracted pair's right position gets a
#: null token, and all pairs of the smallest rank that are apart go at once, left to right, unless the token may be contracted alone.
_CONTRACT_RUNS = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM start
  UNION
  (WITH live AS (SELECT word, pos, tok FROM recurring.state WHERE tok IS NOT NULL AND word IN (SELECT word FROM state)),
    pairs AS (SELECT word, pos, row_number() OVER w AS nth, tok, lead(tok) OVER w AS tok2, lead(pos) OVER w AS pos2 FROM live WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (SELECT p.word, p.pos, p.nth, p.pos2, m.made, m.alone, min(m.made) OVER (PARTITION BY p.word) AS best, min(p.nth) OVER (PARTITION BY p.word, m.made) AS leftmost
      FROM pairs p JOIN merges m ON m.l = p.tok AND m.r = p.tok2),
    chosen AS (SELECT word, pos, pos2, made, nth - row_number() OVER (PARTITION BY word ORDER BY nth) AS run, nth FROM ranked WHERE made = best AND (NOT alone OR nth = leftmost)),
    apart AS (SELECT word, pos, pos2, made FROM chosen QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY nth) % 2 = 1)
   SELECT word, pos, made FROM apart UNION ALL SELECT word, pos2, NULL FROM apart)
)
SELECT word, pos, tok FROM state WHERE tok IS NOT NULL ORDER BY word, pos"""




def _database(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    for name, rows in tables.items():
        db.register("given", rows)
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        db.unregister("given")
    return db


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Decoder:
    """A rank file's vocabulary in a DuckDB of its own, in memory."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        self.db = _database(vocabulary=pa.table({"id": list(ranks.values()), "bytes": pa.array(list(ranks), pa.binary())}))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, which lie one after the other in ``ids``."""
        out: list[list[bytes]] = [[] for _ in sizes]
        of, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        for at in range(0, len(ids), IDS):
            own = of[at : at + IDS]
            self.db.register("given", pa.table({"text": own, "pos": np.arange(at, at + len(own)) - first[own], "id": ids[at : at + IDS]}))
            found = self.db.sql("SELECT text, list(v.bytes ORDER BY g.pos) AS bytes FROM given g JOIN vocabulary v ON v.id = g.id GROUP BY text").to_arrow_table().combine_chunks()
            self.db.unregister("given")
            if pc.sum(pc.list_value_length(found["bytes"])).as_py() != len(own):
                raise ValueError("an id is not in the vocabulary")
            # values lie in the aggregate's order, so a text's bytes are one stretch of them
            parts = found["bytes"].chunk(0)
            data, place = parts.values.buffers()[2].to_pybytes(), np.frombuffer(parts.values.buffers()[1], np.int32)
            ends = place[parts.offsets.to_numpy() + parts.values.offset].tolist()
            for text, a, b in zip(found["text"].to_pylist(), ends, ends[1:], strict=False):
                out[text].append(data[a:b])
        return [b"".join(parts) for parts in out]


class Encoder:
    """A rank file's merges in a DuckDB of its own, in memory, and the words met last."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Regex, pre_tokenizers

        self.ranks = _ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        # the one library here whose character classes are of the vocabulary's version of Unicode; only its splitting is used
        self.splitter = pre_tokenizers.Split(Regex(PATTERN), "isolated")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        # a token is contracted alone if it is part of a merge of a smaller rank
        early = {p for a, b, m in zip(left, right, made, strict=True) for p in (a, b) if m < p}
        self.db = _database(merges=pa.table({"l": left, "r": right, "made": made, "alone": [m in early for m in made]}))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def words(self, text: str) -> list[str]:
        if _FAST.fullmatch(text):
            return _WORD.findall(text)
        return [word for word, _ in self.splitter.pre_tokenize_str(text)]

    def contract(self, words: list[bytes], query: str = _CONTRACT) -> list[bytes]:
        """Ids of each word by the recursion, as little-endian unsigned 32-bit numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start", pa.table({"word": np.repeat(np.arange(len(words)), sizes), "pos": pos, "tok": tok}))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        data, ends = found["tok"].to_numpy().astype("<u4").tobytes(), (4 * np.searchsorted(found["word"].to_numpy(), np.arange(len(words) + 1))).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: their own if they are tokens, else by the recursion, shorter words first."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known = list(map(self.ranks.get, raw))
        held = {w: rank.to_bytes(4, "little") for w, rank in zip(words, known, strict=True) if rank is not None}
        rest = np.array([i for i, rank in enumerate(known) if rank is None], np.int64)
        sizes = np.array([len(raw[i]) for i in rest.tolist()], np.int64)
        order = np.argsort(sizes, kind="stable")
        rest, sizes = rest[order], sizes[order]
        # all steps of short words are rows of the recursion, and the present ones of long words
        for some, rows, query in ((sizes <= SHORT, sizes * (sizes + 1) // 2, _CONTRACT), (sizes > SHORT, sizes, _CONTRACT_RUNS)):
            own, upto = rest[some].tolist(), np.cumsum(rows[some])
            at = 0
            while at < len(own):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_ROWS, "right")))
                held.update(zip([words[i] for i in own[at:end]], self.contract([raw[i] for i in own[at:end]], query), strict=True))
                at = end
        return held

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        cut = [self.words(t) for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(set(words).difference(self.cache))
        for word in new.intersection(self.older):
            self.cache[word] = self.older[word]
        held = self._learn(list(new.difference(self.older)))
        long = {w: ids for w, ids in held.items() if len(w) > LONG}
        self.cache.update((w, ids) for w, ids in held.items() if len(w) <= LONG)
        look = {**self.cache, **long}.__getitem__ if long else self.cache.__getitem__
        return [b"".join(map(look, words)) for words in cut]


def encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column`` in the place of it, as ``into``, an array of int.

    Texts are encoded whole, as ordinary text: there are no special tokens. A null or empty text has
    no ids; rows that repeat are encoded each; an empty table gives no rows; other columns stay, but for one that is named
    like ``into``, which is replaced.
    """
    path = tokenizer_path(ranks)
    modest_batches(docs.sparkSession)
    held = _apart(docs, column, {column, into})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(Encoder, path)
        for rows in arrow_slices(batches, "value", SLICE_ROWS, SLICE_BYTES):
            ids = bpe.encode([t or "" for t in rows.column("value").to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))], names=["rest", "value"])

    return held.mapInArrow(run, held.select("rest").schema.add("value", ArrayType(IntegerType()))).select("rest.*", F.col("value").alias(into))


def decode(coded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", column: str = "ids", into: str = "bytes") -> DataFrame:
    """``coded`` with the bytes of ``column``'s ids as ``into``, which need not be valid UTF-8; ``column`` stays.

    Null ids and a null id among others give null, no ids no bytes; an id that the vocabulary lacks ends the job. Repeated
    rows, other columns and empty tables as in ``encode``.
    """
    path = tokenizer_path(ranks)
    modest_batches(coded.sparkSession)
    held = _apart(coded, column, {into}).withColumn("value", F.when(~F.exists("value", F.isnull), F.col("value").cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = worker_state(Decoder, path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                ids = rows.column("value")
                found = back.decode(ids.flatten().to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
                yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.array([x if ok else None for x, ok in zip(found, ids.is_valid().to_pylist(), strict=True)], pa.binary())], names=["rest", "value"])

    return held.mapInArrow(run, held.select("rest").schema.add("value", "binary")).select("rest.*", F.col("value").alias(into))


def _apart(df: DataFrame, column: str, gone: set[str]) -> DataFrame:
    """All columns but ``gone`` as ``rest``, and ``column`` as ``value``, so that no name can clash."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in gone)).alias("rest"), F.col(f"`{column.replace('`', '``')}`").alias("value"))


def digests(coded: DataFrame, id_column: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows; the second digest is that of the bytes decoded again."""
    told = coded.select(id_column, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return decode(told, ranks).select(id_column, "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
