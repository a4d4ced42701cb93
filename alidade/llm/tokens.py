"""Token counts: Arrow functions that return lengths only.

Texts go through in slices balanced by bytes. A text is cut at ASCII white
space, which every tokenizer here treats as a boundary, so the pieces' counts
add up to the whole text's count exactly. A slice's new pieces are encoded as
one batch and their lengths kept in a bounded table, since words repeat.

Rows: null and empty text have 0 bytes and 0 tokens. A text of any length is
counted whole; repeated rows are counted each; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import long_id, slices, table, utf8_rows

SLICE_BYTES = 1 << 20
BATCH_BYTES = 1 << 18
CACHED = 300_000
CACHED_BYTES = 64
LONG_PIECE = 1 << 14

#: A digit is a token run of its own and no special token holds one, so a
#: piece without white space can be cut behind a digit that ASCII follows.
_BEHIND_DIGIT = re.compile(rb"(?<=[0-9])(?=[\x21-\x7e])")


class LengthCounter:
    """Counts tokens of byte strings with a tokenizer given as its JSON text."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_str(tokenizer_json)
        self._encoder.no_truncation()
        self._encoder.no_padding()
        self._known: dict[bytes, int] = {}

    def _lengths(self, pieces: list[bytes]) -> list[int]:
        out, batch, held = [], [], 0
        for piece in pieces:
            batch.append(piece.decode("utf-8", "replace"))
            held += len(piece)
            if held >= BATCH_BYTES:
                out += map(len, self._encoder.encode_batch(batch, add_special_tokens=False))
                batch, held = [], 0
        if batch:
            out += map(len, self._encoder.encode_batch(batch, add_special_tokens=False))
        return out

    def _long(self, piece: bytes) -> int:
        return sum(self._lengths(_BEHIND_DIGIT.split(piece) if len(piece) > LONG_PIECE else [piece]))

    def count(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        if len(self._known) > CACHED:
            self._known.clear()
        known = self._known
        distinct = set().union(*words) if words else set()
        fresh = [w for w in distinct if w not in known and len(w) <= CACHED_BYTES]
        known.update(zip(fresh, self._lengths(fresh)))
        extra = {w: self._long(w) for w in distinct if len(w) > CACHED_BYTES}
        if not extra:
            return [sum(map(known.__getitem__, ws)) for ws in words]
        return [sum(known[w] if len(w) <= CACHED_BYTES else extra[w] for w in ws) for ws in words]


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: fixed size

    def count(batches):
        counter = LengthCounter(shared.value)
        for batch in batches:
            texts = list(utf8_rows(batch.column(1)))
            sizes = [len(t) for t in texts]
            counts: list[int] = []
            for a, b in slices(sizes, SLICE_BYTES):
                counts += counter.count(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(long_id(docs).alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
