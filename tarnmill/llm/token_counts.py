"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import bound_batches

#: Bytes of text that one encoding call gets, and beyond which a text is split.
BATCH_BYTES = 256 << 10
PIECE_CHARS = 32 << 10
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single plain space between two characters that aren't white space (and no apostrophe or mark beside it).
_CUT = re.compile(r"(?<=\w) (?=\w)")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(texts -> token counts, whether a cut drops its space) of a vocabulary: *.tiktoken, *.json or *.model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_to_numpy(t, disallowed_special=())) for t in texts], False
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        byte_level = "ByteLevel" in str(tok.pre_tokenizer)
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], not byte_level
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], True


def split_safely(text: str, limit: int, drop_space: bool) -> list[str]:
    """Pieces of at most about `limit` characters whose token counts add up to the text's: cut only at a single
    space between two word characters, where every pre-tokeniser here ends a token. The space begins the next
    piece, or is dropped where the tokeniser puts one before each piece itself. Text without such a place isn't cut."""
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start + 1, start + limit)
        while cut > start and not _CUT.match(text, cut):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            found = _CUT.search(text, start + limit)
            if not found:
                break
            cut = found.start()
        pieces.append(text[start:cut])
        start = cut + drop_space
    pieces.append(text[start:])
    return pieces


def count_batch(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int | None]:
    encode, drop_space = encoder(path)
    counts: list[int | None] = [None if t is None else 0 for t in texts]
    owners: list[int] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(owners, encode(batch)):
            counts[i] += n
        owners.clear()
        batch.clear()
        held = 0

    for i, text in enumerate(texts):
        for piece in split_safely(text, piece_chars, drop_space) if text else ():
            owners.append(i)
            batch.append(piece)
            held += len(piece.encode())
            if held >= batch_bytes:
                flush()
    if batch:
        flush()
    return counts


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. The vocabulary's path must be readable on all executors.

    Null text: null counts; empty text: 0. Repeated rows: a row each. Very long texts are encoded in pieces, with
    the same count. Empty table: empty result. Columns other than the two are not read. No shuffle; only lengths
    leave Python."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_batch(batch.column(1).to_pylist(), path)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"), F.octet_length(F.col(f"`{text_col}`")).cast("long").alias("n_bytes"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long").withColumnRenamed("k", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
