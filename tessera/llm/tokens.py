"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, text_or_empty

#: Characters of a chunk; texts up to this length are encoded at once.
CHUNK = 1 << 16
#: Characters that neighbouring chunks share at first; doubled until they agree on a boundary.
OVERLAP = 512
#: Texts and characters that go to the tokenizer in one call.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20
LIMIT = 1024


def load(vocabulary: str):
    """A tokenizer from a .json file: a path, or the name of a public vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Tokenizer.from_file(str(vocabulary))


def _starts(tokenizer, text: str, at: int) -> np.ndarray:
    offsets = tokenizer.encode(text, add_special_tokens=False).offsets
    return np.fromiter((a for a, _ in offsets), np.int64, len(offsets)) + at


def _stable(text: str, p: int) -> bool:
    """Whether the words end at p whatever surrounds the chunk.

    No word of byte-level BPE holds a white space after another character, and no special string holds a
    white space. So a space or line break after a character that is neither begins a word in every chunk
    that holds both; and what begins there depends only on what follows.
    """
    return text[p] in " \n\t\r" and not text[p - 1].isspace()


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, as many as the tokenizer gives for the whole.

    Chunks are spliced where both have a token boundary that is proven stable. While they have none in
    common, the overlap doubles; if it reaches back to the last splice, the left chunk itself grows.
    """
    total, at, end = 0, 0, min(len(text), chunk)
    left = _starts(tokenizer, text[:end], 0)
    while end < len(text):
        lap, splice = overlap, None
        while splice is None:
            begin = max(at, end - lap)
            stop = min(len(text), end + chunk)
            right = _starts(tokenizer, text[begin:stop], begin)
            common = np.intersect1d(left[(left > begin) & (left < end)], right[right < end])
            splice = next((int(p) for p in common[::-1] if _stable(text, int(p))), None)
            if splice is None and begin == at:
                break
            lap *= 2
        if splice is None:  # not even the whole left chunk has a boundary
            end = min(len(text), at + 2 * (end - at))
            left = _starts(tokenizer, text[at:end], at)
            continue
        total += int(np.searchsorted(left, splice))
        left, at, end = right[np.searchsorted(right, splice) :], splice, stop
    return total + len(left)


def count_texts(tokenizer, texts: list[str], chunk: int = CHUNK) -> list[int]:
    counts, waiting, chars = [0] * len(texts), [], 0

    def flush() -> None:
        for i, e in zip(waiting, tokenizer.encode_batch([texts[i] for i in waiting], add_special_tokens=False), strict=True):
            counts[i] = len(e)
        waiting.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk:
            counts[i] = count_long(tokenizer, text, chunk)
            continue
        waiting.append(i)
        chars += len(text)
        if chars > BATCH_CHARS:
            flush()
            chars = 0
    flush()
    return counts


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row a document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Special strings inside texts are one token, as is the library's default; no begin, end or other token
    is added, nothing is cut or padded. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null
    keys stay as they are. Columns other than key and text are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in batches:
            texts = batch.column(2)
            counts: list[int] = []
            for i in range(0, len(texts), BATCH_ROWS):
                counts += count_texts(tokenizer, texts.slice(i, BATCH_ROWS).to_pylist(), chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("t"))
    counted = rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
