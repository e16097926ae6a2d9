"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

Texts become counts of hashed byte trigrams and terms for repetition, weighted by inverse document frequency and projected on the leading
singular vectors of the labelled texts. A document's score is the mean label of its nearest labelled texts, weighted
by their cosine similarity; the cosines with all labelled texts are computed exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, read, text_or_empty
from tessera.llm.texthash import SLICE_BYTES, _buffers, ngrams, whitespace_words, word_slices

#: Buckets of trigrams, dimensions of the latent space, neighbours that vote.
BUCKETS, DIMENSIONS, NEIGHBOURS = 1 << 13, 48, 15
#: Labelled rows that the classifier is fitted on at most: of each label half of them, of the least hashes of their keys.
FIT_ROWS = 2048
#: Terms for repetition: for each tenth that the share of words equal to the one before, and of repeated word
#: five-grams, reaches, so many terms of this count.
TERMS, TERM_COUNT, SMOOTH = 8, 100, 50
WIDTH = BUCKETS + 2 * 9 * TERMS
#: Documents that are projected and compared at once.
BLOCK = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x09, 0x0E)]] = 0x20
_FOLD[0x30:0x3A] = 0x30


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram; white space is one symbol, digits are one."""
    folded = _FOLD[data].astype(np.uint32)
    code = folded[:-2] | (folded[1:-1] << np.uint32(8)) | (folded[2:] << np.uint32(16))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(BUCKETS)))


def _repetition(words: np.ndarray) -> np.ndarray:
    """The terms for repetition of a text's word hashes."""
    grams = ngrams(words, 5)
    repeats = (int((words[1:] == words[:-1]).sum()), len(grams) - len(np.unique(grams)))
    shares = [r / (len(words) + SMOOTH) for r in repeats]  # a line that comes twice in a few words is no junk
    reached = [share >= tenth / 10 for share in shares for tenth in range(1, 10)]
    return np.repeat(np.array(reached, np.int64) * TERM_COUNT, TERMS)


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of the terms of each text, whole; long texts are read in pieces of bounded size."""
    data, offsets = _buffers(column)
    for row, counts, hashes in word_slices(column, whitespace_words()):
        ends = np.cumsum(counts)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True), row):
            own, out = data[offsets[i] : offsets[i + 1]], np.zeros(WIDTH, np.int64)
            for at in range(0, len(own) - 2, SLICE_BYTES):
                out[:BUCKETS] += np.bincount(_grams(own[at : at + SLICE_BYTES + 2]), minlength=BUCKETS)
            out[BUCKETS:] = _repetition(hashes[end - n : end])
            yield out


class Model:
    """Inverse document frequencies, projection, and the labelled vectors with their labels."""

    def __init__(self, raw: np.ndarray, labels: list[int], share: float | None = None, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, in_place: bool = False):
        """in_place: raw may be overwritten, so that one matrix is held. share: of label 1 among all rows that labels may be learnt from; neighbours of a label that was chosen less often weigh more."""
        self.labels, self.neighbours = np.array(labels, np.float32), neighbours
        own = float(self.labels.mean()) if len(labels) else 0.5
        self.prior = own if share is None else share
        self.weights = np.where(self.labels > 0, self.prior / (own or 1), (1 - self.prior) / ((1 - own) or 1))
        held, weighted = np.zeros(raw.shape[1], np.int64), raw if in_place else np.empty(raw.shape, np.float32)
        for i in range(0, len(raw), BLOCK):  # in blocks, so that no other matrix is held
            held += (raw[i : i + BLOCK] > 0).sum(0)
        self.idf = (np.log((1 + len(raw)) / (1 + held)) + 1).astype(np.float32)
        for i in range(0, len(raw), BLOCK):
            weighted[i : i + BLOCK] = self.weigh(raw[i : i + BLOCK])
        if not len(raw):
            self.basis, self.vectors = np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        _, _, basis = _leading(weighted, min(dimensions, len(raw)))
        self.basis = np.ascontiguousarray(basis.T, np.float32)
        self.vectors = _unit(weighted @ self.basis)

    def weigh(self, raw: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(raw) * self.idf)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        """Weighted mean of the nearest rows' labels; the share of label 1 where none is alike."""
        vectors = _unit(self.weigh(raw) @ self.basis)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(raw), self.prior)
        cosines = vectors @ self.vectors.T
        top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(cosines, top, 1), 0).astype(np.float64) ** 8 * self.weights[top]
        votes, total = (near * self.labels[top]).sum(1), near.sum(1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _leading(matrix: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading singular vectors, by power iterations on a random start of fixed seed."""
    start = np.random.default_rng(7).standard_normal((matrix.shape[1], rank + 8)).astype(np.float32)
    found = matrix @ start
    for _ in range(4):
        found, _ = np.linalg.qr(found)
        found = matrix @ (matrix.T @ found)
    found, _ = np.linalg.qr(found)
    left, values, right = np.linalg.svd(found.T @ matrix, full_matrices=False)
    return found @ left[:, :rank], values[:rank], right[:rank]


def held_out(key: str):
    """Rows that no label is learnt from: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model of labelled documents that are not held out.

    The driver gets the term counts of `rows` whole texts at most, half of each label, chosen by the hash of their
    keys; this bounds the fit alone. Null labels and keys teach nothing; null texts are empty texts. Of rows that repeat
    a key, the highest label and the least text count.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("label")).filter("k IS NOT NULL AND label IN (0, 1)")
    known = known.filter(~held_out("k")).groupBy("k").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("k"))
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    chosen = [known.filter(F.col("label") == v).orderBy("h", "k").limit(rows // 2) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # of `rows` rows at most
    found = docs.select(F.col(key).alias("d"), text_or_empty(text).alias("t")).join(chosen, F.col("d") == F.col("k"))
    found = found.groupBy("k").agg(F.max("label").alias("label"), F.min("t").alias("t"))
    found = found.select(F.col("k").cast("string").alias("k"), F.col("label").cast("int").alias("label"), "t").mapInArrow(_sparse, "k string, label int, at binary, n binary").collect()
    raw = np.zeros((len(found), WIDTH), np.float32)
    found.sort(key=lambda r: r["k"])
    for row, r in zip(raw, found, strict=True):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
    return Model(raw, [r["label"] for r in found], share, in_place=True)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for counts in term_counts(batch.column(2)):
            own = np.flatnonzero(counts)
            at.append(own.astype(np.uint16).tobytes())
            n.append(counts[own].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["k", "label", "at", "n"])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """The documents with one more column: the share of the vote for label 1, from 0 to 1, of the whole text.

    Null and empty texts get the share of label 1 among the labelled rows. Rows are scored one by one, so repeated
    rows get equal scores. A column of that name is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.drop(column)
    schema = base.select("*", F.lit(0.0).alias(column)).schema
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, raw, at = np.empty(batch.num_rows), np.empty((BLOCK, WIDTH), np.float32), 0
            for i, counts in enumerate(term_counts(batch.column(names.index(text)))):
                raw[i - at] = counts
                if i + 1 - at == BLOCK or i + 1 == batch.num_rows:
                    scores[at : i + 1] = own.scores(raw[: i + 1 - at])
                    at = i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], schema.names)

    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns only, whatever their names.

    Null and empty texts have the share of label 1 as their score, and stay or go together, as do repeated rows. Null labels and
    keys teach nothing; without any label all scores are 0.5. An empty table gives no rows.
    """
    (name,) = fresh(docs, "__quality")
    scored = score(docs, fit(docs, labels, key, text), text, name)
    return scored.filter(F.col(name) >= threshold).drop(name)


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
