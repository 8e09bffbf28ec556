"""LM scores by deleted interpolation of word bigrams.

The model mixes maximum-likelihood estimates of three orders,

    p(w | v) = a(b) c(v w) / c(v) + m(b) c(w) / N + u(b) / (V + 1),

with weights per bucket b of the context's count c(v). The weights are learned by
expectation-maximisation on held-out counts: a tenth of the training documents is left
out of the counts when their own words are predicted.

How it runs: documents are gathered in chunks of about ``CHUNK`` tokens, whole texts, with
words as numbers. A chunk asks once for each distinct word and word pair it holds, and
says how often it adds to the training count; requests are packed and dealt by hash to
buckets of bounded size, which add up and answer in the order asked. As a frequent word
is one entry per chunk, no key is hot. The answers return to their chunks, which score.
Counts cover all training documents; what is exchanged grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import fold, stored, tasks_for

#: Tokens of a chunk and entries of a bucket.
CHUNK, BUCKET = 1 << 20, 1 << 21
#: Fold that is not learned from; one in so many of the others tunes the weights.
HELD_OUT, TUNE = 1, 10
#: Buckets of context counts by powers of two, probability steps per factor of two, and
#: the number of steps; together they bound the held-out counts that reach the driver.
CONTEXTS, STEPS, LEVELS = 32, 4, 128
ROUNDS = 60


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.zeros(1, values.dtype)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8"), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end, which is the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def pair_hashes(previous: np.ndarray, current: np.ndarray) -> np.ndarray:
    x = previous * np.uint64(0x9E3779B97F4A7C15) + current
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunked(docs: DataFrame, key: str, text: str, chunk: int) -> DataFrame:
    """Rows of (chunk, tune, keys, held, lengths, words, tokens); tuning documents apart."""
    kind = docs.schema[key].dataType
    names = ["tune", "keys", "held", "lengths", "words", "tokens", "entries"]
    kinds = [T.BooleanType(), T.ArrayType(kind), *[T.BinaryType()] * 4, T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def pack(tune: bool, rows: list, held: list[bool], lengths: list[int], number: dict[bytes, int], tokens: list[np.ndarray], key_type) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in number), np.uint64, len(number))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        flat = place[np.concatenate(tokens)]
        columns = [pa.array([tune]), pa.array([rows], pa.list_(key_type)), *[pa.array([b], pa.binary()) for b in (np.array(held, bool).tobytes(), squeeze(np.array(lengths, "<i4")), squeeze_sorted(hashes[order]), squeeze(flat))], pa.array([len(order) + len(flat)])]
        return pa.RecordBatch.from_arrays(columns, names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[bool, list] = {}
        key_type = pa.null()
        for batch in batches:
            key_type = batch.column(0).type
            for k, held, tune, value in zip(*(batch.column(i) for i in range(4))):
                tune = tune.as_py()
                now = open_chunks.setdefault(tune, [[], [], [], {}, [], 0])
                words, number = words_of(value.as_py()), now[3]
                now[4].append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
                now[0].append(k.as_py())
                now[1].append(held.as_py())
                now[2].append(len(words))
                now[5] += len(words)
                if now[5] >= chunk:
                    yield pack(tune, *open_chunks.pop(tune)[:5], key_type)
        for tune, now in open_chunks.items():
            yield pack(tune, *now[:5], key_type)

    held = fold(key) == HELD_OUT
    tune = ~held & (F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % (5 * TUNE) < 5)
    rows = docs.select(F.col(key), held.alias("held"), tune.alias("tune"), F.col(text).alias("text")).mapInArrow(gather, schema)
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Chunk:
    """The arrays of a chunk row; ``pairs`` are its distinct sorted pairs, ``pair_of`` theirs per token."""

    def __init__(self, row: dict) -> None:
        self.words = expand_sorted(row["words"])
        self.tokens = expand(row["tokens"], "<i4")
        self.lengths = expand(row["lengths"], "<i4").astype(np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # The end stands before the first word as well.
        end = np.searchsorted(self.words, np.uint64(xxhash.xxh64_intdigest(b"")))
        self.context = np.concatenate([[0], self.tokens[:-1]])
        self.context[self.starts] = end
        hashes = pair_hashes(self.words[self.context], self.words[self.tokens])
        self.pairs, self.pair_of = np.unique(hashes, return_inverse=True)
        self.train = np.repeat(~self.held, self.lengths)


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    schema = "bucket int, chunk long, tune boolean, pair boolean, hashes binary, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = Chunk(row)
                for pair, hashes, of in ((False, data.words, data.tokens), (True, data.pairs, data.pair_of)):
                    counts = np.bincount(of[data.train], minlength=len(hashes)).astype("<u4")
                    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(hashes)]])
                    out: list[list] = [[], [], []]
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        out[0].append(int(bucket[a]))
                        out[1].append(squeeze_sorted(hashes[a:b]))
                        out[2].append(squeeze(counts[a:b]))
                    n = len(out[0])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([row["chunk"]] * n, pa.int64()), pa.array([row["tune"]] * n), pa.array([pair] * n), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "chunk", "tune", "pair", "hashes", "counts"])

    return chunks.select("chunk", "tune", "held", "lengths", "words", "tokens").mapInArrow(ask, schema)


def _answers(requests: DataFrame) -> DataFrame:
    """Per request the training counts and tuning counts in the order asked.

    A row with a null chunk has the bucket's words, training tokens and tuning tokens.
    """
    names = ["bucket", "chunk", "tune", "pair", "total", "tuned", "v", "n", "t"]

    def add_up(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        out: list[tuple] = []
        for pair in (False, True):
            asked = group.filter(pa.compute.equal(group.column("pair"), pair))
            if not asked.num_rows:
                continue
            hashes = [expand_sorted(x.as_py()) for x in asked.column("hashes")]
            counts = [expand(x.as_py(), "<u4") for x in asked.column("counts")]
            tune = asked.column("tune").to_pylist()
            ends = np.cumsum([len(h) for h in hashes])
            found, of = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(of, weights=np.concatenate(counts), minlength=len(found)).astype("<i8")
            tuned = np.bincount(of, weights=np.concatenate([c if t else np.zeros(len(c)) for c, t in zip(counts, tune)]), minlength=len(found)).astype("<i8")
            for chunk, is_tune, end, h in zip(asked.column("chunk").to_pylist(), tune, ends.tolist(), hashes):
                mine = of[end - len(h) : end]
                # Only a tuning chunk takes its own fold out of the counts.
                out.append((bucket, chunk, is_tune, pair, squeeze(total[mine]), squeeze(tuned[mine]) if is_tune else None, None, None, None))
            if not pair:
                out.append((bucket, None, None, None, None, None, int((total > 0).sum()), int(total.sum()), int(tuned.sum())))
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "bucket int, chunk long, tune boolean, pair boolean, total binary, tuned binary, v long, n long, t long"
    return stored(requests.groupBy("bucket").applyInArrow(add_up, schema), "counts")


def _gathered(answers: pa.Table, pair: bool, column: str) -> np.ndarray:
    mine = answers.filter(pa.compute.equal(answers.column("pair"), pair)).sort_by("bucket")
    return np.concatenate([expand(x.as_py(), "<i8") for x in mine.column(column)])


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its binary logarithm."""
    return np.where(counts > 0, np.minimum(CONTEXTS - 1, np.frexp(np.maximum(counts, 1).astype(float))[1]), 0)


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.floor(-np.log2(p) * STEPS), 0, LEVELS - 2), 0).astype(np.int64)


def _probability(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 0.5 ** ((level - 0.5) / STEPS), 0.0)


def learn_weights(cells: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (bucket, order) by expectation-maximisation on rows (bucket, level 2, level 1, n).

    A bucket without held-out counts has the weights of all buckets together. Weights
    stay above zero where the estimate exists; unseen contexts have no pair estimate.
    """
    parts = np.stack([_probability(cells[:, 1]), _probability(cells[:, 2]), np.full(len(cells), uniform)], axis=1)

    def fit(rows: np.ndarray) -> np.ndarray:
        weight, n = np.array([0.4, 0.5, 0.1]), cells[rows, 3].astype(float)
        for _ in range(ROUNDS):
            mixed = parts[rows] * weight
            shares = mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300)
            weight = (n @ shares) / n.sum()
            weight = np.maximum(weight, 1e-7)
            weight /= weight.sum()
        return weight

    everything = np.ones(len(cells), bool)
    pooled = fit(everything) if len(cells) else np.array([0.4, 0.5, 0.1])
    out = np.tile(pooled, (CONTEXTS, 1))
    for b in np.unique(cells[:, 0]).tolist():
        out[b] = fit(cells[:, 0] == b)
    out[0, 0] = 0.0
    return out / out.sum(axis=1, keepdims=True)


def _held_out_counts(pairs: DataFrame, n: int, t: int) -> DataFrame:
    """Tuning chunks with their answers to counts of (bucket, level 2, level 1)."""

    def count(_, left: pa.Table, answers: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("b", "two", "one", "n")})
        data = Chunk(rows[0])
        word = _gathered(answers, False, "total") - _gathered(answers, False, "tuned")
        pair = _gathered(answers, True, "total") - _gathered(answers, True, "tuned")
        context = word[data.context]
        two = _level(pair[data.pair_of] / np.maximum(context, 1))
        one = _level(word[data.tokens] / max(1, n - t))
        cell = (context_bucket(context) * LEVELS + two) * LEVELS + one
        found, counts = np.unique(cell, return_counts=True)
        return pa.table({"b": found // LEVELS**2, "two": found // LEVELS % LEVELS, "one": found % LEVELS, "n": counts})

    return pairs.applyInArrow(count, "b long, two long, one long, n long").groupBy("b", "two", "one").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(key as text) mod 5 is not 1 (a null key
    counts as remainder 0). A null or empty text is its end alone. Repeated rows count
    and are scored each. Without training documents every word is unknown and both
    scores are 0. An empty table gives an empty table.
    """
    chunks = chunked(docs, key, text, chunk)
    entries = chunks.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    answers = _answers(_requests(chunks, tasks_for(entries, bucket)))
    sums = answers.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "t")]).first()
    v, n, t = (int(x) for x in sums)
    replies = answers.where("chunk is not null").select("chunk", "tune", "pair", "bucket", "total", "tuned")

    tuning = chunks.where("tune").groupBy("chunk").cogroup(replies.where("tune").groupBy("chunk"))
    cells = _held_out_counts(tuning, n, t).toPandas().to_numpy(np.int64).reshape(-1, 4)
    uniform = 1 / (v + 1)
    weights = learn_weights(cells, uniform) if n else np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    kind = docs.schema[key].dataType
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, k) for c, k in zip(names, kinds)]])

    def score(_, left: pa.Table, found: pa.Table) -> pa.Table:
        rows = left.drop_columns(["keys"]).to_pylist()
        data = Chunk(rows[0])
        word, pair = _gathered(found, False, "total"), _gathered(found, True, "total")
        own, context = word[data.tokens], word[data.context]
        weight = weights[context_bucket(context)]
        p = weight[:, 0] * (pair[data.pair_of] / np.maximum(context, 1)) + weight[:, 1] * (own / max(1, n)) + weight[:, 2] * uniform
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))[data.tokens]

        def per_document(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, data.starts)

        columns = [data.held, data.lengths, per_document((own > 0).astype(np.int64)), np.full(len(data.lengths), n), per_document(base), per_document(np.log10(p))]
        keys = left.column("keys").combine_chunks().flatten()
        return pa.Table.from_arrays([keys, *map(pa.array, columns)], names=[key, *names])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, schema)
