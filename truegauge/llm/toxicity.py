"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The instance is a word of a labelled sentence, or a run of single letters ("i d i o t").
The kernel counts common subsequences of three letters, gaps allowed, each weighted by
``DECAY`` to the power of the stretch it spans, and is normalised; so an insult with
inserted or gapped characters stays close to the plain one. A document's label holds for
one of its words at least, not for all. So every word of the bounded sample of labelled
documents counts for the label of each document that it occurs in, words of clean ones
weigh more, and a word has to mark several toxic documents before it counts as toxic.

Landmarks are the words most tied to toxic documents and the most common others. Their
kernel matrix maps every word to Nystrom features, on which a linear squared-hinge SVM is
fitted. As a kernel with landmarks is a sum over letter triples, the trained function is
one weight per triple, which tasks look up. A document scores as its highest word does,
turned into a probability by a logistic curve fitted on the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import fold, fresh, stored

DECAY = 0.6
#: Letters a to z and one for all others; a triple of letters is a number.
LETTERS = 27
#: Longer words are read through windows of so many characters, half a window apart.
WINDOW = 24
#: Bounds of the training sample: labelled documents of each class, words, landmarks.
DOCUMENTS, WORDS, LANDMARKS = 4000, 20_000, 256
#: How much more a word of a clean document weighs; the SVM's ridge.
CLEAN_WEIGHT, RIDGE = 4.0, 1e-6
#: Toxic documents that a word has to mark before it counts for them by half: so many,
#: and this share of them.
DOUBT, DOUBT_SHARE = 5, 0.02
#: Words that a worker remembers.
REMEMBERED = 500_000

# Digits and signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
#: Signs that end or begin a word; those that stand for letters are not among them.
SIGNS = "!?.,;:*#%&-_()[]{}\"'|/\\=+<>~^`"
_SINGLES = re.compile(r"(?<!\S)(?:\w\s+){2,}\w(?!\S)")


def plain(word: str) -> str:
    """Lower case, without accents, look-alike signs as letters, no other signs at the ends."""
    word = word.lower().strip(SIGNS)
    if not word.isascii():
        word = "".join([c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)]).lower()
    if not word.isalpha():
        word = word.translate(LOOKALIKES)
        letters = [i for i, c in enumerate(word) if c.isalpha()]
        word = word[letters[0] : letters[-1] + 1] if letters else ""
    return word


def instances(text: str | None) -> set[str]:
    """The distinct words of a whole text, and its runs of single letters."""
    text = text or ""
    found = set(text.split())
    found.update(" ".join(run.split()) for run in _SINGLES.findall(text))
    return found


POWERS = DECAY ** np.arange(WINDOW + 1)


class Triples:
    """Letter triples of a batch of words: rows are (word, triple number, weight)."""

    def __init__(self, words: list[str]) -> None:
        owner: list[int] = []
        plain_ones: dict[int, list[int]] = {}
        places: dict[int, list[list[int]]] = {}
        letters: dict[int, list[list[int]]] = {}
        gapped: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) <= WINDOW and word.isascii() and word.isalpha():
                if len(word) >= 3:
                    plain_ones.setdefault(len(word), []).append(len(owner))
                    owner.append(at)
                continue
            for start in range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2):
                part = word[start : start + WINDOW]
                spots = [i for i, c in enumerate(part) if c.isalpha()]
                if len(spots) >= 3:
                    gapped.setdefault(len(spots), []).append(len(owner))
                    owner.append(at)
                    places.setdefault(len(spots), []).append(spots)
                    letters.setdefault(len(spots), []).append([min(ord(part[i]) - 97, 26) if part[i] >= "a" else 26 for i in spots])
        self.owner = np.array(owner, np.int64)
        self.parts = len(owner)
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, rows in plain_ones.items():
            text = "".join([words[owner[r]] for r in rows]).encode()
            self._block(rows, np.frombuffer(text, np.uint8).reshape(-1, size).astype(np.int32) - 97, np.arange(size)[None, :])
        for size, rows in gapped.items():
            self._block(rows, np.array(letters[size], np.int32), np.array(places[size]))

    def _block(self, rows: list[int], letters: np.ndarray, places: np.ndarray) -> None:
        """Words of equally many letters; ``places`` has a row each, or one for all."""
        first, second, third = _triples(letters.shape[1])
        step = max(1, 1_000_000 // len(first))
        for k in range(0, len(rows), step):
            c, p = letters[k : k + step], places[k : k + step] if len(places) > 1 else places
            code = (c[:, first] * LETTERS + c[:, second]) * LETTERS + c[:, third]
            weight = POWERS[p[:, third] - p[:, first] + 1]
            self.blocks.append((np.array(rows[k : k + step]), code, np.broadcast_to(weight, code.shape)))

    def norms(self) -> np.ndarray:
        """Square root of the kernel of each part with itself."""
        out = np.ones(self.parts)
        for rows, code, weight in self.blocks:
            order = np.argsort(code, axis=1)
            code, flat = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1).ravel()
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            starts = np.nonzero(new.ravel())[0]
            sums = np.add.reduceat(flat, starts)
            out[rows] = np.sqrt(np.bincount(starts // code.shape[1], weights=sums * sums, minlength=len(rows)))
        return out

    def against(self, table: np.ndarray) -> np.ndarray:
        """Sum of weight * table[triple] per part; ``table`` has one column or many."""
        out = np.zeros((self.parts, *table.shape[1:]))
        for rows, code, weight in self.blocks:
            if table.ndim == 1:
                out[rows] = (table[code] * weight).sum(axis=1)
            else:
                for row, c, w in zip(rows.tolist(), code, weight):
                    out[row] = w @ table[c]
        return out


@lru_cache
def _triples(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grid = np.array([(i, j, k) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, size)])
    return grid[:, 0], grid[:, 1], grid[:, 2]


@dataclass
class Model:
    """Weight per letter triple, bias, and slope and offset of the logistic curve."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        """SVM value of each plain word; a word without a triple has the bias alone."""
        triples = Triples(words)
        values = triples.against(self.weight) / triples.norms() + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, triples.owner, values)
        return np.where(np.isinf(out), self.bias, out)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


class Scorer:
    """Margins of whole texts; words met before are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, found = self.known, [instances(t) for t in texts]
        unseen: dict[str, str] = {}
        for words in found:
            for w in words:
                if w not in known and w not in unseen:
                    unseen[w] = plain(w)
        distinct = sorted({p for p in unseen.values() if p not in known})
        known.update(zip(distinct, self.model.margins(distinct).tolist()))
        known.update({w: known[p] for w, p in unseen.items()})
        return np.array([max(map(known.__getitem__, words), default=self.model.bias) for words in found])


def squared_hinge(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias.

    Every row counts as a toxic and as a clean one, with a weight for each.
    """
    x = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float(toxic @ np.maximum(0, 1 - m) ** 2 + clean @ np.maximum(0, 1 + m) ** 2 + w @ penalty @ w)

    for _ in range(50):
        m = x @ w
        pull, push = toxic * (m < 1), clean * (m > -1)
        # One scaled copy of the rows at a time; the driver's memory is small.
        scaled = x * np.sqrt(pull + push)[:, None]
        target = np.linalg.solve(scaled.T @ scaled + penalty, x.T @ (pull - push))
        step, before = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (target - w)) > before:
            step /= 2
        new = w + step * (target - w)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull towards slope 1."""
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * (w - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def association(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """How strongly a word, by its shares of toxic and clean documents, marks toxic ones."""
    return np.log((toxic + 1e-4) / (clean + 1e-4)) * np.sqrt(toxic + clean)


class Landmarks:
    """The Nystrom map of the landmark words."""

    def __init__(self, words: list[str]) -> None:
        triples = Triples(words)
        # A landmark longer than a window is its first part.
        firsts = np.unique(triples.owner, return_index=True)[1]
        column, norms = {p: i for i, p in enumerate(firsts.tolist())}, triples.norms()
        self.table = np.zeros((LETTERS**3, len(firsts)))
        for rows, code, weight in triples.blocks:
            for row, c, w in zip(rows.tolist(), code, weight):
                if row in column:
                    np.add.at(self.table[:, column[row]], c, w / norms[row])
        values, vectors = np.linalg.eigh(self.table.T @ self.table)
        kept = values > 1e-8 * values[-1:]
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])

    def fit(self, words: list[str], toxic: np.ndarray, clean: np.ndarray) -> Model:
        """The SVM on words with their weights as toxic and as clean ones."""
        parts = Triples(words)
        features = (parts.against(self.table) / parts.norms()[:, None]) @ self.whiten
        t, c = toxic[parts.owner], clean[parts.owner]
        whole = max(1e-12, t.sum() + c.sum())
        w = squared_hinge(features, t / whole, c / whole)
        return Model(self.table @ (self.whiten @ w[:-1]), float(w[-1]))


def word_weights(toxic: np.ndarray, clean: np.ndarray, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of words as toxic and clean from their shares of toxic and clean documents.

    A frequent word counts more, but by the root of its frequency, and for either side
    by its share there, on the toxic side twice over, so that the few sure words outweigh
    the many doubtful ones; both sides weigh the same in all. ``doubt`` is the share of toxic
    documents that a word has to mark before it counts for them by half: most words that
    only toxic documents hold are rare ones that got there by chance.
    """
    often, share = np.sqrt(toxic + clean), toxic / (toxic + CLEAN_WEIGHT * clean + doubt)
    marked, other = often * share**2, often * (1 - share)
    return marked / max(1e-12, marked.sum()), other / max(1e-12, other.sum())


def choose_landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, count: int = LANDMARKS) -> Landmarks:
    """Half the words most tied to toxic documents, half the most common others."""
    marked = np.argsort(-association(toxic, clean), kind="stable")[: count // 2].tolist()
    taken = set(marked)
    common = [i for i in np.argsort(-(toxic + clean), kind="stable").tolist() if i not in taken]
    return Landmarks([words[i] for i in marked + common[: count - len(marked)]])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = DOCUMENTS) -> Model | None:
    """The model from at most ``documents`` labelled documents of each class.

    A document is toxic if any of its label rows says so; null labels say nothing. The
    sample is drawn by hash of the key, so it does not depend on the order of rows. None
    if either class has no labelled document.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).alias("toxic"))
    marked = marked.join(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key")), "key", "left_semi")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(documents) for c in (True, False)]
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("toxic", T.BooleanType())])
    sample = spark.createDataFrame([tuple(r) for d in drawn for r in d.select(F.col("key").cast(kind["key"].dataType), "toxic").collect()], kind)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").select("key", "toxic", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, value in zip(batch.column(1), batch.column(2)):
                found = sorted({plain(w) for w in instances(value.as_py())})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic.as_py()] * len(found), pa.bool_())], ["word", "toxic"])

    counts = texts.mapInArrow(words, "word string, toxic boolean").where(F.length("word") >= 3)
    counts = counts.groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.sum((~F.col("toxic")).cast("int")).alias("c"))
    n_toxic, n_clean = (min(documents, sizes[c]) for c in (True, False))
    tied = F.log((F.col("t") / n_toxic + 1e-4) / (F.col("c") / n_clean + 1e-4)) * F.sqrt(F.col("t") / n_toxic + F.col("c") / n_clean)
    orders = ((F.desc(tied), WORDS // 2), (F.desc(F.col("t") + F.col("c")), WORDS // 4), (F.xxhash64("word"), WORDS // 4))
    counts = stored(counts, "word-counts")
    rows = sorted({tuple(r) for order, most in orders for r in counts.orderBy(order, "word").limit(most).collect()})
    names = [r[0] for r in rows]
    toxic, clean = np.array([r[1] for r in rows]) / n_toxic, np.array([r[2] for r in rows]) / n_clean
    if not rows:
        return None
    landmarks = choose_landmarks(names, toxic, clean)
    model = landmarks.fit(names, *word_weights(toxic, clean, max(DOUBT / n_toxic, DOUBT_SHARE)))
    prior = {True: sizes[True] / n_toxic / sum(sizes.values()), False: sizes[False] / n_clean / sum(sizes.values())}
    found = with_margin(texts.select("toxic", "text"), model, "text", "margin").select("toxic", "margin").toPandas()
    y = found["toxic"].to_numpy(bool)
    weight = np.where(y, prior[True], prior[False]) * len(y)
    model.slope, model.offset = logistic(found["margin"].to_numpy(float), y.astype(float), weight)
    return model


def with_margin(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``docs`` with the SVM value of its highest word; other columns stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            parts = [scorer.margins(texts.slice(i, 128).to_pylist()) for i in range(0, len(texts), 128)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn(name, margin(F.col(text)))


def with_score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; 0 for all without a model.

    A null text is an empty one; an empty text has the model's bias alone.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    margin = fresh(docs, f"_{name}")
    curve = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col(margin) + F.lit(model.offset))))
    return with_margin(docs, model, text, margin).withColumn(name, curve).drop(margin)


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The label rows outside the held-out fold."""
    return labels.where(fold(key) != 0)


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at or above ``threshold``; all columns as they are."""
    score = fresh(docs, "_score")
    model = train(docs, learnable(labels, key), key, text)
    return with_score(docs, model, text, score).where(F.col(score) < threshold).select(docs.columns)
