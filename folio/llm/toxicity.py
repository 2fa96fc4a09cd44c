"""Operator 9: toxicity by a convolutional text classifier in numpy."""

from __future__ import annotations

import copy
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, maybe_among, remainder, stored, table
from .textbatch import chunks, words

#: Hash buckets of the word embeddings, their length, filter widths and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 8
#: Labelled documents of a shard, about: what one task trains on between two averages. Every labelled document is in a shard.
SHARD_ROWS = 1024
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 800, 32, 0.01
#: Times that the networks of all shards are averaged.
ROUNDS = 2
#: What shards change is added up in whole units of one over this, so that sums do not depend on their order.
UNITS = 1 << 20
#: Fewest calibration documents of each class for a language to get a threshold of its own, and most such languages; the others share one.
LEAST_CALIBRATION, MOST_LANGS = 30, 64
#: Outputs of the network are counted in steps of one over GRID for the thresholds, and beyond FARTHEST as FARTHEST.
GRID, FARTHEST = 1024, 64
#: Fewest training documents with a word for it to be learned.
LEAST_SEEN = 5
PREFIXES = (4, 5)
PAD = 0  # bucket of the words around a text
_TRIM = ".,;:!?\"'()[]{}<>|#*$%&-_"


class Heads(dict):
    """First letters of words -> bucket."""

    def __missing__(self, head: str) -> int:
        b = self[head] = 1 + xxhash.xxh64_intdigest(f"{len(head)}:{head}") % (BUCKETS - 1)
        return b


class Buckets(dict):
    """Word -> row of three embedding buckets: the word, lower-cased and without punctuation around it, and its first PREFIXES letters,
    so that an inflected form never seen is still near its stem. Bucket 0 is padding: no such prefix, or no word."""

    def __init__(self):
        super().__init__()
        self.heads, self.rows = Heads(), array("i")

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        w = word.decode("utf-8", "replace").lower().strip(_TRIM)
        self.rows.append(1 + xxhash.xxh64_intdigest(w) % (BUCKETS - 1) if w else PAD)
        self.rows.extend([self.heads[w[:k]] if len(w) > k else PAD for k in PREFIXES])
        return at

    def places(self, text: str | None) -> np.ndarray:
        """The row of every word of a text."""
        ws = words(text)
        return np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.int32).reshape(-1, 1 + len(PREFIXES))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Buckets of all words of each text. Words seen lately are remembered."""
        if len(self) >= 200_000:
            self.clear()
            self.heads, self.rows = Heads(), array("i")
        places = [self.places(t) for t in texts]
        rows = np.frombuffer(self.rows, np.int32).reshape(-1, 1 + len(PREFIXES))
        return [rows[i] for i in places]


class ToxicCnn:
    """Embedding -> filters over 1, 2 and 3 words -> largest ReLU response over the text -> logistic output.

    The first embedding dimension starts as the smoothed log-odds of a word among the training labels, so that the maxima point at
    telling words from the first step on. Buckets of fewer than LEAST_SEEN training documents stay 0, as unseen words are, so
    that nothing is learned from words that occur by chance. The rest is then trained by Adam on the logistic loss.
    """

    def __init__(self, log_odds: np.ndarray, known: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.emb[:, 0] = log_odds
        self.known = known
        self.emb[~known] = 0
        self.filters = [rng.normal(0, 0.15, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for f in self.filters:
            f[:, 0, : FILTERS // 2] += 1.0
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] += 0.2
        self.shift = np.zeros(1, np.float32)

    def pooled(self, texts: list[np.ndarray], spots: bool = False):
        """Largest responses (texts, filters), and where they lie in the joined words if spots. Every word of every text is in."""
        pad = np.full((max(WIDTHS) - 1, 1 + len(PREFIXES)), PAD, np.int32)
        parts = [np.concatenate([pad, t, pad]) for t in texts]
        ids = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        e = self.emb[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            e += self.emb[ids[:, j]]
        top, where = [], []
        for f, b in zip(self.filters, self.bias, strict=True):
            k = len(f)
            h = e[: len(e) - k + 1] @ f[0]
            for o in range(1, k):
                h += e[o : len(e) - k + 1 + o] @ f[o]
            if spots:
                at = np.stack([s + h[s : t - k + 1].argmax(axis=0) for s, t in zip(starts, ends, strict=True)])
                where.append(at)
                m = np.take_along_axis(h, at, axis=0)
            else:
                edges = np.stack([starts, ends - k + 1], axis=1).reshape(-1)
                m = np.maximum.reduceat(np.concatenate([h, np.zeros((1, h.shape[1]), h.dtype)]), edges)[::2]
            top.append(m + b)
        return np.concatenate(top, axis=1), ids, where

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.shift]

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(texts)[0], 0) @ self.out + self.shift[0]

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 13, of: tuple[int, int] | None = None) -> None:
        """Both classes weigh the same in the loss. `of`: clean and toxic documents of all shards, where this is one of them; alone, at least LEAST_STEPS batches are taken."""
        clean, toxic = of or (len(y) - y.sum(), y.sum())
        weight = np.where(y == 1, (clean + toxic) / (2 * max(1, toxic)), (clean + toxic) / (2 * max(1, clean)))
        if not of:
            epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(y))))
        rng = np.random.default_rng(seed)
        dense = self.dense()
        m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        e2 = np.zeros(BUCKETS, np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                top, ids, where = self.pooled([texts[i] for i in pick], spots=True)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.shift[0], -30, 30)))
                g = (weight[pick] * (p - y[pick]) / len(pick)).astype(np.float32)
                back = (g[:, None] * self.out[None, :]) * (top > 0)
                grads, biases, touched, moves = [], [], [], []
                for j, (f, at) in enumerate(zip(self.filters, where, strict=True)):
                    b = back[:, j * FILTERS : (j + 1) * FILTERS]
                    gf = np.zeros_like(f)
                    for o in range(len(f)):
                        at_word = ids[at + o]  # (texts, filters, buckets)
                        gf[o] = np.einsum("tf,tfd->df", b, self.emb[at_word].sum(axis=2))
                        touched.append(at_word.reshape(-1))
                        moves.append(np.repeat((b[:, :, None] * f[o].T[None]).reshape(-1, DIM), ids.shape[1], axis=0))
                    grads.append(gf)
                    biases.append(b.sum(axis=0))
                grads += [*biases, act.T @ g, np.array([g.sum()], np.float32)]
                step += 1
                for k, (param, grad) in enumerate(zip(dense, grads, strict=True)):
                    m1[k] = 0.9 * m1[k] + 0.1 * grad
                    m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                    param -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                move = np.zeros((len(rows), DIM), np.float32)
                np.add.at(move, inverse, np.concatenate(moves))
                move[~self.known[rows]] = 0
                e2[rows] += (move * move).mean(axis=1)
                self.emb[rows] -= 0.05 * move / (np.sqrt(e2[rows])[:, None] + 1e-6)

    def state(self) -> np.ndarray:
        """All parameters in rows of DIM: the embeddings, then the dense ones behind each other."""
        flat = np.concatenate([p.reshape(-1) for p in self.dense()])
        return np.concatenate([self.emb, np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)])

    def add(self, rows: np.ndarray, change: np.ndarray) -> None:
        """Changes to rows of the state."""
        all_rows = self.state()
        all_rows[rows] += change.astype(np.float32)
        self.emb, flat = all_rows[:BUCKETS], all_rows[BUCKETS:].reshape(-1)
        for p in self.dense():
            p[...], flat = flat[: p.size].reshape(p.shape), flat[p.size :]


class WordLanguages:
    """Naive Bayes over the words' buckets: of the words in a bucket and a language, n. A language is a number below `many`."""

    def __init__(self, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, many: int):
        self.many = max(1, many)
        order = np.lexsort((lang, bucket))
        bucket, lang, n = bucket[order], lang[order], n[order]
        self.lang = lang.astype(np.int32)
        self.start = np.searchsorted(bucket, np.arange(BUCKETS + 1)).astype(np.int32)
        self.gain = np.log(1 + 10 * n).astype(np.float32)  # of n + 0.1 over 0.1
        self.base = -np.log(np.bincount(lang, n, self.many) + 0.1 * BUCKETS)

    def guess(self, texts: list[np.ndarray]) -> np.ndarray:
        """The likeliest language of each text; of equal ones the first."""
        if not texts:
            return np.zeros(0, int)
        n = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        size = self.start[ids + 1] - self.start[ids]
        upto = np.cumsum(size)
        at = np.repeat(self.start[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        of = np.repeat(np.repeat(np.arange(len(texts)), n), size)
        gains = np.bincount(of * self.many + self.lang[at], self.gain[at], len(texts) * self.many).reshape(len(texts), self.many)
        return (gains + n[:, None] * self.base).argmax(axis=1)


class ToxicModel:
    """The network, the words' languages, and a threshold for each language; scores are shifted so that a language's threshold is 0.5."""

    def __init__(self, net: ToxicCnn, languages: WordLanguages):
        self.net, self.words = net, languages
        self.thresholds = np.zeros(languages.many, np.float32)

    def judge(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of the network and languages of texts given by the buckets of their words."""
        return self.net.logits(texts), self.words.guess([i[:, 0] for i in texts])

    def calibrate(self, lang: np.ndarray, step: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """Thresholds from the numbers of toxic and clean documents of each language and step of the output; one for all languages with too few."""
        every, at = np.unique(step, return_inverse=True)
        common = self.best(every, np.bincount(at, toxic, len(every)), np.bincount(at, clean, len(every)))
        for k in range(self.words.many):
            of = lang == k
            enough = min(toxic[of].sum(), clean[of].sum()) >= LEAST_CALIBRATION
            self.thresholds[k] = self.best(step[of], toxic[of], clean[of]) if enough else common

    @staticmethod
    def best(step: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
        """The threshold with the best F1, halfway between the neighbouring distinct steps; 0 without documents of both classes."""
        if not toxic.sum() or not clean.sum():
            return 0.0
        order = np.argsort(-step)
        step, hit = step[order], np.cumsum(toxic[order])
        k = int((2 * hit / (hit + np.cumsum(clean[order]) + hit[-1])).argmax())
        return float(step[k] if k + 1 == len(step) else (step[k] + step[k + 1] + 1) / 2) / GRID

    def scores(self, texts: list[str | None], buckets: Buckets) -> np.ndarray:
        ids = buckets.of(texts)
        z, lang = self.judge(ids)
        p = 1 / (1 + np.exp(-np.clip(z - self.thresholds[lang], -30, 30)))
        return np.where([len(i) > 0 for i in ids], p, 0.0)


def shards(docs: DataFrame, given: DataFrame) -> DataFrame | None:
    """All labelled documents, about SHARD_ROWS in a row, stored: the distinct words' buckets and each word's place among them, and of each document the number of words, y, lang, and
    whether it is held back for the thresholds. given: one row an id. None without any document. Texts are shuffled once (twice if ids repeat), those without a label hardly at all."""
    seen = maybe_among(docs.select("doc_id", "lang", "text").where("text IS NOT NULL"), given.select("doc_id"), given.count())
    ids, rows = seen.groupBy("doc_id").count().join(given.hint("merge"), "doc_id").agg(F.count("*"), F.sum("count")).first()
    if not ids:
        return None
    if rows > ids:
        seen = seen.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("row")).select("doc_id", "row.*")
    shard = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id").cast("string")), F.lit(-(-ids // SHARD_ROWS))).cast("int").alias("shard")
    held_back = (F.crc32(F.concat(F.lit("cal"), F.col("doc_id").cast("string"))) % 5 == 0).alias("cal")

    def packed(texts: pa.Table, labels: pa.Table) -> pa.Table:
        y = dict(zip(labels["doc_id"].to_pylist(), labels["y"].to_pylist(), strict=True))
        rows = sorted((r, i) for i, r in enumerate(texts["doc_id"].to_pylist()) if r in y)
        order, buckets = [i for _, i in rows], Buckets()
        places = [buckets.places(texts["text"][i].as_py()) for i in order]
        cells = [[buckets.table().tobytes()], [b"".join(x.tobytes() for x in places)], [[len(x) for x in places]], [[y[r] for r, _ in rows]], [[texts["lang"][i].as_py() for i in order]], [[texts["cal"][i].as_py() for i in order]]]
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_())]
        return pa.table([pa.array(c if order else [], k) for c, k in zip(cells, kinds, strict=True)], names=["words", "places", "n", "y", "lang", "cal"])

    both = seen.select(shard, "doc_id", "lang", "text", held_back).groupBy("shard").cogroup(given.select(shard, "doc_id", "y").groupBy("shard"))
    return stored(both.applyInArrow(packed, "words binary, places binary, n array<int>, y array<int>, lang array<string>, cal array<boolean>"), "toxic-shards")


def unpacked(batches):
    """Of each shard: buckets of the words of each text, y, lang and cal."""
    for b in batches:
        for r in b.to_pylist():
            rows = np.frombuffer(r["words"], np.int32).reshape(-1, 1 + len(PREFIXES))
            places = np.split(np.frombuffer(r["places"], np.int32), np.cumsum(r["n"])[:-1])
            yield [rows[x] for x in places], np.array(r["y"]), r["lang"], np.array(r["cal"])


def tally(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their counts."""
    some, at = np.unique(keys, return_inverse=True)
    return [some, *(np.bincount(at, c, len(some)).astype(np.int64) for c in counts)]


def word_counts(examples: DataFrame, langs: list[str]) -> DataFrame:
    """(bucket, lang, words, clean, toxic) over all documents to fit: words of the bucket, and documents with it by any of their words' buckets. lang: the place in langs, the one behind for others, -1 for null."""

    def counted(batches):
        place, parts = {x: k for k, x in enumerate(langs)}, []
        for ids, y, lang, cal in unpacked(batches):
            for i in np.flatnonzero(~cal):
                k = -1 if lang[i] is None else place.get(lang[i], len(langs))
                said, held = np.unique(ids[i][:, 0], return_counts=True), np.unique(ids[i])
                at = (k + 1) * BUCKETS + np.concatenate([said[0], held])
                one = np.arange(len(at)) >= len(said[0])
                parts.append((at, np.concatenate([said[1], np.zeros(len(held), int)]), one & (y[i] != 1), one & (y[i] == 1)))
            parts = [tuple(tally(*map(np.concatenate, zip(*parts, strict=True))))] if parts else []
        for key, *sums in parts:
            yield pa.RecordBatch.from_arrays([pa.array((key % BUCKETS).astype(np.int32)), pa.array((key // BUCKETS - 1).astype(np.int32)), *map(pa.array, sums)], names=["bucket", "lang", "words", "clean", "toxic"])

    rows = in_arrow(examples, counted, "bucket int, lang int, words long, clean long, toxic long")
    return rows.groupBy("bucket", "lang").agg(*(F.sum(c).alias(c) for c in ("words", "clean", "toxic")))


def train_round(examples: DataFrame, net: ToxicCnn, epochs: int, seed: int, of: tuple[int, int]) -> None:
    """Every shard trains a copy of the network; of what they change, the mean over the shards that change it is taken."""
    shared = examples.sparkSession.sparkContext.broadcast(net)

    def changes(batches):
        before = shared.value.state()
        total, n = np.zeros(before.shape, np.int64), np.zeros(len(before), np.int64)
        for ids, y, _, cal in unpacked(batches):
            fit = np.flatnonzero(~cal)
            local = copy.deepcopy(shared.value)
            local.train([ids[i] for i in fit], (y[fit] == 1).astype(int), epochs, seed, of)
            change = np.rint((local.state().astype(float) - before) * UNITS).astype(np.int64)
            total += change
            n += (change != 0).any(axis=1)
        rows = np.flatnonzero(n)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(n[rows]), *(pa.array(total[rows, j]) for j in range(DIM))], names=["row", "n", *(f"d{j}" for j in range(DIM))])

    sums = ["n", *(f"d{j}" for j in range(DIM))]
    moved = in_arrow(examples, changes, ", ".join(["row int", *(f"{c} long" for c in sums)])).groupBy("row").agg(*(F.sum(c).alias(c) for c in sums)).toArrow()
    rows, n, *change = (c.to_numpy() for c in moved.columns)
    net.add(rows, np.stack(change, axis=1) / n[:, None] / UNITS)
    shared.destroy()


def calibration(examples: DataFrame, model: ToxicModel) -> DataFrame:
    """(lang, step, toxic, clean): documents held back, by the guessed language and the network's output."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        for ids, y, _, cal in unpacked(batches):
            for held in np.array_split(np.flatnonzero(cal), 1 + cal.sum() // 64):
                if len(held):
                    z, lang = shared.value.judge([ids[i] for i in held])
                    step = np.floor(np.clip(z, -FARTHEST, FARTHEST) * GRID).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(step), pa.array((y[held] == 1).astype(np.int64)), pa.array((y[held] != 1).astype(np.int64))], names=["lang", "step", "toxic", "clean"])

    return in_arrow(examples, judged, "lang int, step long, toxic long, clean long").groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> ToxicModel | None:
    """A model from all labelled documents, whole. A fifth, by id hash, is held back and sets thresholds; all others give the words' log-odds and languages, and train the network: each shard of them
    a copy, which are averaged ROUNDS times. What comes to the driver are sums over all documents, by bucket, parameter or step of the output, so its size is bounded, whatever the number of documents.
    Conflicting labels of an id: the higher one; rows that repeat an id: one of them. Null labels, ids and texts teach nothing, a null lang is of no language.
    None without labels of both classes. Columns of docs and labels besides these do not matter, whatever their names."""
    doc_id = F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id")
    given = labels.where(F.col(label_col).isNotNull()).select(doc_id, F.col(label_col).alias("y")).where("doc_id IS NOT NULL")
    examples = shards(docs, stored(given.groupBy("doc_id").agg(F.when(F.max("y").cast("double") == 1, 1).otherwise(0).alias("y")), "toxic-labels"))
    if examples is None:
        return None
    each = examples.select(F.explode(F.arrays_zip("lang", "y", "cal")).alias("e")).select("e.*").groupBy("lang").agg(*(F.count_if((F.col("y") == y) & (F.col("cal") == bool(cal))).alias(f"{'fit' if not cal else 'cal'}{y}") for y in (0, 1) for cal in (0, 1)))
    each = stored(each, "toxic-languages")
    clean, toxic = each.agg(F.sum("fit0"), F.sum("fit1")).first()
    if not clean or not toxic:
        return None
    many = each.where(F.col("lang").isNotNull() & (F.least("cal0", "cal1") >= LEAST_CALIBRATION))
    langs = sorted(r["lang"] for r in many.orderBy(F.desc(F.least("cal0", "cal1")), "lang").limit(MOST_LANGS).collect())
    counts = stored(word_counts(examples, langs), "toxic-words")
    bucket, *by_class = (c.to_numpy() for c in counts.groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toArrow().columns)
    docs_with = np.zeros((2, BUCKETS))  # documents with the bucket
    docs_with[:, bucket] = by_class
    share = (docs_with + 0.5) / (np.array([[clean], [toxic]]) + 1)
    seen = docs_with.sum(axis=0)
    net = ToxicCnn((np.clip(np.log(share[1] / share[0]), -3, 3) * (seen / (seen + 10))).astype(np.float32), (seen >= LEAST_SEEN) & (np.arange(BUCKETS) != PAD))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (clean + toxic)))
    for k in range(ROUNDS):
        train_round(examples, net, -(-epochs // ROUNDS), 13 + k, (clean, toxic))
    said = counts.where("lang >= 0 AND words > 0").select("bucket", "lang", "words").toArrow()
    model = ToxicModel(net, WordLanguages(*(c.to_numpy() for c in said.columns), len(langs) + 1))
    model.calibrate(*(c.to_numpy() for c in calibration(examples, model).toArrow().columns))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): over 0.5 where the network's output on the whole text is above the threshold of the text's language.

    The language is guessed from the words. Null and wordless texts score 0; without a model all do.
    Repeated rows are scored each, equal texts alike; a score at the threshold is 0.5; languages that fit equally well: the first. An empty table gives no rows, and
    further columns of docs do not matter, whatever their names. Texts of any length go through whole, a few at a time. The model travels once to each executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scored(batches):
        buckets = Buckets()
        for b, texts in chunks(batches, most_bytes=1 << 18):
            p = shared.value.scores(texts, buckets) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return in_arrow(rows, scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = remainder(F.col("doc_id"), 5) != 0
    model = learn_toxicity(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return score_toxicity(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
