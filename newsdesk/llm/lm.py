"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Vocabulary. Counts of all training tokens are made in Spark and stay there. The model predicts one of ``CLASSES`` classes: the end, the most
frequent words, and ``BUCKETS`` buckets that share out all other words by their first two bytes and their last. Within a
bucket a word has its smoothed share of the bucket's counts, so the model gives every text a probability.

Model. The two classes before a token predict it: with context vectors R, target vectors Q, one diagonal matrix a position (C) and
biases b, a class's score is (C1 * R[h1] + C2 * R[h2]) . Q[w] + b[w]. Training tells the observed class from shared noise drawn from
the unigram distribution, by Adagrad in numpy. It goes once over all training documents, in ``len(ROUNDS)`` growing parts: in each,
replicas that start from the same model learn from about ``TOKENS`` tokens each and are averaged, weighted by tokens. Parts and replicas
are dealt by hashes of the documents and a replica takes its documents in a fixed order, so that the model depends on the documents
alone, not on how the table is stored. Scoring normalises exactly: there are at most (CLASSES + 1)**2 contexts, and batched matrix
products give the logarithm of each one's sum over classes.

Counts that scoring needs: the ``HEAD`` most frequent words are broadcast (a fixed bound); all other words of the texts are joined with the
count table on the word.

Defined results: a null text counts as empty and has its end token alone; a null id is never held out; repeated rows are counted and
scored each; of words with equal counts the first by bytes get a class of their own; without training documents N is 0 and every
text gets what the formulas give for that; a very long text is learnt from and scored whole, in memory of several times its length; an
empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release
from .shared import stored

FOLDS, HELD_OUT = 7, 2
HEAD = 100_000
CLASSES, BUCKETS = 1024, 256
WIDTH, NOISE, BATCH, RATE = 24, 64, 2048, 0.15
#: Shares of the training documents that each round learns from.
ROUNDS = (1, 2, 4, 8)
#: Tokens that a replica learns from in a round, about, and the most replicas (beyond that they learn from more each).
TOKENS, REPLICAS = 2_000_000, 4096
#: Parameters in one row on their way to the average.
BLOCK = 1024
#: No word holds white space, so this can't be a word.
END = b"\n"
#: Distinct words that a counting task holds before it sends them on.
HELD_WORDS = 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[:2] + word[-1:]) % BUCKETS


def _bucket(word: Column) -> Column:
    raw = word.cast("binary")
    return (F.crc32(F.concat(F.substring(raw, 1, 2), F.substring(raw, -1, 1))) % BUCKETS).cast("int")


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, c: how often each token occurs in all documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return made

        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
                if len(counts) > HELD_WORDS:
                    yield out()
            counts[END] += b.num_rows
        if counts:
            yield out()

    return docs.select("text").mapInArrow(each, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """index: place of each head word; cls and count by place; inside: log10 of each bucket's total, by class (0 for single words)."""

    index: dict[bytes, int]
    cls: np.ndarray
    count: np.ndarray
    tokens: int
    types: int
    inside: np.ndarray
    unigram: np.ndarray

    def places(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def classes(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        out = self.cls[places]
        for k in np.flatnonzero(places < 0).tolist():
            out[k] = CLASSES - BUCKETS + bucket_of(words[k])
        return out


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above a count that at most ``most`` words reach, most frequent first.

    The count is found in a histogram of its logarithm (some thousand rows), so that no task sends its own list to the driver.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    cut, size = 1 << 30, 0
    for part, n in sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
        size += n
        if size > most:
            break
        cut = part
    found = [(r["word"].encode(), r["c"]) for r in counts.where(step >= cut).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What reaches the driver: ``HEAD`` words at most, and one row a bucket."""
    single = CLASSES - BUCKETS
    head = most_frequent(counts, HEAD)
    if not any(w == END for w, _ in head):  # every text has one, so its count is always at hand
        head += [(END, r["c"]) for r in counts.where(F.col("word") == END.decode()).collect()]
    places = {w: k for k, (w, _) in enumerate(head)}
    alone = [END, *[w for w, _ in head if w != END][: single - 1]]
    cls_of = {w: k for k, w in enumerate(alone)}
    cls = np.array([cls_of.get(w, single + bucket_of(w)) for w, _ in head] + [0], np.int64)
    count = np.array([c for _, c in head] + [0], np.int64)
    total = counts.groupBy(_bucket(F.col("word")).alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in total:
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    tokens, types = int(n.sum()), int(v.sum())
    for w in alone:
        if w in places:
            n[bucket_of(w)] -= count[places[w]]
            v[bucket_of(w)] -= 1
    inside = np.zeros(CLASSES)
    inside[single:] = np.log10(n + v + 1)
    mass = np.zeros(CLASSES)
    for w, k in cls_of.items():
        mass[k] = count[places[w]] if w in places else 0
    mass[single:] = n
    return Vocabulary(places, cls, count, tokens, types, inside, (mass + 1) / (mass.sum() + CLASSES))


@dataclass
class Model:
    R: np.ndarray
    Q: np.ndarray
    C: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        small = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        return Model(small(CLASSES + 1, WIDTH), small(CLASSES, WIDTH), np.ones((2, WIDTH), np.float32), np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.Q, self.C, self.b)])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        sizes = [(CLASSES + 1, WIDTH), (CLASSES, WIDTH), (2, WIDTH), (CLASSES,)]
        ends = np.cumsum([math.prod(s) for s in sizes])
        return Model(*[x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, ends[:-1]), sizes, strict=True)])

    def context(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.C[0] * self.R[h1] + self.C[1] * self.R[h2]

    def log_sums(self) -> np.ndarray:
        """Natural logarithm of the sum over classes, by h1 * (CLASSES + 1) + h2."""
        out = np.empty((CLASSES + 1, CLASSES + 1), np.float32)
        second = self.C[1] * self.R
        for h in range(CLASSES + 1):
            s = (self.C[0] * self.R[h] + second) @ self.Q.T + self.b
            top = s.max(1)
            out[h] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out.ravel()


def _gathered(index: np.ndarray, grads: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of grads by index."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # 16 bits, which numpy sorts by radix; there are fewer classes
    ranked = index[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((size, grads.shape[1]), np.float32)
    out[ranked[first]] = np.add.reduceat(grads[order], first, axis=0)
    return out


class Trainer:
    """Adagrad on the noise-contrastive loss, starting from a given model."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int) -> None:
        self.m = Model(model.R.copy(), model.Q.copy(), model.C.copy(), model.b.copy())
        self.rng = np.random.default_rng(seed)
        self.noise_log = np.log(NOISE * unigram).astype(np.float32)
        self.cumulated = np.cumsum(unigram)
        self.squares = {k: np.full_like(getattr(self.m, k), 0.1) for k in "RQCb"}

    def _step(self, name: str, grad: np.ndarray) -> None:
        g = self.squares[name]
        g += grad * grad
        param = getattr(self.m, name)
        param += RATE * grad / np.sqrt(g)

    def batch(self, h1: np.ndarray, h2: np.ndarray, target: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), CLASSES - 1)
        r1, r2, q = m.R[h1], m.R[h2], m.Q[target]
        ctx = m.C[0] * r1 + m.C[1] * r2
        s = np.einsum("nd,nd->n", ctx, q) + m.b[target] - self.noise_log[target]
        sn = ctx @ m.Q[noise].T + (m.b[noise] - self.noise_log[noise])
        e = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        en = -1 / (1 + np.exp(-np.clip(sn, -30, 30)))
        to_ctx = e[:, None] * q + en @ m.Q[noise]
        grad_q = _gathered(target, e[:, None] * ctx, CLASSES)
        np.add.at(grad_q, noise, en.T @ ctx)
        grad_b = np.bincount(target, e, CLASSES).astype(np.float32)
        np.add.at(grad_b, noise, en.sum(0))
        grad_r = _gathered(h1, m.C[0] * to_ctx, CLASSES + 1) + _gathered(h2, m.C[1] * to_ctx, CLASSES + 1)
        grad_c = np.stack([(to_ctx * r1).sum(0), (to_ctx * r2).sum(0)])
        n = np.float32(1 / len(target) ** 0.5)
        for name, grad in (("R", grad_r), ("Q", grad_q), ("C", grad_c), ("b", grad_b)):
            self._step(name, grad * n)


def contexts(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h1 (just before), h2 and target of every token of the class sequences; CLASSES stands before the start."""
    begin = np.full(2, CLASSES, np.int64)
    flat = np.concatenate([x for s in seqs for x in (begin, s)])
    keep = np.ones(len(flat), bool)
    starts = np.cumsum([0, *[len(s) + 2 for s in seqs[:-1]]])
    keep[starts] = keep[starts + 1] = False
    at = np.flatnonzero(keep)
    return flat[at - 1], flat[at - 2], flat[at]


def _sequences(vocab: Vocabulary, texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for t in texts:
        words = words_of(t)
        words.append(END)
        places = vocab.places(words)
        yield words, places, vocab.classes(words, places)


def _mixed(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def train(docs: DataFrame, vocab: Vocabulary, model: Model, replicas: int = 1, seed: int = 0) -> Model:
    """One pass over all of docs; the average of replicas that each learn from their share of the documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        own, tokens = None, 0
        held, size = [], 0

        def learn() -> None:
            nonlocal held, size, tokens
            h1, h2, target = contexts(held)
            order = own.rng.permutation(len(target))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                own.batch(h1[part], h2[part], target[part])
            tokens += len(order)
            held, size = [], 0

        for b in batches:
            if b.num_rows and own is None:
                own = Trainer(model, vocab.unigram, 1000 * (seed + 1) + b.column("replica")[0].as_py())
            for _, _, cls in _sequences(vocab, b.column("text").to_pylist()):
                held.append(cls)
                size += len(cls)
                if size >= 1 << 19:
                    learn()
        if held:
            learn()
        if tokens:
            flat = np.append(own.m.flat().astype(float), 1.0) * tokens
            parts = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["block", "x"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("x").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(x)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "x"])

    # one replica a task, its documents in the order of their hashes
    dealt = docs.select(F.pmod(F.shiftright(_mixed(F.col("doc_id"), F.col("text")), 8), F.lit(replicas)).cast("int").alias("replica"), _mixed(F.col("doc_id"), F.col("text")).alias("h"), "text")
    ordered = dealt.repartitionById(replicas, F.col("replica")).sortWithinPartitions("h", "text")
    summed = ordered.select("replica", "text").mapInArrow(each, "block int, x binary").repartition("block").mapInArrow(add, "block int, x binary").orderBy("block").collect()
    shared.unpersist()
    if not summed:
        return model
    flat = np.concatenate([np.frombuffer(r["x"]) for r in summed])
    return Model.of(np.round(flat[:-1] / flat[-1], 6))


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Model]:
    """Counts, vocabulary and model of the documents that are not held out."""
    training = docs.where(~held_out(F.col("doc_id")))
    counts = stored(count_tokens(training), "counts")
    vocab = vocabulary(counts)
    model = Model.start(vocab.unigram)
    place, begin = F.pmod(_mixed(F.col("doc_id"), F.col("text")), F.lit(sum(ROUNDS))), 0
    for k, share in enumerate(ROUNDS):
        replicas = min(REPLICAS, max(1, math.ceil(vocab.tokens * share / sum(ROUNDS) / TOKENS)))
        model = train(training.where((place >= begin) & (place < begin + share)), vocab, model, replicas, k)
        begin += share
    return counts, vocab, model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model, model.log_sums()))
    base_total = math.log10(vocab.tokens + vocab.types + 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model, log_sums = shared.value
        row = TaskContext.get().partitionId() << 36
        log_count = np.log10(vocab.count + 1.0)
        in_bucket = (vocab.cls >= CLASSES - BUCKETS)[:-1]
        log_inside = np.where(np.append(in_bucket, False), log_count, 0.0)
        for b in batches:
            ids, held, texts = (b.column(k).to_pylist() for k in ("doc_id", "held_out", "text"))
            for k in range(0, len(texts), 200):
                made, seqs, known_log = [], [], []
                for i, (words, places, cls) in enumerate(_sequences(vocab, texts[k : k + 200])):
                    head = places >= 0
                    tail = Counter(words[j] for j in np.flatnonzero(~head).tolist())
                    tail.pop(END, None)
                    made.append((row, ids[k + i], held[k + i], len(words), int((vocab.count[places[head]] > 0).sum()), float(log_count[places[head]].sum()) - len(words) * base_total, [w.decode() for w in tail], list(tail.values())))
                    row += 1
                    seqs.append(cls)
                    known_log.append(float(log_inside[places[head]].sum()) - float(vocab.inside[cls].sum()))
                h1, h2, target = contexts(seqs)
                each_log = np.empty(len(target))
                for a in range(0, len(target), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    each_log[s] = np.einsum("nd,nd->n", model.context(h1[s], h2[s]), model.Q[target[s]]) + model.b[target[s]] - log_sums[h1[s] * (CLASSES + 1) + h2[s]]
                starts = np.cumsum([0, *[len(s) for s in seqs[:-1]]])
                by_model = np.add.reduceat(each_log, starts) / math.log(10)
                columns = list(zip(*made, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)] + [pa.array(by_model + np.array(known_log))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "words", "times", "model"])
        release()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, words array<string>, times array<long>, model double"
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = stored(asked.mapInArrow(each, schema), "scored")
    # words outside the head: their counts come by a join on the word; unseen ones add log10(1) = 0
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = rest.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    return rows.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
