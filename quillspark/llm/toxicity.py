"""Operator 5: toxicity by subword-bag embeddings and a linear softmax.

A bag of words is the average of the embeddings of its words' character n-grams (3 to
5, with the word's edges), hashed into ``2**BITS`` buckets; a linear softmax on that
average gives its log-odds.  Embeddings and softmax are trained jointly in numpy.  As
unseen misspellings share n-grams with known words, they share their vectors.

The bag of a whole text would drown three words in three thousand, so a document is
judged by the bag of its ``words`` most toxic words: of all its bags of so many, the one
with the highest log-odds.  One word alone says less: long clean texts have some word
that looks toxic by chance, but rarely two.  Training follows that: first each word is a
bag with the share of toxic documents that have it, and then, in rounds, each document
is the bag that judges it.  Documents kept from training calibrate the score (a rising
curve from the highest log-odds to the share of toxic documents).

Training reads a bounded sample of labelled documents (``sample`` rows with the
smallest digests of their ids) and of each its distinct words, made on the
executors.  Scoring reads every whole text.

Defined cases: null, empty and wordless texts get the score of a text without any
toxic evidence; a missing label teaches nothing; where several labels exist
for an id, toxic wins; without labels of both kinds the score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_table, fold, tune_arrow
from .grams import buckets, code_stream
from .langid import label_sample

BITS, DIM, ORDERS, WORDS = 17, 6, (3, 4, 5), 2
SAMPLE = 4000
THRESHOLD = 0.7
NO_EVIDENCE = -30.0
DROP = 0.3


def word_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word, then bucket and word of each n-gram) of a code stream."""
    inside = codes > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = np.cumsum(edge[:-1] == 1) - 1  # of each place; at the place before a word it is one less
    at, of = [], []
    for n in ORDERS:
        b, ok = buckets(codes, n, BITS)
        place = np.flatnonzero(ok)
        at.append(b[place])
        of.append(word[place + 1])  # the second character is always in the word
    return start, end, np.concatenate(at), np.concatenate(of)


class ToxicityModel:
    def __init__(self, table: np.ndarray, curve: tuple[np.ndarray, np.ndarray], words: int = WORDS):
        self.table, self.curve, self.words = table, curve, words

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The log-odds of the bag of each text's most toxic words."""
        out = []
        i = 0
        while i < len(texts):  # about a million characters at once
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j] or "") <= 1_000_000):
                held += len(texts[j] or "")
                j += 1
            codes, off = code_stream(texts[i:j], "alnum")
            start, _, at, of = word_grams(codes.astype(np.uint32))
            n = np.bincount(of, minlength=len(start))
            score = np.bincount(of, weights=self.table[at], minlength=len(start)) / np.maximum(n, 1)
            score, start = score[n > 0], start[n > 0]
            first = np.searchsorted(start, off)
            out += [self._most(score[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            i = j
        return np.array(out)

    def _most(self, score: np.ndarray) -> float:
        q = min(self.words, len(score))
        return float(np.partition(score, -q)[-q:].mean()) if q else NO_EVIDENCE

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.evidence(texts)
        # a small part keeps the order of texts that the curve holds equal
        return 0.99 * np.interp(m, *self.curve) + 0.01 * _sigmoid(m / 4)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve from log-odds to the smoothed share of toxic documents, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # share's numerator, number, least x, greatest x
    for v, t in sorted(zip(x.tolist(), y.tolist())):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], high]
    at, share = [], []
    for t, n, low, high in blocks:
        p = (t + 0.25) / (n + 0.5)
        at += [low, high + 1e-6]
        share += [p, p]
    return np.array(at), np.maximum.accumulate(np.array(share))


def train(docs: list[np.ndarray], vocabulary: list[str], labels: list[int], epochs: int = 5, rounds: int = 4, rate: float = 0.2) -> ToxicityModel:
    y = np.array(labels)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), (np.array([0.0]), np.array([0.0])))
    rng = np.random.default_rng(5)
    number, parts, size = vocabulary, [], np.zeros(len(vocabulary), np.int64)
    for i in range(0, len(number), 20_000):
        codes, off = code_stream(number[i : i + 20_000], "alnum")
        start, _, at, of = word_grams(codes.astype(np.uint32))
        # the words are single, so word i of the stream is word i of the vocabulary
        of = np.searchsorted(off, start, "right")[of] - 1
        parts.append(at[np.argsort(of, kind="stable")].astype(np.int32))
        size[i : i + 20_000] = np.bincount(of, minlength=len(off) - 1)
    at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    del parts
    first = np.concatenate([[0], np.cumsum(size)])
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    E = rng.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
    W = np.zeros((DIM, 2), np.float32)
    W[:, 1] = rng.normal(0, 0.3, DIM)
    W[:, 0] = -W[:, 1]
    bias = np.zeros(2, np.float32)
    E_sum, W_sum = np.zeros(E.shape, np.float32), np.zeros(W.shape)

    def step(bags: np.ndarray, toxic: np.ndarray, weight: np.ndarray, lr: float) -> None:
        """One step on bags, rows of words (-1: none), of which each has at least one."""
        nonlocal W, bias
        bag, place = np.nonzero(bags >= 0)
        words = bags[bag, place]
        own = np.bincount(bag, minlength=len(bags))[:, None].astype(np.float32)
        n = size[words]
        gram = at[np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        # some n-grams are left out at random, so that evidence spreads over all of a word's
        kept = ((rng.random(len(gram)) >= DROP) / (1 - DROP)).astype(np.float32)
        of_word = np.add.reduceat(E[gram] * kept[:, None], np.cumsum(n) - n) / n[:, None]
        x = np.add.reduceat(of_word, np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))) / own
        z = x @ W + bias
        p = _sigmoid(z[:, 1] - z[:, 0])
        g = ((p - toxic) * weight)[:, None] * np.array([-1, 1], np.float32)
        back = np.repeat((g @ W.T / own)[bag] / n[:, None], n, 0) * kept[:, None]
        dW, db = x.T @ g / len(bags), g.sum(0) / len(bags)
        W_sum[...] += dW * dW
        W -= lr * dW / np.sqrt(W_sum + 1e-8)
        bias -= 0.1 * lr * db
        for d in range(DIM):  # steps shrink with the gradients a bucket has seen
            dE = np.bincount(gram, weights=back[:, d], minlength=1 << BITS)
            E_sum[:, d] += (dE * dE).astype(np.float32)
            E[:, d] -= lr * dE / np.sqrt(E_sum[:, d] + 1e-8)

    def judging(s: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        """The bag of each document that has the highest log-odds."""
        out = np.full((len(docs), WORDS), -1, np.int64)
        for k, d in enumerate(docs):
            q = min(WORDS, len(d))
            out[k, :q] = d[np.argpartition(s[d], len(d) - q)[len(d) - q :]]
        return out

    def word_scores() -> np.ndarray:
        table = E @ (W[:, 1] - W[:, 0])
        total = np.zeros(len(size), np.float32)
        some = np.flatnonzero(size)
        for part in np.array_split(some, max(1, len(some) // 50_000)):
            if len(part):
                a, b = first[part[0]], first[part[-1] + 1]
                total[part] = np.add.reduceat(table[at[a:b]], first[part] - a)
        return total / np.maximum(size, 1) + bias[1] - bias[0]

    pos, neg = (np.bincount(np.concatenate([docs[i] for i in np.flatnonzero((y == v) & ~held)] or [np.zeros(0, np.int32)]), minlength=len(number)) for v in (1, 0))
    # first: a word's target is its share of toxic documents, drawn to the mean where it is rare
    base = float((y[~held] == 1).mean())
    seen = np.flatnonzero((pos + neg > 0) & (size > 0))
    many = pos[seen] + neg[seen]
    target = (pos[seen] + 2 * base) / (many + 2)
    weight = np.log1p(many)
    up = target > 0.5
    if up.any() and not up.all():
        weight[up] *= 0.5 * weight[~up].sum() / weight[up].sum()
        weight = np.minimum(weight / weight.mean(), 40)
    for _ in range(epochs):
        mixed = rng.permutation(len(seen))
        for part in np.array_split(mixed, max(1, len(mixed) // 2048)):
            step(seen[part][:, None], target[part], weight[part], rate)
    docs = [d[size[d] > 0] for d in docs]
    learn = np.array([i for i in np.flatnonzero(~held) if len(docs[i])], np.int64)
    share = y[learn].mean() if len(learn) else 0.5
    for _ in range(rounds):  # then: each document is the bag that judges it
        bags = judging(word_scores(), [docs[i] for i in learn])
        weight = np.where(y[learn] == 1, np.minimum(10, (1 - share) / max(share, 1e-9)), 1.0)
        for _ in range(2):
            mixed = rng.permutation(len(learn))
            for part in np.array_split(mixed, max(1, len(mixed) // 256)):
                if len(part):
                    step(bags[part], y[learn][part], weight[part] / weight.mean(), rate)
    s = word_scores()
    most = np.array([np.sort(s[d])[-WORDS:].mean() if len(d) else NO_EVIDENCE for d in docs])
    test = held if held.any() else ~held
    curve = _isotonic(most[test], y[test])
    return ToxicityModel((E @ (W[:, 1] - W[:, 0]) + (bias[1] - bias[0])).astype(np.float32), curve)


def fit(rows: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from labelled rows: the driver gets the distinct words of at most ``2 * sample`` of them."""
    tune_arrow(rows.sparkSession)

    def make(batches):
        for b in batches:
            lists = []
            for t in b.column(1).to_pylist():
                codes, _ = code_stream([t], "alnum")
                lists.append(sorted({*codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split("\0")} - {""}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string())), b.column(2).cast(pa.int64())], ["at", "words", "label"])

    got = label_sample(rows, label, sample, id_col, text_col).mapInArrow(make, "at long, words array<string>, label long").toArrow()
    # words as numbers into one vocabulary: no string for each of their places
    words = got.column(1).combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    index, ends = coded.indices.to_numpy(zero_copy_only=False), np.cumsum([0, *words.value_lengths().to_pylist()])
    labels, keys = got.column(2).to_pylist(), got.column(0).to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], ends[i + 1] - ends[i]))
    vocabulary = coded.dictionary.to_pylist()
    docs = [index[ends[i] : ends[i + 1]].astype(np.int32) for i in order]
    del got, words, coded, index
    pa.default_memory_pool().release_unused()  # the driver goes on for long after this
    return train(docs, vocabulary, [labels[i] for i in order])


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns (default: doc_id) with the score of each whole text, as ``name`` (choose one that none of ``keep`` has)."""
    keep = ["doc_id"] if keep is None else keep
    tune_arrow(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("body"))
    kinds = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(source.schema.fields[:-1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches):
        for b in batches:
            s = sent.value.scores(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    out = source.mapInArrow(run, f"{kinds}score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows that may be learnt from, with one label for an id."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    digest = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    # the sample is chosen among the labels, so that only its texts are looked up
    chosen = known.filter(fold("doc_id", 3) != 1).orderBy(digest).limit(SAMPLE)  # bounded
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    model = fit(labelled(docs, docs_table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
