"""Operator 1: language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its words' character n-grams (1 to 4,
hashed into ``2**BITS`` buckets), classified by a linear softmax.  Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled texts: at most ``sample`` rows, those whose ids have the
smallest digests.  Part of the sample is kept from training to calibrate: it gives the softmax
its temperature, and the score under which a prediction is rejected (at most
``reject`` of the calibration texts that are predicted rightly fall below it).

As all layers are linear before the softmax, the trained model is one table of
bucket by language, and whole texts are scored with it in Arrow batches.

Defined cases: null texts and those without a letter are ``und`` with score 0 and
are rejected; without labelled rows every text is ``und``; rows with a null label
teach nothing; repeated rows count again; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_table, fold, tune_arrow
from .grams import buckets, code_stream, sums

BITS, DIM, ORDERS = 15, 16, (1, 2, 3, 4)
SAMPLE = 2500
UNKNOWN = "und"


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text: never more than there are buckets."""
    codes, off = code_stream(texts, "alpha")
    out = []
    for a, b in zip(off[:-1], off[1:]):
        count = np.zeros(1 << BITS, np.int64)
        for n in ORDERS:
            at, ok = buckets(codes[a:b], n, BITS)
            count += np.bincount(at[ok], minlength=1 << BITS)
        at = np.flatnonzero(count)
        out.append((at.astype(np.int32), (count[at] / max(1, count.sum())).astype(np.float32)))
    return out


def label_sample(rows: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most about ``sample`` rows: those whose ids have the smallest digests; repeated ids come together."""
    known = rows.filter(F.col(label).isNotNull() & F.col(text_col).isNotNull())
    digest = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))
    ids = known.select(digest.alias("at")).distinct().orderBy("at").limit(sample)  # bounded
    return known.select(digest.alias("at"), F.col(text_col).alias("text"), F.col(label).alias("label")).join(F.broadcast(ids), "at", "left_semi").orderBy("at").limit(2 * sample).select("at", "text", "label").repartition(16)  # a sorted limit ends in one task


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.temperature, self.threshold = langs, table, temperature, threshold

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the score is high enough, of each text."""
        langs, scores = [], []
        i = 0
        while i < len(texts):  # about a million characters at once
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j] or "") <= 1_000_000):
                held += len(texts[j] or "")
                j += 1
            codes, off = code_stream(texts[i:j], "alpha")
            total, count = 0.0, 0.0
            for n in ORDERS:
                at, ok = buckets(codes, n, BITS)
                at[~ok] = 1 << BITS  # a row of zeros
                ok = np.append(ok, np.zeros(len(codes) - len(ok), bool))
                value = self.table[np.append(at, np.full(len(codes) - len(at), 1 << BITS))]
                total, count = total + sums(value, off), count + sums(ok.astype(np.float64), off)
            has = sums((codes > 0).astype(np.float64), off) > 0
            z = total / np.maximum(count, 1)[:, None] / self.temperature
            p = _softmax(z)
            best = p.argmax(1) if len(self.langs) else np.zeros(j - i, int)
            known = has & bool(len(self.langs))
            langs += [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, p.max(1) if len(self.langs) else 0.0, 0.0))
            i = j
        score = np.concatenate(scores) if scores else np.zeros(0)
        return langs, score, (score >= self.threshold) & (score > 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    if not z.shape[1]:
        return z
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts_bags: list, labels: list[str], epochs: int = 12, rate: float = 1.5, reject: float = 0.01, batch: int = 32) -> LanguageModel:
    """Trains on four fifths of the bags, and calibrates on the others."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros(((1 << BITS) + 1, 0), np.float32), 1.0, 1.0)
    y = np.array([langs.index(x) for x in labels])
    n, rng = len(y), np.random.default_rng(7)
    held = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    E = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    W, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    learn = np.flatnonzero(~held)
    steps, done = epochs * -(-len(learn) // batch), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for i in range(0, len(learn), batch):
            mine = learn[i : i + batch]
            at = np.concatenate([texts_bags[k][0] for k in mine])
            share = np.concatenate([texts_bags[k][1] for k in mine])
            who = np.repeat(np.arange(len(mine)), [len(texts_bags[k][0]) for k in mine])
            used, back = np.unique(at, return_inverse=True)
            M = np.zeros((len(mine), len(used)), np.float32)
            M[who, back] = share
            x = M @ E[used]
            g = _softmax(x @ W + bias)
            g[np.arange(len(mine)), y[mine]] -= 1
            r = rate * (1 - done / steps) / len(mine)
            dx = g @ W.T
            W -= r * (x.T @ g)
            bias -= r * 0.1 * g.sum(0)
            E[used] -= r * 20 * (M.T @ dx)
            done += 1
    table = np.vstack([E @ W + bias, np.zeros((1, len(langs)))]).astype(np.float32)  # averages of rows keep the bias
    test = np.flatnonzero(held) if held.any() else np.arange(n)
    z = np.array([(table[texts_bags[k][0]] * texts_bags[k][1][:, None]).sum(0) for k in test])
    options = np.geomspace(0.2, 20, 60)
    loss = [-np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(test)), y[test]])).mean() for t in options]
    t = float(options[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = p.max(1)[p.argmax(1) == y[test]]
    return LanguageModel(langs, table, t, float(np.quantile(right, reject)) if len(right) else 1.0)


def fit(rows: DataFrame, label: str = "lang", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Bags are made on the executors; the driver gets at most ``2 * sample`` of them."""
    tune_arrow(rows.sparkSession)

    def make(batches):
        for b in batches:
            made = bags(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0].tobytes() for x in made], pa.binary()), pa.array([x[1].tobytes() for x in made], pa.binary()), b.column(2).cast(pa.string())], ["at", "buckets", "shares", "label"])

    got = label_sample(rows, label, sample, id_col, text_col).mapInArrow(make, "at long, buckets binary, shares binary, label string").toArrow().sort_by([("at", "ascending"), ("buckets", "ascending")])
    found = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
    return train(found, got.column(3).to_pylist())


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` columns (default: doc_id) with lang_pred, score and accepted.

    prefix: stands before the names of added columns, where ``keep`` has such names.
    """
    keep = ["doc_id"] if keep is None else keep
    tune_arrow(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("body"))
    kinds = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(source.schema.fields[:-1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows by language

    def run(batches):
        for b in batches:
            lang, score, ok = sent.value.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [*b.schema.names[:-1], "lang_pred", "score", "accepted"])

    out = source.mapInArrow(run, f"{kinds}lang_pred string, score double, accepted boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in ("lang_pred", "score", "accepted")])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    model = fit(docs.filter(fold("doc_id", 5) != 0))
    out = identify(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
