"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits; a linear classifier on hashed
character n-grams predicts every bit.  Decoding adds up, for each language, the
logistic loss of the predicted bits against its codeword, each bit weighted by
how well it separates the training rows; the least loss wins.  A text whose two
best languages lie closer than `margin` is flagged ambiguous.

The model is fitted on a bounded sample: at most `per_language` rows of each
language, those with the smallest xxhash64(doc_id).  A bound on that hash, from
the languages' counts, goes before the ranking, so a window sees a few times the
sample only.  One task on an executor adds the sample up language by language:
it holds one language's rows and either all rows (DUAL at most) or the normal
equations of DIMS + 1 unknowns, whatever the number of languages; the driver
gets the weights alone.  Prediction reads whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
not ambiguous; rows with null doc_id, text or language are predicted but never
trained on; without any training row all is `und`; repeated rows get equal
results, and ties in the sample's order go by the features; very long texts are
one row; other columns, whatever their names, are left out, or go along if
named.  Output: doc_id, held_out, lang_pred, score, ambiguous.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import exchange as X
from . import textvec as T

DIMS = 4096
ORDERS = (1, 2, 3)
#: texts in one feature matrix
ROWS = 256
#: rows of a sample up to which the dual equations are the smaller ones
DUAL = 2048
#: rows for each one of the sample that the bound on the hash lets through
SLACK = 3
UND = "und"
#: steepness of the logistic loss on least-squares margins
STEEP = 3.0

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def cleaned(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space between words, and one at each end; and offsets."""
    if not len(buf):
        return buf, offs
    x = _CLEAN[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    x = np.where(after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), buf + 0x20, x).astype(np.uint8)
    keep = x != 0x20
    keep[1:] |= x[:-1] != 0x20
    keep[:1] = True
    heads = offs[:-1][offs[:-1] < len(buf)]
    keep[heads] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], total[offs]


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of square-rooted, normalised n-gram counts for each text."""
    x, at = cleaned(buf, offs)
    n = len(at) - 1
    out = np.zeros(n * DIMS)
    doc = np.repeat(np.arange(n), np.diff(at))
    x = x.astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        code = (code[: len(x) - k + 1] * np.uint32(0x9E3779B1) + x[k - 1 :]) if k > 1 else x.copy()
        if k in ORDERS and len(code):
            whole = doc[: len(code)] == doc[k - 1 :]
            slot = (code * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F)) >> np.uint32(20)
            out += np.bincount((doc[: len(code)] * DIMS + slot)[whole], minlength=n * DIMS)
    out = np.sqrt(out.reshape(n, DIMS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def lettered(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    plain = ((buf | 0x20) >= 97) & ((buf | 0x20) <= 122)
    total = np.concatenate([[0], np.cumsum(plain)])
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """k codewords: all splits of up to seven classes, seeded random ones beyond."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        cols = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(cols, float).T
    bits = int(np.ceil(15 * np.log2(k)))
    draw = np.random.default_rng(seed).integers(0, 2, (k, 4 * bits)) * 2.0 - 1
    return draw[:, np.abs(draw.sum(0)) < k][:, :bits]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language for each row."""
        f = STEEP * (x @ self.weights[:-1] + self.weights[-1])
        return np.logaddexp(0, -f) @ (self.trust * (self.codes > 0)).T + np.logaddexp(0, f) @ (self.trust * (self.codes < 0)).T


def fit(groups: Iterable[tuple[str, np.ndarray]], ridge: float = 0.3) -> Model:
    """Least-squares bit classifiers from (language, its rows' features), every language with the same weight.

    A bit is trusted by the share of its variance that is explained.
    """
    langs, sizes, sums, held = [], [], [], []
    gram = None
    for lang, x in groups:
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]) / np.float32(np.sqrt(len(x)))
        langs.append(lang), sizes.append(len(x)), sums.append(x1.sum(0, dtype=np.float64) / np.sqrt(len(x)))
        if gram is None:
            held.append(x1)
            if sum(sizes) <= DUAL:
                continue
        if gram is None:
            gram = np.zeros((DIMS + 1, DIMS + 1))
            x1, held = np.vstack(held), []
        gram += x1.T @ x1
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((DIMS + 1, 0), np.float32), np.zeros(0))
    codes, each = codebook(len(langs)), sum(sizes) / len(langs)
    right = each * np.stack(sums, 1) @ codes
    if gram is None:
        x1 = np.vstack(held).astype(np.float64) * np.sqrt(each)
        bits = codes[np.repeat(np.arange(len(langs)), sizes)] * np.sqrt(each / np.repeat(sizes, sizes))[:, None]
        weights = x1.T @ np.linalg.solve(x1 @ x1.T + ridge * np.eye(len(x1)), bits)
        spread = ((x1 @ weights) ** 2).sum(0)
    else:
        gram *= each
        weights = np.linalg.solve(gram + ridge * np.eye(DIMS + 1), right)
        spread = (weights * (gram @ weights)).sum(0)
    known = np.sqrt(np.clip((2 * (weights * right).sum(0) - spread) / sum(sizes), 0.01, 0.998))
    trust = np.arctanh(known)
    return Model(langs, codes, weights.astype(np.float32), trust / trust.sum() * len(trust))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 400) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    ws = X.Workspace(docs.sparkSession, "language", docs)
    known = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    bound = F.when(F.col("n") > SLACK * per_language, (F.lit(float(SLACK * per_language)) / F.col("n") - 0.5) * 2.0**64).otherwise(F.lit(2.0**64))
    ws.write("bounds", known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", bound.alias("bound")))
    some = X.attach(ws, known.withColumn("rank", F.xxhash64("doc_id")), "bounds", "lang").filter(F.col("rank") <= F.col("bound"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                for lo, hi, buf, offs in T.chunks(part.column(2)):
                    x = features(buf, offs)
                    slots = [np.flatnonzero(r).astype(np.uint16) for r in x]
                    cols = [part.column(0).slice(lo, hi - lo), part.column(1).slice(lo, hi - lo)]
                    cols += [pa.array([r.tobytes() for r in slots], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(x, slots, strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "rank", "slots", "x"])

    sample = some.select("lang", "rank", "text").mapInArrow(X.giving_back(count), "lang string, rank long, slots binary, x binary")
    order = Window.partitionBy("lang").orderBy("rank", "slots", "x")
    sample = sample.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.cpu_threads()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(by_language(batches)))], pa.binary())], ["model"])

    one = sample.repartition(1).sortWithinPartitions("lang", "place").select("lang", "slots", "x")
    found = one.mapInArrow(X.giving_back(learn), "model binary").first()  # none of an empty table
    ws.close()
    return pickle.loads(found[0]) if found else fit([])


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, dense rows) of sparse rows sorted by language."""
    name, rows = None, []
    for batch in batches:
        for lang, slots, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and lang != name:
                yield name, np.stack(rows)
                rows = []
            name = lang
            dense = np.zeros(DIMS, np.float32)
            dense[np.frombuffer(slots, np.uint16)] = np.frombuffer(x, np.float32)
            rows.append(dense)
    if rows:
        yield name, np.stack(rows)


def identify(docs: DataFrame, model: Model, margin: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict all documents.  score is the winner's share of exp(-loss); carry: columns that go along."""
    X.on_workers(docs.sparkSession)
    names = ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    also = [c for c in carry if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                whole = batch.slice(k, ROWS)
                for lo, hi, buf, offs in T.chunks(whole.column(2)):
                    part = whole.slice(lo, hi - lo)
                    known = lettered(buf, offs) if model.languages else np.zeros(hi - lo, bool)
                    name, score, close = np.full(hi - lo, UND, object), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                    if known.any():
                        loss = model.losses(features(buf, offs)[known].astype(np.float64))
                        best = loss.argmin(1)
                        name[known] = np.array(model.languages, object)[best]
                        score[known] = 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)
                        if len(model.languages) > 1:
                            two = np.partition(loss, 1, axis=1)
                            close[known] = two[:, 1] - two[:, 0] < margin
                    cols = [part.column(0), part.column(1), pa.array(name, pa.string()), pa.array(score), pa.array(close)]
                    yield pa.RecordBatch.from_arrays([*cols, *(part.column(2 if c == "text" else 3 + also.index(c)) for c in carry)], [*names, *carry])

    kinds = [Y.LongType(), Y.BooleanType(), Y.StringType(), Y.DoubleType(), Y.BooleanType()]
    schema = Y.StructType([Y.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + [docs.schema[c] for c in carry])
    return docs.select("doc_id", held_out().alias("held_out"), "text", *also).mapInArrow(X.giving_back(run), schema)
