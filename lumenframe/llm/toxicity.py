"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds by language.

* A word's vector is the mean of hashed embeddings: of the whole word and of its prefixes, so that forms
  of a word share what is learnt.
* Filters of several widths look at each run of as many words; each keeps its largest value over the
  whole text (max pooling), and a dense layer turns these into a logit. A document has as many places as words, at any
  length; after its last word come zero vectors.
* Training: one dimension of the embeddings starts as the evidence of a hashed row's document counts, the others
  near zero; then gradient steps with step sizes by coordinate, of which the state with the least loss on a fifth of the
  sample that takes no part in them is kept.
* Thresholds: a small frozen model of hashed words tells the language of a text. On the fifth left out, a logistic
  curve maps logits to scores, with an offset for each language, drawn to the common one where
  a language has few rows; the threshold on the logit at which a score reaches 0.3 thus differs by language.

The model is fitted on the driver from a bounded sample of labelled rows: at most about ``max_labelled`` rows (by a hash of the id; all
where there are no more) with texts of at most ``max_bytes`` bytes. Its size is fixed, whatever the corpus. Everything is scored,
in one pass without a shuffle. Only the text enters a score.

Defined results: null text counts as empty, and empty texts get a score too; rows without doc_id are
scored but not learnt from; a document with labels that disagree is toxic if one says so; where nothing, or one kind only, is
labelled, the score is the share of toxic rows; repeated rows are judged each; the caller's columns may have any names,
they come back as the struct own_row; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenframe.llm.common import forget, parallel, prepare, row_struct, table, text_column
from lumenframe.llm.kernels import U64, blocks, joined, lower_ascii, mix, prefix_hash, span_hash, word_spans

#: Rows of the embedding table, dimensions of a word's vector, prefixes in bytes, widths of filters, filters of each width.
ROWS, DIMS, PREFIXES, WIDTHS, FILTERS = 1 << 17, 8, (4, 5, 6, 7, 8), (1, 2, 3), 6
GAP = max(WIDTHS) - 1
#: Rows of the language model's table.
LANG_ROWS = 1 << 15
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
HELD_OUT = "crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4 = 2"


@dataclass
class Block:
    """A block of texts: the embedding rows of each word, where words and documents lie among all places, and words by document."""

    hashed: np.ndarray
    lang_rows: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    count: np.ndarray

    @property
    def places(self) -> int:
        return int(self.starts[-1] + max(self.count[-1], 1) + GAP)


def block_of(raw: list[bytes]) -> Block:
    buf, at = joined(raw)
    buf = lower_ascii(buf)
    starts, ends = word_spans(buf)
    prefix = prefix_hash(buf)
    whole = span_hash(prefix, starts, ends)
    # A prefix as long as the word is told from the word itself by its salt.
    hashed = [whole, *(mix(span_hash(prefix, starts, np.minimum(starts + n, ends)) + U64(n)) for n in PREFIXES)]
    count = np.diff(np.searchsorted(starts, at))
    size = np.maximum(count, 1) + GAP
    doc_starts = np.cumsum(size) - size
    place = np.arange(len(starts)) + np.repeat(doc_starts - (np.cumsum(count) - count), count)
    rows = np.stack([(h & U64(ROWS - 1)).astype(np.int32) for h in hashed], axis=1)
    return Block(rows, ((whole >> U64(40)) & U64(LANG_ROWS - 1)).astype(np.int32), place, doc_starts, count)


class Net:
    """Parameters: emb (ROWS x DIMS), for each width kernel (width x DIMS x FILTERS) and bias, dense and its bias."""

    def __init__(self, seed: int = 1):
        rnd = np.random.default_rng(seed)
        self.emb = rnd.normal(0, 0.01, (ROWS, DIMS)).astype(np.float32)
        self.kernels = [rnd.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.dense = np.full(len(WIDTHS) * FILTERS, 0.3, dtype=np.float32)
        self.bias = np.float32(0)

    def vectors(self, b: Block) -> np.ndarray:
        """Word vectors by place, zero where there is no word."""
        x = np.zeros((b.places, DIMS), dtype=np.float32)
        if len(b.place):
            total = self.emb[b.hashed[:, 0]]
            for k in range(1, b.hashed.shape[1]):
                total += self.emb[b.hashed[:, k]]
            x[b.place] = total / b.hashed.shape[1]
        return x

    def maps(self, x: np.ndarray):
        """For each width the filters' values by place."""
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            n = len(x) - GAP
            out = np.zeros((len(x), FILTERS), dtype=np.float32)
            for o in range(kernel.shape[0]):
                out[:n] += x[o : o + n] @ kernel[o]
            out += bias
            yield out

    def pooled(self, b: Block) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Largest values of all filters by document, the vectors, and the maps."""
        x = self.vectors(b)
        edge = np.stack([b.starts, b.starts + np.maximum(b.count, 1)], axis=1).ravel()
        maps = list(self.maps(x))
        return np.concatenate([np.maximum.reduceat(m, edge, axis=0)[::2] for m in maps], axis=1), x, maps

    def logits(self, b: Block) -> np.ndarray:
        return np.maximum(self.pooled(b)[0], 0) @ self.dense + self.bias


def evidence(docs: list[Block], y: np.ndarray) -> np.ndarray:
    """For each row of the embedding table how surely its words come in toxic documents, within -1..1: the log odds of its document counts in their standard deviations."""
    df = np.zeros((2, ROWS))
    for b, own in zip(docs, y, strict=True):
        df[own, np.unique(b.hashed)] += 1
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    a, c = df[1] + 0.5 * n1 / (n0 + n1), df[0] + 0.5 * n0 / (n0 + n1)
    odds = np.log(a / n1) - np.log(c / n0)
    return np.clip(odds / np.sqrt(1 / a + 1 / c) / 6, -1, 1).astype(np.float32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


class Steps:
    """Gradient steps with a size for each coordinate."""

    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows=None) -> None:
        seen = self.seen.setdefault(name, np.zeros_like(value))
        at = slice(None) if rows is None else rows
        seen[at] += grad * grad
        value[at] -= self.rate * grad / (np.sqrt(seen[at]) + 1e-6)


def fit_net(docs: list[Block], y: np.ndarray, spare: np.ndarray, epochs: int, rate: float = 0.03, batch: int = 32, seed: int = 2) -> Net:
    """Trains on the documents that are not spare; keeps the state with the least loss on those that are."""
    net, rnd = Net(), np.random.default_rng(seed)
    own = np.flatnonzero(~spare)
    net.emb[:, 0] = evidence([docs[i] for i in own], y[own])
    for k in net.kernels:
        k[0, 0, :] = np.abs(k[0, 0, :]) + 1
    net.bias = np.float32(np.log(max(y[own].mean(), 1e-3) / max(1 - y[own].mean(), 1e-3)))
    steps, best = Steps(rate), (np.inf, None)
    left = merged([docs[i] for i in np.flatnonzero(spare)])
    for _ in range(epochs):
        for part in np.array_split(rnd.permutation(own), max(1, len(own) // batch)):
            learn(net, [docs[i] for i in part], y[part], steps)
        loss = log_loss(net.logits(left), y[spare])
        if loss < best[0]:
            best = loss, (net.emb.copy(), [k.copy() for k in net.kernels], [b.copy() for b in net.biases], net.dense.copy(), net.bias)
    if best[1]:
        net.emb, net.kernels, net.biases, net.dense, net.bias = best[1]
    return net


def merged(docs: list[Block]) -> Block:
    """One block of several."""
    at = np.cumsum([0, *(b.places for b in docs)])
    cat = lambda c, shift=None: np.concatenate([getattr(b, c) + (0 if shift is None else k) for b, k in zip(docs, at, strict=False)])
    return Block(cat("hashed"), cat("lang_rows"), cat("place", at), cat("starts", at), cat("count"))


def learn(net: Net, docs: list[Block], y: np.ndarray, steps: Steps) -> None:
    """One step on a batch: gradients flow through the largest place of each filter."""
    b = merged(docs)
    top, x, maps = net.pooled(b)
    act = np.maximum(top, 0)
    d = (sigmoid(act @ net.dense + net.bias) - y) / len(docs)
    word = np.full(b.places, -1)
    word[b.place] = np.arange(len(b.place))
    rows, grads = [], []
    for k, (kernel, m) in enumerate(zip(net.kernels, maps, strict=True)):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        at = np.stack([s + m[s : s + max(n, 1)].argmax(0) for s, n in zip(b.starts.tolist(), b.count.tolist(), strict=True)])
        flow = (d[:, None] * net.dense[own] * (act[:, own] > 0)).astype(np.float32)
        grad = np.stack([np.einsum("nf,nfd->df", flow, x[at + o]) for o in range(kernel.shape[0])])
        for o in range(kernel.shape[0]):
            w = word[at + o]
            i, f = np.nonzero((w >= 0) & (flow != 0))
            rows.append(b.hashed[w[i, f]].ravel())
            grads.append(np.repeat(kernel[o][:, f].T * flow[i, f][:, None] / b.hashed.shape[1], b.hashed.shape[1], axis=0))
        steps.step(f"kernel{k}", net.kernels[k], grad)
        steps.step(f"bias{k}", net.biases[k], flow.sum(0))
    steps.step("dense", net.dense, (d @ act).astype(np.float32))
    net.bias = np.float32(net.bias - 0.05 * d.sum())
    own, where = np.unique(np.concatenate(rows), return_inverse=True)
    if len(own):
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.diff(where[order], prepend=-1))
        steps.step("emb", net.emb, np.add.reduceat(np.concatenate(grads)[order], first, axis=0), own)


def language_table(docs: list[Block], langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Learnt languages and, for each hashed word, its log probability in each: counts of words with one added."""
    names = sorted({x for x in langs if x is not None})
    n = np.ones((LANG_ROWS, max(1, len(names))))
    for b, lang in zip(docs, langs, strict=True):
        if lang is not None:
            np.add.at(n[:, names.index(lang)], b.lang_rows, 1)
    return names, np.log(n / n.sum(0)).astype(np.float32)


def calibrated(z: np.ndarray, y: np.ndarray, lang: np.ndarray, n_langs: int, rounds: int = 200, prior: float = 4.0) -> tuple[float, np.ndarray]:
    """Slope, and for each language an offset, of the logistic curve from logits to scores; offsets are drawn to their mean, the slope to one."""
    slope, common, own = 1.0, 0.0, np.zeros(n_langs)
    for _ in range(rounds):  # Newton steps on one coordinate at a time
        for what in ("slope", "common", *range(n_langs)):
            s = sigmoid(slope * z + common + own[lang])
            r, h = s - y, s * (1 - s)
            if what == "slope":
                slope -= ((r * z).sum() + (slope - 1)) / ((h * z * z).sum() + 1)
                slope = max(slope, 0.1)
            elif what == "common":
                common -= (r.sum() + 0.1 * common) / (h.sum() + 0.1)
            else:
                in_it = lang == what
                own[what] -= (r[in_it].sum() + prior * own[what]) / (h[in_it].sum() + prior)
    return slope, common + own


@dataclass
class Model:
    net: Net | None
    langs: list[str]
    words: np.ndarray
    slope: float
    offsets: np.ndarray

    def language(self, b: Block) -> np.ndarray:
        """Index of the likeliest language by document."""
        edge = np.concatenate([[0], np.cumsum(b.count)])
        total = np.zeros((len(edge), self.words.shape[1]))
        if len(b.lang_rows):
            np.cumsum(self.words[b.lang_rows], axis=0, dtype=np.float64, out=(run := np.zeros((len(b.lang_rows) + 1, self.words.shape[1])))[1:])
            total = run[edge]
        return np.diff(total, axis=0).argmax(1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in blocks(texts, 1 << 18):
            b = block_of(texts[i:j])
            z = self.net.logits(b) if self.net else np.zeros(j - i)
            out[i:j] = sigmoid(self.slope * z + self.offsets[self.language(b)])
        return out

    def thresholds(self) -> dict[str, float]:
        """The logit from which a text counts as toxic, by language."""
        return {x: float((np.log(THRESHOLD / (1 - THRESHOLD)) - self.offsets[k]) / self.slope) for k, x in enumerate(self.langs)}


def train(sample: list[tuple[int, str | None, str | None, int]], epochs: int = 8) -> Model:
    """Fits on (id, text, lang, toxic); the same rows in any order give the same model."""
    sample = sorted(sample, key=lambda r: (r[0], r[1] or "", r[3]))
    y = np.array([r[3] for r in sample], dtype=np.int64)
    docs = [block_of([(r[1] or "").encode("utf-8", "surrogatepass")]) for r in sample]
    langs, words = language_table(docs, [r[2] for r in sample])
    model = Model(None, langs, words, 1.0, np.zeros(max(1, len(langs))))
    spare = (mix(np.array([r[0] for r in sample], dtype=np.int64).view(U64)) % U64(5) == 0) if sample else np.zeros(0, dtype=bool)
    if not len(y) or not 0 < y[~spare].sum() < (~spare).sum() or not 0 < y[spare].sum() < spare.sum():
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
        model.offsets += np.log(share / (1 - share))
        return model
    model.net = fit_net(docs, y, spare, epochs)
    own = np.flatnonzero(spare)
    left = merged([docs[i] for i in own])
    model.slope, model.offsets = calibrated(model.net.logits(left), y[own], model.language(left), model.words.shape[1])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_bytes: int = 100_000) -> list[tuple]:
    """(doc_id, text, lang, toxic) of about max_labelled labelled rows at most, by a hash of their ids; ids of the sample, not texts, are dealt out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    # The sample's ids are at most about max_labelled, so they may go to all tasks.
    got = rows.join(F.broadcast(some), "doc_id").select("doc_id", "text", "lang", "toxic").toArrow()
    return list(zip(*(got.column(c).to_pylist() for c in got.column_names), strict=True)) if got.num_rows else []


def score(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """own_row (the kept columns) and score of docs (text)."""
    src = parallel(docs.select(row_struct(docs, keep), *(["text"] if "text" not in keep else [])))
    schema = StructType([src.schema["own_row"], StructField("score", DoubleType())])
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        m = shared.value
        for b in batches:
            for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in text_column(part).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("own_row"), pa.array(m.scores(raw))], names=schema.names)

    return src.mapInArrow(run, schema)


def op12_toxicity(spark, sf_dir):
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.expr(f"coalesce({HELD_OUT}, false)")
    model = train(labelled_sample(docs.where(~held), labels.where(~held)))
    out = score(docs, ["doc_id"], model).select("own_row.doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
