"""Language identification by prediction by partial matching.

Training counts byte strings of up to four bytes per language on a sample of labelled texts
whose expected size is bounded (``sample_bytes`` for each language, ``MAX_LANGS`` languages). Only strings that end in a text
count, so the counts depend on the texts alone, not on how they are dealt out. From the counts come
variable-order byte context trees: a byte is predicted in its longest known context, and an
unknown byte escapes to the next shorter one (escape method C: a context seen n times with d
different bytes gives a byte seen c times c / (n + d) and the escape d / (n + d)), down to a
uniform byte. The trees are then frozen: the code length of a byte depends on its last
``order`` bytes only, so sorted tables hold it for all strings seen, over all 256 bytes and in
double precision, and a text is scored whole by searches in them.

A text that no model fits costs more bits a byte than texts of any learnt language: ``limits`` takes
from the labelled texts, for each language, the cost that its texts hardly ever exceed. ``told`` counts, and takes its limits, over all texts.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all
texts where there is nothing to learn from; rows without lang are not learnt from; ties go to the
language first in order; texts are scored whole at any length; repeated rows are judged each; the
caller's columns may have any names, they come back as the struct own_row; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenframe.llm.common import forget, parallel, row_struct, table, text_column, written
from lumenframe.llm.kernels import blocks

ORDER = 3
PAD = b"\n" * ORDER
#: Bits a byte by which texts of one language differ at least, for samples of a few texts.
LEAST_SPREAD = 0.25
#: Languages at most: a model of some MB of each goes to every worker.
MAX_LANGS = 500


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (the last four bytes as an integer), n of (lang, text)."""

    def run(batches):
        for b in batches:
            for lang, texts in _by_lang(b):
                gram = grams(texts)
                g, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    out = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grams(texts: list[bytes]) -> np.ndarray:
    """The four bytes that end at each byte of each text, as integers; before a text stands PAD, and no window ends in it."""
    buf = np.frombuffer(b"".join(PAD + t for t in texts), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + ORDER) - size - ORDER
    own = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    return (buf[own] << 24) | (buf[own + 1] << 16) | (buf[own + 2] << 8) | buf[own + 3]


def _by_lang(batch):
    by: dict[str, list[bytes]] = {}
    for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if t:
            by.setdefault(lang, []).append(t.encode("utf-8", "surrogatepass"))
    return by.items()


class Level:
    """Counts of one order for one language: the strings seen, sorted, with the code length of their last byte, and the contexts seen with the bits of an escape."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        own, where = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        counts = np.bincount(where, weights=n, minlength=len(own))
        self.mask = np.uint32((1 << 8 * (order + 1)) - 1)
        self.grams = own
        self.contexts, where = np.unique(own >> 8, return_inverse=True)
        seen, kinds = np.bincount(where, weights=counts), np.bincount(where)
        self.known = -np.log2(counts / (seen + kinds)[where])
        self.escape = -np.log2(kinds / (seen + kinds))

    def bits(self, grams: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of grams; below has those of the next shorter order."""
        g = grams & self.mask
        at, hit = _found(self.contexts, g >> 8)
        out = below + np.where(hit, self.escape[at], 0.0)
        at, hit = _found(self.grams, g)
        return np.where(hit, self.known[at], out)


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are among sorted keys, and whether they are."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


class Model:
    """Frozen statistics: for each language the levels of all orders, over all 256 bytes."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        self.levels = [[Level(grams[x][0].astype(np.uint32), grams[x][1], order) for order in range(ORDER + 1)] for x in self.langs]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for i, j in blocks(texts, 1 << 19):
            # Each string of a block is looked up once.
            gram, where = np.unique(grams(texts[i:j]), return_inverse=True)
            edge = np.cumsum([0, *map(len, texts[i:j])])
            for k, levels in enumerate(self.levels):
                bits = np.full(len(gram), 8.0)
                for level in levels:
                    bits = level.bits(gram, bits)
                run = np.concatenate([[0.0], np.cumsum(bits[where])])
                out[i:j, k] = np.diff(run[edge])
        return out


def sampled(labelled: DataFrame, sample_bytes: int) -> DataFrame:
    """Of (key, lang, text) a sample by a hash of key: about sample_bytes of text for each language, all where there is less."""
    labelled = labelled.where("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: models go whole to every task")
    if not sizes:
        return labelled
    rate = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample_bytes / max(n or 1, 1)))))
    return labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)


def train(labelled: DataFrame, sample_bytes: int | None = 2_000_000) -> Model:
    """Fits on a sample of (key, lang, text), bounded for each language, or on all of it (None)."""
    rows = gram_counts(labelled.where("lang IS NOT NULL") if sample_bytes is None else sampled(labelled, sample_bytes)).toPandas()
    return Model({lang: (x["gram"].to_numpy(), x["n"].to_numpy()) for lang, x in rows.groupby("lang")})


def limits(judged: DataFrame, reach: float = 6.0) -> dict[str, float]:
    """Bits a byte beyond which a text is in no learnt language, from (lang, lang_pred, bits_per_byte): for each language the third quartile of the texts told right and ``reach`` times the distance from their median to their 99th percentile, or LEAST_SPREAD if that is more, beyond it."""
    q = judged.where("lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", [0.5, 0.75, 0.99], 1000).alias("q")).collect()
    return {r[0]: r[1][1] + reach * max(r[1][2] - r[1][0], LEAST_SPREAD) for r in q}


def has_letter(t: str | None) -> bool:
    return any(c.isalpha() for c in t or "")


def predict(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """own_row (the kept columns), lang_pred, score (posterior of the best language, even priors) and bits_per_byte under it."""
    src = parallel(docs.select(row_struct(docs, keep), *(["text"] if "text" not in keep else [])))
    schema = StructType([src.schema["own_row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        m = shared.value
        for b in batches:
            for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                texts = text_column(part).to_pylist()
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                known = np.array([has_letter(t) for t in texts], dtype=bool) & bool(m.langs)
                if m.langs:
                    bits = m.bits(raw)
                    best = bits.argmin(1)
                    least = bits.min(1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    rate = least / np.maximum([len(r) for r in raw], 1)
                    pred = [m.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                else:
                    score, rate, pred = np.zeros(len(raw)), np.zeros(len(raw)), ["und"] * len(raw)
                yield pa.RecordBatch.from_arrays([part.column("own_row"), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, rate, 0.0))], names=schema.names)

    return src.mapInArrow(run, schema)


def told(docs: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of docs (key, lang, text) whose language, by models learnt from all of their own labels, can be told and fits.

    Texts are scored once: their scores are written with the rows, and limits taken from the written table.
    """
    labelled = docs.select(F.col(key).alias("key"), "lang", "text")
    if len(labelled.where("lang IS NOT NULL").select("lang").distinct().limit(MAX_LANGS + 1).collect()) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: models go whole to every task")
    judged = written(predict(docs, docs.columns, train(labelled, None)), "told")
    fits = F.lit(False)
    for lang, most in limits(judged.select(F.col("own_row.lang").alias("lang"), "lang_pred", "bits_per_byte")).items():
        fits = fits | ((F.col("lang_pred") == lang) & (F.col("bits_per_byte") <= most))
    out = judged.where(fits & (F.col("score") >= least))
    return out.select(*(F.col("own_row").getField(c).alias(c) for c in docs.columns))


HELD_OUT = "crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4 = 2"


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(f"NOT coalesce({HELD_OUT}, false) AND lang IS NOT NULL").select(F.col("doc_id").alias("key"), "lang", "text")
    return predict(docs, ["doc_id"], train(learn)).select("own_row.doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")
