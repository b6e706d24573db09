"""Language ID in two steps: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import chunks, tidy, utf8

#: Families of common language codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"], "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"], "turkic": ["tr", "az", "kk", "uz"], "uralic": ["fi", "hu", "et"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Buckets of hashed byte n-grams, and the n-grams' lengths.
BUCKETS, GRAMS = 1 << 13, (1, 2, 3)
#: Labelled rows that the fit reads for each language: a bound that does not grow with the data.
FIT_ROWS = 400
#: Parts of a language in which rows are ranked first.
SPREAD = 64
EPOCHS, RATE, DECAY = 30, 0.5, 1e-4

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32


def features(texts: pa.Array) -> np.ndarray:
    """A row of BUCKETS for each whole text: square roots of its n-gram counts, scaled to length 1. Digits and
    ASCII signs count as one symbol, and n-grams never reach over the end of a text."""
    raw, offsets = utf8(texts)
    n, low = len(offsets) - 1, _LOW[raw].astype(np.uint32)
    low[(low < 97) & (low != 32) | ((low > 122) & (low < 128))] = 35
    who = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, BUCKETS), np.float32)
    for k in GRAMS:
        size = len(low) - k + 1
        if size <= 0:
            continue
        h = np.full(size, 0x9E37 * k, np.uint32)
        for j in range(k):
            h = (h ^ low[j : j + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        ok = who[:size] == who[k - 1 :]
        at = who[:size][ok] * BUCKETS + (h[ok] & np.uint32(BUCKETS - 1))
        out += np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    out = np.sqrt(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit_svm(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged subgradient steps on the hinge loss; y is -1 or 1, both sides weigh alike."""
    rng = np.random.default_rng(seed)
    w, b, sw, sb, n = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float64), 0.0, 0
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())).astype(np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            i = order[at : at + 32]
            bad = (y[i] * (x[i] @ w + b) < 1) * y[i] * weight[i]
            rate = RATE / (1 + 0.2 * epoch)
            w = (1 - rate * DECAY) * w + rate * (bad @ x[i]).astype(np.float32) / len(i) * 8
            b += rate * float(bad.mean())
            if epoch >= EPOCHS // 2:
                sw, sb, n = sw + w, sb + b, n + 1
    return (sw / max(1, n)).astype(np.float32), sb / max(1, n)


class Model:
    """Votes of one-versus-one SVMs among families, then among the languages of the winning family."""

    def __init__(self, x: np.ndarray, labels: list[str], families: dict[str, str] | None = None):
        families = FAMILY if families is None else families
        self.langs = sorted(set(labels))
        home = {c: families.get(c, f"only {c}") for c in self.langs}
        self.groups = {f: [c for c in self.langs if home[c] == f] for f in sorted(set(home.values()))}
        y = np.array([self.langs.index(c) for c in labels])
        of = np.array([list(self.groups).index(home[c]) for c in labels], int)
        self.top = self._pairs(x, of, range(len(self.groups)), 1)
        self.inner = [self._pairs(x, y, [self.langs.index(c) for c in g], 2) for g in self.groups.values()]

    @staticmethod
    def _pairs(x, y, classes, seed):
        out = []
        for a, b in combinations(classes, 2):
            i = np.flatnonzero((y == a) | (y == b))
            out.append((a, b, *fit_svm(x[i], np.where(y[i] == a, 1.0, -1.0).astype(np.float32), seed + 17 * a + b)))
        return out

    @staticmethod
    def _vote(x: np.ndarray, pairs, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes, ties by margin, and the mean probability of its own duels."""
        votes, margin = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        for a, b, w, bias in pairs:
            m = x @ w + bias
            for c, side in ((a, m), (b, -m)):
                k = classes.index(c)
                votes[:, k] += side > 0
                margin[:, k] += np.log1p(np.exp(-np.clip(4 * side, -30, 30)))
        best = np.argmax(votes - 1e-3 * margin / max(1, len(pairs)), axis=1)
        return best, np.exp(-margin[np.arange(len(x)), best] / max(1, len(classes) - 1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x))
        family, sure = self._vote(x, self.top, list(range(len(self.groups))))
        out = np.zeros(len(x), int)
        for f, group in enumerate(self.groups.values()):
            i = np.flatnonzero(family == f)
            if len(i):
                classes = [self.langs.index(c) for c in group]
                best, p = self._vote(x[i], self.inner[f], classes)
                out[i] = np.array(classes)[best]
                sure[i] = sure[i] * p
        return [self.langs[k] for k in out], sure


def fit(labelled: DataFrame, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fits on at most `rows` different rows of each language, those whose hashes (of id and text) are lowest; the
    rest are not collected. Repeated rows and ids, null ones too, count once, so the bound holds whatever the table.

    The lowest hashes come from SPREAD parts of each language, and then from `rows` of each part, so no task ranks
    all rows of a language.
    """
    lang, text = F.col(f"`{lang_column}`"), F.col(f"`{text_column}`")
    known = labelled.filter(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(f"`{id_column}`"), text).alias("fit_row"))
    ids = known.select(F.col("lang").alias("fit_lang"), F.col("fit_row").alias("fit_id"))
    part = Window.partitionBy("fit_lang", F.pmod("fit_id", F.lit(SPREAD))).orderBy("fit_id")
    few = ids.withColumn("k", F.row_number().over(part)).filter(F.col("k") <= rows).select("fit_lang", "fit_id").distinct()
    whole = Window.partitionBy("fit_lang").orderBy("fit_id")
    chosen = few.withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= rows).drop("k")
    # `rows` hashes for each language
    texts = known.join(F.broadcast(chosen), (F.col("fit_row") == F.col("fit_id")) & (F.col("lang") == F.col("fit_lang")), "left_semi").dropDuplicates(["lang", "fit_row"]).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = features(part.column("text"))
                i = [np.flatnonzero(r) for r in x]
                yield pa.record_batch([part.column("lang"), pa.array([k.astype(np.uint16).tobytes() for k in i], pa.binary()), pa.array([r[k].tobytes() for r, k in zip(x, i)], pa.binary())], ["lang", "at", "x"])

    got = texts.mapInArrow(tidy(sparse), "lang string, at binary, x binary").orderBy("lang", F.xxhash64("at", "x")).collect()
    x = np.zeros((len(got), BUCKETS), np.float32)
    for r, row in zip(got, x):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return Model(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows with lang_pred and score (columns of these names give way). Only the text is looked at; `und`
    with score 0 for null texts and texts without a letter, and for all where nothing was learned. Repeated rows get
    equal results; an empty table gives none. The model's size does not depend on the data."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in chunks(batches, text_column, 2 << 20):
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                langs, sure = shared.value.predict(features(b.column(text_column)))
                letters = [has_letter(t) for t in b.column(text_column).to_pylist()]
                cols = [pa.array([c if ok else "und" for c, ok in zip(langs, letters)]), pa.array(np.where(letters, np.clip(sure, 0, 1), 0.0).astype(float))]
                yield pa.record_batch([*[b.column(c) for c in kept], *cols], [*kept, "lang_pred", "score"])

    return plain.mapInArrow(tidy(go), f"{fields}, lang_pred string, score double")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(~out).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
