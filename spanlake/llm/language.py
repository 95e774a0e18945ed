"""Language ID by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier over hashed n-grams of
bytes. A text's bit margins are compared with every codeword by a loss that is weighted with how
well a bit's classifier tells its two sides apart; the codeword of least loss is the prediction, and
one whose runner-up is nearly as close is flagged as ambiguous.

The classifiers are fitted on the driver, on a bounded sample of labelled rows: at most about
``SAMPLE`` rows a language, chosen by a hash of their keys. Prediction reads every whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import texts

#: Labelled rows that the fit takes at most: of each language, and in all.
SAMPLE, SAMPLE_ALL = 400, 4000
#: Hash buckets of n-grams; their orders in bytes.
BUCKETS, ORDERS = 1 << 13, (2, 3, 4)
#: A prediction is ambiguous if its score lead over the runner-up is less.
MARGIN = 0.2
CHUNK = 1 << 18
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))


def features(text: bytes | None) -> np.ndarray:
    """Counts of the hashed n-grams of a text's letters in lower case; other ASCII counts as a blank."""
    counts = np.zeros(BUCKETS, np.int64)
    data = (text or b"").decode("utf-8", "replace").lower().encode().translate(_LETTERS)
    if not data.strip():
        return counts.astype(np.float32)
    line = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
    for a in range(0, len(line), CHUNK):
        part = line[a : a + CHUNK + max(ORDERS) - 1]  # an n-gram belongs to the chunk in which it starts
        code = np.zeros(len(part), np.uint32)
        for k in range(max(ORDERS)):
            code = code[: len(part) - k] * np.uint32(0x01000193) + part[k:] + np.uint32(1)
            if k + 1 in ORDERS:
                mixed = code * np.uint32(0x9E3779B1)
                counts += np.bincount(mixed[:CHUNK] >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts.astype(np.float32)


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1 a row."""
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt(counts.sum(-1, keepdims=True)), 1e-9)


def has_letter(text: bytes | None) -> bool:
    return any(map(str.isalpha, (text or b"").decode("utf-8", "replace")))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, far apart from one another, with columns that split the languages differently.

    Up to 6 languages have the exhaustive code (each split of the languages once); more have the
    best of some random codes of 16 to 64 bits.
    """
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        columns = np.arange(1, 1 << (n - 1))  # the first language is on the same side in all
        return np.array([np.where(columns >> (k - 1) & 1 if k else columns * 0, -1, 1) for k in range(n)])
    rng, width = np.random.default_rng(seed), min(64, 16 + 2 * n)
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = int(min((code[i] != code[j]).sum() for i in range(n) for j in range(i)))
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    """langs; code (languages, bits); weights (buckets, bits); bias and worth of each bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    worth: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows of probabilities over the languages, by loss-weighted decoding."""
        if not self.code.shape[1]:
            return np.ones((len(x), len(self.langs)))
        margins = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.worth).sum(-1)
        spread = np.exp(-(loss - loss.min(1, keepdims=True)) * 2 / max(1, self.code.shape[1]) * len(self.langs))
        return spread / spread.sum(1, keepdims=True)


def fit(x: np.ndarray, y: list[str], steps: int = 150, penalty: float = 1e-5) -> Model:
    """Logistic classifiers of all bits together, by accelerated descent; languages weigh alike."""
    langs = sorted(set(y))
    code = codewords(len(langs))
    own = np.array([langs.index(v) for v in y], np.int64)
    target = code[own].astype(np.float32)
    share = (1.0 / np.bincount(own, minlength=len(langs)))[own][:, None].astype(np.float32) / max(1, len(langs))
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead, ahead_bias, rate = w.copy(), bias.copy(), 2.0
    for step in range(steps if code.shape[1] else 0):
        margin = x @ ahead + ahead_bias
        slope = -target * share / (1 + np.exp(np.clip(target * margin, -50, 50)))
        new, new_bias = ahead - rate * (x.T @ slope + penalty * ahead), ahead_bias - rate * slope.sum(0)
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias = new, new_bias
    right = ((x @ w + bias) * target > 0).mean(0) if len(x) else np.zeros(code.shape[1])
    worth = np.clip(2 * right - 1, 0.05, 1)
    return Model(langs, code, w, bias, worth / max(worth.sum(), 1e-9) * max(1, code.shape[1]))


def sample(docs: DataFrame, labelled: Column, key: str, text: str, lang: str, per_lang: int = SAMPLE, in_all: int = SAMPLE_ALL) -> tuple[np.ndarray, list[str]]:
    """Features and languages of the rows to fit on: those of lowest key hash, which thins each language to the bound.

    At most 2 * ``in_all`` rows leave Spark, whatever keys are repeated. Null texts count as empty, rows without a
    language aren't asked; no rows give no features.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [features(t).astype("<u2" if len(t or b"") < 60_000 else "<f4") for t in texts(batch, "text")]
            packed = [zlib.compress(x.tobytes(), 1) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.dtype.str for x in out], pa.string()), pa.array(packed, pa.binary())], ["lang", "kind", "x"])

    rows = docs.where(labelled & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 30)).alias("order"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return np.zeros((0, BUCKETS), np.float32), []
    each = min(per_lang, in_all // len(counts) or 1)
    limit = F.element_at(F.create_map(*(F.lit(v) for lang_n in counts.items() for v in (lang_n[0], int(2**30 * min(1.0, each / lang_n[1]))))), F.col("lang"))
    some = rows.where(F.col("order") <= limit).orderBy("order", F.xxhash64("text")).limit(2 * in_all).repartition(16)
    got = some.select("lang", "text").mapInArrow(run, "lang string, kind string, x binary").collect()
    got = sorted(sorted(got, key=lambda r: (zlib.crc32(r.x), r.x))[: 2 * in_all], key=lambda r: (r.lang, r.x))  # no language goes as a whole
    return np.array([np.frombuffer(zlib.decompress(r.x), r.kind).astype(np.float32) for r in got]).reshape(-1, BUCKETS), [r.lang for r in got]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of each row's whole text.

    A null text, and one without a letter, is ``und`` with score 0, and so is all if the model knows
    no language. Repeated rows come out as often; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x bits

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            langs, scores, leads = [], [], []
            listed = texts(batch, "text")
            for a in range(0, len(listed), 256):
                own = listed[a : a + 256]
                p = model.scores(unit(np.array([features(t) for t in own]))) if model.langs else np.zeros((len(own), 1))
                order = np.sort(p, 1)
                best = p.argmax(1)
                for k, t in enumerate(own):
                    known = bool(model.langs) and has_letter(t)
                    langs.append(model.langs[best[k]] if known else "und")
                    scores.append(float(p[k, best[k]]) if known else 0.0)
                    leads.append(not known or (p.shape[1] > 1 and float(order[k, -1] - order[k, -2]) < MARGIN))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.bool_())], ["key", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the rows that is never learnt from; a null key is held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x, y = sample(docs, ~held_out(), "doc_id", "text", "lang")
    out = predict(docs, fit(unit(x), y))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
