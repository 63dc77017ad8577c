"""Language ID by a byte convolutional network, trained here in numpy.

Bytes go through filters of several widths (a filter is a row of weights per
place and byte value), the largest response of each filter over a window is
kept, and a linear layer with softmax gives the languages' probabilities. A
text is cut into windows of a fixed number of bytes, all of it, and its score
is the mean of its windows' log-probabilities, weighted by length, normalised.

Training takes a bounded sample of rows: at most ``per_lang`` whole texts of each
language, and about ``SAMPLE_ROWS`` in all, those with the smallest hashes, and
one window of each text per epoch. Rows with crc32(doc_id) % 5 = 0 are held out
and never seen. Sums run in one order for every window, so a text's score does
not depend on the batch it is in.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows with a null lang aren't trained on; without any training row every text
is ``und``; rows repeated or tied get the same prediction; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 256
PER_LANG = 600
#: Rows of the sample: with more languages than SAMPLE_ROWS / PER_LANG each brings fewer, LEAST at least.
SAMPLE_ROWS, LEAST = 24_000, 8
#: With so many languages at most their limits (some 50 bytes each) are broadcast.
BROADCAST_LANGS = 20_000
EPOCHS = 12
UND = "und"


class ByteNet:
    """tables[w][j][byte]: what a byte at place j adds to the filters of width w."""

    def __init__(self, langs: list[str], widths=WIDTHS, filters: int = FILTERS, window: int = WINDOW, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.widths, self.window, self.filters = langs, widths, window, filters
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.out = rng.normal(0, 0.1, (filters * len(widths), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def responses(self, x: np.ndarray, pad: np.ndarray) -> list[np.ndarray]:
        """x: windows by bytes; pad: where bytes stand in for none. By width: windows, places, filters."""
        got = []
        for w, table in zip(self.widths, self.tables, strict=True):
            n = x.shape[1] - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : j + n]]
            r[pad[:, w - 1 :]] = -1e9
            got.append(r)
        return got

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 64, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, pad = self.cut([self._piece(texts[i], rng) for i in rows])
                y = labels[rows]
                pooled, where = [], []
                for r in self.responses(x, pad):
                    k = r.argmax(1)
                    where.append(k)
                    pooled.append(np.take_along_axis(r, k[:, None], 1)[:, 0])
                h = np.concatenate(pooled, 1)
                dead = h < -1e8
                act = np.where(dead, 0, np.tanh(h))
                p = self.softmax(act @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * np.where(dead, 0, 1 - act**2)
                grads = []
                for f, (w, table) in enumerate(zip(self.widths, self.tables, strict=True)):
                    g = np.zeros_like(table)
                    part = back[:, f * self.filters : (f + 1) * self.filters]
                    for j in range(w):
                        byte = np.take_along_axis(x, where[f] + j, 1)
                        np.add.at(g[j], (byte, np.arange(self.filters)[None, :]), part)
                    grads.append(g)
                grads += [act.T @ p, p.sum(0)]
                t += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    q -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def _piece(self, text: bytes, rng) -> bytes:
        at = int(rng.integers(0, max(1, len(text) - self.window + 1)))
        return text[at : at + self.window]

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts of at most a window each: bytes, and where there are none."""
        x = np.zeros((len(texts), self.window), np.uint8)
        size = np.array([len(s) for s in texts])
        for i, s in enumerate(texts):
            x[i, : len(s)] = np.frombuffer(s, np.uint8)
        return x, np.arange(self.window)[None, :] >= size[:, None]

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def compiled(self):
        """The same filters with two places in one lookup: tables by byte pair, for prediction."""
        pairs = []
        for w, t in zip(self.widths, self.tables, strict=True):
            steps = []
            for j in range(0, w - 1, 2):
                steps.append((j, (t[j][None, :, :] + t[j + 1][:, None, :]).reshape(65536, -1)))  # low byte first
            if w % 2:
                steps.append((w - 1, t[w - 1]))
            pairs.append((w, steps))
        return pairs

    def predict(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """data: bytes of all texts in a row; ends: from 0, one more than texts. Probabilities by text."""
        sizes = np.diff(ends)
        counts = np.maximum(1, -(-sizes // self.window))
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = ends[:-1][text] + nth * self.window
        size = np.minimum(self.window, ends[1:][text] - start)
        total = np.zeros((len(sizes), len(self.langs)))
        padded = np.concatenate([data, np.zeros(self.window, np.uint8)])
        tables = self.compiled_tables
        for at in range(0, len(text), 1024):
            s, n = start[at : at + 1024], size[at : at + 1024]
            x = padded[s[:, None] + np.arange(self.window)[None, :]]
            two = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
            short = np.flatnonzero(n < self.window)
            pooled = []
            for w, steps in tables:
                p = self.window - w + 1
                r = None
                for j, table in steps:
                    got = np.take(table, (two if len(table) > 256 else x)[:, j : j + p], axis=0)
                    r = got if r is None else np.add(r, got, out=r)
                for i in short:
                    r[i, max(0, n[i] - w + 1) :] = -1e9
                pooled.append(r.max(1))
            h = np.concatenate(pooled, 1)
            act = np.where(h < -1e8, 0, np.tanh(h)).astype(np.float64)
            z = np.broadcast_to(self.bias.astype(np.float64), (len(h), len(self.langs))).copy()
            for f in range(act.shape[1]):  # one filter after the other: no batch changes the order
                z += act[:, f, None] * self.out[f]
            np.add.at(total, text[at : at + 1024], np.log(self.softmax(z) + 1e-9) * np.maximum(n, 1)[:, None])
        return self.softmax(total / np.maximum(sizes, 1)[:, None] * np.minimum(counts, 4)[:, None])

    @property
    def compiled_tables(self):
        if not hasattr(self, "_compiled"):
            self._compiled = self.compiled()
        return self._compiled

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compiled"}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_language_net(docs: DataFrame, per_lang: int = PER_LANG, sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """Trains on a sample: of each language the ``per_lang`` whole texts with the smallest hashes, fewer where
    there are so many languages that they would be over ``sample_rows`` together."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").count()
    langs = counts.count()
    if not langs:
        return None
    per_lang = min(per_lang, max(LEAST, sample_rows // langs))
    # a hash threshold by language gives about per_lang rows; the smallest hashes of those are taken
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = counts.select("lang", F.least(F.lit(float(1 << 30)), F.lit(1.5 * per_lang * (1 << 30)) / F.col("count")).alias("_limit"))
    if langs <= BROADCAST_LANGS:  # texts stay where they are
        limit = F.broadcast(limit)
    near = rows.select("lang", "text", hashed.alias("_hash")).join(limit, "lang").filter(F.col("_hash") < F.col("_limit"))
    near = near.groupBy("lang", "_hash").agg(F.min("text").alias("text"))  # rows repeated whole count once
    by = Window.partitionBy("lang").orderBy("_hash", "text")
    sample = near.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= per_lang)
    got = sorted((r["lang"], r["_hash"], r["text"]) for r in sample.select("lang", "_hash", "text").collect())
    langs = sorted({r[0] for r in got})
    texts, labels = [], []
    for k, lang in enumerate(langs):
        own = [t.encode() for g, _, t in got if g == lang][:per_lang]
        own = [own[i % len(own)] for i in range(max(len(own), min(per_lang, 64)))]
        texts += own
        labels += [k] * len(own)
    net = ByteNet(langs)
    net.train(texts, np.array(labels))
    return net


def predict_language(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with lang_pred and score; the text alone decides."""
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches):
        import pyarrow.compute as pc

        from .common import by_bytes

        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 4 << 20):
                letters = pc.match_substring_regex(texts, "\\pL").to_numpy(zero_copy_only=False)
                ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
                if net is None:
                    names, score = [UND] * len(texts), np.zeros(len(texts))
                else:
                    p = net.predict(data, ends - ends[0])
                    best = p.argmax(1)
                    names = [net.langs[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, p[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(score.astype(np.float64))], names=[*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    net = fit_language_net(docs, **options)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(rows, net).drop("text")


#: Rejected: no language, or a score below this.
LEAST_SCORE = 0.5


def keep_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least`` as score."""
    net = fit_language_net(docs)
    clash = {"lang_pred", "score"} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    kept = predict_language(renamed, net).filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
