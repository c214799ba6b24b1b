"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter's largest response
in a window is kept, and a softmax over those gives the window's languages. A text is cut into windows from end to
end; its prediction is the mean of its windows' log-probabilities weighted by their bytes. Short windows are padded
with the zero byte, whose embedding is fixed at zero.

Training takes the SAMPLE_DOCS labelled documents with the smallest seeded keys, up to EACH_DOCS of every label
besides (SAMPLE_DOCS in all, so that a rare language is learned too), and of each at most SAMPLE_WINDOWS windows at
seeded places; all three are parameters. Prediction takes every window of every text.

Edge cases: a null text or one without any letter is ``und`` with score 1; an id may be null or repeated; without
labelled rows every text with letters is ``und`` with score 0. An empty table gives an empty result. Only the
text is read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import fresh, given_back, seeded_key, settled, slices, small_batches

WINDOW, EMBED, FILTERS, WIDTHS = 256, 6, 12, (2, 3, 4, 5)
#: Bounds of the training sample: documents with the smallest keys, documents of every label besides, windows of each.
SAMPLE_DOCS, EACH_DOCS, SAMPLE_WINDOWS = 2_000, 32, 2
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNKNOWN = "und"


def window_rows(raw: bytes) -> np.ndarray:
    """A text's bytes as rows of WINDOW, the last padded with zeros."""
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # widest*EMBED x len(WIDTHS)*FILTERS; zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        widest, n = max(WIDTHS), len(WIDTHS) * FILTERS
        net = cls(labels, rng.normal(0, 0.5, (256, EMBED)).astype("f4"), rng.normal(0, 0.3, (widest * EMBED, n)).astype("f4"), np.zeros(n, "f4"), rng.normal(0, 0.1, (n, len(labels))).astype("f4"), np.zeros(len(labels), "f4"))
        net.embed[0] = 0
        net.kernel *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """1 where a filter of its width reaches."""
        reach = np.repeat(WIDTHS, FILTERS)
        return (np.arange(max(WIDTHS) * EMBED)[:, None] < reach[None, :] * EMBED).astype("f4")

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """rows x places x (widest * EMBED): the embedded bytes that each place's filters see."""
        widest = max(WIDTHS)
        flat = self.embed[windows].reshape(len(windows), -1)
        flat = np.pad(flat, ((0, 0), (0, (widest - 1) * EMBED)))
        step = flat.strides[1]
        return np.lib.stride_tricks.as_strided(flat, (len(windows), WINDOW, widest * EMBED), (flat.strides[0], EMBED * step, step))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses, their places, and what the filters saw."""
        seen = np.ascontiguousarray(self._columns(windows)).reshape(len(windows) * WINDOW, -1)
        answers = (seen @ self.kernel).reshape(len(windows), WINDOW, -1)
        return answers.max(axis=1), answers, seen

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        top, _, _ = self.pooled(windows)
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, truth: np.ndarray, labels: list[str], seed: int = 3) -> Network:
    """A network fitted by Adam to windows and the indexes of their labels."""
    net = Network.fresh(labels, seed)
    rng = np.random.default_rng(seed)
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    mask, widest, step = net.mask(), max(WIDTHS), 0
    weight = len(truth) / np.maximum(np.bincount(truth, minlength=len(labels)), 1) / len(labels)
    for _ in range(EPOCHS):
        order = rng.permutation(len(truth))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            x, y = windows[rows], truth[rows]
            top, answers, seen = net.pooled(x)
            places = answers.argmax(axis=1)
            active = np.maximum(top + net.bias, 0)
            z = active @ net.out + net.out_bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None]
            back = (p @ net.out.T) * (active > 0)
            seen = seen.reshape(len(x), WINDOW, -1)
            at = seen[np.arange(len(x))[:, None], places]  # rows x filters x (widest*EMBED)
            grad = {"out": active.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0), "kernel": np.einsum("rf,rfk->kf", back, at) * mask}
            to_bytes = (back[:, :, None] * net.kernel.T[None]).reshape(len(x), -1, widest, EMBED)
            which = np.minimum(places[:, :, None] + np.arange(widest), WINDOW - 1)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], x[np.arange(len(x))[:, None, None], which], to_bytes)
            grad["embed"][0] = 0
            step += 1
            for k in names:
                g = grad[k].astype("f4")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                getattr(net, k)[...] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves no rest by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 3, sample_docs: int = SAMPLE_DOCS, each_docs: int = EACH_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Trains on the bounded sample; None without labelled rows."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    small_batches(docs)
    labelled = own.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # Ids are chosen before any text moves: the smallest keys of all, and for every label those of each_docs slots.
    keyed = labelled.select("id", "lang", seeded_key(seed, F.col("id")).alias("key"))
    slots = keyed.groupBy("lang", F.pmod("key", F.lit(each_docs)).alias("slot")).agg(F.min_by("id", "key").alias("id"))
    own_share = slots.orderBy("slot", "lang").limit(sample_docs).select("id")
    chosen = settled(keyed.orderBy("key", "id").limit(sample_docs).select("id").union(own_share).distinct())
    rows = labelled.join(F.broadcast(chosen), "id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sampled_windows(batches, sample_windows)

    # The windows are cut before the rows come to the driver: at most 2 * sample_docs * sample_windows windows arrive.
    labels, windows, rng = [], [], np.random.default_rng(seed)
    for row in rows.mapInArrow(cut, "lang string, window binary").toLocalIterator():
        if len(labels) == 2 * sample_docs * sample_windows:
            break
        labels.append(row["lang"])
        windows.append(np.frombuffer(row["window"], np.uint8))
    if not labels:
        return None
    names = sorted(set(labels))
    order = rng.permutation(len(labels))
    index = {name: i for i, name in enumerate(names)}
    return train(np.stack(windows)[order], np.array([index[x] for x in labels])[order], names, seed)


def _sampled_windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        langs, windows = [], []
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cut = window_rows(text.encode())
            rng = np.random.default_rng(len(text))
            for i in rng.permutation(len(cut))[:most]:
                langs.append(lang)
                windows.append(cut[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "window"])


def predict_batch(net: Network | None, texts: list[str | None], lettered: list[bool]) -> tuple[list[str], list[float]]:
    """Languages and scores of whole texts; windows of many texts go through the network together."""
    cut = [window_rows(t.encode()) if ok and net else np.zeros((0, WINDOW), np.uint8) for t, ok in zip(texts, lettered, strict=True)]
    counts = [len(c) for c in cut]
    sums: list[np.ndarray] = []
    if sum(counts):
        rows = np.concatenate(cut)
        filled = (rows != 0).sum(axis=1)
        scores = np.concatenate([net.log_probabilities(rows[a : a + 256]) for a in range(0, len(rows), 256)]) * filled[:, None]
        ends = np.cumsum(counts)
        for n, to in zip(counts, ends, strict=True):
            sums.append(scores[to - n : to].sum(axis=0) / max(filled[to - n : to].sum(), 1) if n else np.zeros(0))
    else:
        sums = [np.zeros(0)] * len(texts)
    langs, best = [], []
    for s, ok in zip(sums, lettered, strict=True):
        if not ok or not len(s):
            langs.append(UNKNOWN)
            best.append(0.0 if ok else 1.0)
        else:
            p = np.exp(s - s.max())
            i = int(p.argmax())
            langs.append(net.labels[i])
            best.append(float(min(1.0, p[i] / p.sum())))
    return langs, best


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            langs, scores = predict_batch(sent.value, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains and predicts: doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def with_language(docs: DataFrame, least_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", renewed: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns kept; ``und`` and lower scores go.

    With no labelled row to learn from every text with a letter stays. At the default ``least_score`` that is the
    outcome of the network too, which names a language for each such text. With ``renewed`` the column of languages holds
    what was predicted (``und`` with no row to learn from), whatever stood there.

    The decision runs on the rows themselves, so no join by id is needed and repeated rows are decided one by one.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    @F.pandas_udf("string")
    def accepted(texts, lettered):
        """The language; null for texts that go."""
        import pandas as pd

        if net.value is None:
            return pd.Series([UNKNOWN if ok else None for ok in lettered], dtype=object)
        langs, scores = [], []
        for a in range(0, len(texts), 256):
            got = predict_batch(net.value, texts[a : a + 256].tolist(), lettered[a : a + 256].tolist())
            langs += got[0]
            scores += got[1]
        given_back()
        return pd.Series([x if x != UNKNOWN and s >= least_score else None for x, s in zip(langs, scores, strict=True)], dtype=object)

    text = F.coalesce(F.col(text_col), F.lit(""))
    (name,) = fresh(docs.columns, "found")
    # Not deterministic to the planner, which else works it out for the filter and for the column.
    found = docs.withColumn(name, accepted.asNondeterministic()(text, text.rlike("\\p{L}"))).filter(F.col(name).isNotNull())
    return (found.withColumn(lang_col, F.col(name)) if renewed else found).drop(name)
