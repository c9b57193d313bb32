"""Language ID: a byte convolutional network, trained in numpy on a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .words import give_back

WINDOW = 256  # bytes the network reads at once
EMBED, FILTERS, WIDTHS = 8, 24, (2, 3, 4)  # floats a byte; filters of each width, in bytes
SAMPLE = 6000  # windows to learn from, shared equally among the languages
STEPS, BATCH, RATE = 600, 128, 4e-3
ROWS = 128  # windows in one matrix product
UNKNOWN = "und"


@dataclass(frozen=True)
class ByteConvNet:
    """Byte embedding, filters of several widths over it, the maximum of each over the window, softmax."""

    langs: tuple[str, ...]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # max(WIDTHS) * EMBED x filters; a narrow filter is zero beyond its width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, wide - 1)))
        x = self.embed[padded]
        n, length = windows.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length, wide * EMBED), (s[0], s[1], s[2])).reshape(n * length, -1)

    def pooled(self, windows: np.ndarray, where: bool = False):
        cols = self.columns(windows)
        out = (cols @ self.conv).reshape(*windows.shape, -1)
        at = out.argmax(axis=1) if where else None
        top = np.maximum((out.max(axis=1) if at is None else np.take_along_axis(out, at[:, None], 1)[:, 0]) + self.bias, 0)
        return (top, at, cols) if where else top

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _filters_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask


def _as_windows(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(samples: list[tuple[str, str]], seed: int = 1) -> ByteConvNet:
    """A network from (text, language) pairs.  Adam, softmax loss; half of the windows are cut short at random, so
    that short texts are known too.  Without samples the network knows no language."""
    rng = np.random.default_rng(seed)
    langs = tuple(sorted({lang for _, lang in samples}))
    x = np.concatenate([_as_windows(t.lower().encode()[:WINDOW])[:1] for t, _ in samples]) if samples else np.zeros((0, WINDOW), np.uint8)
    y = np.array([langs.index(lang) for _, lang in samples], dtype=np.int64)
    mask = _filters_mask()
    f = mask.shape[1]
    p = [rng.normal(0, 0.3, (256, EMBED)), rng.normal(0, 0.2, mask.shape) * mask, np.zeros(f), rng.normal(0, 0.1, (f, len(langs))), np.zeros(len(langs))]
    p = [a.astype(np.float32) for a in p]
    p[0][0] = 0
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, 1 + STEPS if len(langs) > 1 else 1):
        pick = rng.integers(0, len(y), BATCH)
        w = x[pick].copy()
        keep = np.where(rng.random(len(pick)) < 0.5, WINDOW, rng.integers(20, WINDOW + 1, len(pick)))
        w[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
        net = ByteConvNet(langs, *p)
        top, at, cols = net.pooled(w, where=True)
        z = top @ p[3] + p[4]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(len(pick)), y[pick]] -= 1
        dz /= len(pick)
        dtop = (dz @ p[3].T) * (top > 0)
        rows = (np.arange(len(pick))[:, None] * WINDOW + at)  # only the place of each maximum learns
        seen = cols[rows]  # batch x filters x columns
        dconv = np.einsum("nf,nfc->cf", dtop, seen) * mask
        dcols = dtop[:, :, None] * p[1].T[None]
        dembed = np.zeros_like(p[0])
        padded = np.pad(w, ((0, 0), (0, max(WIDTHS) - 1)))
        for j in range(max(WIDTHS)):
            np.add.at(dembed, padded[np.arange(len(pick))[:, None], at + j], dcols[:, :, j * EMBED:(j + 1) * EMBED])
        dembed[0] = 0
        for i, g in enumerate((dembed, dconv, dtop.sum(0), top.T @ dz, dz.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = (p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteConvNet(langs, *p)


def held_out(id_col: str) -> Column:
    """True for the rows that no model learns from; a null id is not among them, and is not learnt from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    size: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``size`` (window, language) pairs, the same share of each language; the bound is on what the driver gets.

    Rows come by a hash of id and text, one window of a row, at a place that the hash picks.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), held_out(id_col).alias("h"))
    known = known.where("not h and i is not null and l is not null and t is not null and t != ''")
    counts = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if not counts:
        return []
    each = size / len(counts)
    share = F.coalesce(*[F.when(F.col("l") == lang, F.lit(min(1.0, each / n))) for lang, n in sorted(counts.items())])
    mix = F.xxhash64("i", "t")
    drawn = known.where(F.pmod(mix, F.lit(1 << 24)) < share * (1 << 24))
    place = F.pmod(F.shiftright(mix, 24), F.greatest(F.lit(1), F.char_length("t") - WINDOW + 1)).cast("int") + 1
    rows = drawn.select(F.substring("t", place, F.lit(WINDOW)).alias("w"), "l").limit(2 * size).collect()
    return sorted((r[0], r[1]) for r in rows)


def _blocks(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of whole texts, ROWS at a time: (text number, window, bytes in it)."""
    who, data, size, n = [], [], [], 0
    for i, t in enumerate(texts):
        raw = t.lower().encode()
        for a in range(0, max(1, len(raw)), ROWS * WINDOW):
            part = raw[a:a + ROWS * WINDOW]
            w = _as_windows(part)
            who.append(np.full(len(w), i))
            data.append(w)
            size.append(np.minimum(WINDOW, len(part) - WINDOW * np.arange(len(w))))
            n += len(w)
            if n >= ROWS:
                yield np.concatenate(who), np.concatenate(data), np.concatenate(size)
                who, data, size, n = [], [], [], 0
    if n:
        yield np.concatenate(who), np.concatenate(data), np.concatenate(size)


def predict(text: Column, net: ByteConvNet) -> Column:
    """Struct ``(lang_pred, score)``: the network's mean probabilities over all windows of the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if the network knows no language.  Of equally
    likely languages the first by name is taken.
    """
    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("")
        total, weight = np.zeros((len(texts), max(1, len(net.langs)))), np.zeros(len(texts))
        if net.langs:
            for who, windows, size in _blocks(texts):
                probs = net.probabilities(windows)
                np.add.at(total, who, probs * size[:, None])
                np.add.at(weight, who, size)
        give_back()
        mean = total / np.maximum(weight, 1)[:, None]
        best = mean.argmax(axis=1)
        lettered = np.array([bool(net.langs) and any(map(str.isalpha, t)) for t in texts], bool)
        names = np.array([*net.langs, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": np.where(lettered, names[best], UNKNOWN),
                             "score": np.where(lettered, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)})

    return of(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each row of ``docs``.

    Learns from at most about ``SAMPLE`` labelled rows that are not held out; only the text is an input of a
    prediction.  Rows with a null id are predicted, not learnt from.
    """
    net = train(training_sample(docs, id_col, text_col, lang_col))
    told = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col), net).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose language is not told: ``und``, or a score under ``min_score``."""
    net = train(training_sample(docs, id_col, text_col, lang_col))
    told = docs.select(F.struct("*").alias("row"), predict(F.col(text_col), net).alias("p"))
    return told.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score)).select("row.*")
