"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, in_sample, small_batches

#: Fitting reads about so many documents of each language, picked by the hash of their ids.
SAMPLE = 600
#: Features: hashed byte n-grams, n = 1 to 4.
FEATURES = 1 << 13
ORDERS = (1, 2, 3, 4)
CENTROIDS = 4
#: A text is rejected if its cosine to the nearest centroid is below that of all but this share of the fitting texts, less a margin.
REJECT_SHARE = 0.002
REJECT_MARGIN = 0.6
#: Sharpness with which cosines become a score.
SHARPNESS = 20.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_STEP = 1 << 20


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of the letters of ``text``, lower-cased, with a space between words."""
    data = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(FEATURES)
    for at in range(0, len(data), _STEP):  # bounded memory for very long texts; the steps overlap by the longest n-gram less one
        part = data[at : at + _STEP + max(ORDERS) - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] if n > 1 else part
            own = code[:_STEP]
            out += np.bincount((((own + np.uint32(n * 7919)) * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64), minlength=FEATURES)
    return out


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    languages: tuple[str, ...]
    floor: float

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.array([gram_counts(t) for t in texts]).reshape(-1, FEATURES)
        np.log1p(x, out=x)
        x *= self.idf
        return unit(x)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (0 to 1), cosine to the nearest centroid and whether it is rejected, of each text."""
        lang, score, cosine = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        at = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        if at and self.languages:
            near = self.vectors([texts[k] for k in at]) @ self.centroids.T
            by_lang = np.stack([near[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)
            best = by_lang.argmax(1)
            top = by_lang[np.arange(len(at)), best]
            for k, b in zip(at, best):
                lang[k] = self.languages[b]
            score[at] = 1 / np.exp(SHARPNESS * (by_lang - top[:, None])).sum(1)
            cosine[at], rejected[at] = top, top < self.floor
        return lang, score, cosine, rejected


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


def pack(counts: np.ndarray) -> bytes:
    """A text's counts as bytes: the features it has, then how often."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.float32).tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), FEATURES), np.float32)
    for row, data in zip(out, packed):
        n = len(data) // 6
        row[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float32, n, 2 * n)
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows; starts from the row nearest the mean, then from the rows farthest from the starts."""
    starts = [int((x @ x.mean(0)).argmax())]
    while len(starts) < min(k, len(x)):
        starts.append(int((x @ x[starts].T).max(1).argmin()))
    centres = x[starts]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = unit(np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit_packed(rows: dict[str, list[bytes]]) -> LanguageModel:
    """The model of each language's packed counts; one language at a time is dense."""
    languages = tuple(sorted(y for y in rows if rows[y]))
    if not languages:
        return LanguageModel(np.ones(FEATURES), np.zeros((0, FEATURES)), np.zeros(0, int), (), 0.0)
    seen = sum(np.count_nonzero(unpack(rows[y]), axis=0) for y in languages)
    idf = (np.log((1 + sum(len(rows[y]) for y in languages)) / (1 + seen)) + 1).astype(np.float32)

    def vectors(y: str) -> np.ndarray:
        x = unpack(rows[y])
        np.log1p(x, out=x)
        x *= idf
        return unit(x)

    centres = [cluster(vectors(y), CENTROIDS) for y in languages]
    owner = np.concatenate([np.full(len(c), k) for k, c in enumerate(centres)])
    model = LanguageModel(idf.astype(float), np.concatenate(centres).astype(float), owner, languages, 0.0)
    own = np.concatenate([(vectors(y) @ np.concatenate(centres).T).max(1) for y in languages])
    return replace(model, floor=float(np.quantile(own, REJECT_SHARE)) * REJECT_MARGIN)


def fit_texts(rows: list[tuple[str, str]]) -> LanguageModel:
    """The model of (text, lang) rows."""
    packed: dict[str, list[bytes]] = {}
    for t, y in rows:
        if t is not None and y is not None and _LETTER.search(t):
            packed.setdefault(y, []).append(pack(gram_counts(t)))
    return fit_packed(packed)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of about ``sample`` documents of each language (all, if it has fewer).

    Rows with crc32(id) mod 4 = 2 or without text or lang are not read for it; of rows with the same
    id and lang one counts. Languages are counted, then ids are picked by their hash, so nothing is
    ranked in one task. Texts are counted where they are; the driver receives packed counts, at most
    48 kB each whatever the texts' lengths, and never a text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (crc_of_id(F.col("id")) % 4 != 2))
    per_lang = {y: n for y, n in rows.groupBy("lang").count().collect()}

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([pack(gram_counts(t)) if isinstance(t, str) and _LETTER.search(t) else None for t in some], dtype="object")

    chosen = rows.where(in_sample(F.col("id"), F.col("lang"), per_lang, sample) & F.col("text").isNotNull())
    got = chosen.select("id", "lang", F.pandas_udf(count, "binary")("text").alias("packed")).groupBy("id", "lang").agg(F.min("packed").alias("packed"))
    packed: dict[str, list[bytes]] = {}
    for _, lang, data in got.collect():
        if data is not None:
            packed.setdefault(lang, []).append(bytes(data))
    return fit_packed({y: sorted(v) for y, v in packed.items()})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cosine and rejected (a struct column ``language``).

    Null texts and texts without a letter get ``und``, score 0 and are rejected; so is everything if
    nothing could be learned. Whole texts are read, in bounded steps. Rows and other columns stay
    as they are, but that a column ``language`` of ``docs`` is replaced; no shuffle.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            parts = []
            for at in range(0, max(1, len(some)), 64):
                found = held.value.predict([t if isinstance(t, str) else None for t in some.iloc[at : at + 64]])
                parts.append(pd.DataFrame(dict(zip(("lang_pred", "score", "cosine", "rejected"), found))))
            yield pd.concat(parts, ignore_index=True)

    language = F.pandas_udf(run, "lang_pred string, score double, cosine double, rejected boolean")
    return docs.withColumn("language", language(F.col(text_col)))
