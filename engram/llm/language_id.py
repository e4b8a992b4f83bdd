"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of language masks stands for one Bloom filter per language: bit l of a position is language
l's filter bit, so ANDing the masks at an n-gram's positions returns all languages that contain it at once.
A document's popcount per language, less what that filter's false positives would give, decides.

Which n-grams a filter holds is counted over all training text (counting filters of fixed size, summed
over partitions): an n-gram's bit is set for the languages in which its rate is within ``share`` of
the highest. Sizes are fixed by parameters, so nothing that reaches the driver grows with the input.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text whose n-grams are all
unknown gets the most frequent learned language with score 0; nothing learned: ``und``; rows with null or
empty lang teach nothing; languages that tie: the first by name; repeated rows teach each time and are judged each on its own;
an empty table gives an empty result; very long texts are read whole, in parts cut between words; columns that are named
like a result are replaced by it. More than ``MAX_LANGUAGES`` different values of lang are an error, as each costs filters of a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, runs, strings, summed, table, tidy

UND, MAX_LANGUAGES = "und", 1000
_SPACE = 32
_is_letter = np.zeros(1 << 16, bool)


def _letters() -> np.ndarray:
    if not _is_letter[65]:
        _is_letter[:] = [chr(i).isalpha() for i in range(1 << 16)]
    return _is_letter


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two filter positions of each letter trigram (other characters are one blank), and each text's first trigram."""
    text = " ".join(t.lower() for t in texts)
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(code < 1 << 16, _letters()[np.minimum(code, (1 << 16) - 1)], True)
    code = np.where(letter, code, _SPACE).astype(np.uint32)
    h = code[:-2] * np.uint32(0x9E3779B1) ^ (code[1:-1] * np.uint32(0x85EBCA6B) + (code[2:] * np.uint32(0xC2B2AE35) << np.uint32(7)))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    keep = np.flatnonzero(letter[1:-1])
    h = h[keep]
    at = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    starts = np.searchsorted(keep, at)
    return h >> np.uint32(32 - bits), (h * np.uint32(0x846CA68B)) >> np.uint32(32 - bits), starts


def _sliced(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(row, parts) in parts of at most about ``most`` characters. A long text is cut at characters that aren't letters, where no
    trigram reads across, so the parts hold the same trigrams as the whole; in a longer run of letters the cut falls inside."""
    for i, t in enumerate(texts):
        out, at = [], 0
        while len(t) - at > most:
            end = next((k for k in range(at + most, at + most // 2, -1) if not t[k - 1].isalpha()), at + most)
            out.append(t[at:end])
            at = end
        yield i, [*out, t[at:]]


class Model:
    """masks[p, w]: languages 64 w .. 64 w + 63 at position p; false_rate: each language's false-positive rate."""

    def __init__(self, langs: list[str], first: np.ndarray, second: np.ndarray, share: float, bits: int, prior: int):
        self.langs, self.bits, self.prior = langs, bits, prior
        words = max(1, math.ceil(len(langs) / 64))
        self.masks, fill = [], []
        for counts in (first, second):  # [language, position]
            rate = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            held = (counts > 0) & (rate >= share * rate.max(0, initial=0, keepdims=True))
            mask = np.zeros((1 << bits, words), np.uint64)
            for k in range(len(langs)):
                mask[:, k // 64] |= held[k].astype(np.uint64) << np.uint64(k % 64)
            self.masks.append(mask)
            fill.append(held.mean(1))
        self.false_rate = fill[0] * fill[1] if langs else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Per text and language: the share of n-grams in the filter beyond false positives."""
        out = np.zeros((len(texts), len(self.langs)))
        p, q, starts = grams(texts, self.bits)
        n = np.diff(starts)
        for k in range(len(self.langs)):
            both = (self.masks[0][p, k // 64] & self.masks[1][q, k // 64]) >> np.uint64(k % 64) & np.uint64(1)
            total = np.concatenate(([0], np.cumsum(both, dtype=np.int64)))
            hits = total[starts[1:]] - total[starts[:-1]]
            out[:, k] = np.maximum(0, hits - n * self.false_rate[k]) / (1 - min(0.99, self.false_rate[k]))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        votes, lettered = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        flat = [(i, part) for i, parts in _sliced(texts) for part in parts]
        for a, b in runs([len(t) for _, t in flat], 1_000_000):
            rows = np.array([i for i, _ in flat[a:b]])
            np.add.at(votes, rows, self.score([t for _, t in flat[a:b]]))
        for i, t in enumerate(texts):
            lettered[i] = any(map(str.isalpha, t))
        names, scores = [], []
        for i in range(len(texts)):
            if not lettered[i] or not self.langs:
                names.append(UND)
                scores.append(0.0)
                continue
            total, best = votes[i].sum(), int(votes[i].argmax())
            names.append(self.langs[best] if total > 0 else self.langs[self.prior])
            scores.append(float(votes[i, best] / total) if total > 0 else 0.0)
        return names, scores


def train(rows: DataFrame, *, bits: int = 16, share: float = 0.4, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Count the n-grams of all ``rows`` by language and build the filters. ``max_languages``: more different values are an error."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and lang <> ''")
    langs = [r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} different values of {lang_col}: clean the column or raise max_languages")
    index, size = {x: i for i, x in enumerate(langs)}, 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list[str]] = {}
            for text, lang in zip(strings(b, "text"), b.column("lang").to_pylist(), strict=True):
                by.setdefault(index[lang], []).append(text)
            for k, texts in by.items():
                flat = [part for _, parts in _sliced(texts) for part in parts]
                for x, y in runs(map(len, flat), 1_000_000):
                    p, q, _ = grams(flat[x:y], bits)
                    counts = held.setdefault(k, np.zeros(2 * size, np.int64))
                    counts[:size] += np.bincount(p, minlength=size)
                    counts[size:] += np.bincount(q, minlength=size)
        part = TaskContext.get().partitionId()
        for k, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "part", "payload"])

    got = summed(rows.mapInArrow(tidy(run), "chunk int, part int, payload binary"), "<i8") if langs else {}
    counts = np.stack([got.get(k, np.zeros(2 * size, np.int64)) for k in range(len(langs))]) if langs else np.zeros((0, 2 * size), np.int64)
    prior = int(counts.sum(1).argmax()) if langs else 0
    return Model(langs, counts[:, :size], counts[:, size:], share, bits, prior)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` (without the text) with lang_pred and score; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    docs = docs.select(*names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(strings(b, text_col))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
