"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of three letters in a row is
the product of their vectors, rotated by their place. A document is the sum of the
vectors of all its letter triples, a language that of its labelled documents, and the
language whose sum has the largest cosine with the document's is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import SLICE_BYTES, give_back, prepared, slices
from volscribe.session import broadcast_if_small, written

DIMENSIONS = 1024
UNKNOWN = "und"
# About the cosine of two random vectors of so many dimensions.
LEAST_SCORE = 0.03
# The share of a length's labelled documents that lies below the score its least one is
# learned from, what part of that score is asked for, and the decimals scores are counted by.
FIT_SHARE, FIT_PART, FIT_DECIMALS = 0.005, 0.5, 4
# Fewer documents of a length say nothing about it.
FIT_LEAST = 50
_CODE_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class LetterVectors:
    """Vectors of the letters met so far, and of triples of them."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.row = np.full(0x110000, -1, np.int32)
        # Row 0 stands for what separates words.
        self.row[0] = 0
        self.vectors = self._of(0)[None]

    def _of(self, code: int) -> np.ndarray:
        bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
        return bits * np.int8(2) - np.int8(1)

    def triples(self, keys: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 for each key of three code points."""
        mask = (1 << _CODE_BITS) - 1
        parts = [(keys >> (2 * _CODE_BITS)) & mask, (keys >> _CODE_BITS) & mask, keys & mask]
        codes = np.unique(np.concatenate(parts))
        if len(new := codes[self.row[codes] < 0]):
            self.row[new] = len(self.vectors) + np.arange(len(new))
            self.vectors = np.vstack([self.vectors, *(self._of(c)[None] for c in new.tolist())])
        a, b, c = (self.row[p] for p in parts)
        return np.roll(self.vectors, 2, 1)[a] * np.roll(self.vectors, 1, 1)[b] * self.vectors[c]


def letter_triples(text: str) -> np.ndarray:
    """Keys of all runs of three code points, with every run of other characters as one separator.

    The text is lower-cased and has a separator at both ends. No letters, no keys.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.r_[0, np.where(letter, codes, 0), 0].astype(np.int64)
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    return (codes[:-2] << (2 * _CODE_BITS)) | (codes[1:-1] << _CODE_BITS) | codes[2:]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def bundled(vectors: LetterVectors, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the keys' vectors times their counts, in blocks of bounded size."""
    out = np.zeros(vectors.dimensions)
    for low in range(0, len(keys), 4096):
        out += counts[low : low + 4096].astype(np.float64) @ vectors.triples(keys[low : low + 4096])
    return out


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """The profile of each language: the sum over all documents (text, lang) that name it.

    Documents without lang are left out. A task adds up its own documents and sends one
    vector for each language; the sums of whole numbers are the same in any order. What
    reaches the driver is one vector for each value of lang, whatever the number of rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = LetterVectors(dimensions, seed), {}
        for part in slices(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(letter_triples(text))
            for lang, found in by_lang.items():
                if len(keys := np.concatenate(found)):
                    total[lang] = total.get(lang, 0) + bundled(vectors, *_counted(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
            ["lang", "sums"],
        )

    narrow = docs.where("lang is not null and text is not null").select("lang", "text")
    parts = narrow.mapInArrow(sums, "lang string, sums array<double>")
    cells = parts.select("lang", F.posexplode("sums").alias("place", "value")).groupBy("lang", "place")
    rows = (
        cells.agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("profile"))
        .toLocalIterator()
    )
    return {r["lang"]: np.array(r["profile"]) for r in rows}


class Judge:
    """Predicts the language of texts by the cosines of their sums with the profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], dimensions: int, seed: int):
        self.names = sorted(profiles)
        matrix = np.array([profiles[n] for n in self.names], np.float32).reshape(len(self.names), dimensions)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = (matrix / np.where(length, length, 1)).T.copy()
        self.dimensions, self.seed = dimensions, seed
        self.vectors: LetterVectors | None = None

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its cosine, from 0 to 1, of each text."""
        return self.sized(texts)[:2]

    def sized(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """The language, its cosine and the number of letter triples of each text."""
        if self.vectors is None:  # made on the executor
            self.vectors = LetterVectors(self.dimensions, self.seed)
        names = self.names
        found = [_counted(k) if len(k := letter_triples(t or "")) else None for t in texts]
        sums = np.zeros((len(found), self.dimensions), np.float32)
        known = [f[0] for f in found if f is not None]
        every = np.unique(np.concatenate(known)) if known and names else np.empty(0, np.int64)
        for low in range(0, len(every), 4096):
            block = every[low : low + 4096]
            rows = self.vectors.triples(block).astype(np.float32)
            for k, one in enumerate(found):
                if one is not None:
                    i, j = np.searchsorted(one[0], (block[0], block[-1] + 1))
                    sums[k] += one[1][i:j].astype(np.float32) @ rows[np.searchsorted(block, one[0][i:j])]
        cosines = (sums @ self.matrix) / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        judged = [f is not None and bool(names) for f in found]
        best = np.argmax(cosines, axis=1) if names else []
        labels = [names[best[k]] if ok else UNKNOWN for k, ok in enumerate(judged)]
        scores = [min(1.0, max(0.0, float(cosines[k, best[k]]))) if ok else 0.0 for k, ok in enumerate(judged)]
        return labels, scores, [0 if f is None else int(f[1].sum()) for f in found]


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred and score, the cosine from 0 to 1, of every document (doc_id, text).

    A null text, one without letters, or no profiles at all: ``und`` with score 0. Of
    equal cosines the first language in order wins. Whole texts are read; repeated rows
    are each predicted. Nothing is shuffled.
    """
    judge = Judge(profiles, dimensions, seed)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES // 2):
            labels, scores = judge(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")


def size_class(triples: int) -> int:
    """Texts with up to twice as many triples are in the same class."""
    return max(triples, 1).bit_length()


def fit_least(scored: DataFrame) -> dict[int, float]:
    """The least score that a text of each size class must have to be in a known language.

    Scores rise with the number of triples, towards 1 for thousands of them; what is in
    no known language stays near 0.1 however long it is. So each class asks for a part
    of what all but a few of its labelled documents reach. All rows of ``scored`` (size,
    score) count, by their scores to FIT_DECIMALS places, so that a class has a bounded
    number of them; classes with few rows ask for what the next smaller one does, the
    smallest for LEAST_SCORE.
    """
    found = scored.where("score > 0").groupBy("size", F.round("score", FIT_DECIMALS).alias("score")).agg(F.count("*").alias("n"))
    low = F.percentile("score", F.lit(FIT_SHARE), F.col("n")).alias("low")
    rows = found.groupBy("size").agg(F.sum("n").alias("n"), low).where(F.col("n") >= FIT_LEAST)
    # One row for each power of two.
    known, least, asked = {r["size"]: max(LEAST_SCORE, FIT_PART * r.low) for r in rows.toLocalIterator()}, {}, LEAST_SCORE
    for size in range(64):
        least[size] = asked = known.get(size, asked)
    return least


def accepted(docs: DataFrame) -> DataFrame:
    """Those rows of ``docs`` (doc_id, text, lang, ...) whose text is in one of the languages, with all their columns.

    Rejected are texts that are null or have no letter, and those whose best cosine is
    below what ``fit_least`` learned for their number of letter triples: random letters,
    and languages that no document is labelled with. Very short texts can hardly be
    told, and stay. Equal texts are judged alike. Without profiles there is nothing to
    judge by, and all with letters stay; an empty table stays empty. Rejected texts are named
    by their SHA-256, which is broadcast if it measures small; else Spark shuffles both sides.
    """
    learned = ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    text = F.col("text").cast("string")
    judge = Judge(fit_profiles(docs.where(learned).select("lang", text.alias("text"))), DIMENSIONS, 7)

    @F.pandas_udf("size int, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple[int, float]] = []
        sizes = texts.fillna("").str.len().cumsum() // (SLICE_BYTES // 2)
        for _, part in texts.groupby(sizes.to_numpy(), sort=False):
            own = [None if t is None else t for t in part]
            if judge.names:
                _, scores, numbers = judge.sized(own)
                out += [(size_class(n), s) for n, s in zip(numbers, scores, strict=True)]
            else:
                out += [(0, float(len(letter_triples(t or "")) > 0)) for t in own]
        give_back()
        return pd.DataFrame(out, columns=["size", "score"]).astype({"size": "int32", "score": "float64"})

    name = "rejected text"
    while name in docs.columns:
        name += "_"
    # Each text is judged once. Stored are its digest and score, as the texts themselves would be the input once more.
    digest = F.unhex(F.sha2(text, 256))
    scored = docs.where(text.isNotNull()).select(digest.alias(name), F.coalesce(learned, F.lit(False)).alias("learned"), judged(text).alias("judged"))
    scored = written(scored.select(name, "learned", "judged.*"), "judged")
    least = fit_least(scored.where("learned")) if judge.names else {}
    asked = F.create_map(*[F.lit(x) for size, low in least.items() for x in (size, low)])[F.col("size")] if least else F.lit(1.0)
    rejected = written(scored.where(F.col("score") < asked).select(name).distinct(), "rejected")
    return docs.where(text.isNotNull()).join(broadcast_if_small(rejected), digest == F.col(name), "left_anti")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the documents whose checksum does not hold them out.

    A row without doc_id is never learned from, and its ``held_out`` is false.
    """
    prepared(docs.sparkSession)
    profiles = fit_profiles(docs.where(~held_out()))
    found = predict(docs, profiles)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
