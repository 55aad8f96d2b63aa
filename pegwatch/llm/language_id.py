"""Language ID by a string kernel.

Method: a text is the set of its character n-grams of lengths 1 to 3 (blended spectrum, presence only). The kernel of two
texts sums, over the three lengths, the cosine of their presence vectors. ``LANDMARKS`` texts of the labelled sample are
Nyström landmarks: a text's features are its kernel values with them times the inverse square root of their own kernel
matrix. One-versus-rest kernel ridge regression on those features is a linear map; scoring a batch is a few matrix products.

The model is fitted on the driver on a bounded sample of the labelled rows: at most ``PER_LANGUAGE`` texts of each
language, fewer (but ``FEWEST``) where all languages together would pass ``SAMPLE``, picked by a hash of the id. Every language
that has a labelled text is learned and has a landmark. Only text and label are used. Scoring reads
whole texts, every character of any script: its distinct n-grams are looked up among those of the landmarks (others only count
in the cosine's length), so the kernel is exact.

Language and score: the largest response and its softmax share with a temperature fitted on the sample. A null text, or
one without a letter, is ``und`` with score 0. Without any labelled row every text is ``und``. Repeated rows give repeated
results; very long texts are read in whole; an empty table gives an empty table.

A text is accepted as one of the languages if its response lies above ``bound``: halfway from the response of a text that
shares no letter up to that which ``KEEP`` of the sample's texts reach when judged by a fit without them (landmarks left out if
others suffice), or the latter if it is lower. Texts of fewer than ``FEW`` distinct 3-grams say too little to be rejected.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pegwatch.llm.common import boxed, per_worker, ship_code, sliced

LANDMARKS, PER_LANGUAGE, SAMPLE, FEWEST = 192, 400, 25_600, 8
CHUNK = 1 << 20  # characters of a text that are packed at once
RIDGE, KEEP, FEW = 1e-2, 0.999, 24
FOREIGN = f"{chr(0x10FFFD) * 5} " * 40  # shares blanks with a text, no letter
UNKNOWN = "und"


class Spectrum:
    """The n-grams of lengths 1 to 3 of the landmarks, each packed into 64 bits (21 for a code point), and as bits the landmarks that have it."""

    def __init__(self, landmarks: list[str]):
        grams = [self.grams(t) for t in landmarks]
        self.count = len(landmarks)
        self.sizes = np.array([[len(g) for g in each] for each in grams], np.float64)
        self.codes, self.owners = [], []
        for k in range(3):
            codes, place = np.unique(np.concatenate([g[k] for g in grams]), return_inverse=True)
            owners = np.zeros((len(codes), -(-self.count // 8)), np.uint8)
            who = np.repeat(np.arange(self.count), [len(g[k]) for g in grams])
            np.bitwise_or.at(owners, (place, who // 8), (128 >> (who % 8)).astype(np.uint8))
            self.codes.append(codes)
            self.owners.append(owners)

    @staticmethod
    def grams(text: str) -> list[np.ndarray]:
        """Sorted distinct n-grams of each length, over every character of the lower-cased text with a blank around it."""
        text, out = f" {text.lower()} ", [np.zeros(0, np.uint64)] * 3
        for lo in range(0, max(1, len(text) - 2), CHUNK):
            c = np.frombuffer(text[lo:lo + CHUNK + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            two = c[:-1] << np.uint64(21) | c[1:]
            three = two[:-1] << np.uint64(21) | c[2:]
            out = [np.union1d(o, g) if len(o) else np.unique(g) for o, g in zip(out, (c, two, three), strict=True)]
        return out

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of each text with the landmarks, and its number of distinct 3-grams."""
        out, sizes = np.zeros((len(texts), self.count)), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for k, g in enumerate(self.grams(t)):
                sizes[i] = len(g)
                place = np.minimum(np.searchsorted(self.codes[k], g), len(self.codes[k]) - 1)
                hits = place[self.codes[k][place] == g]
                both = np.zeros(self.count)
                for lo in range(0, len(hits), 1 << 15):
                    both += np.unpackbits(self.owners[k][hits[lo:lo + (1 << 15)]], axis=1, count=self.count).sum(0, dtype=np.int32)
                out[i] += both / np.sqrt(max(1, len(g)) * np.maximum(1, self.sizes[:, k]))
        return out, sizes


class KernelModel:
    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS):
        self.languages = sorted(set(labels))
        y = np.array([self.languages.index(x) for x in labels])
        seen: Counter = Counter()
        turn = []  # languages in turn
        for i, label in enumerate(y.tolist()):
            turn.append((seen[label], label, i))
            seen[label] += 1
        landmarks = max(landmarks, len(self.languages))  # one of each language at least
        chosen = [i for _, _, i in sorted(turn)[:landmarks]]
        self.spectrum = Spectrum([texts[i] for i in chosen])
        k, _ = self.spectrum.kernel([texts[i] for i in chosen])
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        good = values > 1e-6 * values.max()
        self.whiten = vectors[:, good] / np.sqrt(values[good])
        features = self.features(texts)
        # a constant would answer every text alike if there is one language only
        features = np.hstack([features, np.full((len(features), 1), float(len(self.languages) > 1))])
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        weight = 1.0 / np.maximum(1, np.bincount(y))[y]  # each language counts alike
        weight *= len(y) / weight.sum()
        gram = (features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
        self.weights = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
        response = features @ self.weights
        grid = [1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0]
        loss = [-np.log(np.maximum(self.shares(response, s)[np.arange(len(y)), y], 1e-9)).mean() for s in grid]
        self.sharpness = grid[int(np.argmin(loss))]
        lever = weight * (features * np.linalg.solve(gram, features.T).T).sum(1)
        alone = (target - (target - response) / np.maximum(1 - lever, 1e-9)[:, None]).max(1)  # each text by a fit without it
        others = np.setdiff1d(np.arange(len(y)), chosen)
        alone = np.sort(alone[others] if len(others) >= landmarks else alone)
        low = float(alone[int((1 - KEEP) * len(alone))])
        self.bound = -np.inf
        void = float(self.predict([FOREIGN])[2][0])
        self.bound = min(low, (low + void) / 2)

    def features(self, texts: list[str]) -> np.ndarray:
        return self.spectrum.kernel(texts)[0] @ self.whiten

    @staticmethod
    def shares(response: np.ndarray, sharpness: float) -> np.ndarray:
        e = np.exp(sharpness * (response - response.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, share, largest response (about 1 for a typical text, near or below 0 for none of the languages), accepted."""
        kernel, sizes = self.spectrum.kernel(texts)
        response = kernel @ self.whiten @ self.weights[:-1] + self.weights[-1] * (len(self.languages) > 1)
        best = response.argmax(1)
        share = self.shares(response, self.sharpness)[np.arange(len(texts)), best]
        return [self.languages[i] for i in best], share, response.max(1), (response.max(1) > self.bound) | (sizes < FEW)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> KernelModel | None:
    """A model from rows with a text and a label; None if there are none. The sample is the rows with the smallest hashes of their ids in each language."""
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 31)) / float(1 << 31)
    rows = labelled.select(place.alias("h"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    every = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not every:
        return None
    per_language = min(per_language, max(FEWEST, SAMPLE // len(every)))
    # hashes are even, so a share of them holds a few times the wanted rows; no language ever meets in one task whole
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, 4.0 * max(per_language, FEWEST) / n)) for lang, n in every.items()], "lang string, share double")
    keys = rows.join(F.broadcast(shares), "lang").where("h <= share").select("lang", "h", "doc_id")
    order = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    picked = keys.withColumn("k", order).where(F.col("k") <= per_language).select("lang", "doc_id").distinct()
    sample = rows.join(F.broadcast(picked), ["lang", "doc_id"]).limit(2 * per_language * len(every))  # bounded: per_language ids of each language
    found = sorted((r["h"], r["lang"], r["text"]) for r in sample.select("h", "lang", "text").collect())
    found = [r for r in found if has_letter(r[2])]
    return KernelModel([r[2] for r in found], [r[1] for r in found]) if found else None


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), response, accepted (has a letter and, given a model, reaches its bound), for every row; with ``carry`` the whole row as struct ``row`` instead
    of its id. One narrow pass."""
    spark = docs.sparkSession
    ship_code(spark)
    made, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows = boxed(docs) if carry else docs.select(F.col(f"`{id_col}`").alias("doc_id"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("language", made, lambda: shared.value)
        for batch in batches:
            held = batch.column(0).field(text_col) if carry else batch.column(1)  # a carried text crosses once, inside its row
            for part, own in sliced(batch.select([0]), held, 1 << 20):
                texts = own.fill_null("").to_pylist()
                lang, score, response = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
                accepted = [has_letter(t) for t in texts]
                asked = [i for i, a in enumerate(accepted) if a and known is not None]
                for at in range(0, len(asked), 256):
                    some = asked[at:at + 256]
                    for i, a, b, c, d in zip(some, *known.predict([texts[i] for i in some]), strict=True):
                        lang[i], score[i], response[i], accepted[i] = a, float(b), float(c), bool(d)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(response, pa.float64()), pa.array(accepted, pa.bool_())],
                                                 names=[part.schema.names[0], "lang_pred", "score", "response", "accepted"])

    schema = T.StructType([rows.schema.fields[0]]).add("lang_pred", "string").add("score", "double").add("response", "double").add("accepted", "boolean")
    return rows.mapInArrow(run, schema)
