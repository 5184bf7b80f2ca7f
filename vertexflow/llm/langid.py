"""Language identification by hierarchical discrimination.

First the language family is predicted by linear support vector machines, one against the rest; then, within it,
one-versus-one linear support vector machines separate the closely related languages. Features are hashed counts
of one to three letters (white space at word borders), damped by square roots and of unit length, of the whole text.

The machines learn from a sample of the labelled rows: at most `sample` in all, dealt equally to the languages by a
hash of doc_id; that bound is the only one. They learn in one task, and only the machines come to the driver.
Families of languages are fixed values; a language without one forms a family of its own. The score is the product of the logistic family and language margins' shares, in 0..1.

Null texts and texts without a letter are `und` with score 0. Rows without a label are predicted but not learned.
Without any labelled row all texts are `und`. Rows are predicted one by one; repeated rows get equal answers.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_rows, crc32_of_id, lean, text_map

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "malayic": "id jv ms su tl",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SIZE = 4096
_ALPHA = np.array([chr(c).isalpha() for c in range(0x3000)])


def features(text: str | None) -> np.ndarray | None:
    """A unit vector, or None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = codes >= 0x3000
    low = ~letter
    letter = letter.copy()
    letter[low] = _ALPHA[codes[low]]
    if not letter.any():
        return None
    letter = np.r_[False, letter, False]  # runs of other characters, also at the ends, are one space
    codes = np.where(letter, np.r_[np.uint32(32), codes, np.uint32(32)], np.uint32(32))[np.r_[True, letter[1:] | letter[:-1]]]
    one = codes * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(3266489917) + one[2:]
    grams = np.concatenate([one, two, three])
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519)
    counts = np.sqrt(np.bincount(grams >> np.uint32(20), minlength=SIZE))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


class Sparse:
    """Unit vectors by their non-zero places, each with a constant 1 behind them."""

    def __init__(self, places: list[bytes], values: list[bytes]):
        self.ends = np.cumsum([0] + [len(p) // 2 for p in places])
        self.places = np.frombuffer(b"".join(places), np.uint16)
        self.values = np.frombuffer(b"".join(values), np.float32)


def linear_svm(x: Sparse, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights (the bias last) of the hinge loss on some rows of x, by dual coordinate descent; y is 1 or -1 for each of the rows."""
    w, bias, alpha = np.zeros(SIZE, np.float32), 0.0, np.zeros(len(rows))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            part = slice(x.ends[rows[i]], x.ends[rows[i] + 1])
            at, value = x.places[part], x.values[part]
            new = min(max(alpha[i] - (y[i] * (float(value @ w[at]) + bias) - 1) / 2.0, 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[at] += np.float32(step) * value
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, np.float32(bias))


class Model:
    """Families, their machines, and the machines of pairs of languages of a family."""

    def __init__(self, x: Sparse, labels: list[str]):
        langs, every = np.array(labels), np.arange(len(labels))
        family = np.array([FAMILY_OF.get(v, v) for v in labels])
        self.families = sorted(set(family))
        self.languages = {f: sorted(set(langs[family == f])) for f in self.families}
        self.outer = np.array([linear_svm(x, every, np.where(family == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.inner = {}
        for f in self.families:
            for a, b in combinations(self.languages[f], 2):
                at = np.flatnonzero((langs == a) | (langs == b))
                self.inner[a, b] = linear_svm(x, at, np.where(langs[at] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        share = lambda m: 1 / (1 + np.exp(-4.0 * m))
        x = np.append(x, np.float32(1))
        score, family = 1.0, self.families[0]
        if self.outer is not None:
            p = share(self.outer @ x)
            family, score = self.families[int(p.argmax())], float(p.max() / p.sum())
        langs = self.languages[family]
        if len(langs) == 1:
            return langs[0], score
        votes = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            p = float(share(self.inner[a, b] @ x))
            votes[a] += p
            votes[b] += 1 - p
        best = max(langs, key=lambda v: (votes[v], v))
        return best, score * votes[best] / (len(langs) - 1)


def train(docs: DataFrame, sample: int = 6000, most: int = 500) -> Model | None:
    """docs: (doc_id, text, lang), labelled rows to learn from. More than `most` languages are refused: a label column gone wrong."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    if not counts:
        return None
    each = sample / len(counts)
    whole = 1 << 30
    bound = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(whole * min(1.0, each / n))))))
    picked = labelled.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole))).where(F.col("draw") < bound[F.col("lang")])

    def run(batches):
        schema = pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("x", pa.binary())])
        for draws, langs, texts in arrow_rows(batches, "draw", "lang", "text"):
            rows = []
            for draw, lang, x in zip(draws, langs, map(features, texts)):
                if x is not None:
                    at = np.flatnonzero(x)
                    rows.append((draw, lang, at.astype(np.uint16).tobytes(), x[at].tobytes()))
            yield arrow_batch(schema, *(zip(*rows) if rows else [[]] * 4))

    def fit(batches):
        labels, places, values = [], [], []
        for columns in arrow_rows(batches, "lang", "at", "x"):
            for whole, part in zip((labels, places, values), columns):
                whole += part
        if labels:
            yield arrow_batch(pa.schema([("model", pa.binary())]), [pickle.dumps(Model(Sparse(places, values), labels))])

    drawn = picked.select("draw", "lang", "text").mapInArrow(lean(run), "draw long, lang string, at binary, x binary")
    drawn = drawn.orderBy("draw", "lang", "at").limit(2 * sample)  # about `sample`, in one partition; many rows of one draw are copies of a text
    made = drawn.select("lang", "at", "x").mapInArrow(lean(fit), "model binary").first()
    return pickle.loads(made["model"]) if made else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            found = [("und", 0.0) if x is None or model is None else model.predict(x) for x in map(features, texts)]
            yield arrow_batch(schema, ids, *(zip(*found) if found else [[]] * 2))

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, mod: int = 4, rest: int = 2, sample: int = 6000) -> DataFrame:
    """Learns from rows whose crc32(doc_id) modulo `mod` isn't `rest`; (doc_id, held_out, lang_pred, score) of every row."""
    held = F.coalesce(crc32_of_id("doc_id") % mod == rest, F.lit(True))
    return predict(docs, train(docs.where(~held), sample)).withColumn("held_out", held)


def keep(docs: DataFrame, least: float = 0.3, sample: int = 6000, column: str = "lang") -> DataFrame:
    """Documents whose language is told with a score of `least` or more, with their columns as they were; where `column` is null, it gets
    the language told, so that what follows may go by it. Null texts and those without a letter go. Without labelled rows all go."""
    model = train(docs.withColumnRenamed(column, "lang") if column != "lang" else docs, sample)

    def start():
        return lambda text: (None, 0.0) if model is None or (x := features(text)) is None else model.predict(x)

    told = docs.withColumn("__vf_told", text_map(start, pa.schema([("lang", pa.string()), ("score", pa.float64())]), "text")).where(F.col("__vf_told.score") >= least)
    return told.select(*(F.coalesce(c, F.col("__vf_told.lang")).alias(c) if c == column else F.col(c) for c in docs.columns))
