"""Language identification by string kernels (operator 5).

The kernel of two texts is the number of character n-grams (blended over 1 to 3) that both contain, by presence,
divided by the root of the product of their own numbers. Nyström landmarks drawn from a bounded labelled sample
approximate it; one-versus-rest kernel ridge regression on the landmark features gives a value for each language.
Prediction is a batched matrix product: landmark presence, Nyström map and ridge weights fold into one matrix from
n-grams to languages, so a batch of texts is its presence matrix times that matrix.

Characters are lower-cased. Letters a-z and those of the Latin-1 block have a symbol each; all other letters share 68
by a hash of their code point, so letters of one script may fall together, which n-grams of two and three mostly
tell apart; everything else is one gap symbol. Whole texts are read.

Every label value is learned. The sample is bounded: SAMPLE distinct texts a language, fewer where MOST_SAMPLE for
all together asks for it, one at least. They are the texts of smallest hash, which each task finds among its own rows
before anything is shuffled; copies of a text count once, so no text can crowd out the others of its language.

Defined cases: a null text, or one without a letter, gives `und` with score 0, as does every text if no labelled
row can be learned from; rows with null language teach nothing; repeated rows are predicted each, and teach once;
an empty table gives no rows. Only the text enters a prediction, and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut_lineage

#: Texts of the sample for each language, and for all together.
SAMPLE, MOST_SAMPLE = 300, 30_000
#: Landmarks among them for each language, and for all together.
LANDMARKS, MOST_LANDMARKS = 60, 2_000
#: Numbers of the model's matrix (n-grams by languages) and of the landmarks' at most; n-grams of few landmarks give way.
MOST_NUMBERS = 1 << 26
RIDGE = 1e-2
#: Symbols of the alphabet, and the longest n-gram.
SYMBOLS, LONGEST = 128, 3
#: Numbers that n-grams of all lengths take.
SPACE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Texts of one presence matrix.
BLOCK = 128
UNKNOWN = "und"

_NEAR = np.zeros(256, np.uint8)  # symbols of the first 256 code points
for _c in range(26):
    _NEAR[97 + _c] = _NEAR[65 + _c] = _c + 1
for _c in range(0xDF, 0x100):
    _NEAR[_c] = 27 + _c - 0xDF if chr(_c).isalpha() else 0
#: The first symbol that other letters share.
_SHARED = 60


def symbols(text: str) -> np.ndarray:
    """A symbol for each character: 0 for no letter, 1 to 26 for a-z, 27 to 59 for Latin-1, above for other letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _NEAR[np.minimum(code, 255)]
    far = code > 255
    if far.any():
        kinds, back = np.unique(code[far], return_inverse=True)
        mark = [_SHARED + (int(c) * 2654435761 >> 12) % (SYMBOLS - _SHARED) if chr(int(c)).isalpha() else 0 for c in kinds]
        out[far] = np.array(mark, np.uint8)[back]
    return out


def grams(text: str) -> np.ndarray:
    """The sorted numbers of the n-grams a text contains."""
    s = symbols(text).astype(np.int32)
    parts, code, base = [s], s, SYMBOLS
    for n in range(2, LONGEST + 1):
        if len(code) < 2:
            break
        code = code[:-1] * SYMBOLS + s[len(s) - len(code) + 1 :]
        parts.append(code + base)
        base += SYMBOLS**n
    if len(s) > 1 << 15:
        seen = np.zeros(SPACE, bool)
        for p in parts:
            seen[p] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(np.concatenate(parts))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class KernelClassifier:
    """One-versus-rest kernel ridge regression on Nyström features, folded to a matrix from n-grams to languages."""

    def __init__(self, texts: list[np.ndarray], labels: list[str]):
        counts = Counter(labels)
        self.languages = sorted(counts)
        self.column = np.full(SPACE, -1, np.int32)
        if not texts:
            self.weights = np.zeros((1, 0), np.float32)
            return
        each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(counts)))
        taken: Counter = Counter()
        marks = []
        for t, y in zip(texts, labels, strict=True):
            if taken[y] < each:
                taken[y] += 1
                marks.append(t)
        known, held = np.unique(np.concatenate(marks), return_counts=True)
        most = max(1, MOST_NUMBERS // max(len(marks), len(counts)))
        known = np.sort(known[np.argsort(-held, kind="stable")[:most]])
        self.column[known] = np.arange(len(known))
        presence = self._presence(marks) / np.sqrt([[max(1, len(t))] for t in marks]).astype(np.float32)
        values, vectors = np.linalg.eigh((presence @ presence.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        blocks = [texts[i : i + BLOCK] for i in range(0, len(texts), BLOCK)]
        features = np.vstack([self._presence(b) / np.sqrt([[max(1, len(t))] for t in b]) @ presence.T @ root for b in blocks])
        features = np.hstack([features, np.ones((len(features), 1))])
        place = {y: k for k, y in enumerate(self.languages)}
        target = np.full((len(labels), len(self.languages)), -1.0)
        target[np.arange(len(labels)), [place[y] for y in labels]] = 1.0
        share = np.array([len(labels) / len(counts) / counts[y] for y in labels])[:, None]  # languages weigh alike
        solved = np.linalg.solve(features.T @ (share * features) + RIDGE * np.eye(features.shape[1]), features.T @ (share * target))
        self.weights = (presence.T @ (root @ solved[:-1])).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def _presence(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), int(self.column.max()) + 1), np.float32)
        for row, t in zip(out, texts, strict=True):
            at = self.column[t]
            row[at[at >= 0]] = 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and a score from 0 to 1: a softmax share of the languages' values."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        able = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for a in range(0, len(able), BLOCK):
            at = able[a : a + BLOCK]
            own = [grams(texts[i]) for i in at]
            values = self._presence(own) @ self.weights / np.sqrt([[len(g)] for g in own]) + self.bias
            power = np.exp(4 * (values - values.max(1, keepdims=True)))
            share = power.max(1) / power.sum(1)
            for i, k, s in zip(at, values.argmax(1), share, strict=True):
                langs[i], scores[i] = self.languages[k], float(s)
        return langs, scores


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def smallest_hashes(df: DataFrame, n: int) -> DataFrame:
    """(lang, h): of the rows of each task, the n smallest distinct hashes of each language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, own in b.groupby("lang")["h"]:
                old = kept.get(lang, np.zeros(0, np.int64))
                kept[lang] = np.unique(np.concatenate([old, own.to_numpy()]))[:n]
        for lang, h in kept.items():
            yield pd.DataFrame({"lang": lang, "h": h})

    return df.select("lang", "h").mapInPandas(run, "lang string, h long")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> KernelClassifier:
    """Learns from a bounded sample of the labelled rows that are not held out: the texts of smallest hash for each language."""
    able = df.select(
        df[label_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"), held_out(df[id_col]).alias("held")
    ).filter("not held and lang is not null and text is not null")
    hashed = able.withColumn("h", F.xxhash64("text"))
    low = smallest_hashes(hashed, sample).distinct().withColumn("part", F.pmod("h", F.lit(16)))
    for keys in (["lang", "part"], ["lang"]):  # in parts first, so that one task ranks no more than the parts' smallest
        low = low.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("n") <= sample)
    picked = cut_lineage(low.select("lang", "h", "n"))
    languages = picked.select("lang").distinct().count()
    picked = picked.filter(F.col("n") <= max(1, min(sample, MOST_SAMPLE // max(1, languages)))).drop("n")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b[b["text"].map(has_letter)]
            yield pd.DataFrame({"lang": ok["lang"], "h": ok["h"], "grams": ok["text"].map(lambda t: grams(t).astype("<i4").tobytes())})

    # picked is bounded by MOST_SAMPLE or the number of languages; of a text's copies each task reads one
    near = hashed.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "text")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for b in batches:
            fresh = [k for k in zip(b["lang"], b["h"], strict=True)]
            keep = [k not in seen and not seen.add(k) for k in fresh]
            if any(keep):
                yield from read(iter([b[keep]]))

    rows = near.mapInPandas(once, "lang string, h long, grams binary").dropDuplicates(["lang", "h"])
    found = {(r["lang"], r["h"]): bytes(r["grams"]) for r in rows.collect()}  # at most SPACE n-grams a row
    keys = sorted(found)
    return KernelClassifier([np.frombuffer(found[k], "<i4") for k in keys], [k[0] for k in keys])


def predictor(df: DataFrame, model: KernelClassifier):
    """A column function from text to struct<lang_pred, score>."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # SPACE numbers for each language

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, scores = shared.value.predict(part.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of df; no shuffle beyond the sample's."""
    predict = predictor(df, fit(df, id_col, text_col, label_col))
    found = df.select(df[id_col].cast("long").alias("doc_id"), held_out(df[id_col]).alias("held_out"), predict(df[text_col].cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
