"""Language identification of mixed texts: scripts narrow the candidates, Viterbi labels every word.

Model: for each language the log-probabilities of the padded character trigrams of its words, with add-half smoothing,
counted over whole texts of a bounded sample of labelled rows (those of each language whose hash is below a threshold).
Languages are also known by the script ranges that their training words use; a word whose letters lie in a script that
only some languages use is scored for those alone.

Prediction: a word's score for a language is the sum over its trigrams, less the best score of the word and bounded
below. Viterbi over the words of the whole text, with a penalty for each switch, gives the spans. If no stretch favours
another language by more than the penalty, the best path has no switch and is found without the recursion (exact).
The language that labels most letters is the prediction.

score: the share of the predicted language among letters, times the mean probability of it within its words.

Cases: a null text or one without letters is `und` with score 0. Ties go to the language first in the alphabet. A word
in a script unknown to the model carries no evidence; if all are, the text gets the first of k languages with score
1/k. An empty table gives an empty result. With no labelled rows at all, everything is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed, map_texts, small

SWITCH = 12.0
FLOOR = 6.0
#: Unicode ranges of scripts; fixed values.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF), (0x20000, 0x2FFFF)),
}

_WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    code = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class LanguageModel:
    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: trigrams by language."""
        self.langs = sorted(counts)
        grams = sorted({g for c in counts.values() for g in c})
        index = {g: i for i, g in enumerate(grams)}
        m = np.full((len(grams) + 1, len(self.langs)), 0.5)
        for k, lang in enumerate(self.langs):
            for g, n in counts[lang].items():
                m[index[g], k] += n
        self.table = np.log(m / m.sum(0)).tolist() if self.langs else []
        self.index, self.unknown = index, len(grams)
        self.scripts = {lang: {script_of(g.strip()) for g in counts[lang] if g.strip()} for lang in self.langs}

        self.of_script = {s: [k for k, lang in enumerate(self.langs) if s in self.scripts[lang]] for s in (*SCRIPTS, "other")}

    def candidates(self, word: str) -> list[int]:
        return self.of_script[script_of(word)]

    def word_scores(self, word: str) -> list[float]:
        """Zero for the best language, negative for the others; all zero if the script is unknown. Last, whether it is known."""
        near = self.candidates(word)
        out = [-FLOOR] * len(self.langs) + [1.0]
        if not near:
            return [0.0] * (len(self.langs) + 1)
        rows = [self.table[self.index.get(g, self.unknown)] for g in trigrams(word)]
        sums = [sum(r[k] for r in rows) for k in near]
        top = max(sums)
        for k, s in zip(near, sums, strict=True):
            out[k] = max(s - top, -FLOOR)
        return out


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each row of scores (words, languages)."""
    total = scores.sum(0)
    best = int(total.argmax())
    gain = np.cumsum(np.vstack([np.zeros(scores.shape[1]), scores - scores[:, [best]]]), axis=0)
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(len(scores), best, np.int8)
    n, k = scores.shape
    rows, back, state = scores.tolist(), [], [0.0] * k
    for row in rows:
        top = max(range(k), key=state.__getitem__)
        limit = state[top] - penalty
        back.append([top if state[j] < limit else j for j in range(k)])
        state = [max(state[j], limit) + row[j] for j in range(k)]
    out = np.empty(n, np.int8)
    at = max(range(k), key=state.__getitem__)
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = back[i][at]
    return out


class Predictor:
    """Scores words once and remembers them up to a bound."""

    def __init__(self, model: LanguageModel, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs) + 1))  # scores, and whether the script is known

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Places of the words in the table, which grows as new words come."""
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = list(set(tokens).difference(known))
        if new:
            end = len(known) + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]))])
            self.table[len(known) : end] = [self.model.word_scores(w) for w in new]
            known.update(zip(new, range(len(known), end), strict=True))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def label(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of a text, their scores, and their labels."""
        tokens = _WORD.findall(text.lower()) if isinstance(text, str) else []
        if not tokens or not self.model.langs:
            return tokens, np.zeros((0, 0)), np.zeros(0, np.int8)
        rows = self._rows(tokens)  # may replace the table
        scores = self.table[rows]
        return tokens, scores, viterbi(scores[:, :-1])

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether any word is in a script of the model."""
        tokens, scores, labels = self.label(text)
        if not len(labels):
            return "und", 0.0, False
        scores, known = scores[:, :-1], bool(scores[:, -1].any())
        letters = np.fromiter(map(len, tokens), np.float64, len(tokens))
        share = np.bincount(labels, letters, len(self.model.langs)) / letters.sum()
        best = int(share.argmax())
        own = labels == best
        p = 1 / np.exp(scores[own] - scores[own][:, [best]]).sum(1)
        return self.model.langs[best], float(share[best] * (p * letters[own]).sum() / letters[own].sum()), known


def word_spans(text: str, predictor: Predictor) -> list[tuple[int, int, str]]:
    """Character spans (start, end, language) of the lower-cased text, neighbours of one language joined."""
    out: list[tuple[int, int, str]] = []
    labels = predictor.label(text)[2]
    for m, k in zip(_WORD.finditer(text.lower()), labels, strict=False):
        lang = predictor.model.langs[k]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def train(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = 600) -> LanguageModel:
    """Fits the model on rows where `use` holds and lang is not null.

    `train_docs` rows a language are expected in the sample, all if there are no more; rows that repeat key and text
    count once. What reaches the driver are the counts of trigrams. The bound is of the training sample alone;
    predictions read every row and every word.
    """
    own = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), F.col(text).alias("text"))
    sizes = checkpointed(own.groupBy("lang").agg(F.count("*").alias("rows")))
    cut = F.lit(float(2**32) * train_docs) / F.col("rows")
    chosen = own.join(small(sizes), "lang").where(F.pmod("h", F.lit(2**32)) < cut).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[tuple[str, str], int] = {}
            for name, t in zip(frame["lang"], frame["text"], strict=True):
                for w in _WORD.findall(t.lower()):
                    for g in trigrams(w):
                        seen[name, g] = seen.get((name, g), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = {}
    for r in chosen.mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return LanguageModel(counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score), one for each row of `docs`; every word of every text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for frame in frames:
            found = [predictor.predict(t) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return map_texts(docs, key, text, run, "lang_pred string, score double")
