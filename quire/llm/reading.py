"""Reading level: smoothed unigram language models per language and grade.

The training table is small by contract (``max_samples`` labelled rows, an error beyond it): it is
read to the driver once, the models are a dictionary of a few thousand words, and every document of
any corpus is scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links, codes and inserted references, which say nothing about the reading level.
NOISE = re.compile(r"(?:https?://|www\.)\S+|\b[A-Z]{2,}-[\w-]+|\b\w{1,4}\.\s*\d+|§\s*\d+")
WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_SPLIT = re.compile(r"(?<=\w)[-\u00ad]\s*\n\s*(?=\w)")


def words(text: str) -> list[str]:
    """Lower-case words; capitals, line breaks, codes, links and references leave no trace."""
    runs = NOISE.sub(" ", _SPLIT.sub("", text)).lower().split()
    return WORD.findall(" ".join(r for r in runs if not _DIGIT.search(r)))


class Model:
    """log P(word | language, grade) with additive smoothing over the language's vocabulary.

    Words that occur in one sample only (names, mostly) are left out of the vocabulary, and words
    outside it do not count, so names cannot favour a grade.
    """

    def __init__(self, samples: list[tuple[str, int, str]], alpha: float = 0.5):
        self.langs = sorted({s[0] for s in samples})
        self.grades = sorted({s[1] for s in samples})
        counts, spread = defaultdict(Counter), defaultdict(Counter)
        for lang, grade, text in samples:
            found = words(text)
            counts[lang, grade].update(found)
            spread[lang].update(set(found))
        self.vocabulary, self.logp, self.known = {}, [], []
        vocabularies = {lang: {w for w, n in spread[lang].items() if n >= 2} for lang in self.langs}
        for w in sorted(set().union(*vocabularies.values()) if vocabularies else ()):
            self.vocabulary[w] = len(self.logp)
            self.known.append([w in vocabularies[lang] for lang in self.langs])
            self.logp.append([[0.0] * len(self.grades) for _ in self.langs])
        self.known = np.array(self.known, np.float64).reshape(len(self.vocabulary), len(self.langs))
        self.logp = np.array(self.logp, np.float64).reshape(len(self.vocabulary), len(self.langs), len(self.grades))
        for i, lang in enumerate(self.langs):
            v = vocabularies[lang]
            for j, grade in enumerate(self.grades):
                c = counts[lang, grade]
                total = sum(n for w, n in c.items() if w in v) + alpha * len(v)
                for w in v:
                    self.logp[self.vocabulary[w], i, j] = np.log((c[w] + alpha) / total)

    def score(self, text: str) -> tuple[str | None, int | None, float]:
        """(language, grade, probability of the grade); no known word means no level."""
        get = self.vocabulary.get
        ids = [i for w in words(text) if (i := get(w)) is not None]
        if not ids:
            return None, None, 0.0
        ids = np.array(ids)
        lang = int(self.known[ids].sum(0).argmax())
        total = self.logp[ids, lang].sum(0)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[lang], self.grades[best], float(p[best] / p.sum())


def train(samples: DataFrame, max_samples: int = 100_000, alpha: float = 0.5) -> Model:
    """A model of (lang, grade, text) rows; rows with a null are ignored."""
    rows = samples.select("lang", "grade", "text").dropna().limit(max_samples + 1).collect()
    if len(rows) > max_samples:
        raise ValueError(f"more than {max_samples} labelled samples; raise max_samples or sample them first")
    return Model([(r["lang"], r["grade"], r["text"]) for r in rows], alpha)


def grade(df: DataFrame, model: Model, id_col: str, text_col: str, min_words: int = 8) -> DataFrame:
    """(id, lang, grade, probability, n_words) of every row, whole texts.

    Null texts, texts under ``min_words`` words (runs without blanks that hold a letter or digit) and
    texts without a known word have a null grade. The language is judged from the text itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_samples

    @F.pandas_udf("struct<lang: string, grade: int, probability: double, n_words: int>")
    def level(texts: pd.Series) -> pd.DataFrame:
        m, rows = shared.value, []
        for t in texts:
            n = 0 if t is None else sum(any(c.isalnum() for c in w) for w in t.split())
            lang, g, p = m.score(t) if n >= min_words else (None, None, None)
            rows.append((lang, g, p, n))
        out = pd.DataFrame(rows, columns=["lang", "grade", "probability", "n_words"])
        out["grade"] = out["grade"].astype("Int32")
        return out

    return df.select(F.col(id_col), level(F.col(text_col)).alias("_l")).select(id_col, "_l.*")
