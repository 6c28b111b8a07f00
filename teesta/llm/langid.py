"""The language of texts and of their segments, by multilingual mixture inference.

Character n-gram models are fitted on trusted samples, one for each pair of
language and script. A text is a mixture of languages: expectation-maximisation
estimates its proportions from the likelihoods of its segments, and languages
are dropped while the penalised likelihood gains by it.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teesta.llm.shelf import spread

_LINKS = regex.compile(r"\S*@\S+|https?://\S+|[-­¬‐]\n|\S*\p{Nd}\S*")
_SENTENCE = regex.compile(r"(?<=[.?!।॥|])[\s”’\"')]+|[“”\"()]|\n\s*\n")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_SCRIPTS = ("LATIN", "DEVANAGARI", "BENGALI", "ORIYA")


def script_of(word: str) -> str:
    for ch in word:
        if ch.isalpha():
            name = unicodedata.name(ch, "")
            for s in _SCRIPTS:
                if name.startswith(s):
                    return s
            return name.split(" ")[0]
    return ""


def segments(text: str) -> list[tuple[int, int, list[str]]]:
    """(begin, end, words) of sentences, cut further where the script changes for three words or more."""
    out = []
    cuts = [0, *[m.end() for m in _SENTENCE.finditer(text)], len(text)]
    masked = _LINKS.sub(lambda m: " " * len(m[0]), text)
    for a, b in zip(cuts, cuts[1:], strict=False):
        run: list[tuple[int, int, str, str]] = [(m.start() + a, m.end() + a, m[0], script_of(m[0])) for m in _WORD.finditer(masked[a:b])]
        parts: list[list[tuple[int, int, str, str]]] = []
        for w in run:
            if parts and parts[-1][-1][3] == w[3]:
                parts[-1].append(w)
            else:
                parts.append([w])
        joined: list[list[tuple[int, int, str, str]]] = []
        for p in parts:  # a few words of another script belong to the sentence they stand in
            if joined and (len(p) < 3 or len(joined[-1]) < 3 and p[0][3] != joined[-1][0][3]):
                joined[-1] += p
            elif joined and joined[-1][0][3] == p[0][3]:
                joined[-1] += p
            else:
                joined.append(list(p))
        out += [(p[0][0], p[-1][1], [w[2] for w in p]) for p in joined]
    return out


class NgramModels:
    """Log-likelihood ratios of words under each (language, script) model."""

    def __init__(self, samples: list[tuple[str, str]], n: int = 3, smooth: float = 0.3) -> None:
        self.n = n
        counts: dict[tuple[str, str], Counter] = {}
        words: Counter = Counter()
        for lang, text in samples:
            for _, _, ws in segments(text):
                tally = Counter(script_of(w) for w in ws)
                if not tally:
                    continue
                key = (lang, tally.most_common(1)[0][0])
                for w in ws:
                    counts.setdefault(key, Counter()).update(self.grams(w))
                words.update(ws)
        self.keys = sorted(counts)
        self.languages = sorted({k[0] for k in self.keys})
        vocabulary = sorted(set().union(*counts.values())) if counts else []
        self.index = {g: i for i, g in enumerate(vocabulary)}
        size = len(vocabulary) + 1
        table = np.full((size, len(self.keys)), smooth)
        for j, k in enumerate(self.keys):
            for g, c in counts[k].items():
                table[self.index[g], j] += c
        self.table = np.log(table / table.sum(axis=0, keepdims=True))
        self.table -= self.table.max(axis=1, keepdims=True)
        self.script = [k[1] for k in self.keys]
        self._words: dict[str, np.ndarray] = {}

    def grams(self, word: str) -> list[str]:
        w = f" {word.lower()} "
        return [w[i : i + self.n] for i in range(max(1, len(w) - self.n + 1))]

    def word(self, word: str) -> np.ndarray:
        v = self._words.get(word)
        if v is None:
            ids = [self.index[g] for g in self.grams(word) if g in self.index]
            v = self.table[ids].sum(axis=0) if ids else np.zeros(len(self.keys))
            s = script_of(word)
            v = v + np.array([0.0 if s == t else -4.0 for t in self.script])
            if len(self._words) < 500_000:
                self._words[word] = v
        return v


def infer(text: str | None, models: NgramModels, iterations: int = 15, penalty: float = 12.0, full: int = 5) -> tuple[list[tuple[str, float]], list[tuple[int, int, str, float]]]:
    """(languages with their shares, segments with language and confidence); no words give ([], []).

    A language stays only if it gains more than `penalty` of log-likelihood, and
    is named only if a segment of `full` words or more is in it; where no
    segment is that long the likeliest language stands alone.
    """
    if not text or not models.keys:
        return [], []
    segs = [s for s in segments(text) if s[2]]
    if not segs:
        return [], []
    ll = np.array([np.clip(np.sum([models.word(w) for w in s[2]], axis=0), -60.0 - 5 * len(s[2]), 0) for s in segs])
    weight = np.array([len(s[2]) for s in segs], dtype=float)
    long = weight >= full
    # A model that is likeliest for no segment would be the first to be dropped.
    keep = sorted({int(i) for i in ll.argmax(axis=1)})

    def fit(cols: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        l = ll[:, cols]
        pi = np.full(len(cols), 1 / len(cols))
        r = np.empty_like(l)
        for _ in range(iterations):
            z = l + np.log(pi + 1e-12)
            top = z.max(axis=1, keepdims=True)
            r = np.exp(z - top)
            total = r.sum(axis=1, keepdims=True)
            r /= total
            pi = (r * weight[:, None]).sum(axis=0)
            pi /= pi.sum()
        return float((top + np.log(total)).sum()), pi, r

    value, pi, r = fit(keep)
    while len(keep) > 1:
        order = np.argsort(pi)
        drop = None
        for at in order:
            fewer = [k for i, k in enumerate(keep) if i != at]
            v, p, q = fit(fewer)
            if v + penalty >= value:
                drop = (fewer, v, p, q)
                break
        if drop is None:
            break
        keep, value, pi, r = drop
    best = r.argmax(axis=1)
    named: dict[str, float] = {}
    for i in range(len(segs)):
        if long[i]:
            lang = models.keys[keep[best[i]]][0]
            named[lang] = named.get(lang, 0.0) + weight[i]
    if not named:
        lang = models.keys[keep[int(pi.argmax())]][0]
        named = {lang: float(weight.sum())}
    total = sum(named.values())
    out = [(s[0], s[1], models.keys[keep[best[i]]][0], float(r[i, best[i]])) for i, s in enumerate(segs)]
    return sorted(((k, v / total) for k, v in named.items()), key=lambda x: (-x[1], x[0])), out


def models_of(samples: DataFrame, lang: str = "lang", text: str = "sample_text", most: int = 5000) -> NgramModels:
    """Models fitted on the labelled rows; at most `most` of them, the first by text order, enter (a documented bound)."""
    rows = samples.select(lang, text).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).orderBy(lang, text).limit(most).collect()
    return NgramModels([(r[0], r[1]) for r in rows])


def identify(texts: DataFrame, samples: DataFrame, key: str = "signal_id", text: str = "evidence_text") -> DataFrame:
    """key, language, confidence, languages array<struct<language,share>>, segments array<struct<begin,end,language,confidence>>.

    language is the one language of the text, 'mixed' for several, 'und' for a
    text without words (null and empty ones too). confidence is the mean
    posterior of its segments by words, 1 for 'und'. Rows come out as often as
    they stand; other columns are ignored; texts are read whole.
    """
    shared = texts.sparkSession.sparkContext.broadcast(models_of(samples))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for b in batches:
            out = []
            for k, t in zip(b["_key"], b["_text"], strict=True):
                langs, segs = infer(t, models)
                label = "und" if not langs else langs[0][0] if len(langs) == 1 else "mixed"
                size = sum(s[1] - s[0] for s in segs)
                conf = sum((s[1] - s[0]) * s[3] for s in segs) / size if size else 1.0
                out.append((k, label, conf, [{"language": a, "share": s} for a, s in langs], [{"begin": s[0], "end": s[1], "language": s[2], "confidence": s[3]} for s in segs]))
            yield pd.DataFrame(out, columns=["_key", "language", "confidence", "languages", "segments"])

    t = spread(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    return t.mapInPandas(run, f"_key {kind}, language string, confidence double, languages array<struct<language:string,share:double>>, segments array<struct<begin:int,end:int,language:string,confidence:double>>").withColumnRenamed("_key", key)


def wrong_labels(signals: DataFrame, samples: DataFrame, known: tuple[str, ...] = ("en", "hi", "or", "bn", "mr", "mixed", "und")) -> DataFrame:
    """signal_id, language: the languages of the signals whose label is missing or not that of the text."""
    rows = signals.select(F.struct("signal_id", F.lower(F.trim("language")).alias("said")).alias("_both"), "evidence_text")
    found = identify(rows, samples, "_both", "evidence_text")
    said: Column = F.col("_both.said")
    wrong = said.isNull() | ~said.isin(*known) | (said != F.col("language"))
    names = F.when(F.col("language") == "und", F.array(F.lit("und"))).otherwise(F.transform("languages", lambda x: x["language"]))
    return found.where(wrong).select(F.col("_both.signal_id").alias("signal_id"), F.explode(names).alias("language"))
