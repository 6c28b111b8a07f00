"""Text read from scanned pages made continuous and readable again.

Words are looked up in a vocabulary of the corpus: a Levenshtein automaton, in
which two signs may also be read as one and one as two, is run over the
vocabulary's trie and gives every word within the distance. Candidates are
ranked as through a noisy channel: by how often the word would come out as the
form seen, from misreadings learnt over the whole corpus, and by the words
beside it. Page furniture is recognised by its place and repetition, words
broken at line ends are joined, and lines flow together.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teesta.llm.shelf import Shelf, spread

# Words for a page, and marks that break a word at a line's end.
PAGE_WORDS = r"(?:Page|Pg\.?|P\.|पृष्ठ|पान|ପୃଷ୍ଠା|পৃষ্ঠা)"
BREAKS = "-­¬‐‑"

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}!]*[\p{L}\p{M}][\p{L}\p{M}\p{Nd}!]*")
_MASK = regex.compile(r"\S*@\S+|https?://\S+|(?<![\p{L}])[A-Z]{2,}\p{Nd}\S*|\p{Nd}+(?:st|nd|rd|th|mm|km|kg|ml)\b")
_PAGE = regex.compile(rf"^\s*(?:\[\s*\p{{Nd}}{{1,4}}\s*\]|[-–—]\s*\p{{Nd}}{{1,4}}\s*[-–—]|\p{{Nd}}{{1,3}}|\p{{Nd}}{{1,4}}\s*(?:/|of)\s*\p{{Nd}}{{1,4}}|{PAGE_WORDS}\s*\p{{Nd}}{{1,4}}(?:\s*(?:/|of)\s*\p{{Nd}}{{1,4}})?)\s*$", regex.I)
_BROKEN = regex.compile(rf"[\p{{L}}\p{{M}}0-9!][{BREAKS}]\s*$")
_BAR = regex.compile(r"(?<=[\p{Devanagari}\p{Oriya}\p{Bengali}])\|(?=\s|$)")
_END = regex.compile(r"[.?!।|:;,]\s*[\"”’)]*\s*$")

Edit = tuple[str, str]  # what stands in the word, what is seen


class Trie:
    """A vocabulary as nested dictionaries; '' marks the end of a word."""

    def __init__(self, words: dict[str, int]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w


class LevenshteinAutomaton:
    """The automaton of all words that `most` edits or fewer make of `word`.

    An edit puts one sign for another, adds or drops one, or reads two as one or
    one as two. A state is a place in `word` and the edits left; the automaton
    and the trie are walked together, so only prefixes of vocabulary words are
    ever formed, and with no edit left a single path is followed.
    """

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def words(self, trie: Trie) -> dict[str, tuple[Edit, ...]]:
        """Every word of the trie the automaton accepts, with the fewest edits that lead to it."""
        out: dict[str, tuple[Edit, ...]] = {}
        seen, n = self.word, len(self.word)
        stack: list[tuple[dict, int, int, tuple[Edit, ...]]] = [(trie.root, 0, self.most, ())]
        while stack:
            node, i, left, path = stack.pop()
            if not left:
                while i < n and node is not None:
                    node, i = node.get(seen[i]), i + 1
                if node is None:
                    continue
            if i == n and "" in node:
                w = node[""]
                if w not in out or len(path) < len(out[w]):
                    out[w] = path
            if not left:
                continue
            here = seen[i : i + 1]
            last = left == 1  # after the last edit the next sign has to fit
            after = [seen[i + k : i + k + 1] for k in range(3)]
            for c, below in node.items():
                if c == "":
                    continue
                if not last or after[0] in below:
                    stack.append((below, i, left - 1, (*path, (c, ""))))
                if not here:
                    continue
                if c != here and (not last or after[1] in below):
                    stack.append((below, i + 1, left - 1, (*path, (c, here))))
                if i + 1 < n and (not last or after[2] in below):
                    stack.append((below, i + 2, left - 1, (*path, (c, seen[i : i + 2]))))
                for d, under in below.items():
                    if d and (not last or after[1] in under):
                        stack.append((under, i + 1, left - 1, (*path, (c + d, here))))
            if here:
                stack.append((node, i + 1, left - 1, (*path, ("", here))))
                if here in node:
                    stack.append((node[here], i + 1, left, path))
        return out


def difference(true: str, seen: str) -> Edit:
    """What is left of both words when the same beginning and then the same end are taken away; a sign put in stands with the one before it."""
    a = 0
    while a < min(len(true), len(seen)) and true[a] == seen[a]:
        a += 1
    z = 0
    while z < min(len(true), len(seen)) - a and true[-1 - z] == seen[-1 - z]:
        z += 1
    if a and a + z == len(true):
        a -= 1
    return true[a : len(true) - z], seen[a : len(seen) - z]


def probable_edits(word: str, times: int, words: dict[str, int], trie: Trie, rarer: float = 30.0) -> list[tuple[Edit, float]]:
    """The single edits that may have made `word` of words at least `rarer` times as frequent; their shares go by the words' frequencies."""
    if len(word) < 4:
        return []
    found = [(difference(w, word), words[w]) for w in LevenshteinAutomaton(word, 1).words(trie) if words[w] >= rarer * times]
    total = sum(n for _, n in found)
    return [(e, times * n / total) for e, n in found]


class Misreadings:
    """How likely each part of a word is seen as another, learnt from all forms much rarer than a word one edit away."""

    def __init__(self, weights: dict[Edit, float], words: dict[str, int], least: float) -> None:
        signs: Counter = Counter()
        for w, n in words.items():
            for i in range(len(w)):
                signs[w[i]] += n
                signs[w[i : i + 2] if i + 1 < len(w) else ""] += n
        total = sum(n * (len(w) + 1) for w, n in words.items()) or 1
        rate = {(t, s): v / (total if t == "" else max(signs.get(t, 0), v)) for (t, s), v in weights.items() if v >= least}
        # What happens less than once in three thousand times is chance: two words alike.
        self.rate = {e: r for e, r in rate.items() if r >= 1 / 3000}
        self.unlisted = 0.5 / total
        # What a sign may have been, for words no vocabulary has: by the rates alone, the usual ones only.
        self.back: dict[str, list[str]] = {}
        for (t, s), r in sorted(self.rate.items(), key=lambda x: -x[1]):
            if t and s and r >= 1e-3:
                self.back.setdefault(s, []).append(t)
        self.longest_first = sorted(self.back, key=len, reverse=True)

    def of(self, edits: tuple[Edit, ...]) -> float:
        p = 1.0
        for e in edits:
            p *= self.rate.get(e, self.unlisted)
        return p


class Reader:
    """Knows the corpus's words, pairs of words, sign triples, misreadings and running headers, and reads noisy lines by them."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], triples: dict[str, int], misreadings: Misreadings, headers: set[str], sure: float = 0.03) -> None:
        self.words, self.pairs, self.triples, self.misreadings, self.headers, self.sure = words, pairs, triples, misreadings, headers, sure
        self.trie = Trie(words)
        self.beside = {w for p in pairs for w in p.split(" ")}
        self._shapes: dict[int, list[list[str]]] = {}
        for h in sorted(headers):
            self._shapes.setdefault(len(h.split()), []).append(h.split())
        self._kept: dict[str, list[tuple[float, str]]] = {}

    def candidates(self, lower: str) -> list[tuple[float, str]]:
        """(how often the word would be seen as `lower`, word) of every vocabulary word within one edit, or two where a form of seven signs has a sign no word has and none explains it.

        However many they are, only those are left out that no neighbours could make `corrected` take.
        """
        got = self._kept.get(lower)
        if got is None:
            found = LevenshteinAutomaton(lower, 1).words(self.trie)
            got = [(self.words[w] * self.misreadings.of((difference(w, lower),)), w) for w in found if w != lower]
            if len(lower) >= 7 and max(got, default=(0.0, ""))[0] < self.sure and any(not (c.isalpha() or _is_mark(c)) for c in lower):
                two = LevenshteinAutomaton(lower, 2).words(self.trie)
                got += [(self.words[w] * self.misreadings.of(path), w) for w, path in two.items() if len(path) == 2]
            # Neighbours count from a quarter to sixteenfold. What doesn't reach the likeliest or `sure` even so is never taken.
            top, weakest = max(got, default=(0.0, ""))[0], self._chance(lower) * (0.25 if lower in self.words else 1.0)
            got = sorted((x for x in got if 64 * x[0] > top and 16 * x[0] / weakest >= self.sure), key=lambda x: (-x[0], x[1]))
            if len(self._kept) < 500_000:
                self._kept[lower] = got
        return got

    def corrected(self, word: str, left: str = "", right: str = "", scanned: bool = True) -> str | None:
        """The word that was misread as `word` between `left` and `right`, or null if it wasn't misread.

        A candidate is taken if it would be seen in this form at least `sure`
        times as often as the form stands in the corpus by itself. A form under
        the vocabulary's floor may stand there by chance: the less, the longer it
        is, four times at three signs and a quarter of it for each further one. A neighbour with which the
        candidate makes a pair the corpus knows counts fourfold, one that would
        know it but doesn't by half; in a text without any other trace of
        scanning ten times the evidence is asked for.
        """
        if len(word) < 2:
            return None
        lower = word.lower()
        own = self.words.get(lower, 0)
        mixed = any(not (c.isalpha() or _is_mark(c)) for c in word.rstrip("!")) or (word.endswith("!") and len(word) > 2)
        best: tuple[float, str] | None = None
        if len(lower) >= 3:
            fits = self._fit(left, lower, right) if own else 1.0
            chance = self._chance(lower)
            for rate, w in self.candidates(lower):
                v = rate * self._fit(left, w, right) / (chance * fits)
                if best is None or v > best[0]:
                    best = (v, w)
        if best and best[0] >= self.sure * (1 if scanned else 10):
            return _cased(best[1], word)
        if own and not mixed or not scanned and not mixed:
            return None
        # A word the vocabulary lacks, a name: a sign is misread where its triple is rare beside that of what it may have been.
        m = self.misreadings
        new, at, changed = lower, 0, False
        while at < len(new):
            for s in m.longest_first:
                if new.startswith(s, at) and not (at == 0 and word[0].isupper()):
                    here = self._triple(new, at, at + len(s))
                    top = max((self._triple(new[:at] + t + new[at + len(s) :], at, at + len(t)), t) for t in m.back[s])
                    certain = not any(c.isalpha() or _is_mark(c) for c in s)
                    if top[0] >= (60.0 * max(0.5, here) if not certain else 1) or certain and mixed:
                        new, changed = new[:at] + top[1] + new[at + len(s) :], True
                        break
            at += 1
        return _cased(new, word) if changed else None

    def _chance(self, lower: str) -> float:
        return self.words.get(lower, 0) or max(0.03, 4.0 ** (4 - len(lower)))

    def _fit(self, left: str, word: str, right: str) -> float:
        out = 1.0
        for known, a, b in ((left in self.beside, left, word), (right in self.beside, word, right)):
            if known:
                out *= 4.0 if f"{a} {b}" in self.pairs else 0.5
        return out

    def _triple(self, word: str, a: int, b: int) -> float:
        w = f" {word} "
        return float(min((self.triples.get(w[i : i + 3], 0) for i in range(max(0, a - 1), min(len(w) - 2, b + 1))), default=0))

    def is_header(self, line: str) -> bool:
        words = skeleton(line, self).split()
        if not words:
            return False
        for h in self._shapes.get(len(words), ()):
            same = sum(a == b for a, b in zip(h, words, strict=True) if a != "_")
            if same >= max(2, sum(a != "_" for a in h) * 0.75):
                return True
        return False


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def _cased(word: str, like: str) -> str:
    if len(like) > 1 and like.upper() == like and any(c.isalpha() for c in like):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def skeleton(line: str, reader: Reader) -> str:
    """The line's known words in lower case, misreadings corrected, other words as '_'."""
    out = []
    for w in _TOKEN.findall(line):
        known = w.lower() if w.lower() in reader.words else (reader.corrected(w) or "").lower()
        out.append(known if known in reader.words else "_")
    return " ".join(out)


def furniture(lines: list[str], reader: Reader | None = None) -> tuple[set[int], set[int]]:
    """(page marks, headers) as line indices. A text of numbers alone has none.

    A header is a line that comes again, letter case and a sign in eight aside;
    beside a reader it must stand at the top or next to a page mark each time,
    unless it has the shape of one known from the corpus, and such lines needn't
    come again. It doesn't end like a sentence.
    """
    if not any(_TOKEN.search(x) for x in lines):
        return set(), set()
    marks = {i for i, x in enumerate(lines) if _PAGE.match(x)}
    plain = [(i, regex.sub(r"[\s]+", " ", x).strip().casefold()) for i, x in enumerate(lines) if i not in marks and x.strip() and len(x) <= 90 and not _END.search(x) and not _BROKEN.search(x)]
    same: dict[str, list[int]] = {}
    for i, a in plain:
        if len(a) >= 8:
            same.setdefault(a, []).append(i)
    heads = {i for at in same.values() if len(at) > 1 for i in at}
    # Lines that differ in few signs begin or end alike: only such are compared, each different line once.
    near: dict[tuple[int, str], list[str]] = {}
    for a in same:
        near.setdefault((0, a[:4]), []).append(a)
        near.setdefault((1, a[-4:]), []).append(a)
    for group in near.values():
        for n, a in enumerate(group):
            words = set(a.split())
            for b in group[n + 1 :]:
                if abs(len(a) - len(b)) <= 3 and 2 * len(words.intersection(b.split())) + 1 >= len(words) and _close(a, b, max(1, len(a) // 8)):
                    heads.update(same[a], same[b])
    if reader is not None:
        edge = {0} | {i + d for i in marks for d in (-1, 1)}
        heads = {i for i in heads if i in edge} if sum(i in edge for i in heads) >= 2 else set()
        heads |= {i for i, _ in plain if i not in heads and reader.is_header(lines[i])}
    return marks, heads


def _close(a: str, b: str, most: int) -> bool:
    if a == b:
        return True
    if sum((Counter(a) - Counter(b)).values()) > most:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(new[j] + 1, row[j] + (c != d), row[j + 1] + 1))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def broken_lines(lines: list[str], aside: set[int]) -> list[tuple[int, int]]:
    """(line, next line of text) for lines that end within a word."""
    body = [i for i in range(len(lines)) if i not in aside and lines[i].strip()]
    out = []
    for i, j in zip(body, body[1:], strict=False):
        if _BROKEN.search(lines[i]) and regex.match(r"\s*[\p{L}\p{M}!0-9]", lines[j]):
            out.append((i, j))
    return out


def read(text: str | None, reader: Reader) -> tuple[list[tuple[int, str]], str | None]:
    """((line number from 1, kind) of each trace of scanning, the repaired text)."""
    if not text:
        return [], text
    lines = text.split("\n")
    marks, heads = furniture(lines, reader) if len(lines) > 1 else (set(), set())
    noise = {(i + 1, "page_mark") for i in marks} | {(i + 1, "header") for i in heads}
    broken = dict(broken_lines(lines, marks | heads))
    noise |= {(i + 1, "broken_word") for i in broken}
    tail_of = {j: i for i, j in broken.items()}
    scanned = bool(noise)
    fixed = list(lines)
    tokens = [list(_TOKEN.finditer(_MASK.sub(lambda m: "\0" * len(m[0]), line))) for line in lines]
    for i, line in enumerate(lines):
        edits: list[tuple[int, int, str]] = [(m.start(), m.end(), "।") for m in _BAR.finditer(line)]
        for n, m in enumerate(tokens[i]):
            word, last, first = m[0], i in broken and n == len(tokens[i]) - 1, i in tail_of and n == 0
            left = tokens[i][n - 1][0].lower() if n else ""
            right = tokens[i][n + 1][0].lower() if n + 1 < len(tokens[i]) else ""
            if last or first:
                # Half a word is judged with its other half; the sign misread lies in the half that differs.
                near = tokens[broken[i]] if last else tokens[tail_of[i]]
                if not near:
                    continue
                whole = word + near[0][0] if last else near[-1][0] + word
                fix = reader.corrected(whole, left, right, scanned)
                if fix is None or fix.lower() == whole.lower():
                    continue
                half = _half(fix, whole, len(word), last)
                if half is not None and half.lower() != word.lower():
                    edits.append((m.start(), m.end(), half))
                continue
            bare = word.rstrip("!") if not any(c.isdecimal() for c in word) and word.endswith("!") and word[:-1].lower() in reader.words else word
            fix = reader.corrected(bare, left, right, scanned)
            if fix is not None and fix != bare:
                edits.append((m.start(), m.start() + len(bare), fix))
        if edits:
            noise.add((i + 1, "misread"))
            for a, b, new in sorted(edits, reverse=True):
                fixed[i] = fixed[i][:a] + new + fixed[i][b:]
    out: list[str] = []
    join = ""
    for i, line in enumerate(fixed):
        if i in marks or i in heads:
            continue
        if not lines[i].strip():
            out.append("\n\n" if out and out[-1] != "\n\n" else "")
            join = ""
            continue
        piece = line.strip()
        if i in broken:
            piece = piece.rstrip(BREAKS)
        out.append((join if out and out[-1] != "\n\n" else "") + piece)
        join = "" if i in broken else " "
    return sorted(noise), "".join(out).strip()


def _half(fix: str, whole: str, size: int, first: bool) -> str | None:
    """The part of `fix` that stands for the first or last `size` signs of `whole`, if the other part reads as it is."""
    low, seen = fix.lower(), whole.lower()
    rest = seen[size:] if first else seen[: len(seen) - size]
    if first:
        return fix[: len(fix) - len(rest)] if low.endswith(rest) else None
    return fix[len(rest) :] if low.startswith(rest) else None


def counted(text: str) -> tuple[set[str], set[str], set[str]]:
    """The different words, pairs of successive words, and repeated lines at a page's edge of one text."""
    words = [w.lower() for w in _TOKEN.findall(_MASK.sub(" \0 ", text))]
    lines = text.split("\n")
    heads: set[str] = set()
    if len(lines) > 2:
        heads = {" ".join(lines[i].split()) for i in furniture(lines)[1]}
    return set(words), {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}, heads


def triples_of(words: Iterator[str]) -> Counter:
    c: Counter = Counter()
    for w in words:
        x = f" {w} "
        c.update({x[i : i + 3] for i in range(len(x) - 2)})
    return c


def learn(texts: DataFrame, text: str = "evidence_text", share: float = 0.0005, least: int = 3) -> Reader:
    """The reader of a corpus, from counts over all its texts, which are read once.

    Words and pairs of words that stand in at least `share` of the texts (and
    `least`) are the vocabulary and its contexts: no more than the mean number of
    words a text over `share`. Misreadings come from forms much rarer than a
    vocabulary word one edit away; their edits are added up over the corpus. Sign triples are counted over the different words; their
    number is bounded by the signs of the scripts. Headers are the shapes of
    repeated lines found in `least` texts or more and half of `share` of them.
    """
    shelf = Shelf(texts.sparkSession)
    t = spread(texts.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: list[Counter] = [Counter(), Counter(), Counter(), Counter()]
        for b in batches:
            for x in b["_t"]:
                for kind, found in enumerate(counted(x)):
                    c[kind].update(found)
            c[3]["texts"] += len(b)
            if sum(map(len, c)) > 1_000_000:  # a worker's counts are handed on before they grow large
                yield _long(c)
                c = [Counter(), Counter(), Counter(), Counter()]
        yield _long(c)

    counts = shelf.put(t.mapInPandas(count, "_kind int, _w string, _n bigint").groupBy("_kind", "_w").agg(F.sum("_n").alias("_n")))
    total = counts.where("_kind = 3").agg(F.sum("_n")).first()[0] or 0
    floor = max(least, int(total * share))
    some = {0: {}, 1: {}}
    for kind, w, n in counts.where(F.col("_kind").isin(0, 1) & (F.col("_n") >= floor)).collect():
        some[kind][w] = n
    vocabulary, pairs = some[0], {w: n for w, n in some[1].items() if all(x in some[0] for x in w.split(" "))}
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, Trie(vocabulary)))

    def study(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, trie = shared.value
        for b in batches:
            weights: Counter = Counter()
            for w, n in zip(b["_w"], b["_n"], strict=True):
                for e, v in probable_edits(w, n, words, trie):
                    weights[e] += v
            grams = triples_of(b["_w"])
            yield pd.DataFrame([(a, s, v) for (a, s), v in weights.items()] + [(g, None, float(n)) for g, n in grams.items()], columns=["_a", "_s", "_v"])

    studied = counts.where("_kind = 0").select("_w", "_n")
    sums = spread(studied).mapInPandas(study, "_a string, _s string, _v double").groupBy("_a", "_s").agg(F.sum("_v").alias("_v")).where("_v >= 2").collect()
    misreadings = Misreadings({(r[0], r[1]): r[2] for r in sums if r[1] is not None}, vocabulary, floor)
    reader = Reader(vocabulary, pairs, {r[0]: int(r[2]) for r in sums if r[1] is None}, misreadings, set())
    # Repeated lines are reduced to shapes where they are; few shapes are left to gather.
    knows = texts.sparkSession.sparkContext.broadcast(reader)

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for line, n in zip(b["_w"], b["_n"], strict=True):
                c[skeleton(line, knows.value)] += n
            yield pd.DataFrame([(k, n) for k, n in c.items() if sum(w != "_" for w in k.split()) >= 2], columns=["_s", "_n"])

    found = counts.where("_kind = 2").select("_w", "_n").mapInPandas(shapes, "_s string, _n bigint").groupBy("_s").agg(F.sum("_n").alias("_n"))
    reader.headers = {r[0] for r in found.where(F.col("_n") >= max(least, int(total * share / 2))).collect()}
    shelf.clear(counts)
    return Reader(reader.words, reader.pairs, reader.triples, misreadings, reader.headers)


def _long(counters: list[Counter]) -> pd.DataFrame:
    rows = [(kind, w, n) for kind, c in enumerate(counters) for w, n in c.items()]
    return pd.DataFrame(rows, columns=["_kind", "_w", "_n"]).astype({"_kind": "int32", "_n": "int64"})


def repair(texts: DataFrame, key: str = "signal_id", text: str = "evidence_text", reader: Reader | None = None) -> DataFrame:
    """key, repaired text, noise array<struct<line_no,noise>>.

    Noise kinds: broken_word, misread, header, page_mark; line numbers count
    line feeds of the original from 1. Line ends become blanks, blank lines end
    paragraphs. Null stays null, empty empty; rows come out as often as they
    stand; other columns are ignored; texts are read whole.
    """
    shared = texts.sparkSession.sparkContext.broadcast(reader or learn(texts, text))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared.value
        for b in batches:
            out = []
            for k, t in zip(b["_key"], b["_text"], strict=True):
                noise, new = read(t, reader)
                out.append((k, new, [{"line_no": n, "noise": w} for n, w in noise]))
            yield pd.DataFrame(out, columns=["_key", "_new", "noise"])

    t = spread(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    return t.mapInPandas(run, f"_key {kind}, _new string, noise array<struct<line_no:int,noise:string>>").withColumnsRenamed({"_key": key, "_new": text})


def scanning_traces(signals: DataFrame) -> DataFrame:
    """signal_id, line_no, noise."""
    return repair(signals).select("signal_id", F.explode("noise").alias("_n")).select("signal_id", F.col("_n.line_no").alias("line_no"), F.col("_n.noise").alias("noise"))
