"""Personal information in free text: found and replaced by typed placeholders.

High-recall generators propose spans that may overlap: numbers, codes,
addresses, and any two words in a row that the corpus hardly knows. Boosted
trees score each candidate from its format, from how common its words and its
neighbours' are in the whole corpus, and from the nearest cue words. Candidates
above a calibrated threshold are kept, the likeliest first, and replaced.

No labelled texts exist. The trees are fitted on invented items set into
sentences of the corpus, and on the corpus's own candidates that nothing speaks
for; texts are parted between fitting, calibration and choice of the threshold.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teesta.llm.boosting import BoostedTrees
from teesta.llm.shelf import spread

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "PERSON")

# Titles, and words that commonly introduce each kind or a number of goods, in the languages read.
TITLES = ["Dr", "Shri", "Smt", "Sri", "Mr", "Mrs", "Ms", "Prof", "Kumari", "Sd/-", "डॉ", "डा", "श्रीमती", "श्री", "सुश्री", "ଡା", "ଡଃ", "ଶ୍ରୀମତୀ", "ଶ୍ରୀ", "ডা", "ডঃ", "শ্রীমতী", "শ্রী"]
CUES = {
    "name": ["named", "name", "called", "person", "reported by", "signed", "son of", "daughter of", "wife of", "patient", "naam", "mareez", "नाम", "नाव", "मरीज", "रुग्ण", "ନାମ", "ରୋଗୀ", "নাম", "রোগী"],
    "phone": ["call", "phone", "mob", "mobile", "tel", "telephone", "whatsapp", "reached on", "contact", "फोन", "मोबाइल", "मोबाईल", "दूरध्वनी", "दूरभाष", "ଫୋନ", "ମୋବାଇଲ", "ফোন", "মোবাইল"],
    "id": ["id", "identity", "card", "aadhaar", "aadhar", "passport", "voter", "pan", "पहचान", "कार्ड", "ओळख", "आधार", "ପରିଚୟ", "କାର୍ଡ", "ଆଧାର", "পরিচয়", "পরিচয়", "কার্ড", "আধার"],
    "address": ["residence", "resident", "lives", "address", "house", "pata", "निवास", "पता", "पत्ता", "राहणार", "ଠିକଣା", "ଘର", "ঠিকানা", "নিবাস"],
    "goods": ["batch", "lot", "grant", "circular", "letter", "toll free", "helpline", "invoice", "consignment", "serial", "tender", "order", "receipt", "voucher", "parcel", "memo", "licence", "खेप", "पत्र", "परिपत्र", "अनुदान", "हेल्पलाइन", "बैच", "निविदा", "ବ୍ୟାଚ", "ଚିଠି", "ଅନୁଦାନ", "ହେଲ୍ପଲାଇନ", "ব্যাচ", "চিঠি", "অনুদান", "হেল্পলাইন"],
}
# Words for a street and for a house, as addresses have them.
STREETS = r"(?:Street|Lane|Road|Colony|Apartments|Nagar|Marg|गली|गल्ली|मार्ग|ଗଳି|গলি)"
HOUSES = r"(?:House|Plot|Flat|Door|Quarter|Qr\.?|H\.)\s*(?:No\.?\s*)?[\p{Nd}A-Z][\p{Nd}/-]*|मकान\s+संख्या\s+\p{Nd}+|घर\s+क्रमांक\s+\p{Nd}+|ଘର\s+ନମ୍ବର\s+\p{Nd}+|(?:বাড়ি|বাড়ি)\s+নম্বর\s+\p{Nd}+"

_EMAIL = regex.compile(r"[\w\p{M}.+-]*[\w\p{M}]@[\w-]+(?:\.[\w-]+)+")
_NUMBER = regex.compile(r"(?<![\p{Nd}\p{L}\p{M}/@.])(?:\(?\+\p{Nd}{1,3}\)?[\s-]{0,2})?\p{Nd}(?:[\s-]?\p{Nd}){8,14}(?![\p{Nd}\p{L}\p{M}/])")
_CODE = regex.compile(r"(?<![\p{Nd}\p{L}])[A-Z]{2,6}\p{Nd}{3,9}[A-Z]?(?![\p{Nd}\p{L}\p{M}])")
_ADDRESS = regex.compile(rf"(?:{HOUSES}|(?<![\p{{L}}\p{{Nd}}-])[A-Z]-\p{{Nd}}+(?=,)|(?<![\p{{Nd}}\p{{L}}/.-])\p{{Nd}}{{1,4}}(?=,?\s+[A-Z]\w+\s+{STREETS}))(?:(?!\.\s)[^।|]){{4,110}}?(?<!\p{{Nd}})\p{{Nd}}{{6}}(?!\p{{Nd}})")
_WORD = regex.compile(r"[\p{L}\p{M}](?:[\p{L}\p{M}0-9!]*[\p{L}\p{M}0-9])?")
_SIX = regex.compile(r"\p{Nd}{6}")
_NINE = regex.compile(r"\p{Nd}(?:[\s-]?\p{Nd}){8}")
_INITIAL = regex.compile(r"\s+[A-Z]\.\s+")
_STREET, _HOUSE = regex.compile(STREETS), regex.compile(rf"^(?:{HOUSES})")
_TITLE = regex.compile("(?<![\\p{L}\\p{M}])(?:" + "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True)) + r")\.?\s*$", regex.I)
# Words of Indian scripts may carry a case ending.
_any = lambda ws: "|".join(regex.escape(w) + ("s?" if w.isascii() else r"[\p{M}\p{L}]{0,3}") for w in sorted(ws, key=len, reverse=True))
_CUE = {n: regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{_any(ws)})(?![\p{{L}}\p{{M}}])", regex.I) for n, ws in CUES.items()}
_STOP = regex.compile(r"[.!?।]\s|\n\s*\n")
_TITLES = {t.casefold() for t in TITLES}
_NAME_CUES = {w.split()[-1] for w in CUES["name"]}
_CUE_END = regex.compile(_CUE["name"].pattern + r"[\s:,]*$", regex.I)
_EDGES = ".,;:!?()[]\"'।॥|“”’<>-"


class Corpus:
    """How common each word is: `words` has those of at least `floor` of the `total` texts."""

    def __init__(self, words: dict[str, int], total: int, floor: int) -> None:
        self.words, self.total, self.floor = words, max(1, total), max(1, floor)

    def known(self, word: str) -> bool:
        return word.lower() in self.words

    def rarity(self, word: str) -> float:
        """0 for a word of every text, growing with the logarithm; a word under the floor counts as half of it."""
        return math.log(self.total / self.words.get(word.lower(), self.floor / 2))


def _worth_reading(text: str, corpus: Corpus) -> bool:
    """Whether two words in a row may be a name at all: neither known, or a title or an initial among them."""
    before = False
    for token in text.split():
        bare = token.strip(_EDGES)
        if not bare or bare[0].isdecimal():
            before = False
            continue
        low = bare.lower()
        if low.rstrip(".") in _TITLES or len(bare) == 1 and bare.isupper() or low in _NAME_CUES:
            return True
        rare = low not in corpus.words
        if rare and before:
            return True
        before = rare
    return False


def _names(text: str, corpus: Corpus) -> Iterator[tuple[int, int]]:
    """Words in a row that may be a name: two the corpus hardly knows, capital letters in front in Latin script; with one such word after a title or a cue; and any beside an initial."""
    if not _worth_reading(text, corpus):
        return
    words = [m for m in _WORD.finditer(text) if m[0].casefold() not in _TITLES]
    for i, a in enumerate(words):
        first = a[0]
        latin = first[0].isascii()
        if latin and not first[0].isupper() or i + 1 == len(words):
            continue
        b = words[i + 1]
        second = b[0]
        gap = text[a.end() : b.start()]
        if (not latin or second[0].isupper()) and len(second) > 1 and (len(first) > 1 and gap.isspace() or latin and len(first) == 1 and gap.startswith(".") and gap[1:].isspace()):
            strange = (len(first) > 1 and not corpus.known(first)) + (not corpus.known(second))
            before = text[max(0, a.start() - 24) : a.start()]
            if strange == 2 - (len(first) == 1) or _TITLE.search(before) or strange and _CUE_END.search(before):
                yield a.start(), b.end()
        if latin and i + 2 < len(words) and len(second) == 1 and len(first) > 1:
            c = words[i + 2]
            if c[0][0].isupper() and len(c[0]) > 1 and _INITIAL.fullmatch(text[a.end() : c.start()]):
                yield a.start(), c.end()


def candidates(text: str, corpus: Corpus) -> list[tuple[int, int, str]]:
    """Overlapping proposals (begin, end, kind); a long number is proposed as a telephone and as an identity number."""
    out = [(m.start(), m.end(), "EMAIL") for m in _EMAIL.finditer(text)] if "@" in text else []
    if _NINE.search(text):
        for m in _NUMBER.finditer(text):
            out += [(m.start(), m.end(), "PHONE"), (m.start(), m.end(), "ID")]
    out += [(m.start(), m.end(), "ID") for m in _CODE.finditer(text)]
    if _SIX.search(text):
        out += [(m.start(), m.end(), "ADDRESS") for m in _ADDRESS.finditer(text)]
    return out + [(a, b, "PERSON") for a, b in _names(text, corpus)]


def features(text: str, begin: int, end: int, kind: str, corpus: Corpus) -> list[float]:
    """Format and context of a candidate. Cues count by their distance in words within the sentence; 9 stands for none."""
    span, before, after = text[begin:end], text[max(0, begin - 60) : begin], text[end : end + 40]
    for m in _STOP.finditer(before):
        cut = m.end()
        # a full stop after a title or an abbreviation ends no sentence
        if not (_TITLE.search(before, 0, m.start() + 1) or len(before[: m.start()].split(" ")[-1]) <= 3 and before[m.start()] == "."):
            before = " " * cut + before[cut:]
    stop = _STOP.search(after)
    after = after[: stop.start()] if stop else after
    number = "".join(str(int(c)) for c in span if c.isdecimal())
    words = _WORD.findall(span)
    row = [
        float(KINDS.index(kind)), float(len(number)), float(sum(c in "- \n" for c in span)), float(span[:1] in "+("), float(number.startswith("91") and len(number) == 12),
        float(number[0]) if number else -1.0, float(number.startswith("00")), float(sum(c.isalpha() for c in span)), float(end - begin), float(len(words)),
    ]
    for n in ("phone", "id", "address", "goods", "name"):
        found = list(_CUE[n].finditer(before))
        row.append(float(min(9, len(before[found[-1].end() :].split()))) if found else 9.0)
        m = _CUE[n].search(after)
        row.append(float(min(9, len(after[: m.start()].split()))) if m else 9.0)
    rare = [corpus.rarity(w) for w in words if len(w) > 1] or [0.0]
    near = _WORD.findall(before)[-1:], _WORD.findall(after)[:1]
    line = text[text.rfind("\n", 0, begin) + 1 : begin + span.find("\n")] if "\n" in span else ""
    row += [
        float(bool(_TITLE.search(before))), min(rare), max(rare), float(sum(corpus.known(w) for w in words)),
        *[corpus.rarity(n[0]) if n else -1.0 for n in near], float("\n" in span), float(len(line)) if line else -1.0,
        float(bool(_STREET.search(span))), float(bool(_HOUSE.search(span))), float(all(w[:1].isupper() for w in words)), float(len(number) >= 6 and span[-6:].isdecimal()), float("@" in span), float(len(number) == 12),
    ]
    return row


# How the scripts lie in the code chart, and how an address is written in each.
_SHIFT = {"DEVANAGARI": 0, "BENGALI": 0x80, "ORIYA": 0x200}
_HOUSE_FORMS = {"DEVANAGARI": ["मकान संख्या {n}, {p} गली, {q}, पिन {c}", "घर क्रमांक {n}, {p} गल्ली, {q} {c}"], "ORIYA": ["ଘର ନମ୍ବର {n}, {p} ଗଳି, {q}, ପିନ {c}"], "BENGALI": ["বাড়ি নম্বর {n}, {p} গলি, {q}, পিন {c}"]}
_LATIN_HOUSE_FORMS = ["Plot {n}/{m}, {p} Road, {q}, PIN {c}", "House No. {n}, {p} Lane, {q} {c}", "Flat {n}, {p} Apartments, {q}, {c}", "Qr. No. B-{n}, {p} Colony, {q}, {c}", "{n} {p} Street, {q} - {c}", "Door No {n}, {p} Marg, {q} {c}", "{n}, {p} Nagar, {q}, {c}"]


class Inventor:
    """Items of every kind, and look-alikes, from random letters and digits."""

    def __init__(self, r: random.Random) -> None:
        self.r = r
        self.latin = [c + v for c in "b ch d f g h j k l m n p r s sh t v y".split() for v in ("a", "e", "i", "o", "u", "an", "ar")]
        self.deva = [chr(c) + v for c in range(0x915, 0x939) for v in ("", "ा", "ि", "े", "ो", "ु")]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, script: str) -> str:
        n = self.r.choice([2, 2, 3])
        if script == "LATIN":
            return "".join(self.r.choice(self.latin) for _ in range(n)).capitalize()
        return "".join(chr(ord(c) + _SHIFT[script]) for _ in range(n) for c in self.r.choice(self.deva))

    def item(self, kind: str, script: str) -> str:
        r, d = self.r, self.digits
        if kind == "EMAIL":
            return f"{self.word('LATIN').lower()}{r.choice(['.', '_', '+', '', d(2)])}{self.word('LATIN').lower()}@{self.word('LATIN').lower()}.{r.choice(['org', 'in', 'co.in', 'example.net'])}"
        if kind == "PHONE":
            own = r.choice("56789") + d(9)
            return r.choice([f"+91 {own[:5]} {own[5:]}", f"+91-{own}", f"(+91) {own[:4]} {own[4:7]} {own[7:]}", f"{own[:5]}-{own[5:]}", f"{own[:5]} {own[5:]}", own, f"0{own}", f"91{own}", f"0{d(4)}-{d(6)}"])
        if kind == "ID":
            code = "".join(r.choice("ABCDEFGHJKLMNPRSTVXYZ") for _ in range(5))
            return r.choice([self.grouped(), self.grouped(), self.grouped(), f"{d(2)}-{self.grouped('-')}", f"{code[:3]}{d(7)}", f"{code}{d(4)}{r.choice('ABCDEFGH')}"])
        if kind == "ADDRESS":
            form = r.choice(_LATIN_HOUSE_FORMS if script == "LATIN" else _HOUSE_FORMS[script])
            return form.format(n=d(r.choice([2, 3])), m=d(1), p=self.word(script), q=self.word(script), c=d(6))
        a, b = self.word(script), self.word(script)
        if script != "LATIN":
            return f"{a} {b}"
        n = r.choice([f"{a} {b}", f"{a} {b}", f"{a} {r.choice('ABCDEGHJKLMNPRST')}. {b}", f"{r.choice('ABCDEGHJKLMNPRST')}. {b}"])
        return n.upper() if r.random() < 0.15 else n

    def grouped(self, sep: str | None = None) -> str:
        s = self.r.choice(["-", " ", ""]) if sep is None else sep
        return s.join((self.digits(4), self.digits(4), self.digits(4)))


def _script(text: str) -> str:
    n = {"LATIN": 0, "DEVANAGARI": 0, "BENGALI": 0, "ORIYA": 0}
    for c in text:
        o = ord(c)
        if c.isascii() and c.isalpha():
            n["LATIN"] += 1
        elif 0x900 <= o < 0x980:
            n["DEVANAGARI"] += 1
        elif 0x980 <= o < 0xA00:
            n["BENGALI"] += 1
        elif 0xB00 <= o < 0xB80:
            n["ORIYA"] += 1
    return max(n, key=lambda k: n[k])


def training_rows(sample: list[str], corpus: Corpus, size: int = 6000, seed: int = 7) -> list[tuple[str, int, int, str, int, int]]:
    """(text, begin, end, kind, label, text number) of labelled candidates.

    Each text is a passage of the corpus into which an invented item, or a
    number of goods, is set between two words, with a title or a cue word before
    it and up to two common words between, or with nothing. Besides, the
    corpus's own candidates of persons that hold a common word, and of long
    numbers without any cue of their own, are taken for negatives.
    """
    r = random.Random(seed)
    make = Inventor(r)
    passages = [s for t in sample for s in regex.split(r"(?<=[.!?।])\s+", t) if len(s.split()) >= 4] or ["The team met the staff on Monday and left."]
    by_script: dict[str, list[str]] = {}
    for s in passages:
        by_script.setdefault(_script(s), []).append(s)
    cues: dict[tuple[str, str], list[str]] = {}
    for n, ws in CUES.items():
        for w in ws:
            cues.setdefault((n, _script(w)), []).append(w)
    titles = {s: [t for t in TITLES if (_script(t) if t != "Sd/-" else "LATIN") == s] for s in ("LATIN", "DEVANAGARI", "BENGALI", "ORIYA")}
    fillers = {s: [w for w in corpus.words if _script(w) == s and not any(c.search(w) for c in _CUE.values()) and w not in _TITLES] or ["the"] for s in titles}
    digits = {"DEVANAGARI": 0x966, "BENGALI": 0x9E6, "ORIYA": 0xB66}
    out = []
    for i in range(size):
        script = r.choice(sorted(by_script))
        kind = KINDS[i % 5]
        words = r.choice(by_script[script]).split(" ")
        at = r.randrange(len(words) + 1)
        lead, label, item = "", 1, make.item(kind, script)
        few = lambda most: " ".join(r.choice(fillers[script]) for _ in range(r.randrange(most + 1)))  # noqa: E731, B023
        cue = lambda n: r.choice(cues.get((n, script)) or cues[(n, "LATIN")])  # noqa: E731, B023
        luck = r.random()
        if kind == "PERSON":
            lead = f"{r.choice(titles[script])}{r.choice(['.', '', ''])}" if luck < 0.45 else f"{cue('name')}{r.choice(['', ':', ','])}" if luck < 0.8 else ""
        elif kind in ("PHONE", "ID") and luck < 0.33:
            label, lead = 0, f"{cue('goods')} {few(1)}"
            item = make.grouped() if r.random() < 0.6 else item if not item.startswith(("+", "(")) else make.grouped("")
        elif kind == "ID":
            lead = f"{cue('id')} {few(4)}{r.choice(['', ':', ''])}"
        elif kind == "PHONE":
            lead = f"{cue('phone')} {few(4)}{r.choice(['', ':', ''])}" if luck < 0.85 else ""
        elif kind == "ADDRESS":
            lead = f"{cue('address')} {few(1)}{r.choice(['', ':', ''])}" if luck < 0.8 else ""
        if script != "LATIN" and kind in ("PHONE", "ID", "ADDRESS") and r.random() < 0.4:
            item = "".join(chr(digits[script] + int(c)) if c.isascii() and c.isdigit() else c for c in item)
        head = " ".join(words[:at])
        full = f"{head} {' '.join(lead.split())}".strip()
        begin = len(full) + (1 if full else 0)
        text = f"{full} {item}".strip() + r.choice(["", "", ",", "."]) + " " + " ".join(words[at:])
        end = begin + len(item)
        if label and r.random() < 0.25 and " " in item:
            k = begin + r.choice([j for j, c in enumerate(item) if c == " "])
            text = text[:k] + "\n" + text[k + 1 :]
        elif r.random() < 0.2:
            blanks = [k for k, c in enumerate(text) if c == " "]
            for k in r.sample(blanks, min(2, len(blanks))):
                text = text[:k] + "\n" + text[k + 1 :]
        for a, b, k in candidates(text, corpus):
            if (a, b) == (begin, end) and k == kind:
                out.append((text, a, b, k, label, i))
            elif a < end and b > begin and (k == kind or k in ("PHONE", "ID") and kind in ("PHONE", "ID")):
                out.append((text, a, b, k, 0, i))  # what lies within an item of another kind yields to it
    # Nothing speaks for these candidates of the corpus itself.
    for n, t in enumerate(sample):
        for a, b, k in candidates(t, corpus):
            f = features(t, a, b, k, corpus)
            unsupported = k == "PERSON" and any(corpus.known(w) for w in _WORD.findall(t[a:b]) if len(w) > 1) or k == "PERSON" and f[10 + 8] == 9.0 and not _TITLE.search(t[max(0, a - 14) : a]) and "\n" in t[a:b]
            if unsupported or k in ("PHONE", "ID") and not t[a : a + 1] in "+(" and all(x == 9.0 for x in f[10:16]) and f[16] < 9.0:
                out.append((t, a, b, k, 0, size + n))
    return out


class Finder:
    """Corpus, fitted trees and threshold."""

    def __init__(self, corpus: Corpus, sample: list[str], beta: float = 1.0) -> None:
        self.corpus = corpus
        rows = training_rows(sample, corpus)
        x = np.array([features(t, a, b, k, corpus) for t, a, b, k, _, _ in rows])
        y = np.array([c[4] for c in rows], dtype=float)
        part = np.array([c[5] // len(KINDS) % 5 for c in rows])  # by text: 0-2 fit, 3 calibrates, 4 sets the threshold
        self.trees = BoostedTrees().fit(x, y, calibrate=part == 3, leave=part == 4)
        self.cutoff = self.trees.threshold(x[part == 4], y[part == 4], beta)

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Spans (begin, end, kind, probability) that don't overlap, in order."""
        c = candidates(text, self.corpus) if text else []
        if not c:
            return []
        p = self.trees.probability(np.array([features(text, *x, self.corpus) for x in c]))
        return _apart(c, p, self.cutoff)


def _apart(c: list[tuple[int, int, str]], p: np.ndarray, cutoff: float) -> list[tuple[int, int, str, float]]:
    taken: list[tuple[int, int, str, float]] = []
    # The longer span goes first among the equally likely: an address holds its house number, not the other way.
    for i in sorted(range(len(c)), key=lambda i: (-round(float(p[i]), 1), c[i][0] - c[i][1])):
        a, b, k = c[i]
        if p[i] >= cutoff and all(b <= s or a >= e for s, e, _, _ in taken):
            taken.append((a, b, k, float(p[i])))
    return sorted(taken)


def learn(texts: DataFrame, text: str = "evidence_text", share: float = 0.0005, least: int = 3, most: int = 1500) -> Finder:
    """The finder of a corpus.

    Word counts are taken over all texts; words in at least `share` of them (and
    `least`) are known, no more than the mean number of words a text over
    `share`. The trees see at most `most` texts, the first by hash: a bounded
    sample for fitting alone.
    """
    t = texts.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    total = t.count()
    floor = max(least, int(total * share))
    words = t.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"([\p{L}\p{M}]+)"), 1))).alias("_w")).groupBy("_w").count()
    common = {r[0]: r[1] for r in words.where(F.col("count") >= floor).collect()}
    sample = [r[0] for r in t.orderBy(F.xxhash64("_t"), "_t").limit(most).collect()]
    return Finder(Corpus(common, total, floor), sample)


def redact(texts: DataFrame, key: str = "signal_id", text: str = "evidence_text", finder: Finder | None = None) -> DataFrame:
    """key, text with placeholders like [PHONE], and items array<struct<kind,begin,end,confidence>> (code points of the original).

    All else in the text is unchanged. A null text stays null without items;
    rows come out as often as they stand; other columns are ignored; texts are
    read whole.
    """
    shared = texts.sparkSession.sparkContext.broadcast(finder or learn(texts, text))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = shared.value
        for b in batches:
            # All candidates of a batch are scored at once.
            found = [candidates(t, finder.corpus) if t else [] for t in b["_text"]]
            rows = [features(t, *c, finder.corpus) for t, cs in zip(b["_text"], found, strict=True) for c in cs]
            p = finder.trees.probability(np.array(rows)) if rows else np.empty(0)
            out, at = [], 0
            for k, t, cs in zip(b["_key"], b["_text"], found, strict=True):
                spans = _apart(cs, p[at : at + len(cs)], finder.cutoff)
                at += len(cs)
                new = t
                for a, e, what, _ in reversed(spans):
                    new = f"{new[:a]}[{what}]{new[e:]}"
                out.append((k, new, [{"kind": w, "begin": a, "end": e, "confidence": q} for a, e, w, q in spans]))
            yield pd.DataFrame(out, columns=["_key", "_new", "items"])

    t = spread(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    return t.mapInPandas(run, f"_key {kind}, _new string, items array<struct<kind:string,begin:int,end:int,confidence:double>>").withColumnsRenamed({"_key": key, "_new": text})


def personal_items(signals: DataFrame) -> DataFrame:
    """signal_id, kind, begin_at of each item of personal data."""
    return redact(signals).select("signal_id", F.explode("items").alias("_i")).select("signal_id", F.col("_i.kind").alias("kind"), F.col("_i.begin").alias("begin_at"))
