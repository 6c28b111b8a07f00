"""Scanned text: the misreadings aren't told to the reader, it has to learn them from the corpus."""

import random

import pytest

from teesta.llm import scans

SENTENCES = [
    "the mobile medical unit tested samples from homes near the school hostel", "a second round of indoor spraying was finished before the rains came to the village",
    "health workers visited every household and counted fevers among children", "the municipal office cleaned drains and covered open water containers near the market",
    "nurses reached the community centre after many hours and treated several patients", "residents were asked to boil water and to sleep under treated bed nets",
    "supervisors noted that stock of tablets would last until the end of the month", "the notice was read out in the assembly and pasted on the doors of the school",
]
CONFUSED = {"e": "c", "s": "5", "m": "rn", "o": "0", "h": "b", "t": "f"}


def corpus(n=600, seed=5):
    """(id, text, {(line, kind)}): a sixth of the texts is broken into lines, with misreadings and page marks."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = " ".join(r.sample(SENTENCES, 3)).split() + ["".join(r.choice(["ka", "pu", "ri", "bha", "to"]) for _ in range(3)).capitalize()]
        if i % 6:
            out.append((str(i), " ".join(words), set()))
            continue
        truth, lines = set(), []
        for at in range(0, len(words), 9):
            line = words[at : at + 9]
            if r.random() < 0.6:
                k = r.randrange(len(line))
                spots = [j for j, c in enumerate(line[k]) if c in CONFUSED and j]
                if len(line[k]) > 4 and spots:
                    j = r.choice(spots)
                    line[k] = line[k][:j] + CONFUSED[line[k][j]] + line[k][j + 1 :]
                    truth.add((len(lines) + 1, "misread"))
            lines.append(" ".join(line))
            if r.random() < 0.3:
                lines.append(f"- {r.randrange(1, 20)} -")
                truth.add((len(lines), "page_mark"))
        out.append((str(i), "\n".join(lines), truth))
    return out


@pytest.fixture(scope="module")
def reader(spark):
    return scans.learn(spark.createDataFrame([(i, t) for i, t, _ in corpus()], "signal_id string, evidence_text string"))


def one_edit(a, b):
    """Whether one sign put for another, added or dropped, or two read as one or one as two, makes `a` of `b`."""
    for i in range(len(b) + 1):
        for m in (0, 1, 2):
            for n in (0, 1, 2):
                if m + n and m + n <= 3 and i + m <= len(b) and len(b) - m + n == len(a) and a[:i] == b[:i] and a[i + n :] == b[i + m :]:
                    return (m, n) not in ((0, 2), (2, 0), (2, 2))
    return a == b


def test_automaton_gives_every_word_in_reach():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 7))): 1 for _ in range(250)}
    trie = scans.Trie(words)
    for q in ("abcab", "a", "ccc", "bacbac", "ab"):
        near = {w for w in words if one_edit(q, w)}
        assert set(scans.LevenshteinAutomaton(q, 1).words(trie)) == near
        two = scans.LevenshteinAutomaton(q, 2).words(trie)
        assert near <= set(two) and all(len(p) <= 2 for p in two.values())


def test_misreadings_are_learnt(reader):
    got = {e for e, r in reader.misreadings.rate.items() if r > 1e-3}
    assert {(t, s) for t, s in CONFUSED.items()} <= got
    assert reader.misreadings.of((("e", "c"),)) > 100 * reader.misreadings.of((("e", "k"),))


def test_held_out_scans(reader):
    """Texts of another seed: found lines are nearly all and only those misread."""
    hit = false = missed = 0
    for _, text, truth in corpus(200, 77):
        noise, _ = scans.read(text, reader)
        found = {x for x in noise if x[1] == "misread"}
        want = {x for x in truth if x[1] == "misread"}
        hit, false, missed = hit + len(found & want), false + len(found - want), missed + len(want - found)
        assert {x for x in noise if x[1] == "page_mark"} == {x for x in truth if x[1] == "page_mark"}
    assert hit / (hit + missed) >= 0.9 and hit / (hit + false) >= 0.97, (hit, false, missed)


def test_context_ranks(reader):
    """Two words are equally near; the words beside decide."""
    words = {"boat": 100, "boot": 100, "the": 900, "river": 80, "leather": 80}
    pairs = {"river boat": 50, "leather boot": 50}
    m = scans.Misreadings({("a", "x"): 5.0, ("o", "x"): 5.0}, {"boat": 100, "boot": 100}, 1)
    r = scans.Reader(words, pairs, {}, m, set())
    assert r.corrected("boxt", "river", "") == "boat" and r.corrected("boxt", "leather", "") == "boot"
    assert r.corrected("boat", "leather", "") is None  # a word of the corpus that no listed misreading explains
    none = scans.Reader(words, pairs, {}, scans.Misreadings({}, words, 1), set())
    assert none.corrected("bozt", "", "", False) is None


class Whole(scans.Reader):
    """Leaves no candidate out."""

    def candidates(self, lower):
        m = self.misreadings
        got = [(self.words[w] * m.of((scans.difference(w, lower),)), w) for w in scans.LevenshteinAutomaton(lower, 1).words(self.trie) if w != lower]
        if len(lower) >= 7 and max(got, default=(0.0, ""))[0] < self.sure and any(not (c.isalpha() or scans._is_mark(c)) for c in lower):
            got += [(self.words[w] * m.of(p), w) for w, p in scans.LevenshteinAutomaton(lower, 2).words(self.trie).items() if len(p) == 2]
        return sorted(got, key=lambda x: (-x[0], x[1]))


def test_context_ranks_all_candidates():
    """Ten words are as likely, the pair the corpus knows is with the last of them."""
    words = {f"b{c}at": 100 for c in "cdefghijkl"}
    m = scans.Misreadings({(c, "x"): 5.0 for c in "cdefghijkl"}, words, 1)
    r = scans.Reader(words | {"river": 80}, {"river blat": 50}, {}, m, set())
    assert r.corrected("bxat", "river", "") == "blat"


def test_left_out_candidates_are_never_taken():
    """Random vocabularies, forms and neighbours: the same as with every candidate looked at."""
    r, crowds, taken = random.Random(4), 0, 0
    for _ in range(60):
        sign = lambda: r.choice("abcde")
        words = {"".join(sign() for _ in range(r.choice([3, 4, 5, 8]))): int(10 ** r.uniform(0, 4)) for _ in range(250)}
        names = sorted(words)
        weights = {(a, b): float(r.choice([1, 5, 50, 500, 4000])) for a in "abcde" for b in ["x", "0", *"abcde"] if a != b and r.random() < 0.7}
        m = scans.Misreadings(weights, words, 1)
        pairs = {f"{r.choice(names)} {r.choice(names)}": 9 for _ in range(2000)}
        here, whole = (kind(words, pairs, {}, m, set()) for kind in (scans.Reader, Whole))
        for _ in range(150):
            w = r.choice(names)
            i = r.randrange(len(w))
            form = r.choice([w, w[:i] + r.choice("x0abcde") + w[i + 1 :], w[:i] + "0" + w[i + 1 :][:-1] + "x"])
            left, right, scanned = r.choice(names), r.choice([*names, ""]), r.random() < 0.7
            want = whole.corrected(form, left, right, scanned)
            crowds, taken = crowds + (len(whole.candidates(form)) > 8), taken + (want is not None)
            assert here.corrected(form, left, right, scanned) == want
    assert crowds > 500 and taken > 500


def test_repair(spark, reader):
    noisy = "Weekly Bulletin Pada\nthe mobile rnedical unit tes-\nPage 4\nWeekly Bulletin Pada\nted sampl5s from homes near\nthe sch0ol hostel\n\n[5]\n"
    df = spark.createDataFrame([("n", noisy, 1), ("null", None, 1), ("e", "", 1), ("t", "1 | 2\n3", 1), ("t", "1 | 2\n3", 1)], "signal_id string, evidence_text string, noise int")
    rows = scans.repair(df, reader=reader).collect()
    got = {r["signal_id"]: r for r in rows}
    assert {(x["line_no"], x["noise"]) for x in got["n"]["noise"]} >= {(1, "header"), (2, "misread"), (2, "broken_word"), (3, "page_mark"), (4, "header"), (6, "misread"), (8, "page_mark")}
    assert got["n"]["evidence_text"].startswith("the mobile medical unit tested ") and got["n"]["evidence_text"].endswith("from homes near the school hostel")
    assert len(rows) == 5 and got["null"]["evidence_text"] is None and got["e"]["noise"] == [] and got["t"]["noise"] == []
    assert scans.repair(df.limit(0)).count() == 0
