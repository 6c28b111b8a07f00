import random

import numpy as np
import pytest

from teesta.llm import langid, leakage, packing, scans, spans

EN = "The health centre of the block recorded many fevers and tested only few samples in week"
HI = "स्वास्थ्य केंद्र के अनुसार गांव में लोगों को भर्ती किया गया और दवा दी गई"
MR = "आरोग्य केंद्र यांच्या माहितीनुसार गावात लोकांवर उपचार झाले व गोळ्या वाटल्या आहेत"
OR = "ସ୍ୱାସ୍ଥ୍ୟ କେନ୍ଦ୍ର ସୂଚନା ଅନୁସାରେ ଗ୍ରାମରେ ଲୋକଙ୍କୁ ଔଷଧ ଦିଆଯାଇଛି"


def test_attention_capacity_binds():
    """By tokens alone long items share bins whose squared lengths exceed the attention capacity; under it they don't."""
    sizes = np.array([930] * 20 + [70] * 20 + [640, 360] * 10, dtype=np.int64)

    def costs(bins):
        return [int((sizes[bins == b] ** 2).sum()) for b in set(bins.tolist())]

    loose, tight = packing.best_fit(sizes, 1000, 64, 1e18), packing.best_fit(sizes, 1000, 64, 0.865 * 1000**2)
    assert max(costs(loose)) > 0.865 * 1000**2 >= max(costs(tight))
    assert max(int(sizes[tight == b].sum()) for b in set(tight.tolist())) <= 1000
    alone = packing.best_fit(np.array([960, 40, 30]), 1000, 64, 0.9 * 1000**2)
    assert alone[0] not in alone[1:] and alone[1] == alone[2]
    assert len(set(packing.best_fit(np.full(40, 10), 1000, 8, 1e18).tolist())) == 5


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([("en", EN), ("hi", HI), ("mr", MR), ("or", OR), (None, "x"), ("en", None)], "lang string, sample_text string")


def test_language_mixtures(spark, samples):
    rows = [("1", EN, "clash"), ("2", HI + "। " + EN + ".", None), ("3", "12 | 0.5", None), ("4", None, None), ("5", "", None), ("6", MR + ". (PHC)", None), ("6", MR, None), ("7", (OR + "। ") * 400, None)]
    got = [(r["signal_id"], r["language"], r["confidence"]) for r in langid.identify(spark.createDataFrame(rows, "signal_id string, evidence_text string, language string"), samples).collect()]
    assert sorted((a, b) for a, b, _ in got) == [("1", "en"), ("2", "mixed"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "mr"), ("6", "mr"), ("7", "or")]
    assert all(0.5 < c <= 1 for *_, c in got)


def test_wrong_labels(spark, samples):
    rows = [("1", EN, "en"), ("2", EN, "und"), ("3", HI + "। " + EN + ".", "hi"), ("4", HI + "। " + EN + ".", "mixed"), ("5", "7", None), ("6", "7", "und"), ("7", MR, "hi")]
    got = {tuple(r) for r in langid.wrong_labels(spark.createDataFrame(rows, "signal_id string, evidence_text string, language string"), samples).collect()}
    assert got == {("2", "en"), ("3", "en"), ("3", "hi"), ("5", "und"), ("7", "mr")}
    assert langid.wrong_labels(spark.createDataFrame([], "signal_id string, evidence_text string, language string"), samples).count() == 0


def test_very_long_texts():
    r = random.Random(12)
    long = "\n".join(" ".join(r.choice(["fever", "homes", "week", "the", "sample", "in"]) + str(r.randrange(50)) for _ in range(9)) for _ in range(3000))
    reader = scans.Reader({"fever": 50}, {}, {}, scans.Misreadings({}, {"fever": 50}, 1), set())
    noise, text = scans.read(long, reader)
    assert len(text) > 100_000 and noise == sorted(noise)
    assert langid.infer((EN + ". ") * 2000, langid.NgramModels([("en", EN), ("hi", HI)]))[0][0][0] == "en"


def test_scans_with_empty_partitions(spark):
    df = spark.createDataFrame([("a", "one line"), ("b", "two\nlines\nhere"), ("c", None)], "signal_id string, evidence_text string").repartition(40)
    assert scans.scanning_traces(df).count() == 0 and scans.scanning_traces(df.limit(0)).count() == 0


def test_packing(spark):
    r = random.Random(2)
    texts = ["x" * r.randrange(0, 300) for _ in range(500)] + ["é" * 1200, "", None]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string").repartition(2)
    rows = packing.pack(df, capacity=1000, max_items=20).collect()
    size, count = {}, {}
    for x in rows:
        size[x["container_id"]] = size.get(x["container_id"], 0) + x["n_tokens"]
        count[x["container_id"]] = count.get(x["container_id"], 0) + 1
    assert max(size.values()) <= 1000 and max(count.values()) <= 20
    assert sum(size.values()) == sum(len(t.encode()) + 1 for t in texts if t is not None)
    assert {x["doc_id"] for x in rows if x["n_pieces"] > 1} == {500} and sorted(x["n_tokens"] for x in rows if x["doc_id"] == 500) == [401, 1000, 1000]
    assert sum(size.values()) / 1000 / len(size) > 0.9
    assert packing.pack(df.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choice(words) + r.choice(["", ",", " — "]) for _ in range(r.randrange(0, 120)))) for i in range(60)] + [(100, None), (101, "")]
    items = [(i, " ".join(r.choice(words).upper() for _ in range(r.randrange(1, 9)))) for i in range(30)] + [(50, None)]
    got = {tuple(x) for x in leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string"), 4).collect()}
    runs = lambda t: {tuple(w[i : i + 4]) for w in [leakage.words_of(t)] for i in range(len(w) - 3)}
    assert got == {(d, i) for d, t in docs for i, u in items if runs(t) & runs(u)}
    small = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string"), 4, block_chars=60)
    assert {tuple(x) for x in small.collect()} == got
    assert leakage.words_of("A—b, “Ç” 12 ..") == ["ab", "ç", "12"]


def brute_pairs(docs, least):
    w = {d: {t[i : i + least] for i in range(len(t) - least + 1)} for d, t in docs if t}
    return {(a, b) for a in w for b in w if a < b and w[a] & w[b]}


@pytest.mark.parametrize("crowd", [64, 1])
def test_shared_passages_equal_brute_force(spark, crowd):
    r = random.Random(4)
    rand = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [rand(n) for n in (29, 30, 31, 45, 200)]
    docs = []
    for i in range(60):
        t = rand(r.randrange(0, 80)) + r.choice([*passages, ""]) + rand(r.randrange(0, 40)) + r.choice([*passages, ""])
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, "ab" * 60), (104, "ab" * 50)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, class_id int")
    members, pairs, groups = spans.shared_passages(df, 30, 20, crowd)
    cls = {x["_id"]: x["class_id"] for x in members.collect()}
    linked = {(x["class_a"], x["class_b"]) for x in pairs.collect()}
    by = {}
    for x in groups.collect():
        by.setdefault(x["group_id"], set()).add(x["class_id"])
    linked |= {(a, b) for g in by.values() for a in g for b in g if a < b}
    got = {(a, b) for a in cls for b in cls if a < b and (cls[a] == cls[b] or tuple(sorted((cls[a], cls[b]))) in linked)}
    assert got == brute_pairs(docs, 30)


def test_chain_prefers_the_ordered_run():
    score, path = spans.chain([(0, 100), (10, 110), (20, 5), (30, 130)], 10)
    assert path == [(0, 100), (10, 110), (30, 130)] and score > 20
    assert spans.chain([], 10) == (0.0, [])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(new[j] + 1, row[j] + (c != d), row[j + 1] + 1))
        row = new
    return row[-1]


def test_edits_equal_the_plain_distance():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(0, 90))) for _ in "ab")
        assert spans.edits(a, b) == plain_distance(a, b)


def test_every_anchor_is_in_one_chain():
    r = random.Random(2)
    anchors = {(r.randrange(60), r.randrange(60)) for _ in range(150)}
    found = spans.chains(list(anchors), 5)
    assert sorted(x for _, path in found for x in path) == sorted(anchors)
    assert all(a < c and b < d for _, path in found for (a, b), (c, d) in zip(path, path[1:], strict=False))
    assert found[0] == spans.chain(list(anchors), 5) and found[0][0] == max(s for s, _ in found)


@pytest.mark.parametrize("crowd", [16, 2])
def test_fuzzy_passages_find_planted_edits(spark, crowd):
    """Passages of 400 signs with an edit in every 50 or so: no exact stretch is long, only chained seeds reach over the edits."""
    r = random.Random(21)
    rand = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))

    def edited(t):
        out = list(t)
        for at in range(20, len(t) - 20, 50):
            i = at + r.randrange(0, 30)
            out[i] = r.choice(["", "X", "XY", out[i] + "Z"])
        return "".join(out)

    docs, planted = [], set()
    for i in range(0, 120, 2):
        p = rand(400)
        docs += [(i, rand(300) + p + rand(200)), (i + 1, rand(100) + edited(p) + rand(400))]
        planted.add((i, i + 1))
    docs += [(1000 + i, rand(900)) for i in range(30)] + [(2000, None), (2001, ""), (2002, docs[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, class_id string")
    members, found = spans.fuzzy_passages(df, 300, 20, crowd=crowd)
    ids = {}
    for m in members.collect():
        ids.setdefault(m["class_id"], []).append(m["doc_id"])
    rows = found.collect()
    got = {tuple(sorted((min(ids[x["class_a"]]), min(ids[x["class_b"]])))) for x in rows}
    assert got <= planted and len(got & planted) / len(planted) >= 0.9
    text = dict(docs)
    for x in rows:
        a, b = text[min(ids[x["class_a"]])][x["begin_a"] : x["end_a"]], text[min(ids[x["class_b"]])][x["begin_b"] : x["end_b"]]
        assert min(len(a), len(b)) >= 300 and plain_distance(a, b) <= x["edits"] <= 0.1 * max(len(a), len(b))
    # Without chaining there is nothing: no pair shares a stretch of 100 exactly.
    assert spans.shared_passages(df.where("doc_id != 2002"), 100, 60)[1].count() == 0


def test_fuzzy_passages_of_crowds_equal_brute_force(spark):
    """24 texts hold one passage with edits of their own and 12 of them another; all hold two phrases. Every pair comes out, as of all pairs of texts compared one by one."""
    r, k, least = random.Random(31), 20, 120
    rand = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    one, other, phrases = rand(200), rand(170), [rand(60), rand(50)]

    def edited(t):
        i = r.randrange(60, len(t) - 60)
        return t[:i] + r.choice(["", "X", "XY"]) + t[i + 1 :]

    texts = [rand(r.randrange(20, 90)) + edited(one) + rand(70) + phrases[i % 2] + rand(r.randrange(30, 300)) + (edited(other) if i % 2 else "") + phrases[1 - i % 2] for i in range(24)]
    texts += [phrases[0] + rand(r.randrange(40, 400)) + phrases[1] + rand(30) for _ in range(10)] + [rand(150) + one[:90] + rand(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    members, found = spans.fuzzy_passages(df, least, k, crowd=3)
    of = {m["class_id"]: m["doc_id"] for m in members.collect()}
    got = sorted((of[x["class_a"]], of[x["class_b"]], x["begin_a"], x["end_a"], x["begin_b"], x["end_b"], x["edits"]) for x in found.collect())
    want, names = set(), sorted(of)
    seeds = {c: [(x, int(p)) for x, p in zip(*spans.seeds_of(texts[of[c]], k, 2 * k), strict=True)] for c in names}
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            s, t = texts[of[a]], texts[of[b]]
            for _, path in spans.chains([(p, q) for x, p in seeds[a] for y, q in seeds[b] if x == y], k):
                reach = min(path[-1][0] - path[0][0], path[-1][1] - path[0][1]) + k
                if reach >= 0.6 * least and spans.covered([(p, p + k) for p, _ in path]) >= 0.2 * reach:
                    for a0, a1, b0, b1, e in spans.fuzzy_spans(s, t, path, k):
                        if min(a1 - a0, b1 - b0) >= least and 1 - e / max(a1 - a0, b1 - b0) >= 0.9:
                            want.add((of[a], of[b], a0, a1, b0, b1, e))
    assert got == sorted(want)
    assert len({(min(x[:2]), max(x[:2])) for x in got if max(x[:2]) < 24}) == 24 * 23 // 2


@pytest.mark.parametrize("k", [48, 200])
def test_speaking_pairs_lose_no_chain(k):
    """Of any common seeds whose chains reach far enough, one pair stands in both texts with distances within ten gains."""
    r, least, met = random.Random(k), 300, 0
    far = max(0, int(0.6 * least) - k)
    for _ in range(1500):
        n, same = r.randrange(1, 14), r.random()
        side = lambda: np.cumsum([r.randrange(1, r.choice([30, 120, 500])) for _ in range(n)])
        ha = np.array(r.sample(range(10**6), n), np.uint64)
        hb = np.array([x if r.random() < same else r.randrange(10**7, 10**8) for x in ha.tolist()], np.uint64)
        pa, pb = side(), side()
        paths = [path for _, path in spans.chains([(int(p), int(q)) for x, p in zip(ha, pa, strict=True) for y, q in zip(hb, pb, strict=True) if x == y], k)]
        if any(min(path[-1][0] - path[0][0], path[-1][1] - path[0][1]) + k >= 0.6 * least for path in paths):
            met += 1
            a, b = ({int(q): (int(d), int(g)) for q, d, g in zip(*spans.speaking_pairs(h, p, k, far), strict=True)} for h, p in ((ha, pa), (hb, pb)))
            assert any(a[q][0] + b[q][0] <= 10 * min(a[q][1], b[q][1]) for q in a.keys() & b.keys())
    assert met > 100


def test_shared_amounts(spark):
    p = "".join(random.Random(9).choice("abcdefg") for _ in range(400))
    df = spark.createDataFrame([(1, "x" * 50 + p), (2, p + "y" * 30), (3, "q" * 500), (4, None)], "doc_id bigint, text string")
    got = {x["doc_id"]: (x["shared_chars"], x["partners"]) for x in spans.shared_amounts(df).collect()}
    assert got == {1: (400, 1), 2: (400, 1)}


@pytest.mark.parametrize("crowd", [64, 1])
def test_shared_amounts_equal_brute_force(spark, crowd):
    r = random.Random(12)
    rand = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [rand(n) for n in (30, 31, 120, 200)]
    docs = {i: rand(r.randrange(1, 60)) + r.choice([*passages, ""]) + rand(r.randrange(0, 40)) + r.choice([*passages, ""]) for i in range(50)}
    docs = {i: t for i, t in docs.items() if len(t) >= 30}
    windows = {i: {t[p : p + 30] for p in range(len(t) - 29)} for i, t in docs.items()}
    want = {}
    for i, t in docs.items():
        others = {j for j in docs if j != i and windows[i] & windows[j]}
        held = {p + o for p in range(len(t) - 29) for o in range(30) if any(t[p : p + 30] in windows[j] for j in others)}
        if others:
            want[i] = (len(held), len(others))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: (x["shared_chars"], x["partners"]) for x in spans.shared_amounts(df, 30, 20, crowd).collect()}
    assert got == want


def test_shared_amounts_of_a_standing_passage(spark):
    r = random.Random(13)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = "A" + rand(498) + "Z"
    df = spark.createDataFrame([(i, rand(i + 1) + str(i) + p + str(i) + rand(20)) for i in range(70)], "doc_id bigint, text string")
    got = {(x["shared_chars"], x["partners"]) for x in spans.shared_amounts(df).collect()}
    assert len(got) < 20 and min(got)[0] >= 500 and max(got)[0] < 510 and {n for _, n in got} == {69}
