"""Personal data: sentences here are used nowhere else, so what is measured was not seen in fitting."""

import random

import pytest

from teesta.llm import pii

# Plain sentences that make up the corpus, with numbers and places that are no personal data.
PLAIN = {
    "LATIN": [
        "The team visited {n} homes in the village of {w} and checked water tanks near the market.", "Rain of {n} mm was measured at the station on Monday morning.",
        "Parcel {g} with bed nets came by truck.", "The number of fevers rose to {n} in the second week, while the stock of tablets at {w} fell.",
        "Memo {g} was read out at the meeting of the staff.", "Weekly Report of the District Office\nSchools in {w} stay open.", "Workers sprayed {n} houses and cleared drains, but larvae were found again.",
        "For advice use the helpline 1800 {d4} {d3}.",
    ],
    "DEVANAGARI": ["टीम ने {w} गांव में {n} घरों का दौरा किया और बाजार के पास पानी की टंकी देखी।", "सोमवार को केंद्र पर {n} मिमी बारिश हुई।", "खेप {g} ट्रक से आई और दवा बांटी गई।", "मरीज आए थे, पर {n} लोग बाद में ठीक हुए।"],
    "ORIYA": ["ଦଳ {w} ଗ୍ରାମରେ {n} ଘର ବୁଲିଲେ ଏବଂ ପାଣି ଟାଙ୍କି ଦେଖିଲେ।", "ସୋମବାର ଦିନ କେନ୍ଦ୍ରରେ {n} ମିମି ବର୍ଷା ହେଲା।", "ରୋଗୀ ଆସିଥିଲେ ଓ {n} ଜଣ ଭଲ ହେଲେ।"],
    "BENGALI": ["দল {w} গ্রামে {n} বাড়ি ঘুরে দেখে এবং জলের ট্যাঙ্ক পরীক্ষা করে।", "সোমবার কেন্দ্রে {n} মিমি বৃষ্টি হয়।", "রোগী এসেছিল ও {n} জন ভাল হয়।"],
}
# (sentence, item, kind)
HELD_OUT = [
    ("Ms. {} thanked the nurses for their help.", "Anjali Mohanty", "PERSON"), ("The form was signed by {}, who left early.", "Bhaskar R. Nandakumar", "PERSON"), ("Prof. {} gave the talk.", "Kiran Deshpande", "PERSON"),
    ("His neighbour {} brought the sample.", "Laxman Behera", "PERSON"), ("Son of {} was vaccinated.", "Pradeep Swain", "PERSON"), ("Tel. {} in the morning.", "+91 98765 43210", "PHONE"), ("You can ring the mobile {} at any hour.", "98450-12345", "PHONE"),
    ("Her WhatsApp is {} these days.", "9123456780", "PHONE"), ("Messages go to {} only.", "(+91) 9876 123 456", "PHONE"), ("His Aadhaar {} was noted.", "4321-8765-2109", "ID"), ("The passport, {}, had expired.", "KLMNP4567Q", "ID"),
    ("The voter card said {} on it.", "7788 9900 1122", "ID"), ("Forward it to {} today.", "lab.desk+april@clinic.example.org", "EMAIL"), ("({})", "r_sahu77@posts.example.net", "EMAIL"),
    ("She is resident at {} with her mother.", "House No. 12, Temple Lane, Cuttack 753001", "ADDRESS"), ("They moved to {} last spring.", "Flat 9, Lotus Apartments, Puri, 752002", "ADDRESS"), ("The address reads {}.", "Plot 77/2, Station Road, Angul, PIN 759122", "ADDRESS"),
    ("डॉ {} ने सलाह दी।", "सुनील खेतान", "PERSON"), ("उसका नाम {} बताया गया।", "मोहित पंवार", "PERSON"), ("मोबाइल {} पर संदेश भेजें।", "+९१ ९८७६५ ४३२१०", "PHONE"), ("आधार {} दर्ज हुआ।", "4455 6677 8899", "ID"), ("उसका पता {} था।", "मकान संख्या 45, शिव गली, रायपुर, पिन 492001", "ADDRESS"),
    ("ଶ୍ରୀ {} ଆସିଲେ।", "ବିଜୟ ମହାପାତ୍ର", "PERSON"), ("ଫୋନ {} କୁ ଡାକନ୍ତୁ।", "୯୮୭୬୫-୪୩୨୧୦", "PHONE"), ("শ্রীমতী {} এসেছিলেন।", "সুচিত্রা বসাক", "PERSON"), ("মোবাইল {} দেখুন।", "9830012345", "PHONE"), ("পরিচয় নম্বর {} লেখা ছিল।", "5566-7788-9900", "ID"),
]
# Look-alikes that are no personal data.
CLEAN = ["Consignment 4455-6677-8899 arrived late.", "Voucher 998877665544 was paid.", "Letter 1234 5678 9012 came.", "मरीज आए थे, पर बाद में ठीक हुए।", "ରୋଗୀ ଆସିଥିଲେ ଓ ଭଲ ହେଲେ।", "Weekly Report of the District Office", "The Station Office measured rain."]


def corpus(r, n=400):
    make = pii.Inventor(r)
    d = make.digits
    for i in range(n):
        script = list(PLAIN)[i % 4]
        yield " ".join(s.format(n=r.randrange(10, 900), w=make.word(script) + ("pur" if script == "LATIN" else ""), g=make.grouped(), d4=d(4), d3=d(3)) for s in r.sample(PLAIN[script], 3))


@pytest.fixture(scope="module")
def finder(spark):
    texts = [(str(i), t) for i, t in enumerate(corpus(random.Random(8)))]
    return pii.learn(spark.createDataFrame(texts, "signal_id string, evidence_text string"))


def test_sentences_withheld_from_fitting(finder):
    hit, false, kinds = 0, 0, {}
    r = random.Random(4)
    for frame, item, kind in HELD_OUT:
        script = pii._script(frame)
        before = r.choice(PLAIN[script if script in PLAIN else "LATIN"]).format(n=12, w="", g="", d4="", d3="") + " "
        text = before + frame.replace("{}", item)
        begin = len(before) + frame.index("{}")
        found = {(a, b, k) for a, b, k, _ in finder.find(text)}
        right = (begin, begin + len(item), kind) in found
        hit += right
        false += len(found) - right
        kinds.setdefault(kind, []).append(right)
    for text in CLEAN:
        false += len(finder.find(text))
    # A corpus of 400 texts from few sentences lacks many words of the withheld ones, so two of them in a row may pass for a name.
    assert hit / len(HELD_OUT) >= 0.95 and hit / (hit + false) >= 0.8, (hit, false)
    assert all(sum(v) / len(v) >= 0.75 for v in kinds.values()), kinds


def test_redaction_leaves_all_else(spark, finder):
    text = "Call +91 59580\n37897 in the morning. Parcel 4633-4890-4534 came. She lives at Plot 59/4, Nemasahi Road, Modobali, PIN 071043. Dr. Naruhi Beju left. Write to a.b@labha.invalid today."
    df = spark.createDataFrame([("1", text, "x"), ("2", None, None), ("3", "", None), ("4", "Nothing here.", None), ("4", "Nothing here.", None)], "signal_id string, evidence_text string, items string")
    rows = pii.redact(df, finder=finder).collect()
    got = {r["signal_id"]: r for r in rows}
    assert got["1"]["evidence_text"] == "Call [PHONE] in the morning. Parcel 4633-4890-4534 came. She lives at [ADDRESS]. Dr. [PERSON] left. Write to [EMAIL] today."
    assert len(rows) == 5 and got["2"]["evidence_text"] is None and got["4"]["evidence_text"] == "Nothing here." and got["3"]["items"] == []
    assert [text[i["begin"] : i["end"]] for i in got["1"]["items"]][0] == "+91 59580\n37897"
    assert pii.redact(df.limit(0)).count() == 0 and pii.redact(df.where("signal_id = '2'")).count() == 1


def test_long_text(finder):
    r = random.Random(12)
    long = "\n".join(" ".join(r.choice(["fevers", "homes", "week", "the", "sample", "in"]) + str(r.randrange(50)) for _ in range(9)) for _ in range(3000))
    assert finder.find(long + " Write to a.b@labha.invalid for the list.")[-1][2] == "EMAIL"
    assert finder.find(None) == [] and finder.find("") == []
