"""Word lists and codes of the domain. All are fixed values: results depend on these very words."""

# Cues of each assertion class, in the order of precedence.
NOT_AFFIRMED = [
    "no case", "no cases", "not detected", "not reported", "tested negative", "ruled out", "free of", "zero dengue", "zero malaria", "zero cholera", "zero aes", "no new case", "denied reports",
    "कोई मामला नहीं", "मामला नहीं मिला", "पुष्टि नहीं", "କୌଣସି ମାମଲା ମିଳିନାହିଁ", "ମାମଲା ନାହିଁ", "ଚିହ୍ନଟ ହୋଇନାହିଁ", "ପୁଷ୍ଟି ହୋଇନାହିଁ",
]
SPECULATIVE = ["may cause", "may lead", "could lead", "risk of", "fear of", "suspected risk", "हो सकता", "आशंका", "खतरा", "ହୋଇପାରେ", "ଆଶଙ୍କା", "ବିପଦ"]
NON_CURRENT = ["last year", "previous outbreak", "in the past", "historical", "पिछले वर्ष", "पुराना प्रकोप", "ଗତ ବର୍ଷ", "ପୂର୍ବ ପ୍ରକୋପ", "ଇତିହାସରେ"]

# Words that show a text in Latin letters to be English.
ENGLISH_WORDS = [
    "the", "and", "of", "in", "for", "on", "to", "with", "from", "by", "at", "is", "are", "was", "were", "has", "have", "this", "that",
    "district", "districts", "health", "cases", "reported", "department", "government", "notification",
]

# Disease names looked for.
DISEASES = ["malaria", "dengue", "cholera", "measles", "jaundice", "influenza"]

# Words of questions, by what they ask for.
FORECAST_TERMS = ["forecast", "predict", "prediction", "likelihood", "risk next", "अगले", "पूर्वानुमान", "संभावना", "ପୂର୍ବାନୁମାନ", "ସମ୍ଭାବନା"]
OUTLOOK_TERMS = ["outlook", "environmental outlook", "weather outlook", "environmental conditions", "weather-related risk", "मौसम का पूर्वानुमान", "पर्यावरणीय जोखिम", "ପରିବେଶ ଦୃଷ୍ଟିକୋଣ", "ପାଣିପାଗ ଦୃଷ୍ଟିକୋଣ"]
FUTURE_TERMS = [
    "next week", "next month", "next 3 months", "next three months", "coming week", "coming month", "in advance", "12 week", "three-month", "will there be", "will increase", "will spread", "will occur",
    "अगले", "आगामी", "भविष्य", "होगा", "फैलेगा", "ଆଗାମୀ", "ପରବର୍ତ୍ତୀ", "ଭବିଷ୍ୟତ", "ହେବ", "ବ୍ୟାପିବ",
]
OUTBREAK_TERMS = ["outbreak", "epidemic", "surge", "प्रकोप", "महामारी", "ପ୍ରକୋପ", "ମହାମାରୀ"]
INCIDENCE_TERMS = ["how many cases", "case rate", "incidence", "burden", "कितने मामले", "मामलों की संख्या", "କେତେ ମାମଲା", "ରୋଗ ହାର"]
DISTRIBUTION_TERMS = ["rank", "heatmap", "pattern", "across the state"]
COMPARISON_TERMS = [
    "more cases", "fewer cases", "higher", "lower", "compare", "compared to", "which district", "worst", "highest", "lowest", "more malaria", "top", "most", "rank", "heatmap", "pattern", "across the state",
    "ज्यादा मामले", "तुलना", "कौन सा जिला", "ଅଧିକ ମାମଲା", "ତୁଳନା", "କେଉଁ ଜିଲ୍ଲା",
]
STATISTIC_NOUNS = ["case", "cases", "incidence", "api", "burden", "death", "deaths", "positivity", "मामले", "मामलों", "ମାମଲା"]
EVIDENCE_NOUNS = ["evidence", "published", "coverage", "article", "news", "report about", "प्रमाण", "समाचार", "ପ୍ରମାଣ", "ଖବର"]
TREND_TERMS = [
    "gone up", "gone down", "increased", "decreased", "rising", "falling", "trend", "over the years", "since 20", "change between", "how did", "from 20", "compared with 20",
    "बढ़ा", "घटा", "रुझान", "ବୃଦ୍ଧି", "ହ୍ରାସ", "ଧାରା",
]
ALERT_TERMS = ["alert", "warning", "signal", "चेतावनी", "ସତର୍କ", "ସଙ୍କେତ"]
VERIFIED_TERMS = ["verified", "confirmed event", "सत्यापित", "ଯାଞ୍ଚ"]
AUDIT_TERMS = ["training data", "historical data", "dataset", "ଡାଟା", "डेटासेट"]
CLINICAL_TERMS = ["what treatment", "which treatment", "what medicine", "which medicine", "what should i take", "what dose", "diagnose me", "इलाज", "दवा", "खुराक", "क्या करूँ", "ଚିକିତ୍ସା", "ଔଷଧ", "ମୁଁ କଣ କରିବି"]

# Query keys that only track readers; keys that begin with utm_ go too.
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src"]

# Paths that only navigate, and markers of health matters, notices and page furniture in links.
NAVIGATION_SEGMENTS = ["author", "authors", "category", "categories", "tag", "tags", "topic", "topics", "search"]
SECTION_PATHS = ["crime", "district", "health", "lifestyle", "news", "odisha", "photo", "photos", "politics", "sports", "video", "videos"]
HEALTH_MARKERS = [
    "health", "disease", "outbreak", "epidemic", "surveillance", "hospital", "medical", "vector borne", "vector-borne", "immunisation", "immunization", "vaccination", "public health", "sanitation",
    "drinking water", "advisory", "स्वास्थ्य", "रोग", "बीमारी", "प्रकोप", "अस्पताल", "टीकाकरण",
]
NOTICE_MARKERS = ["notification", "notice", "circular", "bulletin", "order", "guideline", "report", "press release", "situation", "अधिसूचना", "परिपत्र", "दिशानिर्देश", "ବିଜ୍ଞପ୍ତି", "ପରିପତ୍ର", "ନିର୍ଦ୍ଦେଶିକା"]
CHROME_MARKERS = [
    "screen-reader", "screen_reader", "sitemap", "site-map", "site_map", "wp-login", "login", "logout", "register", "feedback", "rss", "feed", "photogallery", "photo-gallery", "video-gallery", "brokenlinks",
    "help", "font=", "theme=", "background=",
]

# Hazard codes of warnings, and severities by rank.
HAZARDS = {
    1: "No Warning", 2: "Heavy Rain", 3: "Heavy Snow", 4: "Thunderstorms & Lightning, Squall etc", 5: "Hailstorm", 6: "Dust Storm", 7: "Dust Raising Winds", 8: "Strong Surface Winds", 9: "Heat Wave",
    10: "Hot Day", 11: "Warm Night", 12: "Cold Wave", 13: "Cold Day", 14: "Ground Frost", 15: "Fog", 16: "Very Heavy Rain", 17: "Extremely Heavy Rain",
}
SEVERITY_RANK = {"not_issued": 0, "no_warning": 0, "watch": 1, "alert": 2, "warning": 3}
