"""Fixed values.

Word lists, domain lists, patterns and constants below must equal the values
the scoring rules are defined by; they are data, stated in natural order.
"""

# --- Linguistic word lists (fixed values) -----------------------------------

# Each inner list is one alternation; a word in two lists counts once in each.
CLICKBAIT = [
    ["shocking", "unbelievable", "incredible", "amazing", "stunning", "devastating"],
    ["you won't believe", "won't believe", "can't believe"],
    ["must see", "must read", "must watch", "breaking", "exclusive", "urgent"],
    ["this will blow your mind", "mind blown", "jaw dropping", "epic"],
    ["scandal", "outrageous", "absurd", "ridiculous", "ludicrous"],
    ["explosive", "bombshell", "devastating", "crushing", "destroyed"],
    ["secret", "revealed", "exposed", "leaked", "insider"],
    ["biggest ever", "never before", "first time", "historic", "unprecedented"],
    ["what happens next", "the truth about", "what they don't want"],
    ["this changes everything", "game changer", "mind blown"],
    ["alert", "warning", "urgent", "breaking news", "just in"],
    ["outrage", "fury", "rage", "anger", "furious", "enraged"],
]

EMOTIONAL = [
    "outrage", "fury", "rage", "anger", "furious", "enraged",
    "shock", "shocked", "shocking", "stunned", "stunning",
    "devastating", "devastated", "crushing", "destroyed",
    "epic", "legendary", "historic", "unprecedented",
    "scandal", "scandalous", "controversial", "outrageous",
    "absurd", "ridiculous", "ludicrous", "insane",
    "incredible", "amazing", "stunning", "breathtaking",
    "terrifying", "horrifying", "disgusting", "appalling",
]

INTENSIFIERS = [
    "very", "extremely", "highly", "incredibly", "really", "totally",
    "absolutely", "completely", "utterly", "entirely", "perfectly",
    "massively", "hugely", "enormously", "tremendously", "vastly",
    "dramatically", "significantly", "substantially", "considerably",
]

TENTATIVE = [
    "maybe", "perhaps", "might", "could", "possibly", "probably",
    "likely", "seems", "appears", "suggests", "indicates",
    "allegedly", "reportedly", "supposedly", "purportedly",
    "rumored", "claimed", "asserted", "maintained",
]

EVIDENCE = [
    "according to", "research shows", "studies indicate", "data reveals",
    "evidence suggests", "findings show", "analysis reveals",
    "statistics show", "reports indicate", "investigation reveals",
    "because", "therefore", "thus", "consequently", "as a result",
]

PROFESSIONAL = [
    "officials", "authority", "department", "agency", "institute",
    "study", "research", "analysis", "report", "findings",
    "confirmed", "announced", "stated", "reported", "according to",
    "budget", "funding", "grants", "partnerships", "consultation",
    "planning", "development", "implementation", "expansion",
]

BALANCED = [
    "however", "although", "while", "despite", "nevertheless",
    "concerns", "challenges", "issues", "problems", "criticism",
    "supportive", "opposed", "mixed", "varied", "different",
]

DATA_REFERENCE_PATTERNS = [
    r"\p{Nd}+%",
    r"\p{Nd}{4}",
    r"\$\p{Nd}+",
    r"\p{Nd}+\.\p{Nd}+",
    r"(?i)study|research|analysis|report|findings|data|statistics",
]

# --- Shorter lists of the inline feature variant (fixed values) --------------

INLINE_CLICKBAIT = CLICKBAIT[:8] + [CLICKBAIT[10]]
INLINE_EMOTIONAL = EMOTIONAL[:27]
INLINE_INTENSIFIERS = ["very", "extremely", "incredibly", "absolutely", "completely", "totally",
                       "utterly", "perfectly"]
INLINE_TENTATIVE = ["might", "perhaps", "possibly", "maybe", "could", "may", "seems", "appears"]
INLINE_EVIDENCE = ["according", "study", "research", "data", "evidence", "source", "report", "findings"]
INLINE_PROFESSIONAL = ["according", "research", "study", "analysis", "report", "data", "evidence",
                       "expert", "official"]
INLINE_BALANCED = ["however", "although", "while", "whereas", "despite", "nevertheless",
                   "furthermore", "moreover"]
INLINE_DATA_WORDS = ["study", "research", "data", "report", "analysis", "findings", "statistics", "survey"]

# --- Feature order (fixed values) ------------------------------------------

FEATURE_NAMES = [
    "clickbait_score", "emotional_intensity", "exclamation_density", "caps_density", "question_density",
    "sentiment_polarity", "sentiment_subjectivity", "sentiment_intensity", "sentiment_balance",
    "intensifier_ratio", "tentative_ratio", "evidence_ratio", "professional_ratio", "balanced_ratio",
    "avg_sentence_length", "avg_word_length", "text_length", "word_count",
    "repetition_ratio", "unique_word_ratio",
    "all_caps_words", "exclamation_count", "question_count", "clickbait_matches", "emotional_word_count",
    "professional_word_count", "balanced_word_count", "data_references",
]

FEATURE_GROUP_SIZES = {
    "sensationalism_indicators": 10,
    "sentiment_analysis": 4,
    "language_patterns": 5,
    "text_structure": 6,
    "content_quality": 3,
}

# Feature indices whose z-score is negated, and the same list read by name.
ZSCORE_NEGATED = [0, 1, 2, 3, 4, 7, 10, 18, 20, 21, 22, 23, 24]
ZSCORE_NEGATED_BY_NAME = [0, 1, 2, 3, 4, 6, 9, 18, 20, 21, 22, 23, 24]

ZSCORE_WEIGHTS = {
    "clickbait_score": 0.15,
    "emotional_intensity": 0.12,
    "exclamation_density": 0.10,
    "caps_density": 0.08,
    "question_density": 0.05,
    "sentiment_subjectivity": 0.08,
    "sentiment_balance": 0.05,
    "intensifier_ratio": 0.08,
    "evidence_ratio": 0.06,
    "professional_ratio": 0.06,
    "balanced_ratio": 0.04,
    "repetition_ratio": 0.05,
    "professional_word_count": 0.03,
    "balanced_word_count": 0.02,
    "data_references": 0.03,
}

# --- Word categories of the frequency report (fixed values) ------------------

CREDIBLE_WORDS = [
    "research", "study", "evidence", "data", "analysis", "report", "findings",
    "conclusion", "results", "statistics", "survey", "experiment", "investigation",
    "expert", "scientist", "researcher", "professor", "doctor", "authority",
    "official", "government", "institution", "university", "journal", "peer-reviewed",
]

SUSPICIOUS_WORDS = [
    "shocking", "unbelievable", "secret", "exposed", "revealed", "breaking",
    "urgent", "alert", "warning", "dangerous", "scandal", "conspiracy",
    "cover-up", "hidden", "forbidden", "insider", "leaked", "exclusive",
    "you won't believe", "doctors hate", "one weird trick", "miracle",
    "instant", "guaranteed", "proven", "amazing", "incredible", "stunning",
]

SENSATIONAL_PHRASES = [
    "breaking", "exclusive", "shocking", "unbelievable", "you won't believe",
    "must see", "viral", "outrageous", "scandal", "exposed", "leaked",
    "insider", "sources say", "according to sources", "this changes everything",
    "game changer", "mind blown", "jaw dropping", "stunning", "incredible",
    "watch video", "featured image", "share this", "go viral",
]

TONE_POSITIVE = ["excellent", "great", "wonderful", "success", "achievement", "good", "amazing",
                 "love", "best", "perfect"]
TONE_NEGATIVE = ["terrible", "awful", "disaster", "crisis", "danger", "threat", "bad", "hate",
                 "worst", "horrible"]

# Sensationalism heuristic: emotion alternations, clickbait patterns, intensifiers.
HEURISTIC_EMOTION = [
    r"(?:very|extremely|absolutely|completely|totally|incredibly|amazingly)",
    r"(?:shocking|stunning|devastating|horrifying|terrifying|outrageous)",
    r"(?:never|always|all|every|none|nothing|everything)",
    r"(?:must|have to|need to|should|must)\s+(?:read|see|know|watch)",
]
HEURISTIC_CLICKBAIT = [
    r"you won'?t believe",
    r"this (?:will|is going to) (?:shock|amaze|surprise)",
    r"number \p{Nd}+ (?:will|is going to)",
    r"what happens next",
    r"doctors (?:hate|love|don'?t want)",
    r"one (?:weird|simple|easy) (?:trick|tip|way)",
]
HEURISTIC_INTENSIFIERS = ["very", "extremely", "incredibly", "absolutely", "completely", "totally"]

# --- Source lists (fixed values) ----------------------------------------------

CREDIBLE_DOMAINS = [
    "bbc.com", "reuters.com", "apnews.com", "npr.org",
    "theguardian.com", "nytimes.com", "washingtonpost.com",
    "wsj.com", "economist.com", "ft.com", "bloomberg.com",
]

SUSPICIOUS_DOMAINS = ["beforeitsnews.com", "naturalnews.com", "infowars.com"]

PROBLEM_SOURCES = {
    "naturalnews.com": "Health misinformation",
    "infowars.com": "Conspiracy theories",
    "theonion.com": "Satirical content",
    "babylonbee.com": "Satirical content",
    "activistpost.com": "Conspiracy promotion",
    "bipartisanreport.com": "Misleading headlines",
    "beforeitsnews.com": "User-generated conspiracy content",
    "collective-evolution.com": "Pseudoscience content",
    "davidwolfe.com": "Health misinformation",
    "worldnewsdailyreport.com": "Satirical fake news",
    "nationalreport.net": "Satirical fake news",
}

RELIABLE_SOURCES = [
    "reuters.com", "apnews.com", "bbc.com", "npr.org",
    "channelnewsasia.com", "straitstimes.com", "cnn.com",
    "washingtonpost.com", "nytimes.com", "wsj.com",
    "economist.com", "theguardian.com", "usatoday.com",
    "abcnews.go.com", "cbsnews.com", "nbcnews.com",
    "pbs.org", "time.com", "newsweek.com", "bloomberg.com",
    "politico.com", "axios.com", "propublica.org", "ft.com",
]

LONG_STANDING_DOMAINS = ["bbc.com", "nytimes.com", "washingtonpost.com", "reuters.com", "npr.org",
                         "wsj.com", "economist.com"]
MID_AGE_DOMAINS = ["cnn.com", "theguardian.com", "axios.com", "politico.com", "bloomberg.com"]

SIMPLE_CREDIBLE_DOMAINS = [
    "bbc.com", "reuters.com", "apnews.com", "npr.org",
    "theguardian.com", "nytimes.com", "washingtonpost.com",
    "cnn.com", "edition.cnn.com", "abcnews.go.com", "cbsnews.com",
    "nbcnews.com", "wsj.com", "economist.com", "time.com",
    "channelnewsasia.com", "straitstimes.com",
]

TIERS = [
    (0.95, ["reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "npr.org", "nytimes.com",
            "washingtonpost.com", "wsj.com"]),
    (0.90, ["cnn.com", "theguardian.com", "bloomberg.com", "time.com", "newsweek.com", "politico.com",
            "abcnews.go.com", "cbsnews.com", "nbcnews.com"]),
    (0.85, ["axios.com", "usatoday.com", "businessinsider.com", "fortune.com", "channelnewsasia.com",
            "straitstimes.com"]),
]
TIER_DEFAULT = 0.80

# --- URL rules (fixed values) ---------------------------------------------------

HOST_PREFIXES = ["www.", "m.", "edition.", "uk.", "us.", "au."]

STRICT_REJECT = ["/search", "/category", "/tag", "/author", "/page/", "/feed", "/rss", "/index"]
STRICT_INDICATORS = ["/article/", "/news/", "/story/", "/post/", "/20", "/2024/", "/2025/", "-"]

QUICK_SKIP = ["/video/", "/podcast/", "/gallery/", "/tag/", "/author/", "/search"]

LINK_SKIP = [
    "/video/", "/videos/", "/live/", "/livetv/", "/tv/",
    "/podcast/", "/audio/", "/gallery/", "/photo/",
    "/tag/", "/tags/", "/topic/", "/category/",
    "/author/", "/writers/", "/journalists/",
    "/search", "/login", "/subscribe", "/newsletter",
    "/about", "/contact", "/privacy", "/terms", "/help",
    ".pdf", ".jpg", ".png", ".gif", ".mp4", ".mp3",
    "/weather/", "/horoscope/", "/crossword/", "/puzzle/",
]
LINK_KEYWORDS = [
    "article", "story", "news", "post", "blog",
    "opinion", "analysis", "commentary", "feature",
    "world", "business", "politics", "tech", "sports",
    "singapore", "asia", "international", "lifestyle",
]

# --- WHOIS rules (fixed values) ----------------------------------------------------

TRUSTED_REGISTRARS = ["GoDaddy.com, LLC", "Namecheap, Inc.", "Google LLC", "Amazon Registrar, Inc.",
                      "Network Solutions, LLC"]
PRIVACY_WORDS = ["privacy", "whoisguard", "protected", "redacted", "proxy", "guard", "shield",
                 "domains by proxy", "contact privacy", "identity protect", "private registration"]
HOSTING_PROVIDERS = [
    ("cloudflare", "Cloudflare"), ("awsdns", "AWS Route 53"), ("googledomains", "Google Domains"),
    ("google", "Google Cloud DNS"), ("azure-dns", "Microsoft Azure"), ("nsone", "NS1"),
    ("dyn.com", "Oracle Dyn"), ("ultradns", "UltraDNS"), ("akamai", "Akamai"), ("fastly", "Fastly"),
    ("digitalocean", "DigitalOcean"), ("linode", "Linode"), ("vultr", "Vultr"),
]
LOCK_CODES = ["clientTransferProhibited", "serverTransferProhibited", "clientUpdateProhibited",
              "serverUpdateProhibited"]
DNSSEC_ON = ["signed", "yes", "true", "enabled", "signeddelegation"]

# --- Valence sentiment rules (fixed values) -------------------------------------------

BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
COMPOUND_ALPHA = 15.0

NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin",
    "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully", "fuckin",
    "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible",
    "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally",
    "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce",
    "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of",
]
SPECIAL_PHRASES = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0,
    "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.5,
}

# --- Page extraction rules (fixed values) -----------------------------------------------

BOILERPLATE_PHRASES = ["cookie", "privacy policy", "terms of service", "subscribe", "newsletter",
                       "follow us"]
ARTICLE_CLASS = r"article|content|post"
TEXT_CLASS = r"content|body|text|story"
NON_CONTENT_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
DATE_META = ["article:published_time", "article:published", "publishdate", "date"]
