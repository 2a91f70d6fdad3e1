"""Word lists, patterns, tables and thresholds that define the results.

These are data, not logic. They must equal the published values for results to agree, so they are
written out in their natural order.
"""

from callweave.functions.text import SPACE

# --- regulatory patterns (fixed values) -------------------------------------------------------
RBI_PATTERNS = [
    r"(?i)(?:unauthorized\s+access|data\s+breach|confidential\s+information)",
    r"(?i)(?:share\s+(?:your|my)\s+(?:pin|password|otp|cvv|aadhaar))",
    r"(?i)(?:send\s+(?:money|payment)\s+to\s+(?:this|that|my)\s+(?:account|number))",
    r"(?i)(?:bank\s+account\s+(?:number|details))",
    r"(?i)(?:atm\s+pin|net\s+banking\s+(?:password|pin))",
    r"(?i)(?:upi\s+(?:pin|password)|paytm\s+pin)",
    r"बैंक(?:\s+खाता|\s+विवरण)|पिन(?:\s+शेयर|\s+बताओ)|ओटीपी(?:\s+भेजो|\s+बताओ)",
    r"(?i)आधार\s*(?:नंबर|संख्या|शेयर|बताओ)",
    r"(?i)(?:पैसे?\s+भेजो|पेमेंट\s+करो|ट्रांसफर\s+करो)",
]

IRDAI_PATTERNS = [
    r"(?i)(?:pre-existing\s+disease|not\s+covered|claim\s+denied|policy\s+lapsed)",
    r"(?i)(?:misrepresent|false\s+(?:information|declaration)|fraud(?:ulent)?)",
    r"(?i)(?:without\s+consent|solicited\s+(?:call|contact))",
    r"(?i)(?:cooling.off\s+period|free\s+look\s+period)",
    r"(?i)(?:agent\s+commission|mis.sell(?:ing)?)",
    r"पहले\s+से\s+बीमार|बीमा\s+(?:दावा|क्लेम)\s+(?:अस्वीकृत|खारिज)|पॉलिसी\s+बंद",
    r"(?i)बिना\s+सहमति|ठगी|धोखाधड़ी",
]

# --- abusive keywords, matched as substrings of the lowered text (fixed values) ----------------
ABUSIVE_KEYWORDS = [
    "गाली", "गंदी", "बेवकूफ", "मूर्ख", "कमीना", "साला", "भोसड़ी", "मादरचोद",
    "बहनचोद", "लंड", "चूत", "रंडी", "हरामी", "सुअर", "कुत्ता", "कुत्ते",
    "घटिया", "लौड़े", "लौंडा", "खोटा", "नालायक", "बेहया",
    "चोर", "झूठा", "धोखेबाज", "कमीने", "साले", "हरामजादे",
    "idiot", "stupid", "moron", "bastard", "asshole",
    "bitch", "fuck", "shit", "dick", "screw you", "shut up",
    "worthless", "useless", "incompetent",
]

# --- innocent look-alikes, never matched by edit distance (fixed values) -----------------------
INNOCENT_WORDS = [
    "कमीज", "कमीज़",
    "कितने", "कितना",
    "बेचना", "बेचेंगे",
    "सीने", "सीना",
    "करना", "करेंगे",
    "पत्रिका",
    "पड़ोसे", "पड़ोसी",
    "दूल्हे", "दूल्हा",
    "भैया", "भैये",
    "मालूम",
    "काहे",
    "बांटता",
    "चिकट",
    "धोती",
    "सलवार",
    "सीले",
    "चिकना",
]

# --- multi-word abuse (fixed values) -----------------------------------------------------------
COMPOUND_PATTERNS = [
    r"तेरी\s*मां\s*चोद",
    r"तेरी\s*मां\s*की\s*चूत",
    r"मां\s*चुदा",
    r"बहन\s*के\s*लौड़े",
    r"भोसड़ी\s*के",
    r"बहन\s*की\s*लौड़ी",
    r"तेरी\s*बेटी\s*को\s*बेच",
    r"मां\s*चोद",
    r"बाप\s*चोद",
    r"सुअर\s*के\s*बच्चे",
    r"कुत्ते\s*की\s*तरह",
    r"गांडू",
    r"गांड[\p{L}\p{N}_]*",
]

# --- threats, case-sensitive (fixed values) ----------------------------------------------------
THREAT_PATTERNS = [
    r"(?:तेरी|तू)\s*(?:मां|बेटी|बहन)\s*(?:.*?(?:सोना|बेच|उठा|मार|काट|जला))",
    r"(?:मिल\s*गया|मिल\s*गई)\s*(?:ना|तो)",
    r"(?:मार\s*(?:ऊंगा|दूंगा|डालूंगा|देंगे))",
    r"(?:काट\s*(?:ऊंगा|दूंगा|डालूंगा))",
    r"(?:जला\s*(?:दूंगा|देंगे))",
    r"(?:खत्म\s*(?:कर\s*दूंगा|कर\s*देंगे))",
    r"(?:बर्बाद\s*(?:कर\s*दूंगा|कर\s*देंगे))",
    r"(?:तबाह\s*(?:कर\s*दूंगा|कर\s*देंगे))",
    r"(?:सुसाइड|आत्महत्या)",
    r"(?:kill\s*you|murder\s*you|destroy\s*you|burn\s*you)",
    r"(?:rape|raped|raping)",
    r"(?:threaten|threatening|threat)",
    r"(?:you\s*will\s*regret|you'll\s*be\s*sorry)",
]

# Words one of which any match of the pattern must contain, in lower case. They let a cheap substring
# test stand before the regular expression; patterns without an entry are always run.
PATTERN_HINTS = {
    RBI_PATTERNS[0]: ["unauthorized", "breach", "confidential"],
    RBI_PATTERNS[1]: ["share"],
    RBI_PATTERNS[2]: ["send"],
    RBI_PATTERNS[3]: ["bank"],
    RBI_PATTERNS[4]: ["atm", "banking"],
    RBI_PATTERNS[5]: ["upi", "paytm"],
    IRDAI_PATTERNS[0]: ["pre-existing", "covered", "denied", "lapsed"],
    IRDAI_PATTERNS[1]: ["misrepresent", "false", "fraud"],
    IRDAI_PATTERNS[2]: ["consent", "solicited"],
    IRDAI_PATTERNS[3]: ["cooling", "look"],
    IRDAI_PATTERNS[4]: ["commission", "sell"],
    THREAT_PATTERNS[9]: ["kill", "murder", "destroy", "burn"],
    THREAT_PATTERNS[10]: ["rape", "raping"],
    THREAT_PATTERNS[11]: ["threat"],
    THREAT_PATTERNS[12]: ["regret", "sorry"],
}

# --- self-introduction phrases that mark the agent (fixed values) ------------------------------
AGENT_PHRASES = (
    r"(?:बात\s+कर\s+रह[ीा]\s+हूं|जॉब\s+रिकॉर्डिंग|कैलिबर|इंटरव्यू|रिक्वायरमेंट|सेल[्स]?\s+प्रोफाइल|"
    r"सेलेक्ट\s+होते|सैलरी\s+होगा|आपको\s+(?:बता|समझा|एक्सप्लेन)|सुनो\s+आप\s+पहले|ओके\s+अ|"
    r"गुड\s+आफ्टरनून|नंबर\s+दिया\s+है)"
)

# --- text model labels -> (emotion, sentiment) (fixed values) ----------------------------------
TEXT_LABELS = {
    "anger": ("anger", "negative"),
    "disgust": ("disgusted", "negative"),
    "fear": ("fear", "negative"),
    "joy": ("joy", "positive"),
    "neutral": ("neutral", "neutral"),
    "sadness": ("sad", "negative"),
    "surprise": ("surprised", "neutral"),
}

# --- emotion -> sentiment (fixed values) -------------------------------------------------------
EMOTION_SENTIMENT = {
    "anger": "negative",
    "sad": "negative",
    "fear": "negative",
    "disgusted": "negative",
    "joy": "positive",
    "neutral": "neutral",
    "surprised": "neutral",
    "annoyed": "negative",
    "anticipation": "neutral",
    "confident": "positive",
    "hopeful": "positive",
    "compassion": "positive",
    "apprehensive": "negative",
    "grateful": "positive",
    "guilty": "negative",
    "impressed": "positive",
    "uncertain": "neutral",
}

# Emotions shown as negative whatever their sentiment (fixed values).
NEGATIVE_DISPLAY = ["anger", "sadness", "disgust"]

# --- acoustic emotion profiles: pitch, energy, rate, jitter, pause, peak position (fixed values) -
ACOUSTIC_PROFILES = {
    "anger": ([2.0, 2.0, 1.5, 1.0, -2.0], "middle"),
    "sad": ([-2.0, -2.0, -2.0, 0.5, 2.0], "beginning"),
    "joy": ([1.5, 1.0, 1.0, -0.5, -1.0], "end"),
    "fear": ([1.0, 0.5, 0.5, 2.0, 0.5], "end"),
    "neutral": ([0.0, 0.0, 0.0, -1.0, 0.0], "beginning"),
    "disgusted": ([-0.5, 0.0, -0.5, 0.5, 0.0], "beginning"),
    "surprised": ([2.0, 1.5, 0.5, 0.5, -1.0], "end"),
    "annoyed": ([0.5, 0.5, 0.5, 0.5, -0.5], "middle"),
}
ACOUSTIC_WEIGHTS = [1.5, 1.3, 1.0, 0.8, 0.7]
ACOUSTIC_POSITION_BONUS = 0.10
ACOUSTIC_TEMPERATURE = 0.35
ACOUSTIC_MIN_CONFIDENCE = 0.20

# --- QA weights and grades (fixed values) ------------------------------------------------------
QA_WEIGHTS = {
    "customer_sentiment": 0.30,
    "compliance": 0.25,
    "agent_stability": 0.20,
    "intent_resolution": 0.15,
    "talk_ratio": 0.10,
}
QA_GRADES = [(85, "A"), (70, "B"), (55, "C")]
SENTIMENT_BASE = {"positive": 1.0, "neutral": 0.5, "negative": 0.0}

# --- result document slices (fixed values) -----------------------------------------------------
STAGE_SLICES = {
    "denoise": ["duration_s", "denoise_metrics"],
    "diarize": ["duration_s", "segments", "talk_ratio", "separability", "confidence_method", "role_resolution"],
    "transcribe": ["duration_s", "segments", "talk_ratio", "role_resolution"],
    "emotion": ["duration_s", "segments", "fusion"],
    "compliance": ["compliance", "crm_note"],
    "qa-score": ["qa", "crm_note", "compliance"],
    "crm-note": ["crm_note", "compliance", "qa"],
}

# --- job stages (fixed values) -----------------------------------------------------------------
JOB_STAGES = ["denoise", "diarize", "stt", "acoustic", "text_emo", "compliance", "fusion", "qa", "crm"]
JOB_TTL_SECONDS = 86_400

# --- sentences of notes (fixed values) ---------------------------------------------------------
NO_VIOLATIONS = "No violations detected."
VIOLATIONS_FOUND = " violation(s) found ("
VIOLATIONS_BY_AGENT = " by agent)."
ACTION_NONE = "No action required. Call met quality standards."
ACTION_REVIEW = "Flag for compliance review. Agent violations detected."
ACTION_COACHING = "Schedule coaching session. Low QA score."
ACTION_MONITOR = "Monitor. Call requires periodic review."

# --- transcript store fingerprint (fixed values) -----------------------------------------------
STORE_TTL_DAYS = 30
STORE_CONFIG = {
    "model": "chirp_3",
    "vad_enabled": "true",
    "VAD_FRAME_MS": "25",
    "VAD_PADDING_S": "0.3",
    "VAD_GAP_TOLERANCE_S": "0.5",
    "CHUNK_SECONDS": "50",
}


def java_pattern(pattern: str) -> str:
    """A pattern for Java: Unicode case folding and white space, and a dot that stops at line feeds only."""
    return "(?d)" + pattern.replace("(?i)", "(?iu)").replace(r"\s", SPACE)


def needs_devanagari(pattern: str) -> bool:
    """True if every alternative of the pattern has a mandatory Devanagari letter.

    Answers False when in doubt: optional groups or character classes next to such letters.
    """
    if any(x in pattern for x in (")?", ")*", "{0", "|)", "(|")):
        return False
    import re

    bare = re.sub(r"\[[^\]]*\]|.[?*]", "", pattern)
    return all(re.search("[\u0904-\u0939]", part) for part in bare.split("|"))
