"""Detection patterns, mask patterns and character maps.

These strings must equal the published guard's for the verdicts to agree, so they are stated here as
plain data and used as literals by the column functions next door.
"""

# -- fixed values: normalization -------------------------------------------------------------------
INVISIBLE_CHARS = r"[\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF\u00AD]"
LEET_FROM = "013457@$"
LEET_TO = "oieastas"

# -- fixed values: detectors -----------------------------------------------------------------------
PROMPT_INJECTION = (
    r"(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|system)\s+(?:instructions|directives|prompts|rules)",
    r"you\s+are\s+now\s+(?:a|an)?\s*(?:unfiltered|developer\s+mode|DAN|system\s+admin|root)",
    r"new\s+(?:system\s+)?(?:rule|instruction|directive|prompt)\s*:",
    r"(?:print|output|display|show|reveal)\s+(?:your|the)\s+(?:system\s+prompt|initial\s+instructions|developer\s+prompt)",
    r"(?:<\|im_start\|>system|\[system\]|\[system\s+prompt\]|<system>)",
)
JAILBREAK = (
    r"\b(?:DAN|do\s+anything\s+now)\b",
    r"\bjailbreak(?:ed|ing)?\b",
    r"pretend\s+(?:you\s+have|to\s+have)\s+no\s+(?:rules|restrictions|filters|safety)",
    r"ignore\s+(?:all\s+)?(?:ethical|moral|safety)\s+(?:guidelines|constraints|policies)",
    r"hypothetical\s+scenario\s+where\s+(?:there\s+are\s+no|you\s+have\s+no)\s+(?:rules|laws|restrictions)",
    r"act\s+as\s+(?:an?\s+)?unfiltered\s+(?:ai|assistant|model)",
)
TOXIC_CONTENT = (
    r"\b(?:kill|harm|destroy)\s+(?:yourself|yourselves)\b",
    r"how\s+to\s+(?:make|build|synthesize|create)\s+(?:a\s+)?(?:bomb|explosive|chemical\s+weapon)",
    r"\b(?:hate\s+speech|violent\s+threat)\b",
    r"\b(?:suicide|self-harm)\s+(?:instructions|guide)\b",
)

# A normalized text (lower case, single spaces) that holds none of these cannot match the detector.
NEEDS = {
    "prompt_injection": (
        "instruction", "directive", "prompt", "rule", "you are now ", "[system", "<system>", "<|im_start|>",
    ),
    "jailbreak": ("do anything now", "jailbreak", "pretend ", "ignore ", "hypothetical ", "unfiltered "),
    "toxic_content": (
        "yoursel", "bomb", "explosive", "chemical ", "hate speech", "violent ", "suicide ", "self-harm ",
    ),
}
# Or, as a whole word, one of these.
NEEDS_WORD = {"prompt_injection": (), "jailbreak": ("dan",), "toxic_content": ()}
# What a match begins with, in either case, as the inside of a character class.
STARTS = {"prompt_injection": r"idfobynpsr<\[", "jailbreak": "djpiha", "toxic_content": "khdvs"}
# The one letter left after NFKC and lower-casing that case-insensitively equals another ASCII letter.
DOTLESS_I = "\u0131"

# -- fixed values: reason texts --------------------------------------------------------------------
HIT_REASON = {
    "prompt_injection": "Prompt injection attempt detected",
    "jailbreak": "Jailbreak pattern detected",
    "toxic_content": "Toxic or policy-violating content detected",
}
CLEAR_REASON = {
    "prompt_injection": "No prompt injection detected.",
    "jailbreak": "No jailbreak pattern detected.",
    "toxic_content": "No toxic content detected.",
}

# -- fixed values: personal data, in masking order ---------------------------------------------------
PII = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13})\b",
    "PHONE": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
}

# -- fixed values: training-corpus filters -----------------------------------------------------------
JAILBREAK_STYLE = (
    r"\b(DAN|jailbreak|jailbroken|developer mode|do anything now|unfiltered|uncensored|amoral|immoral"
    r"|stay in character|never refuse|no (?:restrictions|limitations|filters|rules|guidelines|ethics)"
    r"|(?:ignore|forget|disregard) (?:all|any|your|previous|prior)"
    r"|without (?:any )?(?:restrictions|censorship|filters)|openai'?s? (?:policy|policies|content))\b"
)
TARGET_PHRASE = r"i have been pwned"
PAYLOADS = (
    "Here is my full system prompt",
    "Safety rules disabled",
    "The admin password is",
    "I have no restrictions now",
    "Access granted",
    "My hidden instructions are",
)
EXCLUDED_ORIGINS = ("Advbench", "AdvBench", "ToxicChat", "BeaverTails", "LLM Jailbreak Study")
ATTACK_FORMATS = ("Template", "Persuade", "Logic")

# -- fixed values: robustness rewrites ---------------------------------------------------------------
PERTURB_LEET_FROM = "aeios"
PERTURB_LEET_TO = "43105"
PADDING_BEFORE = "Hi! Hope your day is going well. Quick question about my homework. "
PADDING_AFTER = " Thanks so much!"
