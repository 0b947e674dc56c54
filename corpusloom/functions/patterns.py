"""Fixed patterns and word lists that results depend on.

Each pattern is written so that Java's and RE2's engines read it alike: explicit
classes instead of Unicode shorthands and no lookaround, unless it is marked.
"""

# Text features.
DISPLAY_MATH = r"(?s)\$\$.*?\$\$"
INLINE_MATH = r"(?:^|[^$])\$[^$\n](?:(?:[^$\n]|\$\$+)*[^$\n])?\$(?:[^$]|$)"
LATEX_COMMAND = r"\\[A-Za-z]+"
TABLE_ROW = r"^\s*\|.*\|\s*$"
FORMULA_QUERY = r"[=^_~]|\\[A-Za-z]+|\$|[≤≥≈≠±×÷∑∫√∂∇πλσθφμΩ°]"
FORMULA_FRAGMENT = r"(?s:\$\$.+?\$\$)|\$[^\n]+?\$|\\[A-Za-z]+(?:\s*[\^_]\s*\{?[A-Za-z0-9]+\}?)?|[A-Za-z0-9]+\s*[\^_]\s*\{?[A-Za-z0-9]+\}?"
TOKEN = r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[=^_+<>%°µπλσθφαβγδωΩΔ∑∫√∞±×÷≤≥≈≠∂∇⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]"
_SYMBOLS = TOKEN.rsplit("[", 1)[1][:-1]
#: The matches of TOKEN in Java, several times as fast: the long class is tried only where one of its ranges begins (looks ahead, Java only).
TOKEN_SCAN = r"[A-Za-z]++|[0-9]++(?:\.[0-9]+)?|[" + "".join(c for c in _SYMBOLS if c.isascii()) + r"]|(?=[\u0080-\u00bf\u00d7\u00f7\u0250-\uffff])[" + "".join(c for c in _SYMBOLS if not c.isascii()) + "]"
WORD = r"[\p{L}\p{N}_]+"
BAD_CHARACTER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"

# Personal data, in the order in which they are redacted.  PHONE looks around itself (Java only).
PII = [
    ("AADHAAR", r"\b[2-9][0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("PHONE", r"(?:\+91[\-\s]?|0)?(?<![0-9])[6-9][0-9]{9}(?![0-9])"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("GSTIN", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"),
    ("PASSPORT", r"\b[A-PR-WY][1-9][0-9]{7}\b"),
    ("VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|6011|3[47][0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
]
PHONE_FOUND = r"(?:^|[^0-9])[6-9][0-9]{9}(?:[^0-9]|$)"

# Instructions hidden in text; the first that matches decides (category, action).
INJECTION = [
    (r"ignore\s+(all\s+)?(previous|prior|above|your)\s+(system\s+)?(instructions?|prompt|rules?|constraints?)", "instruction_override", "refuse"),
    (r"disregard\s+(the\s+)?(system|previous|all)\s*(instructions?|prompt|rules?)?", "instruction_override", "refuse"),
    (r"forget\s+(all\s+)?(previous|your|the)\s+(instructions?|rules?|constraints?|guidelines?)", "instruction_override", "refuse"),
    (r"override\s+(your\s+)?(instructions?|system|programming|training)", "instruction_override", "refuse"),
    (r"(previous|prior|old|your)\s+instructions?\s+(do\s+not|don't|no\s+longer|doesn't|won't)\s+(apply|count|matter|hold|stand)", "instruction_override", "refuse"),
    (r"you\s+are\s+now\s+(?:a|an|my)\s+\w", "role_change", "refuse"),
    (r"pretend\s+(you\s+have\s+no|you\s+are\s+not|there\s+are\s+no)\s+(restrictions?|limits?|rules?|guidelines?)", "role_change", "refuse"),
    (r"act\s+as\s+(?:if\s+)?(?:you\s+are\s+)?(?:an?\s+)?(?:different|unrestricted|uncensored)", "role_change", "refuse"),
    (r"\bDAN\b|do\s+anything\s+now", "jailbreak_keyword", "refuse"),
    (r"developer\s*mode|jailbreak\s*mode|god\s*mode|unrestricted\s*mode|uncensored\s*mode", "jailbreak_keyword", "refuse"),
    (r"(enable|activate|unlock)\s+(jailbreak|unrestricted|uncensored|developer)", "jailbreak_keyword", "refuse"),
    (r"(reveal|print|show|display|output|repeat|echo|dump)\s+(?:(?:your|the|my)\s+)?(system\s+)?(prompt|instructions?|rules?|configuration|context)", "exfil", "refuse"),
    (r"what\s+(are|were)\s+your\s+(instructions?|system\s+prompt|rules?)", "exfil", "refuse"),
    (r"(show|reveal|print|give\s+me)\s+(?:me\s+)?(?:(?:your|the)\s+)?(api[\s_]?key|token|password|secret|credential)", "exfil", "refuse"),
    (r"(print|repeat|echo)\s+(the\s+)?(text|content|words?)\s+(above|before|previously|earlier)", "exfil", "refuse"),
    (r"(print|show|reveal|display|output|dump)\s+.{0,30}(system\s+prompt|your\s+instructions?)", "exfil", "refuse"),
    (r"\.env\b|\b[A-Z0-9]+_API_(?:TOKEN|KEY)\b|\b[A-Z0-9]+_PASS(?:WORD)?\b|system_prompt\.txt", "exfil", "refuse"),
    (r"training\s+data|model\s+weights|internal\s+(data|database|documents?)", "exfil", "sanitize"),
    (r"<\|system\|>|<\|assistant\|>|<\|im_start\|>|<\|im_end\|>", "tag_injection", "refuse"),
    (r"###\s*(System|Instruction|Assistant|Human|User)\s*:", "tag_injection", "refuse"),
    (r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>", "tag_injection", "refuse"),
    (r"<system>|</system>|<context>|</context>", "tag_injection", "refuse"),
    (r"```\s*(system|instruction|override|jailbreak)", "codefence_injection", "refuse"),
    (r"NOTE\s+TO\s+(AI|ASSISTANT|SYSTEM):\s*ignore", "indirect_injection", "refuse"),
    (r"IMPORTANT\s+(AI|SYSTEM)\s*(INSTRUCTION|DIRECTIVE|OVERRIDE)", "indirect_injection", "refuse"),
]
NEUTRALIZED = "[neutralized-instruction]"

# System internals that must not leave; settings and modules by their form, whatever the product.
LEAKAGE = [
    r"(?i)RESPONSE RULES:|SCREENSHOT ANALYSIS INSTRUCTIONS:|GENERAL RULES:|MULTI-HOP PROTOCOL:",
    r"(?i)CONVERSATION & FOLLOW-UPS:|MULTI-HOP & QUANTITATIVE REASONING:",
    r"\[Source:[^\n]*?\|\s*score=[0-9.]+\]",
    r"(?i)KNOWLEDGE GRAPH \(entity relationships\):|DOCUMENT PASSAGES \(relevant text",
    r"(?i)<<CONTEXT>>|<</CONTEXT>>|<<USER_QUERY>>|<</USER_QUERY>>",
    r"(?i)\b[A-Z0-9]+_API_(?:TOKEN|KEY)\b|\b[A-Z0-9]+_PASSWORD\b",
    r"(?i)system_prompt\.txt|\b[a-z_]+_(?:chain|client)\.py\b",
    r"(?i)NEED_MORE:\s*[^\n]+",
]

# Page parts that carry no text.
JUNK_TAGS = ["nav", "footer", "header", "script", "style", "noscript", "aside", "form", "button", "iframe", "svg", "menu"]
JUNK_SIGNATURES = ["cookie", "consent", "popup", "modal", "banner", "newsletter", "subscribe", "social", "share", "advert", "sidebar", "breadcrumb"]

# Follow-up questions.
PRONOUNS = ["it", "its", "that", "those", "these", "this", "they", "them", "their", "he", "she", "his", "her", "one", "ones", "there"]
OPENERS = ["what about", "how about", "and ", "what else", "why", "how so", "which one", "the same", "compared to", "vs ", "versus"]
NAMED_ENTITY = r"\b[A-Z][A-Za-z0-9\-]{1,}\b"

# Grounding and citations.
GROUNDING_NUMBER = r"\b[0-9][0-9,]*(?:\.[0-9]+)?\b"
SOURCES_FOOTER = r"(?i)\s*SOURCES:\s*\[[^\]]*\]\s*$"
INLINE_CITATION = r"\[S([0-9]+)\]"

# File formats by suffix (source type, category, quality gate, switch, page numbers).
FORMATS = [
    (".pdf", "pdf", "pdf", False, None, True),
    (".html", "html", "html", False, None, False),
    (".htm", "html", "html", False, None, False),
    (".xhtml", "html", "html", False, None, False),
    (".txt", "text", "text", False, None, False),
    (".md", "text", "text", False, None, False),
    (".docx", "docx", "docling", True, "office", False),
    (".pptx", "pptx", "docling", True, "office", False),
    (".adoc", "asciidoc", "docling", True, "office", False),
    (".xlsx", "xlsx", "docling", True, "office", False),
    (".csv", "csv", "docling", True, "office", False),
    (".png", "image", "docling", True, "images", False),
    (".jpg", "image", "docling", True, "images", False),
    (".jpeg", "image", "docling", True, "images", False),
    (".tif", "image", "docling", True, "images", False),
    (".tiff", "image", "docling", True, "images", False),
    (".bmp", "image", "docling", True, "images", False),
    (".webp", "image", "docling", True, "images", False),
    (".gif", "image", "docling", True, "images", False),
]
