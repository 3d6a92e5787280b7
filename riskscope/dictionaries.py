"""Reference dictionaries used by the feature operators.

Every list here is a parameter default: each operator accepts its own
replacement.  The lists are small and become literal ``IN`` sets / arrays in
the plan (Catalyst turns ``isin`` with more than ten literals into a hash
``InSet``), so no join and no shuffle is needed to apply them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------

# Top-level domains often abused by scam campaigns (with the leading dot).
SUSPICIOUS_TLDS = (
    ".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".club", ".online", ".site", ".info",
    ".biz", ".pw", ".win", ".loan", ".rest", ".run", ".work", ".click", ".link", ".buzz", ".icu",
)

# Brand names looked for (as substrings) in hostname + path.
BRAND_KEYWORDS = (
    "paypal", "amazon", "google", "facebook", "apple", "netflix", "microsoft", "ebay",
    "instagram", "whatsapp", "youtube", "twitter", "linkedin", "dropbox", "chase",
    "wellsfargo", "bankofamerica", "hdfc", "icici", "sbi", "adobe", "binance", "coinbase",
    "docusign", "gemini", "kucoin", "metamask", "roblox", "shopee", "trezor",
)

# Registered domains owned by a brand.  Brands without an entry have no
# official domain, so any hit on them counts as a mismatch.
OFFICIAL_BRAND_DOMAINS = {
    "adobe": ("adobe.com",),
    "amazon": ("amazon.com",),
    "apple": ("apple.com",),
    "binance": ("binance.com",),
    "coinbase": ("coinbase.com",),
    "docusign": ("docusign.com",),
    "facebook": ("facebook.com",),
    "gemini": ("gemini.com",),
    "google": ("google.com",),
    "kucoin": ("kucoin.com",),
    "metamask": ("metamask.io",),
    "microsoft": ("microsoft.com",),
    "netflix": ("netflix.com",),
    "paypal": ("paypal.com",),
    "roblox": ("roblox.com",),
    "shopee": ("shopee.com",),
    "trezor": ("trezor.io",),
}

# URL shortening services (exact hostname match).
SHORTENING_SERVICES = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "rb.gy", "is.gd", "buff.ly", "cutt.ly",
    "tiny.cc", "rebrand.ly", "shorturl.at", "urlz.fr", "short.ly", "u.to", "v.gd", "clck.ru",
    "snip.ly", "bl.ink", "trib.al",
)

# Free hosting platforms (hostname equal to, or a subdomain of, one of these).
FREE_HOSTING_DOMAINS = (
    "blogspot.com", "framer.app", "github.io", "ipfs.dweb.link", "netlify.app", "pages.dev",
    "typedream.app", "vercel.app", "webflow.io", "weebly.com", "weeblysite.com",
)

# Words counted (each at most once) in the lower-cased URL.
SUSPICIOUS_WORDS = (
    "login", "verify", "secure", "account", "update", "signin", "confirm", "banking",
    "password", "wallet", "support", "ebayisapi", "webscr", "cmd", "dispatch", "redirect",
    "checkout", "gift", "prize", "winner", "free", "alert", "airdrop", "bridge", "claim",
    "giveaway", "kyc", "restore", "unlock", "validation",
)

# TLDs whose appearance inside a URL path (".com/" or ".com" at the end) is a signal.
PATH_TLDS = (
    "com", "net", "org", "info", "biz", "edu", "gov", "io", "co", "me", "tk", "ml", "ga", "cf",
    "gq", "xyz", "top", "club", "online", "site",
)

# Second-level labels under a two-letter country code that do not count as a
# subdomain (``a.b.co.uk`` has one subdomain).
COMMON_SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac")

# Scam phrases in page text; single words are matched on tokens after stop
# word removal, multi-word phrases as whole words in the normalised text.
SCAM_KEYWORDS = (
    "act now", "today only", "important notice", "reactivate", "reset password", "otp",
    "cashback", "winner", "reward", "bonus", "prize", "congratulations", "lucky", "claim your",
    "click here to claim", "ssn", "social security", "verify identity", "we noticed unusual",
    "suspicious activity", "unusual activity", "your account has been", "has been compromised",
    "account locked", "security alert", "account suspended", "crypto giveaway", "wallet phrase",
    "seed phrase", "send bitcoin",
)

# Caps applied to the content features.
MAX_TEXT_LENGTH_FEATURE = 250
MAX_TOKEN_COUNT_FEATURE = 30
MAX_EXCLAMATION_FEATURE = 4
TITLE_WEIGHT = 3
LOW_CONTENT_CHARS = 100

# Tags removed together with their content before page text is taken.
DROPPED_TAGS = (
    "script", "style", "noscript", "svg", "canvas", "template", "iframe", "header", "footer",
    "nav", "aside",
)

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

# ASCII punctuation (Python's ``string.punctuation``), replaced by spaces
# before tokenising.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# English stop words: Spark ML's default list (``StopWordsRemover``).  Entries
# with an apostrophe can never match because punctuation is removed first.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "cannot", "could", "ought", "would",
)

# Built-in public-suffix rules (ICANN part, a small subset).  ``kind`` is
# ``exact``, ``wildcard`` (``*.ck`` stored as ``ck``) or ``exception``
# (``!www.ck`` stored as ``www.ck``).  A full list can be loaded with
# ``riskscope.sources.io.read_suffix_rules``.
BUILTIN_SUFFIXES = (
    # generic
    ("com", "exact"), ("net", "exact"), ("org", "exact"), ("edu", "exact"), ("gov", "exact"),
    ("mil", "exact"), ("int", "exact"), ("info", "exact"), ("biz", "exact"), ("io", "exact"),
    ("app", "exact"), ("dev", "exact"), ("xyz", "exact"), ("rest", "exact"), ("link", "exact"),
    ("top", "exact"), ("club", "exact"), ("online", "exact"), ("site", "exact"), ("tk", "exact"),
    ("ml", "exact"), ("ga", "exact"), ("cf", "exact"), ("gq", "exact"), ("pw", "exact"),
    ("win", "exact"), ("loan", "exact"), ("run", "exact"), ("work", "exact"), ("click", "exact"),
    ("buzz", "exact"), ("icu", "exact"), ("me", "exact"), ("co", "exact"), ("tv", "exact"),
    ("ly", "exact"), ("gl", "exact"), ("gd", "exact"), ("cc", "exact"), ("at", "exact"),
    ("to", "exact"), ("fr", "exact"), ("de", "exact"), ("es", "exact"), ("it", "exact"),
    ("nl", "exact"), ("ru", "exact"), ("ch", "exact"), ("se", "exact"), ("eu", "exact"),
    ("us", "exact"), ("ca", "exact"),
    # country codes with common second levels
    ("uk", "exact"), ("co.uk", "exact"), ("ac.uk", "exact"), ("gov.uk", "exact"),
    ("org.uk", "exact"), ("in", "exact"), ("co.in", "exact"), ("ac.in", "exact"),
    ("gov.in", "exact"), ("bn", "exact"), ("com.bn", "exact"), ("au", "exact"),
    ("com.au", "exact"), ("br", "exact"), ("com.br", "exact"), ("jp", "exact"),
    ("co.jp", "exact"), ("cn", "exact"), ("com.cn", "exact"), ("nz", "exact"),
    ("co.nz", "exact"), ("za", "exact"), ("co.za", "exact"),
    # wildcard and exception rule pair
    ("ck", "wildcard"), ("www.ck", "exception"),
)
