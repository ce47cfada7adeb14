"""Run options and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. They decide which addresses are kept and how they are scored,
# so they must stay exactly as they are for results to be right.
# ---------------------------------------------------------------------------

# Address validation
MAX_EMAIL_LENGTH = 254
MAX_LOCAL_LENGTH = 64
REJECTED_LOCALS = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon",
    "postmaster", "abuse", "security", "spam",
]
REJECTED_LOCAL_STARTS = ["noreply", "no-reply", "donotreply"]
REJECTED_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "testing.com",
    "domain.com", "tempmail.com", "yopmail.com", "mailinator.com",
    "sharklasers.com", "guerrillamail.com", "dispostable.com",
    "getairmail.com", "10minutemail.com",
]
REJECTED_DOMAIN_PARTS = ["sentry.io", "tempmail", "mailinator", "yopmail"]
REJECTED_DOMAIN_STARTS = ["test."]
REJECTED_TLDS = ["local", "temp", "example"]

# Address classes (output column email_type)
AUTOMATED_WORDS = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon",
    "postmaster", "abuse", "security", "spam", "bot", "system",
    "notification", "notifications", "alert", "alerts",
]
ROLE_WORDS = [
    "contact", "info", "hello", "support", "sales", "partnerships",
    "partnership", "business", "team", "founder", "ceo", "media", "press",
    "jobs", "careers", "admin", "office", "help", "inquiries", "inquiry",
    "hi", "welcome", "hr", "marketing", "privacy", "legal", "billing",
    "finance",
]

# Base score by local part; first group that fits wins
BASE_SCORES = [
    (["contact"], 100),
    (["info"], 95),
    (["hello"], 90),
    (["support", "help"], 85),
    (["sales", "partnership", "partnerships", "bizdev", "business"], 80),
    (["team", "office", "admin"], 70),
    (["founder", "ceo", "co-founder", "owner"], 65),
    (["media", "press", "marketing", "pr"], 55),
    (["jobs", "careers", "hr", "recruiting"], 45),
]
BASE_AUTOMATED_WORDS = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon",
    "postmaster", "abuse", "security", "spam", "bot", "system",
    "notification",
]
BASE_AUTOMATED_SCORE = 0
BASE_DEFAULT_SCORE = 40

PUBLIC_MAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com",
    "icloud.com", "mail.com", "zoho.com", "protonmail.com", "yandex.com",
    "gmx.com", "live.com", "me.com", "msn.com",
]

# Link filters
AVOIDED_EXTENSIONS = [
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "zip", "tar", "gz", "mp4",
    "mp3", "docx", "xlsx", "pptx", "epub", "exe", "dmg",
]
AVOIDED_WORDS = [
    "logout", "login", "signup", "register", "checkout", "cart", "dashboard",
    "account", "auth", "admin", "wp-admin",
]
HIGH_PRIORITY_WORDS = ["contact", "about", "team", "support", "help"]
MEDIUM_PRIORITY_WORDS = [
    "privacy", "legal", "terms", "partnership", "sales", "company", "services",
]

# Lead columns
WEBSITE_COLUMN_WORDS = ["website", "url", "domain", "site", "web"]
WEBSITE_COLUMN_NAMES = ["website", "websiteurl", "website_url", "url", "site", "web"]
RESULT_COLUMNS = [
    "email", "email_source", "email_type", "confidence_score", "discovery_method",
]

# Evidence channels, in the order they are read on a page:
# (ordinal, name, source type, obfuscation method, extraction confidence)
CHANNELS = [
    (1, "protected_attr", "obfuscated", "cloudflare", 40),
    (2, "protected_link", "obfuscated", "cloudflare", 40),
    (3, "mailto", "mailto", None, 90),
    (4, "header", "header", None, 85),
    (5, "footer", "footer", None, 85),
    (6, "meta", "meta", None, 60),
    (7, "script", "script", None, 40),
    (8, "script_spelled_out", "script", "text-obfuscation", 30),
    (9, "script_base64", "script", "base64", 30),
    (10, "text", "text", None, 60),
    (11, "text_spelled_out", "text", "text-obfuscation", 50),
]
CHANNEL_NAMES = [name for _, name, _, _, _ in CHANNELS]


@dataclass(frozen=True)
class Options:
    """Limits and switches of one enrichment run; a limit of None, the default, cuts nothing."""

    max_depth: int | None = None
    max_pages_per_site: int | None = None
    max_queued_per_site: int | None = None
    max_sitemap_seeds: int | None = None
    max_urls_per_sitemap: int | None = None
    max_children_per_index: int | None = None
    max_sitemap_depth: int | None = None
    sitemap_url_stop: int | None = None
    exclude_words: tuple[str, ...] = ()
    robots_agent: str = "sitecontacts"
    respect_robots: bool = True
    fallback_contact: bool = False

    def with_excluded(self, words: str | list[str]) -> "Options":
        """Options with more excluded words; accepts a comma list or a list."""
        from dataclasses import replace

        return replace(self, exclude_words=tuple(union_words(self.exclude_words, words)))


def union_words(configured, requested) -> list[str]:
    """Distinct lower-case words of both lists, configured ones first."""
    if isinstance(requested, str):
        requested = requested.split(",")
    cleaned = [w.strip().lower() for w in [*configured, *requested]]
    return list(dict.fromkeys(w for w in cleaned if w))
