"""Word lists, patterns and wording that results must reproduce exactly."""

# Characters that count as white space, spelled out so that every regex dialect agrees.
SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Phrases that mark a listing text as closed.
CLOSED_FLAG_PATTERNS = (
    r"no longer accepting applications",
    r"position filled",
    r"job expired",
    r"this role is no longer available",
    r"application closed",
    r"we've filled this position",
    r"this position has been closed",
    r"job posting expired",
    r"n\.o\. longer available",
)

# Patterns that decide "closed" before any phrase is counted.
EXPLICIT_CLOSED_PATTERNS = (
    r"no longer (accepting|open|available)",
    r"position\s+filled",
    r"job\s+expired",
    r"(is|has been|has)\s+(closed|filled)",
    r"role\s+(is\s+)?(no longer|not)\s+available",
    r"application\s+closed",
    r"we've\s+filled",
    r"we have\s+filled",
    r"hiring\s+(has\s+been\s+)?completed",
)

CLOSED_PHRASES = (
    "no longer accepting applications",
    "position filled",
    "job expired",
    "this role is no longer available",
    "application closed",
    "we've filled this position",
    "this position has been closed",
    "job posting expired",
    "no longer available",
    "applications are closed",
    "hiring has been completed",
    "role has been filled",
    "job is closed",
    "position is no longer open",
    "this job has been filled",
    "unfortunately this role is no longer",
)

OPEN_PHRASES = (
    "apply now",
    "submit your application",
    "join our team",
    "we're hiring",
    "open positions",
    "apply today",
    "apply before",
    "accepting applications",
    "now hiring",
    "apply online",
)

# Patterns and answer codes that mean a page no longer holds a live posting.
GONE_PATTERNS = (
    r"job no longer (exists|available)",
    r"position (has been|is) (filled|closed)",
    r"no longer accepting applications",
    r"this role is (no longer|not) (available|accepting)",
    r"we have filled this position",
    r"404\s*page|page not found",
)
GONE_HTTP_STATUS = (404, 410, 403)

# Method names and wording of verdicts.
KEYWORD_METHOD = "keyword_fallback"
SHORT_TEXT_METHOD = "insufficient_content"
PARSE_FAILED_METHOD = "parse_failed"
PROVIDER_METHODS = ("ai_ollama", "ai_huggingface")
REASON_NONE = "No clear indicators found"
DEFAULT_CHANGE_REASON = "AI classification"

# Prompt wording around the posting text.
PROMPT_TEXT_LIMIT = 2000
PROMPT_HEAD = """Analyze the following job posting text and determine if it is still open or closed.

Rules:
- If the job is closed, expired, filled, or no longer accepting applications, respond with exactly: "closed"
- If the job is still open and accepting applications, respond with exactly: "open"
- Do not include any other text, explanation, or punctuation.

Job posting text:
---
"""
PROMPT_TAIL = """
---

Status:"""

# Selectors used where a site has none of its own; the listing list is tried in order.
LISTING_SELECTORS = (
    "[data-job-id]",
    "[class*='job-card']",
    "[class*='job-listing']",
    "[class*='job posting']",
    "article.job",
    "div[data-id*='job']",
    "li.job-item",
    ".job",
    "a[href*='/jobs/']",
)
TITLE_SELECTOR = "[data-testid='job-title'], h2, h3, a.job-link"
URL_SELECTOR = "a[href*='job'], a[href*='career'], a"
LOCATION_SELECTOR = "[class*='location'], [class*='city'], [class*='remote']"
DATE_SELECTOR = "[class*='date'], [class*='posted'], time"
DESCRIPTION_SELECTOR = "[class*='description'], [class*='summary'], p"
JOB_LINK_SELECTOR = "a[href*='job'], a[href*='career'], a[href*='position']"
HEADING_SELECTOR = "h1, h2, h3, h4"
MAIN_SELECTOR = "main, [role=\"main\"], .job-content, .job-description, article"
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside")
UNTITLED = "Unknown Position"
PREVIEW_LENGTH = 500
