"""Fixed values. Every list here must equal the expected one for right results."""

# Social and directory sites that never count as a company website.
BLOCKED_DOMAINS = [
    "facebook.com", "linkedin.com", "twitter.com", "x.com", "instagram.com", "youtube.com",
    "tiktok.com", "pinterest.com", "glassdoor.com", "yelp.com", "bbb.org", "crunchbase.com",
    "zoominfo.com", "yellowpages.com", "indeed.com", "reddit.com", "wikipedia.org",
    "bloomberg.com", "dnb.com",
]

# Sites that only answer a residential, rendered fetch.
ANTIBOT_DOMAINS = [
    "g2.com", "linkedin.com", "crunchbase.com", "bloomberg.com", "zoominfo.com",
    "glassdoor.com", "reuters.com", "similarweb.com",
]

# Host names that must not be fetched.
INTERNAL_HOSTS = ["localhost", "metadata.google.internal", "metadata.internal"]

# Public suffixes. A two-letter last label always counts as a country suffix (rule in
# operators/domains.py); these are the generic ones and the common second levels.
GENERIC_SUFFIXES = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop",
    "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "xxx", "post", "arpa",
    "app", "dev", "xyz", "tech", "online", "site", "store", "shop", "cloud", "blog", "agency",
    "digital", "media", "studio", "design", "solutions", "services", "systems", "software",
    "company", "global", "group", "world", "life", "live", "news", "today", "space", "website",
    "email", "network", "finance", "capital", "ventures", "consulting", "marketing", "academy",
    "health", "care", "energy", "works", "team", "tools", "page", "web",
]
SECOND_LEVELS = {
    "uk": ["co", "org", "ac", "gov", "ltd", "plc", "me", "net", "sch", "nhs"],
    "au": ["com", "net", "org", "edu", "gov", "id", "asn"],
    "nz": ["co", "net", "org", "ac", "govt", "school", "geek"],
    "za": ["co", "org", "net", "ac", "gov", "web"],
    "jp": ["co", "or", "ne", "ac", "go", "ad", "ed", "gr", "lg"],
    "kr": ["co", "or", "ne", "ac", "go", "re", "pe"],
    "in": ["co", "net", "org", "ac", "gov", "edu", "res", "firm", "gen", "ind"],
    "il": ["co", "org", "net", "ac", "gov", "muni"],
    "br": ["com", "net", "org", "gov", "edu"],
    "mx": ["com", "net", "org", "gob", "edu"],
    "ar": ["com", "net", "org", "gob", "edu"],
    "co": ["com", "net", "org", "gov", "edu"],
    "pe": ["com", "net", "org", "gob", "edu"],
    "tr": ["com", "net", "org", "gov", "edu"],
    "cn": ["com", "net", "org", "gov", "edu", "ac"],
    "hk": ["com", "net", "org", "gov", "edu"],
    "tw": ["com", "net", "org", "gov", "edu"],
    "sg": ["com", "net", "org", "gov", "edu"],
    "my": ["com", "net", "org", "gov", "edu"],
    "ph": ["com", "net", "org", "gov", "edu"],
    "pk": ["com", "net", "org", "gov", "edu"],
    "id": ["co", "or", "ac", "go", "web", "sch"],
    "th": ["co", "or", "ac", "go", "in"],
    "vn": ["com", "net", "org", "gov", "edu"],
    "ke": ["co", "or", "ac", "go", "ne"],
    "ng": ["com", "net", "org", "gov", "edu"],
    "eg": ["com", "net", "org", "gov", "edu"],
    "sa": ["com", "net", "org", "gov", "edu"],
    "ua": ["com", "net", "org", "gov", "edu"],
    "pl": ["com", "net", "org", "gov", "edu"],
    "pt": ["com", "org", "gov", "edu"],
    "es": ["com", "nom", "org", "gob", "edu"],
    "gr": ["com", "net", "org", "gov", "edu"],
    "at": ["co", "or", "ac", "gv"],
}

# Link patterns per extraction option, best pattern first (3 points, then 2).
HIGH_LINKS = r"(?i)/(about|about-us|team|our-team|people|leadership|staff|contact|contact-us)(/|$)"
MEDIUM_LINKS = r"(?i)/(services|products|solutions|what-we-do|offerings)(/|$)"
LOW_LINKS = (
    r"(?i)/(case-stud|clients|customers|portfolio|testimonials|partners|our-work|success-stories)(/|$)"
)
LINK_PATTERNS = {
    "industry_description": [HIGH_LINKS, MEDIUM_LINKS],
    "target_market": [LOW_LINKS, MEDIUM_LINKS],
    "company_people": [HIGH_LINKS],
    "homepage_raw_text": [],
}
# The same table with the pattern that was evidently meant for case studies.
LINK_PATTERNS_CORRECTED = {
    **LINK_PATTERNS,
    "target_market": [LOW_LINKS.replace("case-stud|", "case-stud(?:y|ies)|"), MEDIUM_LINKS],
}
SKIPPED_FILES = [".pdf", ".jpg", ".png", ".gif", ".css", ".js", ".zip"]

# Local parts of company mailboxes, and the address pattern.
GENERIC_MAILBOXES = [
    "info", "contact", "hello", "support", "sales", "help", "admin", "office", "team", "general",
    "enquiries", "inquiries", "mail", "service", "billing", "hr", "careers", "press", "media",
]
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Titles that are matched strictly, and the markers of a subordinate role.
STRICT_TITLES = [
    "ceo", "cto", "cfo", "coo", "cmo", "cro", "cpo", "cso", "founder", "co-founder", "cofounder",
    "owner", "president",
]
SUBORDINATE_MARKERS = [
    "assistant", "analyst", "coordinator", "specialist", "associate", "intern",
    "executive support", "chief of staff", "office of ", "to ceo", "to cto", "to cfo", "to coo",
    "to cmo", "to founder", "to the ceo", "to the cto", "to the cfo", "to the founder",
]
# Names of sample records.
PLACEHOLDER_NAMES = ["sample contact", "test contact", "(sample", "(test", "do not contact"]

# News queries for funding rounds.
NEWS_QUERIES = [
    'startup "raises" funding',
    '"Series A" OR "Series B" OR "Series C" funding round',
    '"Series D" OR "Series E" OR "Series F" funding round',
    '"seed round" OR "pre-seed" startup funding',
    'startup "closes" funding round',
    '"growth equity" OR "growth round" startup',
    '"venture debt" OR "bridge round" startup',
    'startup "raised from" investors',
]

# Search phrasings per software category; {name} is the category name.
CATEGORY_QUERIES = [
    'site:g2.com/products "{name}"',
    "site:g2.com/products {name} software reviews",
    "site:g2.com/products best {name} tools",
    "site:g2.com/products {name} alternatives",
    "site:g2.com/products top {name} software 2025 2026",
    "g2.com/products {name}",
    'site:g2.com/products "{name}" platform',
    'site:g2.com/products "{name}" vendor',
    'site:g2.com/products "G2 Grid" "{name}"',
    'site:g2.com/products "{name}" 2026',
    'site:g2.com/products "{name}" software company',
    'site:g2.com/products "{name}" pricing',
]
# Endings cut from a product title, in this order.
PRODUCT_ENDINGS = [
    " Reviews", " Pricing", " - G2", " Alternatives", " Pros and Cons", " Features", " Details",
    " Reviews, Prices", " Reviews &",
]
SKIPPED_PRODUCT_PATHS = ["/competitors", "/compare", "/alternatives"]

# Row statuses and how the two result views group them.
ROW_STATUSES = [
    "pending", "searched", "resolved", "verified", "normalized", "crawled", "extracted", "enriched",
    "not_found", "blocked", "failed", "scrape_failed", "extract_failed",
]
FOUND_STATUSES = ["normalized", "enriched", "found", "extracted", "crawled"]
NOT_FOUND_STATUSES = ["not_found", "blocked", "failed", "scrape_failed"]
PREVIEW_GROUPS = {
    "success": ["found", "normalized", "enriched", "extracted", "crawled", "g2_scraped"],
    "destructive": ["not_found", "scrape_failed"],
    "warning": ["blocked", "extract_failed"],
}
PREVIEW_LABELS = {
    "found": "Found", "normalized": "Normalized", "enriched": "Enriched",
    "not_found": "Not Found", "blocked": "Blocked", "pending": "Pending",
    "searched": "Searched", "verified": "Verified", "resolved": "Resolved",
    "crawled": "Crawled", "extracted": "Extracted", "extract_failed": "No intel",
    "scrape_failed": "Scrape Failed", "g2_scraped": "G2 Scraped",
}

# Fixed value: reason of a verdict that could not be had.
FAILED_VERDICT = "LLM call failed or response could not be parsed."

# Limits that a job may pass; no operator cuts by them unless told to.
MAX_ROWS = 100_000
MAX_TEXT_PER_PAGE = 8_000
MIN_CONTENT_LENGTH = 1_500
MAX_PAGES_PER_SITE = 6
MAX_DOCUMENT_CHARS = 16_000
TRUNCATION_MARK = "\n\n[...truncated]"
VERDICT_BATCH = 20
ROW_BATCH = 200
NEWS_BATCH = 15
EARTH_KM_PER_DEGREE = 111.0
MAPS_PER_SEARCH = 100
MAX_TILES = 6
MAX_RADIUS_KM = 50.0
LISTING_PAGE_SIZE = 15
LISTING_PAGES_MAX = 500
QUERY_PAGES = 3
MAX_CATEGORY_COMPANIES = 50_000

# Daily limits per kind of identifier and action.
DAILY_LIMITS = {
    ("email", "email_capture"): 50,
    ("ip", "email_capture"): 50,
    ("email", "upload"): 50,
    ("ip", "upload"): 50,
}
# Cache prefixes in use.
CACHE_PREFIXES = [
    "g2_cat_scrape_v3", "g2_cat_scrape_v2", "g2_cat", "enrich", "linkedin", "serper", "scrape",
    "intel", "funding_discovery",
]
# The steps a row's status may take, website finder first, then company intel.
WEBSITE_STEPS = [
    ("pending", "searched"), ("searched", "verified"), ("searched", "not_found"), ("verified", "normalized"), ("verified", "blocked"),
    ("verified", "failed"), ("normalized", "enriched"),
]
INTEL_STEPS = [
    ("pending", "resolved"), ("resolved", "verified"), ("resolved", "not_found"), ("resolved", "crawled"), ("resolved", "scrape_failed"),
    ("verified", "crawled"), ("verified", "scrape_failed"), ("verified", "not_found"), ("crawled", "extracted"), ("crawled", "extract_failed"),
    ("scrape_failed", "extracted"), ("extracted", "enriched"), ("extract_failed", "enriched"),
]
