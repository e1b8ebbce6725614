"""Fixed values that must equal the behaviour being matched.

Everything in this module is data (word lists, patterns, labels, limits),
kept together and in its natural order so it can be reviewed at a glance.
"""

# --------------------------------------------------------------------------
# FIXED VALUES — built-in categories: (key, display name, description),
# in declaration order. Declaration order also breaks density-score ties.
# --------------------------------------------------------------------------
BUILTIN_CATEGORIES = [
    ("TECHNOLOGY", "Technology", "Software, programming, AI, development, tech news"),
    ("NEWSPAPER_ARTICLE", "Newspaper Article", "News articles, journalism, current events"),
    ("TECHNOLOGY_UPDATE", "Technology Update", "Tech announcements, product releases, updates"),
    ("SIMPLE_ARTICLE", "Simple Article", "General articles, blogs, informational content"),
    ("UNKNOWN", "Unknown", "Could not determine category"),
]

# FIXED VALUES — descriptions used when a category record is created
# (keyed by lower-cased name); anything else gets DEFAULT_DESCRIPTION_PREFIX + name.
CATEGORY_RECORD_DESCRIPTIONS = [
    ("technology", "Documents related to technology, programming, software development, and tech news"),
    ("technology update", "Latest technology updates, product launches, and software releases"),
    ("newspaper article", "News articles, breaking news, and current events"),
    ("simple article", "General articles, blog posts, tutorials, and guides"),
    ("unknown", "Uncategorized documents"),
]
DEFAULT_DESCRIPTION_PREFIX = "Documents categorized as "

# FIXED VALUES — density patterns per built-in category (case-insensitive,
# word-bounded alternations), in declaration order.
DENSITY_PATTERNS = [
    ("Technology", [
        r"software|programming|developer|coding|algorithm|javascript|python|java|react|angular|vue|node\.js|api|database|cloud|aws|azure|docker|kubernetes|artificial intelligence|machine learning|AI|ML|blockchain|cryptocurrency|bitcoin|ethereum",
        r"github|stackoverflow|tech|technology|framework|library|open source|backend|frontend|fullstack|devops|ci/cd|microservices|rest|graphql",
    ]),
    ("Newspaper Article", [
        r"breaking|news|reported|journalist|correspondent|reuters|associated press|CNN|BBC|times|post|herald|tribune|gazette|today|daily",
        r"politics|government|election|president|minister|congress|parliament|senate|house|policy|legislation|investigation",
        r"according to sources|officials said|statement|press conference|interview|exclusive|developing story",
    ]),
    ("Technology Update", [
        r"update|upgrade|release|version|patch|changelog|new features|announcement|launched|beta|alpha|rollout",
        r"apple|google|microsoft|facebook|meta|amazon|tesla|spotify|netflix|uber|twitter|instagram|tiktok|whatsapp",
        r"iOS|android|windows|mac|chrome|firefox|safari|edge|app store|play store|product launch|keynote",
    ]),
    ("Simple Article", [
        r"how to|guide|tutorial|tips|advice|learn|beginner|step by step|introduction|overview|basics",
        r"blog|article|post|content|writing|author|published|lifestyle|health|travel|food|culture|sports|entertainment",
        r"opinion|review|analysis|commentary|thoughts|perspective|experience|personal|story|essay",
    ]),
]
DENSITY_MIN_SCORE = 0.1
DENSITY_CLASSIFIER = "enhanced-rule-based-v1.0"
UNKNOWN_NAME = "Unknown"

# FIXED VALUES — keyword rules (category -> keywords), in definition order.
DEFAULT_KEYWORD_RULES = {
    "finance": ["bank", "banking", "finance", "financial", "investment", "money",
                "loan", "credit", "debt", "mortgage", "insurance", "trading",
                "stocks", "portfolio", "crypto", "cryptocurrency", "bitcoin"],
    "technology": ["technology", "tech", "software", "programming", "development",
                   "coding", "computer", "ai", "artificial intelligence", "machine learning",
                   "cloud", "api", "database", "framework", "javascript", "python", "java"],
    "news": ["news", "breaking", "report", "article", "journalism", "politics",
             "government", "election", "policy", "current events"],
    "science": ["science", "research", "study", "experiment", "biology", "chemistry",
                "physics", "medicine", "health", "medical", "scientific"],
    "business": ["business", "company", "corporate", "enterprise", "startup",
                 "entrepreneur", "management", "strategy", "marketing", "sales"],
}
# FIXED VALUES — domain rules (category -> domains), in definition order.
# ("yahoo.com/finance" can never match: the path is stripped from the domain.)
DEFAULT_DOMAIN_RULES = {
    "news": ["cnn.com", "bbc.com", "reuters.com", "ap.org", "nytimes.com",
             "washingtonpost.com", "theguardian.com"],
    "technology": ["github.com", "stackoverflow.com", "techcrunch.com", "wired.com",
                   "ars-technica.com", "theverge.com", "hacker-news.com"],
    "finance": ["bloomberg.com", "cnbc.com", "marketwatch.com", "wsj.com",
                "investing.com", "yahoo.com/finance"],
}
RULE_THRESHOLD = 0.7
RULE_KEYWORD_WEIGHT = 0.7
RULE_DOMAIN_WEIGHT = 0.3
RULE_CLASSIFIER = "rule-based-v1.0"

# FIXED VALUES — TF-IDF stop words (49 English words) and parameters.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her",
    "was", "one", "our", "out", "day", "get", "has", "him", "his", "how",
    "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did",
    "its", "let", "put", "say", "she", "too", "use", "any", "may", "with",
    "this", "that", "from", "they", "were", "been", "have", "what", "your",
]
TFIDF_MIN_DF = 2
TFIDF_MAX_FEATURES = 1000
TFIDF_THRESHOLD = 0.6
TFIDF_CLASSIFIER = "ml-tfidf-v1.0"
MIN_TOKEN_LENGTH = 3  # tokens longer than two characters
# FIXED VALUES: the generic syntax of a URI reference (RFC 2396 with the
# "other" characters of java.net.URI), as one pattern per part.
_ESCAPED = r"%[0-9A-Fa-f]{2}"
_OTHER = r"[^\x00-\x7F\s\p{Z}\p{C}]"
_PCHAR = rf"(?:[A-Za-z0-9_.!~*'(),;:$&+=@\-]|{_ESCAPED}|{_OTHER})"
_URIC = rf"(?:[A-Za-z0-9_.!~*'(),;:$&+=@/?\[\]\-]|{_ESCAPED}|{_OTHER})"
_AUTHORITY = rf"(?:[A-Za-z0-9_.!~*'(),;:$&+=@\-]|{_ESCAPED}|{_OTHER})*+(?:\[[0-9A-Fa-f:.%]++\](?::[0-9]*+)?)?"
_HIERARCHY = rf"(?://(?:(?=[^/?#]){_AUTHORITY}|(?=[/?#]))(?:/{_PCHAR}*+)*+|(?!//)/{_PCHAR}*+(?:/{_PCHAR}*+)*+)"
_RELATIVE = rf"(?:(?![:/?#])(?:(?!:){_PCHAR})++(?:/{_PCHAR}*+)*+)?"
URI_REFERENCE = (rf"\A(?:[A-Za-z][A-Za-z0-9+.\-]*+:(?:{_HIERARCHY}(?:\?{_URIC}*+)?|(?!/){_URIC}++)"
                 rf"|(?:{_HIERARCHY}|{_RELATIVE})(?:\?{_URIC}*+)?)(?:#{_URIC}*+)?\z")

# FIXED VALUES — external model request / labels.
MODEL_TOOL_NAME = "classify_document"
MODEL_METHOD = "tools/call"
MODEL_LABEL_PREFIX = "mcp-"
MODEL_DEFAULT_LABEL = "mcp-ai"

# FIXED VALUES — ingest steps in order, and the texts attached to them.
INGEST_STEPS = ["URL_VERIFICATION", "PDF_CONVERSION", "STORAGE",
                "CONTENT_ANALYSIS", "CATEGORIZATION", "COMPLETED"]
MSG_URL_REQUIRED = "URL is required"
MSG_BAD_SCHEME = "Invalid URL scheme. Only HTTP and HTTPS are supported."
MSG_BAD_FORMAT = "Invalid URL format"
MSG_ACCESSIBLE = "URL is accessible"
# FIXED VALUES: standard HTTP reason phrases used in fetch outcomes.
HTTP_REASONS = [
    (200, "OK"), (301, "Moved Permanently"), (302, "Found"), (304, "Not Modified"),
    (400, "Bad Request"), (401, "Unauthorized"), (403, "Forbidden"), (404, "Not Found"),
    (429, "Too Many Requests"), (500, "Internal Server Error"), (502, "Bad Gateway"),
    (503, "Service Unavailable"),
]

# FIXED VALUES — page metadata fallbacks.
UNTITLED = "Untitled Document"
FALLBACK_TITLE = "Web Page Snapshot"
FALLBACK_DESCRIPTION = "PDF snapshot of web page"
DESCRIPTION_PREFIX = "PDF snapshot of "

# FIXED VALUES — file names, notes, API paths.
DEFAULT_FILE_BASE = "document"
STORED_NAME_BAD = r'[\\/:*?"<>|]'
DOWNLOAD_NAME_BAD = r"[^a-zA-Z0-9._-]"
LINK_NAME_BAD = r'[<>:"/\\|?*]'
NOTE_NAME_BAD = r"[^a-zA-Z0-9\s\-_]"
NOTE_HEADINGS = {"description": "## Description\n", "notes": "## Notes\n", "resources": "## Resources\n[Download PDF](../pdfs/",
                 "categories": "## Categories\n", "metadata": "## Metadata\n- **Fetched:** ",
                 "canonical": "- **Canonical URL:** ", "size": "- **PDF Size:** "}
STORED_NAME_MAX = 100
DOWNLOAD_NAME_MAX = 100
LINK_NAME_MAX = 200
NOTE_TITLE_MAX = 50
NOTE_TAG = "page-snapshot"
DEFAULT_NOTE_META_TAG = "data-note"
PDF_URL_PREFIX = "/api/v1/documents/"
PDF_URL_SUFFIX = "/pdf"
SIZE_UNITS = "KMGTPE"
GRAPH_ROOT_ID = "root"
GRAPH_ROOT_NAME = "Categories"
