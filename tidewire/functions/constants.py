"""Word lists, patterns and tables that results depend on, in their natural order."""

# Event types with strong and weak patterns.
EVENT_PATTERNS = {
    "acquisition": (
        [r"\bacquires?\b", r"\bacquired\b", r"\bacquisition\b", r"\bto acquire\b", r"\bbought\b", r"\bbuys\b", r"\bmerger\b", r"\bmerges?\b", r"\btakeover\b"],
        ["deal", "transaction", "strategic"],
    ),
    "funding": (
        [r"\braises?\b.*\$", r"\braised\b.*\$", r"\bseries [a-e]\b", r"\bseed round\b", r"\bfunding round\b", r"\bsecures? funding\b"],
        ["million", "billion", "valuation", "investors"],
    ),
    "executive_move": (
        [
            r"\bjoins?\b.*\bas\s+(ceo|cto|cfo|coo|vp|president|chief)\b", r"\bjoins?\b.*\bas\b", r"\bnamed\s+(ceo|cto|cfo|coo|vp|president)\b", r"\bappoints?\b",
            r"\bsteps? down\b", r"\bdeparts?\b", r"\bresigns?\b", r"\bhired\s+as\b",
        ],
        ["executive", "leadership", "chief", "president", "vp", "vice president"],
    ),
    "layoff": ([r"\blayoffs?\b", r"\blays? off\b", r"\blaid off\b", r"\bcuts? jobs\b", r"\bjob cuts\b", r"\bworkforce reduction\b"], ["restructuring", "downsizing"]),
    "ipo": ([r"\bipo\b", r"\binitial public offering\b", r"\bgoes? public\b", r"\bpublic listing\b"], ["stock", "shares", "trading"]),
}
PERSON_INDICATORS = ["ceo", "cto", "cfo", "founder", "president", "partner", "executive", "chief"]
AMOUNT_PATTERN = r"\$[\d,.]+\s*(million|billion|M|B)?"

# Sources by domain with tier and base confidence.
SOURCE_TIERS = [
    ("Bloomberg", "bloomberg.com", 1, 0.95), ("Wall Street Journal", "wsj.com", 1, 0.95), ("Reuters", "reuters.com", 1, 0.95), ("SEC EDGAR", "sec.gov", 1, 1.0),
    ("Crunchbase", "crunchbase.com", 1, 0.90), ("Crunchbase News", "news.crunchbase.com", 1, 0.90), ("TechCrunch", "techcrunch.com", 2, 0.85), ("GeekWire", "geekwire.com", 2, 0.85),
    ("VentureBeat", "venturebeat.com", 2, 0.85), ("Techmeme", "techmeme.com", 2, 0.80), ("Axios", "axios.com", 2, 0.85), ("The Verge", "theverge.com", 2, 0.80),
    ("Wired", "wired.com", 2, 0.80), ("Fortune", "fortune.com", 2, 0.85), ("Forbes", "forbes.com", 2, 0.80), ("PR Newswire", "prnewswire.com", 3, 0.70),
    ("Business Wire", "businesswire.com", 3, 0.70), ("SiliconANGLE", "siliconangle.com", 3, 0.75), ("Inc", "inc.com", 3, 0.75), ("Fast Company", "fastcompany.com", 3, 0.75),
    ("Ars Technica", "arstechnica.com", 3, 0.75), ("Hacker News", "news.ycombinator.com", 3, 0.60),
]
DEFAULT_SOURCE = ("Unknown", "unknown", 3, 0.50)

# Suffixes, in the order in which they are cut.
ENTITY_SUFFIXES = [" Inc.", " Inc", " Corp.", " Corp", " LLC", " Ltd.", " Ltd", " Corporation", " Company", " Co.", " Co", " PLC", " LP", " LLP", " Holdings", " Group", " Technologies", " Technology", " Systems"]
FILING_SUFFIXES = [s.lower() for s in ENTITY_SUFFIXES] + [" solutions", " software", " labs", " ai", " io"]
ONE_SUFFIX = ENTITY_SUFFIXES[:14]
URL_SUFFIXES = [" Inc", " Inc.", " Corp", " Corp.", " LLC", " Ltd", " Ltd."]
PLACEHOLDERS = ["N/A ", "n/a ", "--- ", "[none] ", ". ", "- ", "-- "]

# Aliases, canonical name first.
KNOWN_ALIASES = {
    "nvidia": ["nvidia corp", "nvidia corporation", "nvidia inc"], "meta": ["meta platforms", "facebook", "meta inc"], "google": ["alphabet", "google inc", "google llc", "alphabet inc"],
    "amazon": ["amazon inc", "amazon.com", "amazon web services", "aws"], "microsoft": ["microsoft corp", "microsoft corporation", "msft"], "apple": ["apple inc", "apple computer"],
    "openai": ["open ai", "openai inc"], "anthropic": ["anthropic ai", "anthropic inc"],
}

# Names that are no entities.
INVALID_NAMES = [
    "target", "blank", "href", "http", "https", "www", "reuters", "techcrunch", "bloomberg", "fortune", "the wall street journal", "cnbc", "yahoo finance", "employees", "investor",
    "investors", "series a", "series b", "series c", "series d", "series e", "seed", "seed round", "new tech", "ai startup", "cap table management", "nuclear fusion company",
    "fusion power company", "chief medical officer",
]
INVALID_PATTERNS = [r"^[A-Z]{20,}$", r"^CBM[iI]", r"^\d+$", r"^[a-f0-9]{32,}$", r"^target=", r"^href=", r"^<[^>]+>", r"^[^a-zA-Z]*$"]
REMOVED_ENTITIES = ["investor", "company", "startup", "firm", "corporation", "employees", "staff", "team", "people", "person", "the company", "the startup", "the firm"]
GENERIC_TERMS = ["company", "startup", "firm", "business", "corporation"]
COMMON_WORDS = ["company", "startup", "firm", "investor", "ceo", "cto", "employee"]
BAD_FRAGMENTS = [
    "says", "said", "announced", "reported", "according", "stated", "the company", "the startup", "the firm", "the investor", "in a", "for a", "with a", "to a", "from a", "which", "that",
    "this", "their", "its", "monday", "tuesday", "wednesday", "thursday", "friday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
]
DIGEST_DENIED = ['target="_blank"', "href=", "http://", "https://", "investing.com", "reuters -", "google news"]
PERSON_DENIED = ["gpt-", "claude ", "gemini ", "llama ", "mistral ", "donald trump", "joe biden", "barack obama", "elon musk", "venezuela", "colombia", "ministry"]

# Signs of a fund or special purpose vehicle, and of an organisation.
FUND_PARTS = [
    "a series of", "series of ", "spv,", " spv ", " spv", "fund lp", "fund l.p.", "fund, l.p.", "fund, llc", "fund llc", "master fund", "offshore fund", "opportunity fund", "access fund",
    "gp llc", "gp, llc", "gp ii", "gp iii", "gp iv", "gp ltd", "capital lp", "partners lp", "partners l.p.", "ventures lp", "partners i,", "partners ii,", "partners iii,", "partners iv,",
    "partners i-", "partners ii-", "partners iii-", "operating partnership", "reit", "municipal", "real estate", "dst", "apartment", "senior investors", "housing", "witz ventures llc",
    "anchor capital gp", "springcoast", "growth partners", "alternative investment", "investors, llc", "holdings, llc",
]
FUND_PATTERNS = [
    r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{4}\s+a\s+series", r"\bfund\s+(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b", r"fund\s+[ivx]+\s+llc", r"-\s*series\s*\d",
    r"\bq[1-4]\s+\d+\s+a\s+series", r"^\d+\s+[a-z]+\s+(st|ave|blvd|rd|way|dr)",
]
ORGANISATION_PARTS = [
    "LLC", "L.L.C.", "INC", "INC.", "CORP", "CORP.", "LTD", "LTD.", "L.P.", "LP", "LIMITED", "PARTNERS", "PARTNERSHIP", "FUND", "CAPITAL", "VENTURES", "MANAGEMENT", "ADVISORS", "HOLDINGS",
    "TRUST", "REIT", "GROUP", "COMPANY", "CO.", "SARL", "S.A.",
]

# Signs that a person's name is a firm's or has a placeholder, in any letter case.
MISLABELLED_PATTERN = r"(?i)^(N/A |--- |\[none\] |\. |- |LLC )|LLC|Ltd|Inc|L\.P\.|Corp|Fund|Partners|Capital|Management|Advisors"

# Money words with their factors, and rounds with their words, in the order tried.
MULTIPLIERS = [("billion", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("mm", 1e6), ("mn", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3)]
ROUNDS = [
    ("seed", ["seed", "pre-seed", "angel"]), ("series_a", ["series a", "series-a"]), ("series_b", ["series b", "series-b"]), ("series_c", ["series c", "series-c", "series d", "series e"]),
    ("funding", ["funding", "raises", "raised", "secures", "closes", "investment"]),
]
ACQUISITION_WORDS = ["acquires", "acquired", "acquisition", "merger", "merged", "buys", "bought", "takeover"]
EXECUTIVE_WORDS = ["ceo", "cto", "cfo", "coo", "chief", "president", "vp", "vice president", "joins", "appointed", "hired", "names"]
LAYOFF_WORDS = ["layoff", "layoffs", "laid off", "cuts jobs", "workforce reduction", "downsizing"]

# Sections of a digest in order, as (kind, title, most items), by period.
DIGEST_SECTIONS = {
    "weekly": [
        ("funding", "🚀 Companies That Raised Funding", 20),
        ("acquisition", "🤝 Acquisitions & Mergers", 15),
        ("layoff", "📉 Layoffs (Displaced Talent)", 15),
        ("move", "👔 Executive Movements", 20),
        ("candidate", "⭐ Hot Candidates", 15),
    ],
    "daily": [
        ("funding", "Funding Rounds", 15),
        ("acquisition", "M&A Activity", 10),
        ("layoff", "Layoffs (Displaced Talent)", 15),
        ("move", "Executive Moves", 10),
        ("candidate", "Available Talent", 10),
    ],
}

# Patterns of facts in texts, in order of precedence, searched without regard to case.  NAME stands for
# the entity's name; a pattern without a group gives all that it matches.
HEAD_COUNTS = [
    r"(\d{1,3}(?:,\d{3})*)\s*(?:employees|staff|workers)",
    r"employs?\s*(?:about|approximately|around|over|more than)?\s*(\d{1,3}(?:,\d{3})*)",
    r"workforce\s*of\s*(?:about|approximately|around|over)?\s*(\d{1,3}(?:,\d{3})*)",
    r"(\d{1,3}(?:,\d{3})*)\s*people\s*(?:work|employed)",
]
HEAD_COUNT_BUCKETS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (None, "5000+")]
HEADQUARTERS = [
    r"headquartered\s+in\s+([^,.]+(?:,\s*[A-Z][a-z]+)?)",
    r"based\s+in\s+([^,.]+(?:,\s*[A-Z][a-z]+)?)",
    r"headquarters?\s+(?:is|are|located)?\s*(?:in|at)?\s*([^,.]+(?:,\s*[A-Z][a-z]+)?)",
    r"(?:San Francisco|New York|Palo Alto|Mountain View|Austin|Boston|Seattle|Los Angeles|London|Berlin)",
]
FOUNDING_YEARS = [r"founded\s+(?:in\s+)?(\d{4})", r"established\s+(?:in\s+)?(\d{4})", r"started\s+(?:in\s+)?(\d{4})", r"since\s+(\d{4})"]
FUNDING_TOTALS = [
    r"raised\s+\$?([\d.]+)\s*(billion|million|B|M)",
    r"\$?([\d.]+)\s*(billion|million|B|M)\s+(?:in\s+)?(?:funding|investment|raised)",
    r"funding\s+(?:of|totaling)\s+\$?([\d.]+)\s*(billion|million|B|M)",
    r"series\s+[A-Z]\s+(?:of|at|worth)?\s*\$?([\d.]+)\s*(billion|million|B|M)",
]
FUNDING_ROUNDS = [r"(series\s+[A-Z](?:\d)?)", r"(seed\s+(?:round|funding))", r"(pre-seed)", r"(IPO)"]
INDUSTRIES = [
    r"(?:in the|specializes in|focuses on)\s+([a-z]+(?:\s+[a-z]+)?)\s+(?:industry|sector|space|market)",
    r"(artificial intelligence|machine learning|AI|ML|fintech|healthtech|biotech|edtech|cybersecurity|cloud computing|SaaS|e-commerce|robotics)",
]
COMPANY_TYPES = [("startup", r"startup|start-up"), ("public", r"publicly\s+traded|NYSE|NASDAQ|public\s+company"), ("private", r"private\s+company|privately\s+held")]
WEBSITES = [r"(https?://(?:www\.)?[a-z0-9-]+\.[a-z]{2,}(?:/[^\s]*)?)", r"(?:website|site):\s*((?:www\.)?[a-z0-9-]+\.[a-z]{2,})"]
OTHER_SITES = ["linkedin", "crunchbase", "wikipedia"]
JOB_TITLES = [
    r"NAME\s*(?:is|,)\s*(?:the\s+)?(?:current\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Officer|Executive|Director|Manager|Engineer|Scientist))?)",
    r"(?:CEO|CTO|CFO|COO|CMO|CPO|VP|President|Director|Founder|Co-Founder)",
    r"serves?\s+as\s+(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
]
EXECUTIVE = r"CEO|CTO|CFO|COO|CMO|CPO|Chief|C-level|President|Founder|Co-Founder"
EXECUTIVE_LEVELS = [("C-level", r"CEO|CTO|CFO|COO|CMO|CPO|Chief"), ("Founder", r"Founder|Co-Founder"), ("VP", r"VP|Vice President"), ("Director", r"Director")]
EMPLOYERS = [
    r"NAME\s+(?:is|works)\s+(?:at|for|with)\s+([A-Z][A-Za-z0-9\s]+?)(?:\.|,|as)",
    r"(?:CEO|CTO|CFO|COO|founder)\s+(?:of|at)\s+([A-Z][A-Za-z0-9\s]+?)(?:\.|,)",
    r"joined\s+([A-Z][A-Za-z0-9\s]+?)(?:\s+in|\s+as|\.)",
]
PLACES = [r"based\s+in\s+([^,.]+)", r"lives?\s+in\s+([^,.]+)", r"from\s+([A-Z][a-z]+(?:,\s*[A-Z][a-z]+)?)"]
EARLIER_EMPLOYERS = [
    r"(?:previously|formerly|earlier)\s+(?:at|with|worked\s+(?:at|for))\s+([A-Z][A-Za-z0-9\s,]+?)(?:\.|;|and\s+(?:later|before))",
    r"(?:ex-|former\s+)[A-Za-z]+\s+(?:at|of)\s+([A-Z][A-Za-z0-9]+)",
]
SCHOOLS = [
    r"(?:graduated|studied|degree)\s+(?:from|at)\s+([A-Z][A-Za-z\s]+(?:University|College|Institute|School))",
    r"(Stanford|MIT|Harvard|Berkeley|Yale|Princeton|Cornell|Caltech|Carnegie\s+Mellon|Columbia)",
]
SKILLS = [r"expertise\s+in\s+([^,.]+)", r"specializes?\s+in\s+([^,.]+)", r"known\s+for\s+([^,.]+)"]
COMPANY_PAGES = ["https://www.linkedin.com/company/", "https://www.crunchbase.com/organization/"]
PERSON_SEARCH = "https://www.linkedin.com/search/results/people/?keywords="
