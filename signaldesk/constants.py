"""Word lists, weights and limits that results depend on."""

# --- fixed values: forms -------------------------------------------------
TARGET_FORMS = (
    "10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A",
    "40-F", "40-F/A", "6-K", "6-K/A", "8-K", "8-K/A",
)
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
FORM_BASE_SCORE = {"10-K": 95.0, "20-F": 95.0, "40-F": 95.0, "10-Q": 85.0, "8-K": 75.0, "6-K": 65.0}
FORM_BASE_QUEUE_DEFAULT = 50.0
FORM_BASE_PENDING_DEFAULT = 55.0
FORM_LIST_ORDER = ("10-K", "20-F", "40-F", "10-Q", "8-K", "6-K")

ITEM_TOPICS = {
    "1.01": "material-agreement",
    "1.02": "bankruptcy",
    "1.03": "mine-safety",
    "2.01": "acquisition-disposition",
    "2.02": "results-of-operations",
    "2.03": "creation-of-obligation",
    "2.04": "triggering-events",
    "2.05": "costs-exit-activities",
    "2.06": "material-impairments",
    "3.01": "delisting",
    "3.02": "unregistered-sales",
    "3.03": "material-modification-of-rights",
    "4.01": "auditor-change",
    "4.02": "non-reliance-on-financials",
    "5.01": "change-of-control",
    "5.02": "leadership-change",
    "5.03": "amendments-to-articles",
    "5.07": "shareholder-vote",
    "7.01": "regulation-fd",
    "8.01": "other-events",
    "9.01": "financial-statements-exhibits",
}
MATERIAL_ITEMS = ("1.01", "2.01", "2.02", "2.03", "3.02", "4.02", "5.02", "8.01")
PERIODIC_6K_WORDS = (
    "quarterly results", "quarterly report", "interim results", "interim report", "annual report",
    "financial results", "earnings release", "results for the quarter", "six months ended", "guidance",
    "approval", "partnership", "collaboration", "leadership", "financing",
)
MATERIAL_8K_WORDS = (
    "earnings", "guidance", "approval", "complete response letter", "partnership", "collaboration",
    "acquisition", "merger", "chief executive", "chief financial", "financing", "offering",
)

# --- fixed values: industry codes covered --------------------------------
COVERED_SIC = {
    "2833": "MEDICINAL CHEMICALS & BOTANICAL PRODUCTS",
    "2834": "PHARMACEUTICAL PREPARATIONS",
    "2835": "IN VITRO & IN VIVO DIAGNOSTIC SUBSTANCES",
    "2836": "BIOLOGICAL PRODUCTS, (NO DIAGNOSTIC SUBSTANCES)",
    "3841": "SURGICAL & MEDICAL INSTRUMENTS & APPARATUS",
    "3842": "ORTHOPEDIC, PROSTHETIC & SURGICAL APPLIANCES",
    "3844": "X-RAY APPARATUS & TUBES & RELATED IRRADIATION APPARATUS",
    "3845": "ELECTROMEDICAL & ELECTROTHERAPEUTIC APPARATUS",
}
REASON_LABELS = {
    "sic-allowlist": "Core life sciences SIC filter",
    "manual-allowlist": "Manual include override",
}

# --- fixed values: scoring words and weights -----------------------------
MATERIAL_WEIGHTS = {
    "approval": 1.0,
    "fda": 0.8,
    "phase 3": 0.9,
    "guidance": 0.8,
    "acquisition": 0.8,
    "manufacturing": 0.6,
    "warning letter": 0.9,
    "restructuring": 0.7,
    "layoff": 0.6,
    "commercial launch": 0.8,
}
HIGH_SIGNAL_EVENTS = (
    "results-of-operations", "earnings", "approval", "regulatory", "acquisition-disposition",
    "acquisition", "leadership-change", "material-agreement", "financing", "clinical-data",
)
FILING_OVERRIDE_EVENTS = (
    "results-of-operations", "acquisition-disposition", "leadership-change", "material-agreement", "regulatory",
)
NEWS_OVERRIDE_EVENTS = ("approval", "regulatory", "earnings", "acquisition", "leadership-change")
NEWS_FULL_TIER_EVENTS = ("approval", "regulatory", "earnings", "acquisition")
FILING_FULL_TIER_EVENTS = ("results-of-operations", "regulatory")
FILING_FULL_TIER_FORMS = ("10-K", "20-F", "40-F", "8-K")

# --- fixed values: news classification -----------------------------------
NEWS_EVENT_WORDS = {
    "approval": ("approval", "approves", "clearance", "authorized"),
    "regulatory": ("fda", "complete response letter", "crl", "warning letter", "advisory committee"),
    "earnings": ("earnings", "quarterly results", "annual results", "guidance", "results"),
    "financing": ("offering", "financing", "debt", "raise", "capital"),
    "clinical-data": ("phase 3", "phase 2", "topline", "trial data", "clinical data"),
    "material-agreement": ("partnership", "collaboration", "license", "licensing", "agreement"),
    "acquisition": ("acquisition", "merger", "buyout", "takeover"),
    "leadership-change": ("ceo", "cfo", "chief executive", "board", "chair", "appointed"),
    "manufacturing": ("manufacturing", "plant", "facility", "supply"),
}
TOPIC_EVENT_FALLBACK = {"clinical": "clinical-data", "regulatory": "regulatory", "finance": "earnings"}
TOPIC_WORDS = {
    "regulatory": ("fda", "approval", "clearance", "warning letter"),
    "manufacturing": ("plant", "manufacturing", "facility"),
    "clinical": ("trial", "phase 1", "phase 2", "phase 3", "study"),
    "m&a": ("acquisition", "merger", "deal"),
    "finance": ("earnings", "guidance", "financing", "layoff"),
}
PROMO_WORDS = ("webinar", "whitepaper", "sponsored", "advertisement")
REGULATOR_SOURCES = ("FDA Press Releases", "FDA Drug Approvals")
REGULATOR_HOST = "fda.gov"
OFFICIAL_FEED_WEIGHT = 0.98
STATIC_FEEDS = (
    ("Fierce Pharma", "https://www.fiercepharma.com/rss/xml", 0.95, ("pharma",)),
    ("Fierce Biotech", "https://www.fiercebiotech.com/rss/xml", 0.95, ("biotech", "medtech")),
    ("FDA Press Releases",
     "https://www.fda.gov/about-fda/contact-fda/stay-informed/rss-feeds/press-releases/rss.xml", 0.9, ("regulatory",)),
    ("STAT News", "https://www.statnews.com/feed/", 0.95, ("pharma", "biotech", "policy")),
    ("Endpoints News", "https://endpts.com/feed/", 0.92, ("biotech", "clinical-trials")),
    ("BioPharma Dive", "https://www.biopharmadive.com/feeds/news/", 0.90, ("pharma", "biotech")),
    ("GEN News", "https://www.genengnews.com/feed/", 0.85, ("biotech", "genomics")),
    ("FDA Drug Approvals", "https://www.fda.gov/drugs/drug-approvals-and-databases/rss.xml", 0.90,
     ("regulatory", "approvals")),
)
BUILTIN_IR_SOURCES = (
    ("LLY", "rss", "https://investor.lilly.com/rss/news-releases.xml"),
    ("ABBV", "rss", "https://investors.abbvie.com/rss/news-releases.xml"),
    ("GILD", "html_page", "https://investors.gilead.com/overview/default.aspx"),
    ("AMGN", "html_page", "https://investors.amgen.com/"),
    ("PFE", "html_page", "https://investors.pfizer.com/Investors/News/default.aspx"),
    ("MRNA", "html_page", "https://investors.modernatx.com/"),
)
ARTICLE_SITES = {
    "statnews.com": "entry-content",
    "endpts.com": "entry-content",
    "biopharmadive.com": "article-body",
    "genengnews.com": "entry-content",
}

# --- fixed values: trials --------------------------------------------------
PHASE_ORDER = (
    "Phase 3", "Phase 2/Phase 3", "Phase 2", "Phase 1/Phase 2",
    "Phase 1", "Early Phase 1", "Phase 4", "Not Applicable",
)
PHASE_BONUS = {
    "Phase 3": 25.0, "Phase 2/Phase 3": 22.0, "Phase 2": 18.0, "Phase 1/Phase 2": 14.0, "Phase 1": 10.0,
}
CURRENT_STATUSES = (
    "active, not recruiting", "available", "enrolling by invitation", "not yet recruiting", "recruiting",
)
LEGAL_SUFFIXES = (
    "ag", "co", "company", "companies", "corp", "corporation", "gmbh", "holding", "holdings", "inc",
    "incorporated", "kgaa", "limited", "llc", "lp", "ltd", "nv", "plc", "sa", "sarl", "se", "spa",
)

# --- fixed values: sections ------------------------------------------------
SECTION_ORDER = (
    "business", "risk_factors", "legal_proceedings", "md&a", "liquidity",
    "financial_statements", "subsequent_events",
)
# Tried in this order when only heading lines can be found.
SECTION_HEADING_WORDS = {
    "business": ("business", "our business", "overview"),
    "risk_factors": ("risk factors", "principal risks"),
    "md&a": ("management's discussion", "management discussion", "operating and financial review"),
    "financial_statements": ("financial statements", "consolidated statements", "balance sheets"),
    "legal_proceedings": ("legal proceedings", "litigation"),
    "liquidity": ("liquidity and capital resources", "capital resources"),
    "subsequent_events": ("subsequent events", "recent developments"),
}
METADATA_TOKENS = ("true", "false", "fy", "q1", "q2", "q3", "q4", "p3m", "p6m", "p9m", "p12m")

# --- fixed values: queue and budgets ----------------------------------------
QUEUE_STATUSES = ("pending", "failed", "stale")
MAX_ATTEMPTS = 3
FILING_BACKLOG_DAYS = 21
NEWS_BACKLOG_DAYS = 5
CATALYST_LOOKAHEAD_DAYS = 180
CATALYST_RECENT_DAYS = 90
POLL_ORIGIN = "sec_poll"
BUDGET_KINDS = ("filing", "news", "override", "diff", "digest")
DAILY_BUDGET_USD = 1.0
BUDGET_SHARES = {"filing": 0.25, "news": 0.45, "override": 0.10, "diff": 0.10, "digest": 0.10}
DAILY_LIMITS = {
    "filing": 16, "news": 38, "override": 8, "diff": 8, "digest": 2,
    "filing_full_ai": 4, "filing_short_ai": 12, "news_full_ai": 8, "news_short_ai": 30,
}
PRICES_PER_MILLION = (
    ("gpt-5.4", 2.50, 0.25, 15.00),
    ("gpt-5.4-mini", 0.75, 0.075, 4.50),
    ("gpt-5.4-nano", 0.20, 0.02, 1.25),
    ("gpt-5-mini", 0.25, 0.025, 2.00),
)
LOCAL_ZONE = "America/New_York"

# --- fixed values: rule-based summary ----------------------------------------
SUMMARY_FLAG_WORDS = {
    "risk_flags": ("Risk", ("risk", "warning", "litigation", "regulatory", "shortage", "delay")),
    "opportunity_flags": ("Opportunity", ("approval", "expansion", "growth", "launch", "positive", "partnership")),
    "material_changes": (
        "Detected", ("acquisition", "guidance", "trial", "restructuring", "financing", "manufacturing")),
}
SUMMARY_IMPORTANCE_WORDS = ("approval", "guidance", "restructuring", "trial", "earnings", "revenue")
