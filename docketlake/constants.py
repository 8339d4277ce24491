"""Word lists, lookup tables, thresholds and patterns that results depend on."""

# --- tokenizing ------------------------------------------------------------
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he",
    "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with",
]
TOKEN_CAP = 200
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- chunking --------------------------------------------------------------
CHARS_PER_TOKEN = 4
TARGET_TOKENS = 256
JUDGMENT_TARGET_TOKENS = 512
OVERLAP_RATIO = 0.15
MIN_TOKENS = 10
SPLIT_MAX_TOKENS = 7500
OVERSIZE_TOKENS = 8192

PARAGRAPH_BOILERPLATE = [
    "Download PDF", "Download DOCX", "Share", "Report a problem", "Document detail",
    "Related documents", "Sign up or Log in", "https://", "www.", ".html", ".pdf",
    "accessed on", "cite_note", "contents of #navigation", "data-offcanvas",
    "navigation-column", "navigation-content", "#",
]
MIN_PARAGRAPH_CHARS = 10
MIN_HEADNOTE_CHARS = 50

# --- document hierarchy: doc_type, authority_level, rank, scope, category ----
HIERARCHY = [
    ("constitution", "supreme", 1, "all_courts", "constitutional_law"),
    ("act", "high", 2, "national", "legislation"),
    ("ordinance", "medium", 3, "specific", "legislation"),
    ("si", "medium", 3, "specific", "legislation"),
]

COURT_CODES = {
    "zwcc": "Constitutional Court of Zimbabwe",
    "zwsc": "Supreme Court of Zimbabwe",
    "zwhc": "High Court of Zimbabwe (Harare)",
    "zwhhc": "High Court of Zimbabwe (Harare)",
    "zwbhc": "High Court of Zimbabwe (Bulawayo)",
    "zwchhc": "High Court of Zimbabwe (Chinhoyi)",
    "zwmthc": "High Court of Zimbabwe (Mutare)",
    "zwmsvhc": "High Court of Zimbabwe (Masvingo)",
    "zwlc": "Labour Court of Zimbabwe",
}

COURT_NAMES = [
    "High Court of Zimbabwe",
    "Supreme Court of Zimbabwe",
    "Constitutional Court of Zimbabwe",
    "Magistrates Court",
    "Labour Court",
]

LANGUAGE_NAMES = {"eng": "English", "en": "English", "sna": "Shona", "ndc": "Ndebele"}

MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]

CONSTITUTION_PHRASES = [
    "constitution of zimbabwe",
    "constitutional provisions",
    "chapter 1: founding provisions",
    "chapter 2: citizenship",
    "chapter 4: human rights",
    "supreme law of zimbabwe",
]

BANNER_TITLES = ["Zimbabwe", "About this collection", "Contents"]

# vector table columns: name, maximum length, default
VECTOR_COLUMNS = [
    ("doc_type", 20, "unknown"),
    ("language", 10, "eng"),
    ("parent_doc_id", 64, ""),
    ("tree_node_id", 16, ""),
    ("nature", 32, ""),
    ("chapter", 16, ""),
    ("date_context", 32, ""),
    ("authority_level", 20, ""),
    ("binding_scope", 20, ""),
    ("subject_category", 30, ""),
]

# --- retrieval -------------------------------------------------------------
RRF_C = 60
RRF_WEIGHTS = {"dense": 0.6, "bm25": 0.4}
MIN_RERANK_SCORE = 0.3
DIVERSITY_SHARE = 0.4
CONTEXT_TOKENS = 8000
CONTEXT_TOKENS_PER_DOC = 500
CONTEXT_CHARS_PER_DOC = 2000
RERANK_TEXT_CHARS = 500
FALLBACK_TOP_K = 12
PREFETCH_TOP_K = 15

# complexity, candidates retrieved, results kept, cache seconds, answer tokens
COMPLEXITY = [
    ("simple", 15, 5, 7200, 800),
    ("moderate", 25, 8, 3600, 2500),
    ("complex", 40, 12, 1800, 5000),
    ("expert", 50, 15, 900, 8000),
]
DEFAULT_COMPLEXITY = "moderate"

AUTHORITY_TAGS = {
    "constitution": "[CONSTITUTIONAL AUTHORITY - Supreme Law, Binding on All]",
    "act": "[STATUTORY AUTHORITY - Acts of Parliament, Binding]",
    "si": "[REGULATORY AUTHORITY - Statutory Instrument, Binding if Intra Vires]",
    "case_constitutional": "[CONSTITUTIONAL COURT - Binding on All Courts]",
    "case_supreme": "[SUPREME COURT - Binding on High Court and Subordinate Courts]",
    "case_high": "[HIGH COURT - Binding on Magistrates Courts, Persuasive to Coordinate Benches]",
    "case_magistrate": "[MAGISTRATES COURT - Persuasive Authority Only]",
    "commentary": "[LEGAL COMMENTARY - Persuasive Academic/Professional Analysis]",
}
DEFAULT_AUTHORITY_TAG = "[LEGAL AUTHORITY]"

CACHE_THRESHOLD = 0.95

# --- answers and evaluation ------------------------------------------------
SENTENCE_WORDS = [
    "shall", "must", "may", "entitled", "liable", "penalty", "fine", "imprisonment",
    "court", "tribunal", "employer", "employee",
]
STRUCTURE_MARKERS = ["ISSUE", "RULE", "APPLICATION", "CONCLUSION", "1.", "2.", "3."]
LENGTH_MARKERS = ["##", "**", "1.", "2."]
TRANSITION_WORDS = ["therefore", "however", "furthermore", "consequently", "accordingly"]
CONSTITUTION_TERMS = [
    "Constitution", "constitutional", "Constitutional Court", "constitutional rights",
    "supreme law", "supreme court", "constitutional supremacy", "hierarchy", "(Source:",
]

# price per 1000 tokens: model, input, output
TOKEN_PRICES = [
    ("gpt-3.5-turbo", 0.0015, 0.002),
    ("gpt-5-mini", 0.00015, 0.0006),
]
DEFAULT_PRICE_MODEL = "gpt-3.5-turbo"

QUALITY_WEIGHTS = {"attribution": 0.3, "coherence": 0.3, "relevance": 0.2, "citation_density": 0.2}
COHERENCE_SCORES = {"excellent": 95, "good": 85, "acceptable": 75, "poor": 50, "unacceptable": 25}
GRADES = [(90, "A+"), (85, "A"), (80, "B+"), (75, "B"), (70, "C+"), (65, "C")]

# --- request limits --------------------------------------------------------
QUERY_LIMIT = (10, 60)
STRICT_LIMIT = (5, 60)
SIGNUP_LIMITS = [(2, 60), (5, 3600)]
BAN_SECONDS = 3600
MAX_DOCUMENT_BYTES = 50_000_000
KEY_PREFIXES = ["sources/", "corpus/docs/"]
