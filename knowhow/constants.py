"""Enumerations, weights and cut-offs that results depend on."""

# Role weights and the three levels a caller may choose from.
ROLE_WEIGHT = {"proposer": 1.0, "poster": 1.0, "lead": 1.0, "member": 0.6, "owner": 0.3}
ROLE_LEVEL_WEIGHT = {"low": 0.3, "normal": 0.6, "high": 1.0}
DEFAULT_ROLE_LEVEL = {"proposer": "high", "poster": "high", "lead": "high", "member": "normal", "owner": "low"}

# Search.
RRF_K = 60
LIST_SIZE = 100
W_FTS = 0.5
BETA = 0.3
TOP_N = 5
VEC_MIN = 0.50
FTS_MIN = 8.0
PROFILE_TOP = 50
TODAY_YEAR = 2026
PLANNED_DISCOUNT = 0.8
BM25_K1 = 1.5
BM25_B = 0.75

# Similar people.
SIMILAR_MIN = 0.5
SIMILAR_TOP = 5
SAME_DEPT_FACTOR = 0.3
OVERLAP_BOOST = 0.0

# People network: what each level of organisational closeness counts for (0 = worked together).
LEVEL_STRENGTH = [1.0, 0.8, 0.5, 0.3, 0.1, 0.0]
NETWORK_T = 0.5
NETWORK_RANGE = 2
NETWORK_TOP = 10
PAIR_MIN = 0.25
SURPRISE_PROFILE_MIN = 0.6
SURPRISE_THEME_MAX = 0.15

# Themes.
THEME_K = 80
UNIQUE_CUT = 0.10
GAP_MIN_DOCS = 8
GAP_MAX_RATE = 0.15
SUCCESSOR_POOL = 30
SUCCESSOR_TOP = 3

# Profiles.
NOTE_CHARS = 300
PROFILE_CHARS = 6000
MEMO_CHARS = 1000
TAG_N = 5
TAG_MAX_DF = 0.05
NOTE_ROLES = {
    "proposal": ["problem", "action_plan"],
    "idea": ["problem", "action_plan"],
    "project": ["purpose", "action", "outcome"],
}

# Generated-text checks.
BRIEF_MAX_ITEMS = 3
BRIEF_MAX_TEXT = 160
BRIEF_DOCS = 3
BRIEF_DOC_CHARS = 1200

# Document states.
RESULTS = ["accepted", "rejected", "on_hold", "in_review"]
PJ_STATUSES = ["done", "running", "cancelled", "planned"]
PROPOSAL_AREAS = ["efficiency", "cost", "delivery", "safety", "quality", "other"]
DOC_CATEGORY = {"proposal": "1-4", "project": "2-1", "idea": "7-5"}
DOC_PREFIX = {"proposal": "KZ-", "project": "PJ-", "idea": "IDEA-"}
AUTHOR_ROLES = {"proposal": ["proposer"], "project": ["owner", "lead", "member"], "idea": ["poster"]}

# Length limits.
MAX_TITLE = 200
MAX_SOURCE_FILE = 255
MAX_REASON = 500
MAX_SECTION_NAME = 50
MAX_BODY = 5000
SHORT_BODY = 30

# Embedding cost estimate: tokens per character and price per million tokens.
TOKENS_PER_CHAR = 1.5
USD_PER_MTOKEN = 0.02

# Clustering analyses.
ANALYSES = {
    "duplicate": {"roles": ["action_plan", "purpose", "action"], "min_docs": 2, "min_depts": None},
    "issue": {"roles": ["problem"], "min_docs": 4, "min_depts": 2},
}

# Nouns that carry no meaning alone (fixed word list).
STOPWORDS = [
    "こと", "もの", "ため", "よう", "これ", "それ", "あれ", "ここ", "そこ", "とき",
    "場合", "際", "等", "方", "点", "中", "上", "下", "前", "後", "他", "以上", "以下",
    "今回", "今後", "現在", "全体", "一部", "それぞれ", "ほか",
]
# Words of the profile layout itself; never reported as common ground (fixed word list, in our codes).
FORM_WORDS = [
    "tag", "ambition", "execution", "proposal", "proposer", "time", "excerpt", "summary", "self", "career",
    "current_job", "future_wish", "effort", "charge", "lead", "member", "owner", "poster", "document",
]
# Generic place words that department names are made of (fixed word list, in our codes).
PLACE_WORDS = ["plant", "branch", "office", "hq"]
