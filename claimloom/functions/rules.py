"""The word lists, patterns and thresholds that the results rest on."""

# --- fixed values: stop lists, one for each job ---
SUGGEST_STOP = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "that", "this")
VERIFY_STOP = (*SUGGEST_STOP, "was", "were")
GRAPH_STOP = (*VERIFY_STOP, "is", "are", "do", "does", "did", "be", "been", "by", "with", "as", "at", "from")
DOCUMENT_STOP = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "that", "this", "these", "those", "is", "are", "was",
    "were", "be", "been", "being", "it", "its", "with", "from", "by", "as", "at", "into", "case", "court",
)
AUTHORITY_STOP = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "that", "this", "those", "these", "is", "are", "was",
    "were", "be", "been", "being", "it", "its", "as", "by", "with", "from", "at", "into", "their", "them", "they", "he",
    "she", "his", "her", "public", "schools", "school", "education", "court", "case",
)
NEGATIONS = ("not", "no", "never", "none", "without", "cannot", "can't", "didn't", "didnt", "won't", "wont")

# --- fixed values: markers ---
QUALIFIERS = ("always", "never", "all", "only", "entirely", "completely", "every", "none")
DOCUMENT_QUALIFIERS = ("always", "never", "all", "only", "must", "every", "none")
KNOWLEDGE = ("knew", "should have known", "understood", "aware", "intended")
CAUSATION = ("caused", "because", "due to", "resulted in", "led to")
NAME_STOP = (
    "page", "question", "answer", "court", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december", "january", "february",
)
VERBS = (
    "is", "are", "was", "were", "signed", "approved", "reviewed", "caused", "opened", "closed", "sent", "received",
    "emailed", "observed", "knew", "understood", "failed", "continued", "admitted", "explained",
)
CONTEXT_LABELS = ("from", "to", "cc", "bcc", "date", "sent", "subject", "re")

# --- fixed values: patterns, in the form that Java and RE2 share ---
TOKEN = "[a-z0-9']+"
QUOTED = r'"[^"\n]+"|“[^”\n]+”'
NAME = r"\b[A-Z][a-z]{2,}\b"
REPEATED = r"\b(always|repeatedly|routinely|ongoing|continued?|continues?|regularly|daily|weekly|monthly|every day|each day)\b"
DISCRETE = (
    r"\b(once|that day|one time|single|on\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
    r"|on\s+\d{1,2}/\d{1,2}/\d{2,4}|on\s+\d{4}-\d{2}-\d{2})\b"
)
INFERENCE = (
    r"\b(because|therefore|thus|so|suggest(s|ed|ing)?|show(s|ed|ing)?|demonstrat(es|ed|ing)?|impl(ies|ied|y)|likely"
    r"|appears?|knew|understood|intended|should have known)\b"
)
GLOSS = r",\s*(which|showing|suggesting|therefore|thus|so)\b|\b(and|but)\s+(therefore|thus|so)\b"
WEAK = (
    r"\bi\s+(do\s+not|don't|did\s+not|didn't)\s+(know|remember|recall)\b|\b(not sure|unsure)\b"
    r"|\b(cannot|can't)\s+(say|recall|remember)\b|\b(no recollection|do not recall whether|don't know whether)\b"
)
DECLARATION_CONTEXT = (
    r"\b(declare as follows|under penalty of perjury|foregoing is true|foregoing is true and correct|executed on|executed this)\b"
)
EXHIBIT_CONTEXT = (
    r"\b(true and correct copy|attached hereto|page intentionally left blank|marked as exhibit)\b|^exhibit\s+[a-z0-9._-]+$"
)
CASE_CITED = r"\bv\.\s+[A-Z]"
UNIVERSAL = r"\b(always|all|must)\b"

# --- fixed values: characters that upper case makes several of, and their capital form as one character (itself if there is none) ---
EXPANDED = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
EXPANDED_CAPITALS = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in EXPANDED)

# --- fixed values: limits ---
SUGGESTIONS = 5
WEAK_OVERLAP = 0.05
SNIPPET_CHARS = 220
TITLE_CHARS = 80
