"""Model schemas, enumerations and the fixed values the pipeline must honour.

Everything under "Fixed values" has to equal the behaviour being matched
(labels, defaults, keyword lists, patterns); it is stated here once, in
natural order, and imported by the operators.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

# Posting status axis and processing axis (independent of each other).
STATUSES = ["FETCHED", "SCORED", "APPROVED", "APPLIED", "INTERVIEWING", "REJECTED", "HIRED"]
PROCESSING_STATES = ["IDLE", "QUEUED", "PROCESSING"]

# Board columns: position, column id, label, status shown.  The labels trail
# the status by one step (APPROVED is shown as "Applied"); this is kept.
BOARD_COLUMNS = [
    (1, "discovery", "New Matches", "FETCHED"),
    (2, "scored", "Scored", "SCORED"),
    (3, "applied", "Applied", "APPROVED"),
    (4, "interviewing", "Interviewing", "APPLIED"),
]
BOARD_LOCATION = "Location Unspecified"
PREVIEW_CHARS = 100
INBOX_CAP = 50

# Feed normalisation defaults.
INGEST_DEFAULTS = {"refnr": "", "titel": "Unknown Title", "arbeitgeber": "Unknown Company", "hashId": ""}
SCAN_DEFAULTS = {"titel": "Unknown Title", "arbeitgeber": "Unknown Employer", "ort": ""}
IMPORT_DEFAULTS = {"title": "Unknown Title", "company": "Unknown Employer", "description": ""}
INGEST_KEYWORD = "Java Developer"
SCAN_KEYWORD = "Java"
PORTAL_BASE = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"

# Profile defaults.
DEFAULT_MIN_MATCH_SCORE = 75
DEFAULT_MAX_JOB_AGE_DAYS = 30
DEFAULT_AI_MODEL = "llama3"
DEFAULT_PERSONA_NAME = "New Persona"
FALLBACK_SIGNATURE = "Mit freundlichen Grüßen,\nJohn Doe"

# Column limits of the posting table.
REFERENCE_MAX_LEN = 255
TITLE_MAX_LEN = 2000
COMPANY_MAX_LEN = 2000
EMAIL_MAX_LEN = 255
PORTAL_MAX_LEN = 2000

# Prompt assembly: text and CV are cut to this many characters + "...".
PROMPT_CUT = 4000
PROMPT_MISSING_TITLE = "die ausgeschriebene Stelle"
PROMPT_MISSING_COMPANY = "Ihr Unternehmen"

# Reply key aliases, in declared order (the first present alias wins).
SCORE_ALIASES = ["score", "matchScore", "match_score", "compatibility_score", "rating"]
LETTER_ALIASES = ["coverLetterMarkdown", "cover_letter_markdown", "coverLetter", "cover_letter", "letter"]
ANALYSIS_ALIASES = ["analysis", "reasoning", "matchAnalysis", "match_analysis", "explanation"]

# Error texts of reply extraction, and the failure classification patterns
# (tested in this order).
EMPTY_REPLY_ERROR = "LLM returned empty response"
NO_DELIMITER_ERROR = "No valid JSON object delimiters ({ }) found in LLM response"
FAIL_PATTERN_404 = "404"
FAIL_PATTERN_MODEL_MISSING = "model 'llama3' not found"
FAIL_PATTERN_NO_DELIMITERS = "No valid JSON object delimiters"
FAIL_PATTERN_OPEN = "OPEN"
# User-facing texts of the failure branch.
FAIL_TEXT_DOWNLOADING = ("The AI model ('llama3') is currently downloading in the background or unavailable. "
                         "First-time setup usually takes 5-10 minutes. Please wait and try again.")
FAIL_TEXT_INCOMPLETE = ("The AI model returned an incomplete response (likely due to hallucination or exceeding "
                        "context buffers). It has been gracefully deferred.")
FAIL_TEXT_DEFERRED = ("AI Matchmaking is deferred due to ongoing connection recovery. The system is "
                      "re-establishing model health (Circuit Breaker OPEN).")
FAIL_NOTE_PREFIX = "[System] AI Matchmaking Deferred — "
FAIL_ANALYSIS_PREFIX = "AI Matching deferred. Reason: "
PROGRESS_LABEL_FORMAT = "%s @ %s"          # title @ company
PROGRESS_START_FORMAT = "⏳ Scoring: %s"
PROGRESS_OK_FORMAT = "✓ %s — %s%% match"
PROGRESS_FAIL_FORMAT = "✗ %s — %s"

# Markup tags kept by the sanitiser (case-insensitive), 28 names.
ALLOWED_TAGS = [
    "p", "br", "b", "strong", "em", "i",
    "ul", "ol", "li",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "span", "div", "a", "hr", "pre", "code",
    "table", "tr", "td", "th", "thead", "tbody",
]

# Mail classification keywords (all compared lower-cased).
MAIL_GATE_WORDS = ["update", "status", "unfortunate", "rejection"]
MAIL_REJECT_ANY = ["unfortunately"]          # body or subject
MAIL_REJECT_BODY = ["other candidates"]      # body only
MAIL_INTERVIEW_ANY = ["interview"]           # body or subject
MAIL_INTERVIEW_BODY = ["next steps"]         # body only

# Score bands of the reply contract (upper bounds inclusive).
SCORE_BANDS = [("90-100", 90, 100), ("75-89", 75, 89), ("55-74", 55, 74),
               ("35-54", 35, 54), ("0-34", 0, 34)]

# Reply contract: letter words, analysis items, bullet prefix.
LETTER_MIN_WORDS = 200
LETTER_MAX_WORDS = 320
ANALYSIS_MIN_ITEMS = 3
ANALYSIS_MAX_ITEMS = 5
ANALYSIS_BULLET = "• "
LETTER_SUBJECT_PREFIX = "Betreff:"
LETTER_SALUTATION = "Sehr geehrte Damen und Herren,"
LETTER_CLOSING = "Mit freundlichen Grüßen"

# Circuit-breaker window settings.
BREAKER_WINDOW = 10
BREAKER_FAILURE_RATE = 80.0
BREAKER_SLOW_SECONDS = 180.0
BREAKER_SLOW_RATE = 100.0

# Progress event types.
PROGRESS_TYPES = ["start", "success", "error", "info"]

# Dispatch mail: subject, body opening, attachment names.
DISPATCH_SUBJECT = "Bewerbung als Software Engineer - Blue Card Profile"
DISPATCH_BODY_OPENING = "Sehr geehrte Damen und Herren,\n\nanbei erhalten Sie meine Bewerbungsunterlagen.\n\n"
CV_ATTACHMENT_NAME = "Lebenslauf.pdf"
LETTER_ATTACHMENT_NAME = "Anschreiben.pdf"

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

POSTING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("reference_id", T.StringType()),
    T.StructField("hash_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("match_score", T.IntegerType()),
    T.StructField("employer_email", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("ai_analysis", T.StringType()),
    T.StructField("portal_url", T.StringType()),
    T.StructField("scored_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

APPLICATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("cv_path", T.StringType()),
    T.StructField("letter_path", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

PROFILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("search_keyword", T.StringType()),
    T.StructField("system_prompt", T.StringType()),
    T.StructField("email_signature", T.StringType()),
    T.StructField("ai_model", T.StringType()),
    T.StructField("min_match_score", T.IntegerType()),
    T.StructField("max_job_age_days", T.IntegerType()),
])

PERSONA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("profile_id", T.StringType()),
    T.StructField("persona_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("prompt_override", T.StringType()),
    T.StructField("cv_path", T.StringType()),
    T.StructField("is_default", T.BooleanType()),
])

MESSAGE = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("mailbox", T.StringType()),
    T.StructField("from_addr", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("received_at", T.TimestampNTZType()),
])

ACTION = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("arg", T.StringType()),
])

REPLY = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("error", T.StringType()),
])

MEMORY = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
])

CALL = T.StructType([
    T.StructField("service", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("failed", T.BooleanType()),
    T.StructField("duration_s", T.DoubleType()),
])

RAW_SUMMARY = T.StructType([
    T.StructField("refnr", T.StringType()),
    T.StructField("hashId", T.StringType()),
    T.StructField("titel", T.StringType()),
    T.StructField("arbeitgeber", T.StringType()),
    T.StructField("arbeitsort", T.StructType([T.StructField("ort", T.StringType())])),
])

SEARCH_PAGE = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("stellenangebote", T.ArrayType(RAW_SUMMARY)),
])

RAW_DETAIL = T.StructType([
    T.StructField("refnr", T.StringType()),
    T.StructField("stellenbeschreibung", T.StringType()),
    T.StructField("taetigkeit", T.StringType()),
    T.StructField("anforderungen", T.StringType()),
    T.StructField("externeUrl", T.StringType()),
    T.StructField("kontakt", T.StructType([
        T.StructField("email", T.StringType()),
        T.StructField("angebotskontakt", T.StructType([T.StructField("email", T.StringType())])),
    ])),
])


def empty(spark, schema: T.StructType):
    """Empty typed frame (the neutral element of unions and overwrites)."""
    return spark.createDataFrame([], schema)

# Rejection memory: its sentence and its type.
REJECTION_MEMORY_FORMAT = "Rejection for %s at %s: %s"
REJECTION_MEMORY_TYPE = "rejection_learning"

# The answers of the bulk operations.
RESULT_TEXTS = {
    "score_all": "Queued %d jobs for AI scoring. Check the Activity Log for progress.",
    "score_none": "No unscored jobs found in your inbox.",
    "cancel_queue": "Queue drained — %d job(s) cancelled.",
    "scan": "Scraped %d new jobs",
}
