"""Record types, closed value sets and settings of the catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Closed enums of the data model.
ACCOUNT_KINDS = ("slack", "google", "microsoft", "imap", "local", "web")
SOURCE_KINDS = (
    "slack.thread", "slack.day", "google.meet", "google.doc", "microsoft.file",
    "mail.message", "mail.thread", "web.page", "local.file",
)
ACCOUNT_KIND_OF = {
    "slack.thread": "slack", "slack.day": "slack", "google.meet": "google", "google.doc": "google",
    "microsoft.file": "microsoft", "mail.message": "imap", "mail.thread": "imap",
    "web.page": "web", "local.file": "local",
}
SECTION_POSITION = {"background": 0, "overview": 1, "decisions": 2, "action_items": 3, "details": 4}
ORIGIN_RANK = {"generated": 1, "extracted": 2, "user": 3}
RAW_ROLES = ("primary", "notes", "transcript", "attachment", "extracted_text")
RAW_STATUS = ("present", "missing", "fetch_failed")
SUMMARY_STATUS = ("none", "pending", "done", "skipped", "failed")
LINK_STATUS = ("pending", "ingested", "unavailable", "abandoned", "not_applicable", "duplicate")
GENERATOR_KINDS = ("llm_api", "llm_cli", "local_llm", "source_native", "unknown")
ITEM_KINDS = ("decision", "action", "resolved", "question", "accomplishment")
CLOSURE_KINDS = ("resolved", "accomplishment", "decision")
EFFECTIVE_STATUS = ("open", "done", "dropped", "answered", "superseded")
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
ITEM_PROMPTS = ("conversation-summary/v2", "meeting-summary/v2", "document-summary/v4")
NOISE_SUBTYPES = ("channel_join", "channel_leave", "thread_broadcast", "group_join", "group_leave")
BROADCASTS = ("<!channel>", "<!here>", "<!everyone>")
BUILTIN_EXCLUDES = ("~$*", ".~lock.*", "Thumbs.db", ".DS_Store", "desktop.ini")
LINK_BACKOFF_DAYS = (1, 3, 7, 14, 30)


@dataclass(frozen=True)
class Settings:
    """Parameters of the jobs with their default values."""

    item_min_confidence: str = "medium"
    items_max_per_entry: int = 30
    stale_days: int = 30
    candidate_days: int = 60
    candidate_min_similarity: float = 0.2
    link_min_confidence: str = "medium"
    min_evidence_chars: int = 6
    max_evidence_chars: int = 200
    max_actors: int = 10
    summary_min_chars: int = 400
    summary_min_messages: int = 3
    min_chars_by_kind: dict[str, int] = field(default_factory=dict)
    summary_max_attempts: int = 3
    max_input_chars: int = 40_000
    estimated_output_tokens: int = 700
    prompt_overhead_tokens: int = 400
    weekly_cap_usd: float | None = 2.0
    monthly_cap_usd: float | None = 10.0
    budget_timezone: str = "UTC"
    day_timezone: str = "UTC"
    overlap_secs: int = 300
    initial_days: int = 30
    window_days: int = 7
    thread_hot_days: int = 7
    thread_watch_days: int = 45
    dormant_days: int = 30
    calendar_overlap_days: int = 3
    queue_max_attempts: int = 5
    links_max_per_run: int = 50
    links_max_attempts: int = 6
    snippet_chars: int = 80
    details_excerpt_chars: int = 400
    doc_max_chars: int = 300_000
    folder_max_depth: int = 8
    folder_path_chars: int = 300


DEFAULTS = Settings()

SECTION = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("text", T.StringType())]
)

IMPORT_RECORD = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("source_created_at", T.StringType()),
        T.StructField("source_updated_at", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("sections", T.ArrayType(SECTION)),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("generator_kind", T.StringType()),
                    T.StructField("provider", T.StringType()),
                    T.StructField("model", T.StringType()),
                    T.StructField("prompt_version", T.StringType()),
                    T.StructField("generated_at", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "raw",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("role", T.StringType()),
                        T.StructField("path", T.StringType()),
                        T.StructField("media_type", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

ITEM_DRAFT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("kind", "text", "owner", "requester", "due", "status", "actors", "confidence", "evidence")
    ]
)

MESSAGE_BODY = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("thread_ts", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("latest_reply", T.StringType()),
        T.StructField("bot_profile", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField(
            "user_profile",
            T.StructType(
                [T.StructField(n, T.StringType()) for n in ("name", "display_name", "real_name", "first_name")]
            ),
        ),
        T.StructField("blocks", T.StringType()),
        T.StructField(
            "attachments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in ("title", "text", "fallback", "title_link", "from_url", "original_url")
                    ]
                )
            ),
        ),
        T.StructField(
            "files",
            T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])),
        ),
    ]
)
