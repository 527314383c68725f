"""Explicit schemas of the catalog, cue, candidate and log tables."""

MATERIALS = (
    "id string, kind string, ext string, name string, rel_path string, size bigint, sha256 string, tags array<string>, "
    "ai_tags array<string>, description string, source string, orig_name string, created_at timestamp, location string, "
    "external_path string, form string, topics array<string>, usage array<string>"
)
CUES = "track_id string, lang string, idx bigint, start_ms bigint, end_ms bigint, text string"
EVENT_LOG = "ts timestamp, kind string, duration_ms double, ok boolean, zero_hit boolean"
HISTORY = "ts timestamp, actor string, action string, target_id string, detail string"
FEEDBACK = "ts timestamp, action string, accepted boolean, note string, by string, lang string, orig_query string, translated_query string"
GOLD = "id string, source_lang string, source_text string, type string, context map<string,string>, references map<string,array<string>>"
CANDIDATE = (
    "platform string, video_id string, url string, title string, author string, author_id string, published_at double, views bigint, "
    "likes bigint, comments bigint, coins bigint, favorites bigint, shares bigint, duration_sec int, thumb_url string, description string"
)
STEP_EVENT = "job_id bigint, step_key bigint, event_id bigint, ts timestamp, status string"
LINE_EVENT = "video_id bigint, track bigint, ts timestamp, text string"
EXPORT_COLUMNS = [
    "id", "kind", "ext", "name", "size", "sha256", "tags", "ai_tags", "description", "source", "orig_name", "location", "external_path", "created_at",
]
