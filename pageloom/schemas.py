"""Schemas of the engine's tables; reads never infer."""

PAGES = "page_id bigint, url string, html string"
PAGES_FULL = PAGES + ", status int, content_type string, captured_at timestamp"
SEEDS = "seed_id bigint, seed string"
SITEMAPS = "url string, status int, content_type string, xml string"
ROBOTS = "origin string, status int, body string"
EXPORT = (
    "domain string, out_path string, format string, title string, url string, "
    "content string, content_sha1 string, captured_at timestamp"
)
EXPORT_KEYS = ("domain", "out_path", "format")
