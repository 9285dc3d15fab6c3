"""Options of a harvest. Defaults are those of the documented command line."""

from __future__ import annotations

from dataclasses import dataclass

FORMATS = ("md", "json", "txt", "html")


@dataclass(frozen=True)
class HarvestConfig:
    max_pages: int | None = 10_000  # saved pages per seed, crawl route only; None = no limit
    depth: int = 0  # 0 = unlimited
    include: str | None = None  # Java regex, searched in the URL
    exclude: str | None = None
    sitemap: bool = False  # try sitemaps; include/exclude switch that off
    crawl_without_sitemap: bool = True  # what to do with seeds lacking one
    sitemap_robots: bool = False  # the sitemap route ignores robots by default
    sitemap_patterns: bool = False  # ... and include/exclude
    distinct_sitemap_urls: bool = True
    format: str = "md"
    lang: str = ""  # keep URLs whose first path segment is this
    save_html: bool = False  # keep the raw page next to its export
    agent: str = "*"  # name looked up in robots rules
    robots_missing: bool = True  # verdict for an origin without robots row
    seen_filter: int = 0  # words of the filter that spares look-ups of seen URLs; 0 = none

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, not {self.format!r}")
        if (self.max_pages is not None and self.max_pages < 1) or self.depth < 0:
            raise ValueError("max_pages must be positive and depth not negative")
