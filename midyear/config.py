"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    """Limits of one run.

    ``page_limit`` admits ``page_limit + 1`` link pages per site and year, since
    the count is compared before it grows. ``depth`` is the deepest link level.
    ``strict_status`` turns link pages that did not answer 200 into errors
    instead of storing their bodies. ``broadcast_bytes`` bounds the sets
    of URLs that may be broadcast; larger ones are joined by shuffle.
    """

    attempts: int = 3
    page_limit: int = 20
    depth: int = 1
    year_range: int = 1
    strict_status: bool = False
    broadcast_bytes: int = 32 << 20

    def __post_init__(self) -> None:
        if self.attempts < 1:
            raise ValueError("attempts must be at least 1")
        if self.page_limit < 0 or self.depth < 0 or self.year_range < 0:
            raise ValueError("page_limit, depth and year_range cannot be negative")
