"""Yearly text collections from archived web captures, as Spark jobs."""

from midyear.config import CrawlConfig
from midyear.session import build_session, cut_lineage

__all__ = ["CrawlConfig", "build_session", "cut_lineage"]
