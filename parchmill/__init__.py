"""Web pages to a clean Markdown corpus, as Spark jobs."""

from parchmill.session import build_session, prepare

__all__ = ["build_session", "prepare"]
