"""Spark jobs for the data work behind large image-localization runs."""

from panelflow.session import build_session

__all__ = ["build_session"]
