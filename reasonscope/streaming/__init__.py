"""Applying rules and a fitted model to streaming DataFrames."""

from reasonscope.streaming.classify import classify_stream  # noqa: F401
