"""Streaming versions: event-time windows with watermarks, stateful count windows and latest values."""

from __future__ import annotations

from .windows import count_or_timeout, combine_latest, counted, keep_latest, sort_batches, timed

__all__ = ["combine_latest", "count_or_timeout", "counted", "keep_latest", "sort_batches", "timed"]
