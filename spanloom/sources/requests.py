"""Requests for transcription: what they may hold, and the states of a job."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from math import isfinite

from spanloom.sources.store import Store

#: Limits of a request: fixed values of the interface.
MOST_TERMS, LONGEST_TERM, LONGEST_CONTEXT, SPEAKERS = 500, 150, 20_000, 8
#: From which states a job may be taken up again or given up.
RETRIED_FROM = ("failed", "interrupted", "cancelled")
CANCELLED_FROM = ("queued", "running", "interrupted", "failed")


def errors(profile: str, profiles: Collection[str], terms: Sequence[object] | None = None, context: str = "", speaker: object = None, limit_seconds: float | None = None) -> list[str]:
    """What is wrong with a request; empty if nothing is."""
    good = lambda t: isinstance(t, str) and bool(t.strip()) and len(t) <= LONGEST_TERM
    checks = (
        (profile in profiles, "unknown profile"),
        (terms is None or len(terms) <= MOST_TERMS and all(map(good, terms)), f"terms must be up to {MOST_TERMS} texts of 1 to {LONGEST_TERM} characters"),
        (speaker is None or type(speaker) is int and 0 <= speaker < SPEAKERS, f"speaker must be 0 to {SPEAKERS - 1}"),
        (limit_seconds is None or isfinite(limit_seconds) and limit_seconds >= 1, "a preview takes one second at least"),
        (len(context) <= LONGEST_CONTEXT, f"context may have {LONGEST_CONTEXT} characters"),
    )
    return [what for fine, what in checks if not fine]


def start(store: Store, audio_path: str, profile: str, profiles: Collection[str], **options) -> tuple[str, bool]:
    """(job, whether it is new) of a checked request; terms are sorted and distinct, so that their order makes no other job."""
    wrong = errors(profile, profiles, **options)
    if wrong:
        raise ValueError("; ".join(wrong))
    terms = options.get("terms")
    return store.create({"audio_path": audio_path, "profile": profile, **options, "terms": sorted(set(terms)) if terms is not None else None})


def _move(store: Store, job: str, allowed: Sequence[str], status: str) -> None:
    if store.state(job)["status"] not in allowed:
        raise ValueError(f"only jobs that are {', '.join(allowed)} can become {status}")
    store.set_state(job, status=status, error=None)


def retry(store: Store, job: str) -> None:
    _move(store, job, RETRIED_FROM, "queued")


def cancel(store: Store, job: str) -> None:
    _move(store, job, CANCELLED_FROM, "cancelled")
