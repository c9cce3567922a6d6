"""Checks of what callers ask for, before anything is searched."""

from __future__ import annotations

MOST_RESULTS, MOST_TERMS = 50, 100


class ArgumentError(ValueError):
    """An argument that cannot be served."""


def query(text: str | None) -> str:
    found = (text or "").strip()
    if not found:
        raise ArgumentError("the query must not be blank")
    return found


def number(value: str | int | None, default: int, least: int, most: int, name: str) -> int:
    """A whole number within bounds; no value is the default."""
    if value is None or value == "":
        return default
    try:
        found = int(value)
    except (TypeError, ValueError):
        raise ArgumentError(f"{name} must be a whole number") from None
    if not least <= found <= most:
        raise ArgumentError(f"{name} must be between {least} and {most}")
    return found


def clamped(value: int | None, default: int, least: int, most: int, name: str) -> int:
    """As :func:`number`, but what is above the upper bound is brought down to it."""
    if isinstance(value, bool) or (value is not None and not isinstance(value, int)):
        raise ArgumentError(f"{name} must be a whole number")
    return number(min(value, most) if value is not None else None, default, least, most, name)


def address(url: str | None) -> str:
    found = (url or "").strip()
    if not found.lower().startswith(("http://", "https://")):
        raise ArgumentError(f"not an http(s) address: {found}")
    return found


def path(target: str | None) -> str:
    found = (target or "").strip()
    if not found or found.lower().startswith(("http://", "https://")):
        raise ArgumentError(f"not a path: {found}")
    return found
