"""What a Python worker keeps between tasks, of one operator at a time.

Workers are reused over stages; an operator that starts in one drops the caches of
the others, so they don't add up.
"""

from __future__ import annotations

from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


def only(name: str | None = None) -> None:
    """Drop all caches but that one."""
    for other, clear in _clear.items():
        if other != name:
            clear()
