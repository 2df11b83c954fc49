"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable

_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]):
    """What ``load`` returns, called once per worker process and name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]
