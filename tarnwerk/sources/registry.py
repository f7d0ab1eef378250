"""Named fetchers of object bytes: callables from (base, hash) to bytes."""

from __future__ import annotations

from collections.abc import Callable

_fetchers: dict[str, Callable[[str, str], bytes]] = {}


def register(name: str, fetch: Callable[[str, str], bytes]) -> None:
    if name in _fetchers:
        raise KeyError(f"a fetcher named {name} is there already")
    _fetchers[name] = fetch


def get(name: str) -> Callable[[str, str], bytes]:
    return _fetchers[name]


def names() -> list[str]:
    return sorted(_fetchers)
