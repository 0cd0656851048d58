"""What a Python worker makes once and keeps for the tasks of one call."""

from __future__ import annotations

import uuid
from collections.abc import Callable

_HELD: dict[str, object] = {}
_MOST = 2


def token() -> str:
    """A name for what the tasks of one call share."""
    return uuid.uuid4().hex


def once(name: str, make: Callable[[], object]):
    """What ``make`` gives, made once in this worker; older things are let go."""
    if name not in _HELD:
        while len(_HELD) >= _MOST:
            del _HELD[next(iter(_HELD))]
        _HELD[name] = make()
    return _HELD[name]
