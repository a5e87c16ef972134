"""What a worker loads once and keeps: models and measurers, each under a name made of what it is."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle

Loaded = TypeVar("Loaded")
#: So many stay in a worker; the one not used for longest goes first.
MOST = 2
_LOADED: OrderedDict[str, object] = OrderedDict()


def name_of(factory: Callable[[], Loaded]) -> str:
    """A name for what a factory makes: a hash of all that is sent to a worker for it, so that another factory never has the same one, and the same
    one is found again by later calls."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def loaded(name: str, factory: Callable[[], Loaded]) -> Loaded:
    if name not in _LOADED:
        while len(_LOADED) >= MOST:
            _LOADED.popitem(last=False)
        _LOADED[name] = factory()
    _LOADED.move_to_end(name)
    return _LOADED[name]
