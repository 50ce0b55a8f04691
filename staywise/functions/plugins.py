"""Plug-ins that run inside Python workers: built once per worker, never shipped as built."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle

_BUILT: dict[str, Callable] = {}


def factory_key(factory: Callable) -> str:
    """The same factory gives the same key, another one another key."""
    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def built_once(factory: Callable[[], Callable], key: str) -> Callable:
    """What ``factory`` builds; built at first use and kept for the life of the worker."""
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]
