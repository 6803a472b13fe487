"""What a Python worker remembers between tasks.

Workers are used again by later stages, of other operators too. Each operator's memory (encoded words, word hashes,
automaton states) is bounded, and only the last one asked for is kept, so that a chain of operators needs no more memory
than the largest of them.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    """The worker's memory of this key, made anew, and any other forgotten, where another key was the last."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]
