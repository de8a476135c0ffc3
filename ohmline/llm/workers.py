"""What a Python worker makes once and keeps for all its tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import Broadcast, SparkContext

from ohmline.shared import ship

ship(__name__)


def share(context: SparkContext, value: Any) -> Broadcast:
    """``value`` for :func:`once`."""
    return context.broadcast([value])


def once(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """``make`` of the shared value: made by the first task of a worker and kept beside the value, which a worker loads once."""
    kept = shared.value
    if len(kept) == 1:
        kept.append(make(kept[0]))
    return kept[1]
