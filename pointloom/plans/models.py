"""What a model is, and how it gets to the tasks.

A model is a function ``xyz (N, 3) metres -> N labels``, or an object with
``load()`` and ``predict(xyz)``. An object may tell with ``context_buffer_m`` how
far it looks around a point. Objects are sent to the tasks unloaded; each worker
process loads one when the first group reaches it and keeps it for the groups
and tasks that follow, so weights are read once a worker and not once a tile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

import numpy as np


class LoadedModel(Protocol):
    def load(self) -> None: ...

    def predict(self, xyz: np.ndarray) -> np.ndarray: ...


Model = Callable[[np.ndarray], np.ndarray] | LoadedModel

# the model that this process has loaded, by the key that it was sent under
_held: dict[str, LoadedModel] = {}


class Sent:
    """Calls ``predict`` of a model that is loaded where and when it is first called."""

    def __init__(self, model: LoadedModel):
        self.model, self.key = model, uuid.uuid4().hex

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        if self.key not in _held:
            for other in _held.values():  # a worker holds one model at a time
                getattr(other, "unload", lambda: None)()
            _held.clear()
            self.model.load()
            _held[self.key] = self.model
        return _held[self.key].predict(xyz)


def sendable(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks, whatever kind of model it is."""
    return Sent(model) if hasattr(model, "predict") else model


def need_of(model: Model, need: float | None = None) -> float | None:
    """How far the model looks around a point: ``need`` if that is given, or what the model says."""
    return getattr(model, "context_buffer_m", None) if need is None else need
