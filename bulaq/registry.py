"""Named factories: chunkers, embedders, stores, readers and writers are looked up here."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Name to factory; a later registration of a name replaces the earlier one."""

    def __init__(self, kind: str):
        self.kind = kind
        self._of: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable) -> None:
        if not callable(factory):
            raise TypeError(f"the factory of {self.kind} {name!r} must be callable")
        self._of[name] = factory

    def create(self, name: str, *args, **options):
        return self.get(name)(*args, **options)

    def get(self, name: str) -> Callable:
        if name not in self._of:
            raise KeyError(f"no {self.kind} {name!r}; available: {self.names()}")
        return self._of[name]

    def names(self) -> list[str]:
        return sorted(self._of)

    def __contains__(self, name: str) -> bool:
        return name in self._of
