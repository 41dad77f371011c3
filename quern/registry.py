"""Named factories, without global discovery."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str):
        self.kind = kind
        self._makers: dict[str, Callable[..., T]] = {}

    def register(self, name: str, maker: Callable[..., T]) -> None:
        if name in self._makers:
            raise ValueError(f"{self.kind} {name!r} is already registered")
        self._makers[name] = maker

    def create(self, name: str, *args, **kwargs) -> T:
        if name not in self._makers:
            raise ValueError(f"unknown {self.kind} {name!r}")
        return self._makers[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._makers)
