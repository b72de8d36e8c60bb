"""A bounded memory of made values."""

from __future__ import annotations


class Memo:
    """A dict in two halves. ``young`` is looked up directly; when it is full it becomes the old half and the former
    old half is forgotten. What is still in use is taken over from the old half by ``recall``."""

    def __init__(self, size: int) -> None:
        self.half = max(1, size // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.half:
            self.old = dict(self.young)
            self.young.clear()  # the same dict stays in use, so bound methods of it hold
        self.young[key] = value

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        return self.recall(key) if value is None else value
