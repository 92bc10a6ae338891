"""What installations plug in: embedders and language models. The defaults are deterministic and need no model."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]: ...

    def count_tokens(self, text: str) -> int: ...


class Llm(Protocol):
    def complete(self, prompt: str) -> str: ...


_WORDS = re.compile(r"\w+").findall
#: How many hashes of words a process keeps before it lets them go.
_MOST_HASHES = 1 << 18


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_HASHES:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return h


_hash = _Hashes().__getitem__


class HashingEmbedder:
    """Signed hashing of words into ``dim`` places, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        return self.matrix(texts).tolist()

    def matrix(self, texts: list[str]):
        """The vectors of ``embed`` as rows of an array."""
        import numpy as np

        hashes = [list(map(_hash, _WORDS(text.lower()))) for text in texts]
        h = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in hashes])
        at = row * self.dim + (h % np.uint64(self.dim)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * self.dim).astype(float).reshape(len(texts), self.dim)
        n = np.array([x**0.5 for x in (v * v).sum(1).tolist()]).reshape(-1, 1)  # sums of whole numbers, so exact
        return np.divide(v, n, out=v, where=n > 0)

    def count_tokens(self, text: str) -> int:
        return max(1, len(text) // 4)


class CannedLlm:
    """Replies from a table of prompt fragments; an empty reply otherwise."""

    def __init__(self, replies: dict[str, str] | None = None):
        self.replies = replies or {}

    def complete(self, prompt: str) -> str:
        return next((r for k, r in self.replies.items() if k in prompt), "")


def extract_json(text: str):
    """The first JSON value of a reply: fenced, or by balanced brackets; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in ([fenced[1]] if fenced else []) + [text[m.start() :] for m in re.finditer(r"[\[{]", text)]:
        try:
            return json.JSONDecoder().raw_decode(candidate.strip())[0]
        except ValueError:
            continue
    return None


def apply_edits(text: str, edits: list[dict]) -> str:
    """ADD, DELETE and REPLACE edits on the lines of a skill."""
    lines = text.split("\n")
    for e in edits:
        op, old, new = e.get("op", "").upper(), e.get("old", ""), e.get("new", "")
        if op == "ADD" and new:
            lines.append(new)
        elif op == "DELETE" and old in lines:
            lines.remove(old)
        elif op == "REPLACE" and old in lines:
            lines[lines.index(old)] = new
    return "\n".join(lines)
