"""The line of a symbolic summary in one pass over a text.

The same parts as the column functions ``entity_codes``, ``topics``, ``key_sentence``, ``emotions`` and ``flags`` of
``text``, for whole tables: words are split once, and of the many stems only those are looked for that a word begins with.
"""

from __future__ import annotations

import collections
import heapq
import re

from memloom.functions import fixed

_RUNS = re.compile(r"[^\W_]+").findall
_CAPITALS = re.compile(r"\b[^\W\d_a-z]\w+").finditer
_SENTENCES = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+").split
_DIGIT = re.compile(r"\d").search
_NOT_ENTITIES = frozenset(w.lower() for w in fixed.NOT_ENTITIES)
_NOT_TOPICS = frozenset(fixed.NOT_TOPICS)
#: Letters at the head of a stem that is no single word.
_HEAD = re.compile(r"[^\W\d_]*").match


def _index():
    """Stems of one word by their first three letters, by their whole first word, and those that begin with no letter."""
    begin, whole, other = collections.defaultdict(list), collections.defaultdict(list), []
    lists = [*fixed.EMOTIONS.values(), *fixed.FLAGS.values(), *(w for _, w in fixed.SENTENCE_CUES)]
    for stem in dict.fromkeys(w for words in lists for w in words):
        head = _HEAD(stem)[0]
        if head == stem and len(stem) >= 3:
            begin[stem[:3]].append(stem)
        elif head and head != stem:
            whole[head].append(stem)
        else:
            other.append(stem)
    return dict(begin), dict(whole), other


_BEGIN, _WHOLE, _OTHER = _index()


def _begins(low: str, stem: str) -> bool:
    """Whether a stem stands where no letter precedes it."""
    at = low.find(stem)
    while at > 0 and low[at - 1].isalpha():
        at = low.find(stem, at + 1)
    return at >= 0


def _present(low: str, words) -> set[str]:
    """Stems that begin a word."""
    out = {s for s in _OTHER if _begins(low, s)}
    for w in words:
        if not w.isalpha():  # letters after digits begin a word too
            for part in "".join(c if c.isalpha() else " " for c in w).split():
                out.update(s for s in _BEGIN.get(part[:3], ()) if part.startswith(s))
                out.update(s for s in _WHOLE.get(part, ()) if _begins(low, s))
            continue
        got = _BEGIN.get(w[:3])
        if got:
            out.update([s for s in got if w.startswith(s)])
        if w in _WHOLE:
            out.update(s for s in _WHOLE[w] if _begins(low, s))
    return out


def _entities(text: str, most: int) -> list[str]:
    out: list[str] = []
    for m in _CAPITALS(text):
        w = m[0]
        if w[0].isupper() and w.isalpha() and w.lower() not in _NOT_ENTITIES:
            code = w[:3].upper()
            if code not in out:
                out.append(code)
                if len(out) == most:
                    break
    return out


def _quote(text: str, present: set[str]) -> str:
    cues = [(k, hit) for k, words in fixed.SENTENCE_CUES if (hit := [w for w in words if w in present])]
    best, top = "", 0
    for s in _SENTENCES(text.strip(" ")):
        s = s.strip(" ")
        if len(s) < 20:
            continue
        score = len(s)
        if cues:
            low = s.lower()
            score += sum(k for k, words in cues if any(_begins(low, w) for w in words))
        if score > top:
            best, top = s, score
    return best[:137] + "..." if len(best) > 140 else best


def line(text: str | None, most: int = 3) -> str:
    """Entities, topics, quote, emotions and flags of a text."""
    text = text or ""
    low = text.lower()
    words = collections.Counter(_RUNS(low))
    present = _present(low, words)
    common = heapq.nsmallest(most, ((-n, w) for w, n in words.items() if len(w) >= 4 and w not in _NOT_TOPICS and (w.isalpha() or not _DIGIT(w))))
    codes = [[c for c, stems in table.items() if not present.isdisjoint(stems)] if present else [] for table in (fixed.EMOTIONS, fixed.FLAGS)]
    quote = _quote(text, present).replace('"', "'")
    parts = ["0:" + ("+".join(_entities(text, most)) or "???"), "_".join(w for _, w in common) or "misc"]
    parts += [f'"{quote}"'] if quote else []
    parts += ["+".join(c) for c in (codes[0][:most], codes[1]) if c]
    return "|".join(parts)
