"""Text expressions: Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

import collections
import functools
import heapq
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions import fixed

#: Letters folded to ASCII, one to one (fixed values).
FOLD_FROM = "åäàáâãÅÄÀÁÂÃöòóôõÖÒÓÔÕéèêëÉÈÊËíìîïÍÌÎÏúùûüÚÙÛÜýÿÝøØçÇñÑšŠžŽðÐłŁ"
FOLD_TO = "aaaaaaAAAAAAoooooOOOOOeeeeEEEEiiiiIIIIuuuuUUUUyyYoOcCnNsSzZdDlL"
#: Letters folded to two (fixed values).
FOLD_PAIRS = (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"), ("þ", "th"), ("Þ", "Th"))
#: Letters that lose an accent in search keys, but stay single (fixed values).
ACCENT_FROM, ACCENT_TO = "åäàáâãöòóôõéèêëíìîïúùûüýÿçñšž", "aaaaaaoooooeeeeiiiiuuuuyycnsz"

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def word_pattern(alternatives: str) -> str:
    """Whole words in any script; both engines' notions of a word boundary are avoided."""
    return f"{_BEFORE}(?:{alternatives}){_AFTER}"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def fold_ascii(x: Column) -> Column:
    """Nordic and European letters as ASCII; other letters stay."""
    x = F.translate(x, FOLD_FROM, FOLD_TO)
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), FOLD_PAIRS, x)


def strip_accents(x: Column) -> Column:
    """Lower case without accents (letters such as æ and ß stay)."""
    return F.translate(F.lower(x), ACCENT_FROM, ACCENT_TO)


def _printable(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x20-\x7E]+", "")


def canonical_name(x: Column) -> Column:
    """Key of an entity: lower case, no blanks, hyphens or underscores, ASCII."""
    return _printable(fold_ascii(F.regexp_replace(F.lower(x), r"[\s\-_]+", "")))


def normal_predicate(x: Column) -> Column:
    return _printable(fold_ascii(F.regexp_replace(F.lower(F.trim(x)), r"[\s\-]+", "_")))


def short_hash(*parts: Column, sep: str = "|") -> Column:
    """First 16 hex digits of SHA-256: the id of content-addressed rows."""
    x = parts[0] if len(parts) == 1 else F.concat_ws(sep, *parts)
    return F.left(F.sha2(x, 256), F.lit(16))


#: A letter of an index term.
TERM_LETTERS = r"[a-z0-9_\x{80}-\x{10FFFF}]"


def tokens(x: Column, pattern: str = r"[^a-z0-9_\x{80}-\x{10FFFF}]+") -> Column:
    """Index terms: lower case, split at everything but letters, digits and underscore."""
    return F.filter(F.split(F.lower(x), pattern), lambda t: t != "")


def query_terms(x: Column) -> Column:
    """Distinct terms of a question: three letters or more, no stop words."""
    stop = F.array(*[F.lit(w) for w in fixed.QUERY_STOP_WORDS])
    parts = F.split(F.lower(x), r"[\s\p{P}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def slug(x: Column) -> Column:
    """Path of lower-case ASCII segments joined by hyphens; null if nothing is left."""
    s = F.regexp_replace(F.lower(F.regexp_replace(x, r"^[^\x21-\x7E]+|[^\x21-\x7E]+$", "")), r"[_\s]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-/]", ""), r"-{2,}", "-")
    parts = F.filter(F.transform(F.split(s, "/"), lambda p: F.regexp_replace(p, r"^-+|-+$", "")), lambda p: p != "")
    out = F.array_join(parts, "/")
    return F.when(out != "", out)


def room_of_path(path: Column) -> Column:
    """Room named by the first matching part of a path, ``source`` if none."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    rules = [(f"/{r}/", room) for room, r in fixed_rooms()] + [(s, "tests") for s in (".test.", ".spec.", "/specs/")]
    out = F.lit("source")
    for part, room in reversed(rules):
        out = F.when(p.contains(part), room).otherwise(out)
    return out


def fixed_rooms():
    """(room, path part) in order of precedence (fixed values)."""
    for room, single in (
        ("controllers", "controller"), ("services", "service"), ("models", "model"), ("migrations", "migration"),
        ("helpers", "helper"), ("repositories", "repository"), ("handlers", None), ("middleware", None), ("tests", None),
    ):
        yield room, room
        if single:
            yield room, single


def hall_of_text(text: Column, halls: dict | None = None) -> Column:
    """The hall of the most keyword hits in the first 5000 characters (the detector's own limit), the first of equals; ``general`` without any.

    Words are split once, and only those that begin like a keyword are looked at further.
    """
    halls = {h: [(w[1:], True) if w[0] == "=" else (w, len(w) <= 3) for w in dict.fromkeys(words)] for h, words in (halls or fixed.HALLS).items() if words}
    single = sorted({w[:3] for words in halls.values() for w, _ in words if w.isalnum()})

    def hits(t: Column, word: str, whole: bool) -> Column:
        return count(t, r"(?<![\p{L}\p{N}])" + re.escape(word) + (r"(?![\p{L}\p{N}])" if whole else ""))

    def best(s: Column) -> Column:
        scored = [
            F.struct(sum((hits(s["few"] if w.isalnum() else s["all"], w, whole) for w, whole in words), F.lit(0)).cast("int").alias("s"), F.lit(-i).alias("o"), F.lit(h).alias("h"))
            for i, (h, words) in enumerate(halls.items())
        ]
        return F.array_max(F.array(*scored))

    low = F.lower(F.substring(text, 1, 5000))
    few = F.array_join(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: F.substring(w, 1, 3).isin(single)), " ")
    # Bound to a lambda variable, so that the words are split once and not for every keyword.
    found = F.transform(F.array(F.struct(few.alias("few"), low.alias("all"))), best)
    return F.get(F.transform(found, lambda f: F.when(f["s"] > 0, f["h"]).otherwise("general")), F.lit(0))


#: Cue words of the importance score (fixed values).
DECISIONS = "decided|chose|must|will|because|therefore|critical|important|essential|mandatory|required|blocker|urgent|resolved|agreed"
RELATIONS = "is|are|was|were|has|have|uses|depends|requires|provides|implements"
NUMBER = _BEFORE + r"\d+(?:\.\d+)?" + _AFTER


def importance(text: Column, names: list[str] | None = None) -> Column:
    """Heuristic salience in 0..1: decisions, entities, numbers, length band and relations."""
    parts = F.filter(F.split(text, " "), lambda t: t != "")
    size = F.length(text)
    named = sum((F.lower(text).contains(n).cast("int") for n in names), F.lit(0)) if names else F.lit(0)
    score = (
        F.least(F.lit(0.30), count(text, "(?i)" + word_pattern(DECISIONS)) * 0.06)
        + F.least(F.lit(0.20), named * 0.05)
        + F.when(F.size(parts) == 0, 0.0).otherwise(F.least(F.lit(0.15), count(text, NUMBER) / F.greatest(F.size(parts), F.lit(1)) * 1.5))
        + F.when(size < 50, 0.03).when(size < 200, 0.08).when(size <= 2000, 0.15).when(size <= 5000, 0.10).otherwise(0.05)
        + F.least(F.lit(0.20), count(text, _BEFORE + f"(?:{RELATIONS})" + r"\s+\S+") * 0.07)
    )
    return F.when(text.isNull() | (F.trim(text) == ""), 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


#: Typed tokens: type, pattern, group (fixed values).
TYPED = (
    ("qualified", r"(?<![\p{L}\p{N}_])([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*)+)(?![\p{L}\p{N}_])"),
    ("hex", r"(?<![\p{L}\p{N}_])(0x[0-9a-fA-F]+)(?![\p{L}\p{N}_])"),
    ("number", r"(?<![\p{L}\p{N}_])(\d+(?:\.\d+)?)(?![\p{L}\p{N}_])"),
    ("arity", r"(?<![\p{L}\p{N}_])(\d+)\s*(?:args?|params?|parameters?|items?)(?![\p{L}\p{N}_])"),
    ("funcall", r"(?<![\p{L}\p{N}_])([a-z_][a-z0-9_]{2,})\s*\("),
)


def typed_tokens(text: Column) -> Column:
    """Distinct struct(type, value) of a text, in the order of the types."""

    def tagged(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))

    found = []
    for kind, pattern in TYPED:
        values = F.regexp_extract_all(text, F.lit(pattern), 1)
        if kind == "hex":
            values = F.transform(values, F.lower)
        if kind == "number":
            values = F.transform(values, lambda v: F.regexp_replace(v, r"^0+(?=\d)", ""))
        found.append(F.transform(values, tagged(kind)))
    return F.array_distinct(F.concat(*found))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([a-z][a-z0-9-]*(?:/[a-z][a-z0-9-]*)*)\]\]"), 1)


def wiki_quality(content: Column, n_citations: Column, path: Column) -> Column:
    """0..1 from length, citations, links, headings and nesting of a page."""
    n = F.size(F.filter(F.split(content, " "), lambda t: t != ""))
    return F.least(
        F.lit(1.0),
        F.least(F.lit(0.30), n / 150.0 * 0.30)
        + F.when(n_citations > 0, 0.30).otherwise(0.0)
        + F.when(F.size(wikilinks(content)) > 0, 0.20).otherwise(0.0)
        + F.when(content.contains("\n##") | content.startswith("##"), 0.10).otherwise(0.0)
        + F.when(path.contains("/"), 0.10).otherwise(0.0),
    )


def is_numeric(x: Column) -> Column:
    return x.rlike(r"^[\d.\-+eE]*\d[\d.\-+eE]*$")


def snippet(text: Column, pattern: str, before: int = 80, after: int = 120) -> Column:
    """Surroundings of the first match; the first 200 characters without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_substr(text, F.lit(pattern)))
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + size + after, F.length(text) + 1)
    return F.when(at == 0, F.left(text, F.lit(200))).otherwise(
        F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start))
    )


def sentences(text: Column) -> Column:
    """Sentences of all paragraphs, trimmed.

    Functions of two parameters, as ``F.trim``, would be given each element's index as their second.
    """
    blocks = F.filter(F.transform(F.split(text, r"\n\n"), lambda b: F.trim(b, F.lit("\n \t"))), lambda b: b != "")
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])[ \t\n\f\r]+")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def noun_phrase(text: Column, most: int = 80) -> Column:
    """First clause, cut at ``most`` characters."""
    return F.trim(F.left(F.regexp_extract(text, r"^([^.!?,;:\n]*)", 1), F.lit(most)))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def laplace(successes: Column, failures: Column) -> Column:
    return (successes + 1) / (successes + failures + 2)


def entity_type(name: Column, tools=fixed.KNOWN_TOOLS, organizations=fixed.KNOWN_ORGANIZATIONS, suffixes=fixed.TOOL_SUFFIXES) -> Column:
    """tool, organization, person, project or concept, by the first rule that holds."""
    n = F.trim(name)
    low = F.lower(n)
    base = F.regexp_extract(low, r"^([^-_.]*)", 1)

    def known(x, values):
        return x.isin([v.lower() for v in values])

    def alt(values):
        return "|".join(re.escape(v) for v in values)

    particle, word = alt(fixed.NAME_PARTICLES), r"\p{Lu}(?:\p{Ll}|['’-](?=\p{L})|(?<=['’-])\p{Lu})+"
    boundary = "|".join(f"(?i:{re.escape(s[0])}){'' if len(s) == 1 else '(?i:' + re.escape(s[1:]) + ')'}" for s in suffixes)
    rules = [
        (low.rlike(r"^(?=.{1,4}$)[+-]?(?:\d+\.?\d*|\.\d+)(?:e\d+)?$"), "concept"),
        (low.rlike(r"^(?:v(?=..))?\d[\d.]*\d$") & (F.length(F.regexp_replace(low, "^v", "")) >= 3), "concept"),
        (low.rlike(r"^[{(]?[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12}[)}]?$"), "concept"),
        (n.rlike(r"^\.[\p{L}\p{N}]+$"), "tool"),
        (n.rlike(r"[/\\]") & n.rlike(r"\.[^./\\]+$"), "tool"),
        (known(base, tools) | known(low, tools), "tool"),
        (known(low, organizations) | low.rlike(rf"^.+ (?:{alt(fixed.LEGAL_SUFFIXES)})$"), "organization"),
        (low.rlike(rf"^.+[-_.](?:{alt(suffixes)})$") | n.rlike(rf"^.*\P{{Lu}}(?=\p{{Lu}})(?:{boundary})$"), "tool"),
        (n.rlike(r"^\p{Lu}[^. ]*(?:\.\p{Lu}[^. ]*)+\.?$"), "tool"),
        (~n.contains(" ") & (n.rlike(r"^(?=.*\p{Ll})\p{Lu}.*\p{Lu}") & (F.length(n) >= 3) | n.rlike(r"^(?=.*\p{Lu})[\p{Lu}\p{Nd}_]{3,}$")), "tool"),
        (low.rlike(r"^(?:user|admin|användar)(?:$|\p{Nd}.*| .*|e$|en$|name$)"), "person"),
        (n.rlike(rf"^{word}(?: +(?:{word}|{particle})){{0,2}} +{word}$"), "person"),
        (low.rlike(rf"^.+(?:{alt(fixed.PROJECT_SUFFIXES)})$"), "project"),
    ]
    out = F.lit("concept")
    for rule, kind in reversed(rules):
        out = F.when(rule, kind).otherwise(out)
    return F.when(name.isNull() | (n == ""), "concept").otherwise(out)


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, as the variable of a lambda, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def _stems(words) -> str:
    return r"(?<!\p{L})(?:" + "|".join(re.escape(w) for w in words) + ")"


def _begins(low: Column, words) -> Column:
    """Whether one of the stems begins a word; the pattern is asked only where a stem occurs at all, which bytes tell."""
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words]) & low.rlike(_stems(words))


def _codes(low: Column, table: dict) -> Column:
    return F.array_compact(F.array(*[F.when(_begins(low, w), c) for c, w in table.items()]))


def emotions(text: Column, most: int = 3) -> Column:
    """Codes of the first emotions, in table order, whose stems begin a word."""
    return F.slice(bound(F.lower(text), lambda low: _codes(low, fixed.EMOTIONS)), 1, most)


def flags(text: Column) -> Column:
    return bound(F.lower(text), lambda low: _codes(low, fixed.FLAGS))


def key_sentence(text: Column) -> Column:
    """The sentence of twenty characters or more with the highest length plus cue weights; the first of equals."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)

    def score(s):
        cues = lambda low: sum((F.when(_begins(low, w), k).otherwise(0) for k, w in fixed.SENTENCE_CUES), F.lit(0))
        return F.length(s) + bound(F.lower(s), cues)

    best = F.array_max(F.transform(parts, lambda s, i: F.struct(score(s).alias("k"), (-i).alias("o"), s.alias("s"))))["s"]
    return F.coalesce(bound(best, lambda s: F.when(F.length(s) > 140, F.concat(F.left(s, F.lit(137)), F.lit("..."))).otherwise(s)), F.lit(""))


def topics(text: Column, most: int = 3) -> Column:
    """Commonest words of four letters or more that are not common words; ties in order of the alphabet.

    Counting words within a row is quadratic in array functions, so this one is an Arrow function.
    """
    import pandas as pd

    def one(x):
        n = collections.Counter(words((x or "").lower()))
        return [w for _, w in heapq.nsmallest(most, ((-k, w) for w, k in n.items() if w not in skip))]

    words = re.compile(r"(?<![^\W_])[^\W\d_]{4,}(?![^\W_])").findall
    skip = frozenset(fixed.NOT_TOPICS)

    def topics_of(s: pd.Series) -> pd.Series:
        return s.map(one)

    topics_of.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(topics_of, "array<string>")(text)


def entity_codes(text: Column, most: int = 3) -> Column:
    """Three-letter codes of the first capitalised words that are not sentence words."""
    skip = F.array(*[F.lit(w.lower()) for w in fixed.NOT_ENTITIES])
    names = F.regexp_extract_all(text, F.lit(r"(\p{Lu}(?<![\p{L}\p{N}_]\p{Lu})\p{L}+)(?![\p{L}\p{N}_])"), 1)  # what stands before is asked of capitals only
    codes = F.transform(F.filter(names, lambda w: ~F.array_contains(skip, F.lower(w))), lambda w: F.upper(F.left(w, F.lit(3))))
    return F.slice(F.array_distinct(codes), 1, most)


def symbolic(text: Column, wing: Column | None = None, room: Column | None = None, date: Column | None = None, stem: Column | None = None) -> Column:
    """Two-line symbolic summary: header, then entities, topics, quote, emotions and flags."""
    import pandas as pd

    def lines_of(s: pd.Series) -> pd.Series:
        from memloom.functions import symbols

        return s.map(symbols.line)

    lines_of.__annotations__ = {"s": pd.Series, "return": pd.Series}
    line = F.pandas_udf(lines_of, "string")(text)
    if wing is None and stem is None:
        return line
    head = F.concat_ws("|", *[F.coalesce(x if x is not None else F.lit(None).cast("string"), F.lit("?")) for x in (wing, room, date, stem)])
    return F.concat_ws("\n", head, line)


def kebab_path(text: Column, words: int = 5) -> Column:
    """Path from the first words of three letters or more of a topic."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", ""), " "), lambda w: F.length(w) > 2)
    return F.array_join(F.slice(parts, 1, words), "-")


def parse_symbolic(summary: Column) -> Column:
    """Parts of a symbolic summary as struct(wing, room, date, stem, entities, topics, quote, emotions, flags); the inverse of ``symbolic``."""
    lines = F.split(summary, "\n")
    head = F.when(F.size(lines) > 1, F.split(lines[0], r"\|"))
    body = F.element_at(lines, -1)
    quote = F.regexp_extract(body, r'\|"(.*)"(?:\||$)', 1)
    plain = F.split(F.regexp_replace(body, r'\|".*"(?=\||$)', ""), r"\|")
    rest = F.slice(plain, 3, 2)

    def part(pattern: str) -> Column:
        return F.split(F.coalesce(F.get(F.filter(rest, lambda p: p.rlike(pattern)), F.lit(0)), F.lit("")), r"\+")

    def listed(x: Column, nothing: str) -> Column:
        return F.filter(x, lambda e: (e != "") & (e != nothing))

    named = [F.when(head.isNotNull() & (F.get(head, F.lit(i)) != "?"), F.get(head, F.lit(i))).alias(n) for i, n in enumerate(("wing", "room", "date", "stem"))]
    return F.struct(
        *named,
        listed(F.split(F.regexp_replace(plain[0], "^0:", ""), r"\+"), "???").alias("entities"),
        listed(F.split(F.get(plain, F.lit(1)), "_"), "misc").alias("topics"),
        quote.alias("quote"),
        listed(part(r"^[a-z]+(?:\+[a-z]+)*$"), "").alias("emotions"),
        listed(part(r"^[A-Z]+(?:\+[A-Z]+)*$"), "").alias("flags"),
    )
