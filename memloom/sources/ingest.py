"""Sources: files, conversations, annotated bundles; sweeping; chunking."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import fixed
from memloom.functions import text as T


# Files ------------------------------------------------------------------------------------------


def skipped(path: Column) -> Column:
    """Paths that are not mined: by extension, folder, name or ending, whatever the case."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name, parts = F.element_at(F.split(p, "/"), -1), F.split(p, "/")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    folders = F.array(*[F.lit(x.lower()) for x in fixed.SKIP_DIRECTORIES])
    ending = F.lit(False)
    for s in fixed.SKIP_SUFFIXES:
        ending = ending | name.endswith(s.lower())
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), folders)
    return ext.isin([x.lower() for x in fixed.SKIP_EXTENSIONS]) | name.isin([x.lower() for x in fixed.SKIP_FILES]) | ending | inside


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(source, mtime, text) of all files below a folder that are mined."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.where(~skipped(F.col("path")))
    return rows.select(F.col("path").alias("source"), F.unix_millis("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text"))


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files without a stored row of the same source and time."""
    return files.join(stored.select("source", "mtime"), ["source", "mtime"], "left_anti")


def sweep(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, status): ok, stale or missing."""
    s = stored.groupBy("source").agg(F.max("mtime").alias("ig_m"))
    status = F.when(F.col("ig_m").isNull(), "missing").when(F.col("ig_m") != F.col("mtime"), "stale").otherwise("ok")
    return files.join(s, "source", "left").select("source", status.alias("status"))


# Conversations ----------------------------------------------------------------------------------


def conversation_turns(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """One row per turn of a JSON array of turns; other texts are one turn. Empty turns go."""
    turns = F.from_json(json_col, "array<struct<turn:bigint,role:string,content:string>>")
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.col(json_col).alias("content")))
    rows = df.select(*keep, F.explode(F.coalesce(turns, whole)).alias("t")).select(*keep, "t.*")
    return rows.where(F.col("content").isNotNull() & (F.trim("content") != ""))


# Annotated bundles ------------------------------------------------------------------------------


def parse_frontmatter(text: str) -> tuple[dict, str]:
    """Header fields and body of a text that begins with a YAML header of scalars, lists and folded text."""
    lines = text.replace("\r\n", "\n").split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, text
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if end is None:
        return {}, text
    fields: dict = {}
    key, folded = None, False
    for line in lines[1:end]:
        item, scalar = re.match(r"^\s*-\s+(.*)$", line), re.match(r"^([A-Za-z_][\w-]*):\s*(.*)$", line)
        if item and key is not None and not folded:
            have = fields.get(key)
            fields[key] = [*(have if isinstance(have, list) else []), _unquoted(item[1])]
        elif scalar:
            key, value = scalar[1], scalar[2].strip()
            folded = value in (">", ">-", "|")
            if value.startswith("[") and value.endswith("]"):
                fields[key] = [_unquoted(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                fields[key] = "" if folded else _unquoted(value)
        elif folded and key is not None and line.strip():
            fields[key] = f"{fields[key]} {line.strip()}".strip()
    return fields, "\n".join(lines[end + 1 :]).lstrip("\n")


def _unquoted(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'`" else x


def rewrite_links(body: str, folder: str = "") -> str:
    """Relative links to Markdown files as wikilinks; URLs, anchors and the part after a Citations heading stay."""
    head, mark, tail = re.match(r"(?ms)\A(.*?)(^#+\s*Citations\b.*)?\Z", body).group(1), "", ""
    tail = body[len(head) :]

    def one(m):
        target = m[2].split("#")[0]
        if re.match(r"[a-z]+:", m[2]) or m[2].startswith("#") or not re.search(r"\.(md|markdown)$", target):
            return m[0]
        parts: list[str] = [] if target.startswith("/") else [p for p in folder.split("/") if p]
        for p in target.lstrip("/").split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        path = re.sub(r"\.(md|markdown)$", "", "/".join(parts)).lower()
        return f"[[{re.sub(r'[^a-z0-9/-]+', '-', path)}]]"

    return re.sub(r"\[([^\]]*)\]\(([^)\s]+)\)", one, head) + mark + tail


BUNDLE = "path string, type string, title string, description string, resource string, tags array<string>, body string, extra map<string,string>"


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """Concept files below a folder: header fields and body with links rewritten. index and log files are left out."""
    import pandas as pd

    base = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    rows = base.where(name.rlike(r"\.(md|markdown)$") & ~name.rlike(r"^index\.") & (name != "log.md"))
    rel = F.regexp_replace(F.expr("substring(file, instr(file, '" + root.rstrip("/").replace("'", "") + "') + " + str(len(root.rstrip("/")) + 1) + ")"), r"\.(md|markdown)$", "")

    def parse(batches):
        known = ("type", "title", "description", "resource")
        for pdf in batches:
            out = []
            for path, text in zip(pdf["rel"], pdf["value"]):
                f, body = parse_frontmatter(text)
                tags = f.get("tags") or []
                extra = {k: str(v) for k, v in f.items() if k not in (*known, "tags")}
                row = [f[k] if isinstance(f.get(k), str) else None for k in known]
                out.append((path, *row, tags if isinstance(tags, list) else [tags], rewrite_links(body, path.rpartition("/")[0]), extra))
            yield pd.DataFrame(out, columns=["path", *known, "tags", "body", "extra"])

    return rows.select(rel.alias("rel"), "value").mapInPandas(parse, BUNDLE)


def bundle_triples(bundle: DataFrame) -> DataFrame:
    """(subject, predicate, object) from type, resource and tags of concepts."""
    one = bundle.select(F.col("path").alias("subject"), F.lit("has_type").alias("predicate"), F.col("type").alias("object"))
    two = bundle.select(F.col("path").alias("subject"), F.lit("resource").alias("predicate"), F.col("resource").alias("object"))
    three = bundle.select(F.col("path").alias("subject"), F.lit("tagged").alias("predicate"), F.explode("tags").alias("object"))
    return one.unionByName(two).unionByName(three).where("object is not null and object <> ''")


def skill_issues(folder: str, fields: dict) -> list[str]:
    """Rules that the header of a skill breaks."""
    name, about, out = fields.get("name") or "", fields.get("description") or "", []
    if not name:
        out.append("name is missing")
    elif not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", name):
        out.append("name is not kebab case")
    if name and name != folder:
        out.append("name differs from the folder")
    if len(name) > 64:
        out.append("name is too long")
    if re.search(r"anthropic|claude", name):
        out.append("name has a reserved word")
    if not about:
        out.append("description is missing")
    if len(about) > 1024:
        out.append("description is too long")
    if re.search(r"[<>]", about):
        out.append("description has angle brackets")
    return out


# Task memories as JSON lines --------------------------------------------------------------------


def export_memories(df: DataFrame, path: str) -> None:
    df.select("id", "wing", "when_to_use", "content", "score", "author").write.mode("overwrite").json(path)


def import_memories(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, wing string, when_to_use string, content string, score double, author string").json(path)
    return rows.withColumn("score", F.coalesce("score", F.lit(0.8))).withColumn("author", F.coalesce("author", F.lit("imported"))).withColumn("source", F.lit("success"))


# Facts with numbers -----------------------------------------------------------------------------

#: Patterns of facts (fixed values): predicate, pattern, groups of subject and object, subject where none is near.
FACTS = (
    ("has_param_count", r"(?iU)(\w+)\s*\([^)]*\)\s+takes?\s+(\d+)", 1, (2,), None),
    ("has_version", r"(?iU)([\w.]+)\s+v?(\d+\.\d[\d.]*)", 1, (2,), None),
    ("returns_type", r"(?U)\breturns?\s+([\w<>\[\]]+)", 0, (1,), "unknown"),
    ("has_timeout", r"(?iU)\btimeout[:\s]+(\d+)\s*(ms|s|min|sec)", 0, (1, 2), "room"),
    ("uses_port", r"(?iU)\bport[:\s]+(\d{2,5})\b", 0, (1,), "room"),
    ("has_value", r"(?iU)chunk[_\s]size[:\s=]+(\d+)", 0, (1,), "room"),
)
FACT_ARRAY = "array<struct<subject:string,predicate:string,object:string>>"
#: How far back a subject may stand.
NEAR = 80


def _near_subject(before: Column) -> Column:
    """An identifier of two letters or more at the very end of a text, else the first one in it that is called; null without."""
    last, called = F.regexp_extract(before, r"(?U)([\w.]+)\s*$", 1), F.regexp_extract(before, r"(?U)(\w[\w.]*)\s*\(", 1)
    return F.when(F.length(last) >= 2, last).when(called != "", called)


def _subject_before(turns: Column, fallback: Column):
    return lambda _, i: F.coalesce(_near_subject(F.right(F.array_join(F.slice(turns, F.lit(1), 2 * i + 1), ""), F.lit(NEAR))), fallback)


def _fact(predicate: str):
    return lambda a, b: F.struct(a.alias("subject"), F.lit(predicate).alias("predicate"), b.alias("object"))


def _may_hold(text: Column, low: Column) -> dict[str, Column]:
    """What every match of a pattern holds, by predicate; cheaper to look for than the pattern."""
    holds = {"has_param_count": low.contains("take"), "has_version": text.rlike(r"(?U)\d\.\d"), "returns_type": text.contains("return")}
    return holds | {"has_timeout": low.contains("timeout"), "uses_port": low.contains("port"), "has_value": low.contains("chunk")}


def facts_of(text: Column, room: Column) -> Column:
    """Array of struct(subject, predicate, object), pattern by pattern; null text has none."""
    found, none = [], F.from_json(F.lit("[]"), FACT_ARRAY)
    may_hold = _may_hold(text, F.lower(text))
    for predicate, pattern, s, groups, otherwise in FACTS:
        named = [F.regexp_extract_all(text, F.lit(pattern), g) for g in ([s] if s else []) + list(groups)]
        if s:
            subjects, objects = named[0], named[1:]
        else:
            # Texts between matches and the matches themselves by turns: what stands before match i ends after 2 i + 1 of them.
            turns = F.flatten(F.transform(F.arrays_zip(F.split(text, pattern).alias("x"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("y")), lambda z: F.array(z["x"], z["y"])))
            fallback = F.lit(otherwise) if otherwise != "room" else room

            def subjects_of(x: Column, fallback=fallback) -> Column:
                return F.transform(x["named"], _subject_before(x["turns"], fallback))

            subjects, objects = T.bound(F.struct(turns.alias("turns"), named[0].alias("named")), subjects_of), named
        value = objects[0] if len(objects) == 1 else F.zip_with(*objects, lambda a, b: F.concat(a, b))
        facts = F.zip_with(subjects, value, _fact(predicate))
        found.append(F.when(may_hold[predicate], facts).when(text.isNotNull(), none))
    return F.array_distinct(F.concat(*found))


def numeric_facts(df: DataFrame, id_col: str, text_col: str, room: Column | None = None) -> DataFrame:
    """(id, subject, predicate, object, confidence) of facts with numbers; ``room`` is the subject where no other is near."""
    room = F.lit("source") if room is None else room
    rows = df.select(F.col(id_col), F.explode(facts_of(F.col(text_col), room)).alias("f"))
    return rows.select(id_col, "f.subject", "f.predicate", "f.object", F.lit(0.9).alias("confidence"))


# Chunking ---------------------------------------------------------------------------------------


def count_tokens(text: str) -> int:
    return max(1, len(text) // 4)


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def split_sentences(text: str) -> list[str]:
    out = []
    for block in (b.strip() for b in text.split("\n\n")):
        out += [t for s in _SENTENCE_END.split(block) if (t := s.strip())]
    return out


def fixed_windows(text: str, most: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Segments up to sentence ends or line breaks, gathered up to ``most`` tokens; longer ones are cut at a blank."""
    segments = re.findall(r"[^\n]*?(?:[.!?](?=\s|$)|\n|$)", text)
    out, now, used = [], "", 0
    for s in segments:
        while count(s) > most:
            room = most * 3
            cut = max((i + 1 for i, ch in enumerate(s[:room]) if ch.isspace() and i >= room - 200), default=room)
            out, now, used = [*out, *([now] if now.strip() else []), s[:cut]], "", 0
            s = s[cut:]
        n = count(s) + 1 if s else 0  # counts of parts may each lose a rest
        if now and used + n > most:
            out, now, used = [*out, now], "", 0
        now, used = now + s, used + n
    return [c.strip() for c in [*out, now] if c.strip()]


def topic_chunks(
    text: str, embed: Callable | None = None, least: int = 80, target: int = 800, most: int = 1800, threshold: float = 0.60, overlap: int = 0,
    count: Callable[[str], int] = count_tokens,
) -> list[str]:
    """Chunks of whole sentences, cut where adjacent sentences differ, at the cap, or at a low after the target."""
    if not text or not text.strip():
        return []
    if count(text) <= most and embed is None:
        return [text.strip()]
    parts = split_sentences(text)
    if len(parts) < 2 or embed is None:
        chunks = fixed_windows(text, most, count)
    else:
        import numpy as np

        v = np.asarray(embed(parts), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        near = [1.0, *(v[1:] * v[:-1]).sum(1).tolist()]
        chunks, now, used = [], [], 0
        for i, s in enumerate(parts):
            n = count(s)
            cut = used >= least and near[i] < threshold or used + n > most or used >= target and near[i] <= min(near[max(1, i - 2) : i + 3])
            if now and cut:
                chunks.append(" ".join(now))
                now, used = [], 0
            now.append(s)
            used += n
        chunks.append(" ".join(now))
        chunks = [c for chunk in chunks for c in (fixed_windows(chunk, most, count) if count(chunk) > most else [chunk])]
    if len(chunks) > 1 and count(chunks[-1]) < least and count(chunks[-2]) + count(chunks[-1]) <= most:
        chunks[-2:] = [chunks[-2] + "\n" + chunks[-1]]
    return with_overlap(chunks, overlap, most, count)


def with_overlap(chunks: list[str], sentences: int, most: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """The last sentences of the chunk before go in front, as far as the cap allows."""
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:]):
        tail, used = [], count(chunk)
        for s in reversed(split_sentences(before)[-sentences:] if sentences else []):
            if used + count(s) > most:
                break
            used += count(s)
            tail.insert(0, s)
        out.append(" ".join(tail) + "\n" + chunk if tail else chunk)
    return out


#: Lines that open a part (fixed values): headings, declarations after any modifiers, regions, functions, and rules of one mark.
MODIFIERS = "public|internal|private|protected|static|sealed|abstract|partial|file|readonly|ref|new"
DECLARATIONS = "namespace|class|record|struct|interface|enum"
FUNCTIONS = "def |fn |func |pub fn |pub struct |impl "
OPENING = re.compile(rf"#[ #]|(?i:#region)|(?:(?:{MODIFIERS}) +)*(?:{DECLARATIONS}) |(?:{FUNCTIONS})|([-=*/])\1{{2,}}\s*$")


def part_starts(text: str) -> list[int]:
    """Places where a part opens: an opening line's first mark, or an empty line before a filled one."""
    lines, out, at = text.split("\n"), [], 0
    for i, line in enumerate(lines):
        bare = line.lstrip()
        gap = not bare and 0 < i < len(lines) - 1 and lines[i + 1].strip()
        if gap or OPENING.match(bare):
            out.append(at + len(line) - len(bare))
        at += len(line) + 1
    return out


def structural(text: str, least: int = 200, target: int = 800, most: int = 1200, size: Callable[[str], int] = len) -> list[str]:
    """Chunks cut at the opening line nearest to the target, else after a sentence, else at the cap.

    ``size`` measures a text: characters, or tokens for an embedder (then 64, 512 and 1024 are usual).
    """
    if not text or not text.strip():
        return []
    starts, out, i = part_starts(text), [], 0
    while size(text[i:]) > most:
        near = [(abs(n - target), p) for p in starts if p > i and least <= (n := size(text[i:p])) <= most]
        if near:
            cut = min(near)[1]
        else:
            # The longest stretch within the cap, by bisection as sizes grow with length.
            low, high = i + 1, len(text)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size(text[i:mid]) <= most else (low, mid - 1)
            ends = [m.end() for m in re.finditer(r"[.!?]\s", text[i:low]) if least <= size(text[i : i + m.end()]) <= target]
            cut = i + ends[-1] if ends else low
        out.append(text[i:cut].strip())
        i = cut
    rest = text[i:].strip()
    if out and rest and size(rest) < least and size(out[-1]) + size(rest) < most:
        out[-1] += "\n" + rest
    elif rest:
        out.append(rest)
    return [c for c in out if c]


#: Characters of chunks that a task gathers before it sends them on.
SENT_CHARS = 1 << 22


def _chunk_table(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[str]]) -> DataFrame:
    import pyarrow as pa

    t = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows, ords, chunks, size = [], [], [], 0

            def sent(batch=batch):
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ords, pa.int32()), pa.array(chunks, pa.string())], names=[id_col, "ord", "chunk"])

            for k, x in enumerate(batch.column(1)):
                new = cut(x.as_py() or "")
                rows += [k] * len(new)
                ords += range(len(new))
                chunks += new
                size += sum(map(len, new))
                if size > SENT_CHARS:
                    yield sent()
                    rows, ords, chunks, size = [], [], [], 0
            if rows:
                yield sent()

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {t}, ord int, chunk string")


def chunked(df: DataFrame, id_col: str, text_col: str, embed: Callable | None = None, **options) -> DataFrame:
    """(id, ord, chunk) by topic shift; ``embed`` maps sentences to vectors."""
    return _chunk_table(df, id_col, text_col, lambda x: topic_chunks(x, embed, **options))


def structural_chunks(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    return _chunk_table(df, id_col, text_col, lambda x: structural(x, **options))
