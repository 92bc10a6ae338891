"""A facade over a store of tables: the calls that an agent makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.config import Config
from memloom.functions import text as T
from memloom.operators import cluster as C
from memloom.operators import flows
from memloom.operators import graph as G
from memloom.operators import lookups as L
from memloom.operators import memory as M
from memloom.operators import retrieval as R
from memloom.operators import wiki as W
from memloom.schemas import TABLES
from memloom.session import ship
from memloom.seams import Embedder, HashingEmbedder, Llm
from memloom.sources import ingest as I
from memloom.sources.store import Store, insert_absent, written


class MemoryStore:
    """Memories under a root folder. Every read is a DataFrame; every write is a new snapshot."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: Config | None = None):
        ship(spark)
        self.spark, self.store = spark, Store(spark, root)
        self.embedder, self.config = embedder or HashingEmbedder(), config or Config()

    def table(self, name: str, wing: str | None = None) -> DataFrame:
        df = self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], TABLES[name])
        return df if wing is None else df.where(F.col("wing") == wing)

    def drawers(self, wing: str | None = None) -> DataFrame:
        return R.active(self.table("drawers", wing))

    # Writes -------------------------------------------------------------------------------------

    def add_memories(self, rows: DataFrame, drawer_type: str = "synthesis") -> DataFrame:
        """Admit and store (wing, room, content, source); returns what happened to each row."""
        judged = C.admission(rows, "content", None, self.config.admission_length, self.config.admission_symbols)
        good = judged.where("admitted").select("wing", "room", "content", "source")
        fields = {f.split()[0]: f.split()[1] for f in TABLES["drawers"].split(", ")}
        vectors = self._embedded(good, "content")
        known = {
            "id": T.short_hash(F.col("content")), "fts_text": F.concat_ws(" ", "content", "wing", "room"), "content_hash": F.sha2("content", 256),
            "importance": T.importance(F.col("content")), "drawer_type": F.lit(drawer_type), "mined_at": F.current_timestamp(),
            "is_representative": F.lit(True), "access_count": F.lit(0),
        }
        have = set(vectors.columns)
        new = vectors.select(*[F.col(n) if n in have else known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
        new = written(new.dropDuplicates(["id"]))
        stored = self.table("drawers").select("id", "embedding")
        # Near a stored row, or near a new row that comes before by id.
        near = C.similarity_join(new.select("id", "embedding"), stored, self.config.admission_duplicate).where("a <> b")
        among = C.similarity_join(new.select("id", "embedding"), new.select("id", "embedding"), self.config.admission_duplicate, self_join=True)
        twins = near.unionByName(among.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        twin = written(twins.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("score", "b")).alias("duplicate_of")))
        fresh = new.join(twin.select("id"), "id", "left_anti").join(stored.select("id"), "id", "left_anti")
        fresh = written(fresh.select(*new.columns))
        self.store.append("drawers", fresh)
        self._index(fresh)
        self.log("add", "drawers", f"{fresh.count()} rows")
        out = judged.withColumn("id", T.short_hash(F.col("content"))).join(twin, "id", "left")
        again = F.col("admitted") & F.col("duplicate_of").isNotNull()
        return out.withColumn("reason", F.when(again, "near_duplicate").otherwise(F.col("reason"))).withColumn("admitted", F.col("admitted") & ~again)

    def _embedded(self, rows: DataFrame, text_col: str) -> DataFrame:
        """``rows`` with column embedding."""
        import pyarrow as pa

        embedder, names = self.embedder, [*rows.columns, "embedding"]

        def run(batches):
            for batch in batches:
                vectors = embedder.embed([x or "" for x in batch.column(text_col).to_pylist()]) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=names)

        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>")

    def _index(self, rows: DataFrame) -> None:
        """What is derived from new rows: postings, lengths, typed tokens and symbolic summaries."""
        self.store.append("postings", R.postings(rows, "id", "fts_text"))
        self.store.append("lengths", rows.select("id", "wing", F.size(T.tokens(F.col("fts_text"))).alias("len")))
        tokens = rows.select("id", F.explode(T.typed_tokens(F.col("content"))).alias("t"))
        self.store.append("drawer_tokens", tokens.select(F.col("id").alias("drawer_id"), F.col("t.type").alias("token_type"), F.col("t.value").alias("token_value")))
        aaak = T.symbolic(F.col("content"), F.col("wing"), F.col("room"), F.date_format("mined_at", "yyyy-MM-dd"), F.lit("memory"))
        self.store.append("closets", rows.select(T.short_hash(F.col("id")).alias("id"), F.col("id").alias("drawer_id"), "wing", "room", aaak.alias("aaak_text"), F.col("mined_at").alias("created_at")))

    def log(self, action: str, target: str, summary: str = "", wing: str | None = None, agent: str | None = None) -> None:
        """One row of the activity log."""
        row = self.spark.createDataFrame([(wing, action, target, agent, summary)], "wing string, action string, target string, agent string, summary string")
        row = row.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("ts"), *row.columns)
        self.store.append("activity_log", row)

    def touch(self, ids: DataFrame) -> None:
        """Record uses of rows (id) as events; counters are sums over them."""
        self.store.append("access_events", ids.select("id", F.current_timestamp().alias("ts")))

    def record_call(self, calls: DataFrame) -> None:
        """Add rows of tool_call_history."""
        self.store.append("tool_call_history", calls)

    def summarize_tool(self, tool: str, llm: Llm, wing: str | None = None) -> str | None:
        """Judge a tool's open calls, write guidelines from the latest ones and mark those as summarised."""
        text, calls = flows.summarize_tool(self.table("tool_call_history"), tool, llm, wing)
        self.store.write("tool_call_history", written(calls))
        if text is not None:
            row = self.spark.createDataFrame([(wing, tool, text)], "wing string, tool_name string, guidelines string").withColumn("updated_at", F.current_timestamp())
            kept = self.table("tool_memories").where(~(F.col("wing").eqNullSafe(F.lit(wing)) & (F.col("tool_name") == tool)))
            self.store.write("tool_memories", written(kept.unionByName(row)))
        return text

    def guidelines(self, tool: str, wing: str | None = None) -> DataFrame:
        return L.matching(self.table("tool_memories"), wing=wing, tool_name=tool).limit(1)

    def reflect(self, wing: str, llm: Llm) -> DataFrame:
        """New drafts of answers to questions about the latest rows of a wing; stored."""
        new = written(flows.reflect(self.drawers(wing), self.table("reflection_drafts"), lambda q: self.search(q, wing, k=8), self.embedder, llm, wing))
        self.store.append("reflection_drafts", new)
        return new

    def accept_draft(self, draft_id: str, llm: Llm) -> None:
        """A draft becomes accepted; facts drawn from its answer become triples."""
        drafts, facts = flows.accepted_draft(self.table("reflection_drafts"), draft_id, llm)
        self.store.write("reflection_drafts", written(drafts))
        self.add_triples(facts.select("subject", "predicate", "object", F.current_date().alias("valid_from"), F.lit(0.7).alias("confidence"), F.lit(None).cast("string").alias("drawer_id")))

    def resolve_entities(self, groups: list, llm: Llm | None = None) -> int:
        """Merge candidate groups [(id, name, mentions)] as the model, or the most frequent name, says; the number of aliases."""
        mapping = written(flows.confirmed_aliases(self.spark, groups, llm))
        entities, triples = G.merge_entities(self.table("entities"), self.table("triples"), mapping)
        self.store.write("entities", written(entities))
        self.store.write("triples", written(triples))
        return mapping.count()

    def reindex_skills(self, found: DataFrame, wing: str | None = None) -> DataFrame:
        """Sync the registry with (folder_path, name, description, skill_md_mtime) found on disk; the actions taken."""
        old = self.table("skills")
        mine = L.matching(old, wing=wing)
        actions = written(L.synced(mine, found))
        kept = old.join(actions.where("action in ('removed', 'updated')"), "folder_path", "left_anti")
        new = found.join(actions.where("action in ('added', 'updated')").select("folder_path"), "folder_path")
        counts = mine.select("folder_path", "success_count", "fail_count")
        new = new.join(counts, "folder_path", "left")
        fresh = self._embedded(new, "description")
        known = {"id": T.short_hash(F.col("folder_path")), "wing": F.lit(wing), "success_count": F.coalesce("success_count", F.lit(0)), "fail_count": F.coalesce("fail_count", F.lit(0))}
        shaped = [known.get(f.name, F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema]
        self.store.write("skills", written(kept.unionByName(fresh.select(*shaped))))
        return actions

    def write_page(self, path: str, wing: str, title: str, content: str, citations: list[str], agent: str | None = None) -> str:
        """Check, store and link a page, resolve its reviews, and log it: created or updated."""
        slug = self.spark.range(1).select(T.slug(F.lit(path)).alias("s")).first()["s"]
        if not slug or not title.strip() or not content.strip():
            raise ValueError("path, title and content are needed")
        missing = set(citations) - {r["id"] for r in self.table("drawers").where(F.col("id").isin(citations)).select("id").collect()}
        if missing:
            raise ValueError(f"unknown citations: {', '.join(sorted(missing))}")
        pages = self.table("wiki_pages")
        done = "updated" if pages.where(F.col("path") == slug).limit(1).count() else "created"
        row = self.spark.createDataFrame(
            [(slug, wing, title, content, citations, agent, self.embedder.embed([content])[0])],
            "path string, wing string, title string, content string, citations array<string>, updated_by string, embedding array<float>",
        )
        row = row.withColumn("quality_score", T.wiki_quality(F.col("content"), F.size("citations"), F.col("path"))).withColumn("updated_at", F.current_timestamp())
        every = pages.where(F.col("path") != slug).unionByName(row, allowMissingColumns=True)
        edges = W.links(every)
        back = W.backlinks(edges).select("path", F.col("sources").alias("backlinks"))
        every = written(every.drop("backlinks").join(back, "path", "left").select(*pages.columns))
        self.store.write("wiki_pages", every)
        self.store.write("wiki_backlinks", written(edges))
        if citations and self.store.exists("wiki_pending_updates"):
            queue = self.table("wiki_pending_updates")
            mine = queue.where((F.col("page_path") == slug) & F.col("drawer_id").isin(citations)).select("id")
            self.store.write("wiki_pending_updates", written(W.resolve(queue, mine, "updated", F.current_timestamp(), only_open=True)))
        note = f"{done} {slug} ({len(citations)} citations)"
        entry = self.spark.createDataFrame([(slug, done, agent, note)], "path string, action string, agent string, note string")
        self.store.append("wiki_log", entry.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("ts"), *entry.columns))
        self.log("wiki_write", slug, note, wing, agent)
        return done

    def scaffold(self, summary: str, wing: str, hints: list[str] = ()) -> dict:
        """What a new page needs: related rows, open reviews of the hinted pages, and a suggested path and title."""
        named = self.spark.range(1).select(T.kebab_path(F.lit(summary)).alias("p"), T.noun_phrase(F.lit(summary)).alias("t")).first()
        reviews = L.open_reviews(self.table("wiki_pending_updates"), wing)
        return {"path": named["p"], "title": named["t"], "related": self.search(summary, wing, k=5), "reviews": reviews.where(F.col("page_path").isin(list(hints)))}

    def mine(self, root: str, wing: str) -> DataFrame:
        """Files below a folder, chunked; unchanged files are skipped."""
        stored = self.table("drawers").select("source", F.col("source_mtime").alias("mtime"))
        files = I.changed_files(I.read_files(self.spark, root), stored)
        chunks = I.chunked(files, "source", "text", least=self.config.chunk_least, target=self.config.chunk_target, most=self.config.chunk_most)
        return self.add_memories(chunks.select(F.lit(wing).alias("wing"), T.room_of_path(F.col("source")).alias("room"), F.col("chunk").alias("content"), "source"), "source")

    def add_triples(self, rows: DataFrame) -> None:
        """Store (subject, predicate, object, valid_from, confidence, drawer_id) in canonical form."""
        new = G.with_triple_ids(G.canonical_triples(rows))
        fields = [f.split() for f in TABLES["triples"].split(", ")]
        new = new.select(*[F.col(n).cast(t).alias(n) if n in new.columns else F.lit(None).cast(t).alias(n) for n, t in fields])
        self.store.write("triples", insert_absent(self.table("triples"), new))

    def prune(self, wing: str, theta: float | None = None) -> DataFrame:
        """Retire redundant rows of a wing; returns the report."""
        theta = theta or self.config.prune_theta
        rows = self.drawers(wing).select("id", "embedding", "access_count")
        pairs = C.similarity_join(rows, rows, theta, self_join=True)
        members = rows.join(C.connected(pairs, rows.select("id")), "id")
        out = C.prune(members, C.geometry(members), theta, self.config.prune_protect)
        gone = out.where(~F.col("is_representative")).select("id")
        from memloom.sources.store import retire, written

        gone = written(gone)
        self.store.write("drawers", retire(self.table("drawers"), gone))
        return out.agg(F.countDistinct("cluster_id").alias("clusters"), F.count_if("is_representative").alias("kept"), F.count_if(~F.col("is_representative")).alias("retired"))

    # Reads --------------------------------------------------------------------------------------

    def get(self, row_id: str) -> DataFrame:
        """One row by id; the use is recorded."""
        row = L.by_key(self.table("drawers"), row_id)
        self.touch(row.select("id"))
        return row

    def search(self, query: str, wing: str | None = None, room: str | None = None, k: int = 10, as_of=None, patterns: DataFrame | None = None) -> DataFrame:
        """Composed retrieval: (id, score, position, room, content, level).

        Keyword, vector and graph channels are fused and diversified; then typed tokens shared with the question,
        triple patterns (s, p, o), slots per cluster and backlinks of citing pages change the order. Uses are recorded.
        """
        rows = L.matching(self.drawers(wing), room=room)
        docs = rows.select("id", F.col("fts_text").alias("text"), "embedding", "importance", "last_accessed_at", "access_count")
        tokens = [t for t in query.lower().split() if len(t) >= 3]
        kg = None
        if self.store.exists("entities") and self.store.exists("triples") and tokens:
            kg = G.two_hop(self.table("entities"), self.table("triples"), tokens).withColumnRenamed("drawer_id", "id").join(rows.select("id"), "id", "left_semi")
        words = None
        if self.store.exists("postings"):
            mine = rows.select("id")
            stats = self.store.read("lengths").join(mine, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
            words = R.indexed(self.store.read("postings").join(mine, "id", "left_semi"), stats, query, self.config.fetch)
        q = self.embedder.embed([query], "query")[0]
        found = R.hybrid(docs, query, q, 2 * k, self.config.fetch, self.config.mmr_weight, kg, as_of, words)
        near = written(rows.join(F.broadcast(found), "id").select("id", "score", "room", "content", "cluster_id"))  # 2 k rows
        asked = T.typed_tokens(F.lit(query))
        boosted = near.withColumn("score", F.col("score") + self.config.side_index_weight * R.jaccard(asked, T.typed_tokens(F.col("content"))))
        if patterns is not None:
            more = G.predicate_boost(near, patterns, self.config.predicate_weight, text_col="content")
            boosted = boosted.join(more, "id", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
        kept = R.governed(boosted, k, aggressive=self.config.governance == "aggressive").drop("in_slot")
        if self.store.exists("wiki_pages"):
            links = W.citation_backlinks(self.table("wiki_pages", wing), near)
            kept = kept.join(F.broadcast(links), "id", "left").withColumn("score", R.backlink_boost(F.col("score"), F.col("backlinks"), self.config.backlink_weight, self.config.backlink_cap)).drop("backlinks")
        level = R.confidence_level(F.col("score"), self.config.confidence_high, self.config.confidence_medium, self.config.confidence_proceed)
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # k rows
        out = written(kept.withColumn("position", place).select("id", "score", "position", "room", "content", level.alias("level")))
        self.touch(out.select("id"))
        return out.orderBy("position")

    def wake_up(self, wing: str, seed: str | None = None) -> DataFrame:
        """Context pack (layer, id, text, ord) in order, within the budget of characters.

        Facts, attempts, pages and open reviews head it; synthesis rows have a guaranteed part, recent and related
        rows share what is left, but a least part too.
        """
        c, rows = self.config, self.drawers(wing)

        def layer(name: str, df: DataFrame, key, ident, text) -> DataFrame:
            return df.select(F.lit(name).alias("layer"), key.cast("double").alias("key"), ident.cast("string").alias("id"), text.alias("text"))

        def lines(found: DataFrame, n: int) -> DataFrame:
            return found.orderBy(F.desc("key"), "id").limit(n)

        named = F.concat_ws(" → ", "subject_name", "predicate", "object_name")
        facts = G.named_triples(self.table("triples"), self.table("entities"), 20)
        pages = self.table("wiki_pages", wing)
        reviews = W.pending_summary(self.table("wiki_pending_updates", wing))
        head = (
            lines(layer("facts", facts, F.col("confidence"), F.sha2(named, 256), named), 20)
            .unionByName(lines(layer("attempts", L.attempts(rows), F.unix_micros("mined_at"), F.col("id"), F.col("content")), 3))
            .unionByName(lines(layer("pages", pages, F.unix_micros("updated_at"), F.col("path"), F.concat_ws(" — ", "path", "title")), 30))
            .unionByName(lines(layer("reviews", reviews, F.col("n"), F.col("page_path"), F.concat(F.col("page_path"), F.lit(" ("), F.col("n"), F.lit(" candidates)"))), 10))
        )
        head = written(head)
        used = head.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
        entry = F.concat(F.lit("["), F.col("wing"), F.lit("/"), F.col("room"), F.lit("]\n"), F.col("content"))
        synthesis = layer("synthesis", rows.where("drawer_type = 'synthesis'"), F.unix_micros("mined_at"), F.col("id"), entry)
        first = written(R.packed(synthesis, max(c.wake_up_synthesis_least, c.wake_up_budget - used - c.wake_up_tail_least), [F.desc("key"), "id"]).drop("used"))
        taken = first.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        stamp = F.coalesce("last_accessed_at", "mined_at")
        source = rows.where("drawer_type = 'source'")
        recent = written(layer("recent", source, F.unix_micros(stamp), F.col("id"), entry).orderBy(F.desc("key"), "id").limit(c.wake_up_recent))
        tail = recent
        if seed:
            seen = first.select("id").unionByName(recent.select("id"))
            near = R.vector_topk(source.join(seen, "id", "left_anti"), self.embedder.embed([seed], "query")[0], 3 * c.wake_up_semantic).where(F.col("score") >= c.wake_up_least)
            picked = R.mmr(near, c.wake_up_semantic, c.mmr_weight).select("id", "position")
            tail = recent.unionByName(layer("related", near.join(picked, "id"), -F.col("position"), F.col("id"), entry))
        order = F.when(F.col("layer") == "recent", 0).otherwise(1)
        rest = R.packed(tail, max(c.wake_up_tail_least, c.wake_up_budget - used - taken), [order, F.desc("key"), "id"]).drop("used")
        ranks = F.array_position(F.array(*[F.lit(x) for x in ("facts", "attempts", "pages", "reviews", "synthesis", "recent", "related")]), F.col("layer"))
        out = written(head.unionByName(first).unionByName(rest).withColumn("ord", F.row_number().over(Window.orderBy(ranks, F.desc("key"), "id"))))  # bounded by the budget
        self.touch(out.where("layer in ('synthesis', 'recent', 'related')").select("id"))
        return out.select("layer", "id", "text", "ord").orderBy("ord")

    def guidance(self, wing: str, seed: str | None) -> str:
        """What to do after a wake-up: proceed, ask_user or verify."""
        if not seed:
            return "proceed"
        best = R.vector_topk(self.drawers(wing).where("drawer_type = 'source'"), self.embedder.embed([seed], "query")[0], self.config.wake_up_semantic)
        row = best.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.count_if(F.col("score") >= self.config.wake_up_least).alias("n"))
        return row.select(R.seed_guidance(F.lit(True), F.col("top"), F.col("n"), self.config.wake_up_least, self.config.confidence_proceed).alias("g")).first()["g"]

    def attempts(self, wing: str | None = None, n: int = 3) -> DataFrame:
        return L.attempts(self.drawers(wing), n)

    def synthesis(self, wing: str | None = None) -> DataFrame:
        return self.drawers(wing).where("drawer_type = 'synthesis'").orderBy(F.desc("mined_at"), "id")

    def recent(self, wing: str | None = None, n: int = 20, source_only: bool = False) -> DataFrame:
        return L.newest(self.drawers(wing), n, "mined_at", drawer_type="source" if source_only else None)

    def pages(self, wing: str | None = None) -> DataFrame:
        return L.page_index(self.table("wiki_pages"), wing)

    def page(self, path: str) -> DataFrame:
        return L.by_key(self.table("wiki_pages"), path, "path")

    def page_log(self, n: int = 50) -> DataFrame:
        return L.newest(self.table("wiki_log"), n, "ts")

    def reviews(self, wing: str | None = None, page_path: str | None = None, n: int = 50) -> DataFrame:
        return L.open_reviews(self.table("wiki_pending_updates"), wing, page_path, n)

    def episodes(self, wing: str, outcome: str | None = None, n: int = 20) -> DataFrame:
        return L.newest(self.table("episodes"), n, "created_at", wing=wing, outcome=outcome)

    def skill(self, id_or_name: str) -> DataFrame:
        return L.by_key(self.table("skills"), id_or_name, "id", "name")

    def drafts(self, wing: str, n: int = 20) -> DataFrame:
        return L.newest(self.table("reflection_drafts"), n, "created_at", wing=wing, status="pending")

    def calls(self, tool: str, wing: str | None = None, n: int = 20) -> DataFrame:
        return L.newest(self.table("tool_call_history"), n, "called_at", wing=wing, tool_name=tool)

    def task_memories(self, wing: str, n: int = 50) -> DataFrame:
        return L.newest(self.table("task_memories"), n, "time_created", wing=wing)

    def summary_of(self, drawer_id: str) -> DataFrame:
        """The symbolic summary of a row."""
        return L.by_key(self.table("closets"), drawer_id, "drawer_id").select("aaak_text")

    def around(self, query: str, wing: str | None = None, n: int = 3) -> DataFrame:
        """The best hit of a question with the n rows before and after it by time."""
        best = self.search(query, wing, k=1).first()
        rows = self.drawers(wing)
        return R.around(rows, best["id"] if best else None, n, "mined_at")

    def grep(self, pattern: str, wing: str | None = None, k: int = 20) -> DataFrame:
        hits = R.grep_exact(self.drawers(wing), pattern, text_col="content")
        return hits.orderBy(F.desc("mined_at"), "id").limit(k).select("id", "room", "source", "snippet")

    def entity(self, name: str, day, direction: str = "both") -> DataFrame:
        return G.neighbourhood(self.table("triples"), name, day, direction)

    def wiki_search(self, query: str, wing: str | None = None, k: int = 10) -> DataFrame:
        pages = self.table("wiki_pages", wing)
        return W.search(pages, query, self.embedder.embed([query], "query")[0], W.links(pages), k)

    def lint(self, wing: str | None = None) -> DataFrame:
        return W.lint(self.table("wiki_pages", wing), self.table("drawers"), self.table("wiki_pending_updates", wing), self.table("entities"), self.table("triples"))

    def find_episodes(self, query: str, wing: str | None = None, k: int = 5) -> DataFrame:
        return M.find_episodes(self.table("episodes", wing), self.embedder.embed([query], "query")[0], k)

    def find_skills(self, query: str, wing: str | None = None, k: int = 5) -> DataFrame:
        return M.find_skills(self.table("skills", wing), self.embedder.embed([query], "query")[0], k)
