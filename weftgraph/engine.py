"""The engine: ingest, query, delete, merge and export over a workspace's tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.models import Config, QueryParam
from weftgraph.operators import chunking as C
from weftgraph.operators import conversation as T
from weftgraph.operators import discovery as D
from weftgraph.operators import extraction as E
from weftgraph.operators import graph as G
from weftgraph.operators import index as I
from weftgraph.operators import maintenance as M
from weftgraph.operators import reduce as R
from weftgraph.operators import retrieval as Q
from weftgraph.operators import stores as S
from weftgraph.operators import vectors as V
from weftgraph.plans.scratch import Scratch
from weftgraph.sources import custom_graph as K
from weftgraph.tables import Store

#: Rounds in which chunks with malformed records are asked again, and what is asked.
RETRIES = 2
AGAIN = "\n\nthese records have too few fields, give them whole:\n"
MISSED = "\n\nname further entities and relations that were missed; these were found:\n"
UNITED = "\n\nare these two the same? answer yes or no"
_PAIR = "\u0001"


@dataclass
class Answer:
    text: str
    context: str


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark = spark
        self.config = config or Config()
        self.store = Store(spark, root, self.config.workspace, self.config.buckets)
        self._indexes: dict[str, int] = {}

    # -- ingest --

    def enqueue(self, docs: DataFrame, track: str = "track") -> str:
        """Queue ``ord, content, file_path, id?, time_label?, created_at?``; returns the track id."""
        if "created_at" not in docs.columns:
            docs = docs.withColumn("created_at", F.current_timestamp())
        if "time_label" not in docs.columns:
            docs = docs.withColumn("time_label", F.lit(None).cast("string"))
        scratch = Scratch(self.spark, "enqueue")
        full, status = S.enqueue(docs, self.store.read("doc_status"), track)
        made = X.record_id("doc-", X.sanitize(F.col("content")))
        labels = docs.select((F.coalesce(F.when(F.length("id") > 0, F.col("id")), made) if "id" in docs.columns else made).alias("id"), "time_label", "ord")
        labels = S.latest(labels, "id", F.col("ord")).select("id", "time_label")
        status = scratch.save(status.join(labels, "id", "left").withColumns({"chunks_count": F.lit(None).cast("int"), "error_msg": F.lit(None).cast("string")}))
        self.store.append("full_docs", full)
        self.store.append("doc_status", status)
        return track

    def _chunks(self, docs: DataFrame) -> DataFrame:
        """``id, chunk_order_index, tokens, content`` of the documents by the configured chunking."""
        cfg = self.config
        if cfg.chunker:
            return C.chunked(docs, "id", "content", cfg.chunker, cfg.tokenize)
        return C.with_tables(docs, "id", "content", cfg.chunk_tokens, cfg.chunk_overlap, tokenizer=cfg.tokenize)

    def process(self) -> None:
        """Chunk, extract and reduce every unfinished document; only touched keys are reduced again."""
        scratch = Scratch(self.spark, "process")
        status = self.store.read("doc_status")
        pending = scratch.save(status.where("status IN ('pending', 'processing', 'failed')"))
        texts = pending.select("id", "file_path", "time_label").join(self.store.read("full_docs"), "id")
        if texts.limit(1).count() == 0:
            return
        cut = self._chunks(texts).join(texts.select("id", "file_path", "time_label"), "id").withColumnRenamed("id", "doc")
        new = cut.select(X.record_id("chunk-", F.col("content")).alias("id"), "content", "tokens", "chunk_order_index", F.col("doc").alias("full_doc_id"), "file_path", "time_label")
        new = scratch.save(S.latest(new, "id", F.desc("full_doc_id"), F.desc("chunk_order_index")))
        self.store.upsert("text_chunks", new)
        self._extract(new)
        counts = new.groupBy(F.col("full_doc_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
        done = scratch.save(pending.join(self.store.read("full_docs").select("id"), "id", "left_semi").join(counts, "id", "left"))
        done = done.withColumns({"status": F.lit("processed"), "chunks_count": F.coalesce("_n", F.lit(0)), "updated_at": F.current_timestamp()})
        self.store.upsert("doc_status", scratch.save(done.drop("_n")))

    def insert(self, docs: DataFrame, track: str = "track") -> str:
        self.enqueue(docs, track)
        self.process()
        return track

    def statuses(self, of: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
        return S.page(self.store.read("doc_status"), of, number, size)

    def insert_custom_chunks(self, chunks: DataFrame, doc: str, file_path: str = "custom_chunks") -> None:
        """Ready-made chunks ``content, chunk_order_index`` of a document; those already stored are left out."""
        scratch = Scratch(self.spark, "custom")
        rows = K.chunk_rows(chunks.withColumns({"file_path": F.lit(file_path), "source_id": F.lit(doc)}), doc).withColumn("time_label", F.lit(None).cast("string"))
        rows = K.new_chunks(S.latest(rows, "id", F.col("chunk_order_index")), self.store.read("text_chunks").select(F.col("full_doc_id").alias("id")), self.store.read("text_chunks"))
        rows = scratch.save(rows.select(*self.store.columns("text_chunks")))
        self.store.append("text_chunks", rows)
        self._extract(rows)

    def insert_custom_graph(self, chunks: DataFrame, entities: DataFrame, relations: DataFrame, doc: str = "custom") -> None:
        """Ready-made chunks, entities and relations; no model is asked for records."""
        scratch = Scratch(self.spark, "custom")
        rows, nodes, edges = K.load(chunks, entities, relations, doc)
        rows = scratch.save(rows.withColumn("time_label", F.lit(None).cast("string")).select(*self.store.columns("text_chunks")))
        told = {"full_doc_id": F.lit(doc), "file_path": F.lit("custom_kg")}
        ent = scratch.save(nodes.withColumns({**told, "ord": F.concat_ws("|", F.lit(doc), "entity_name")}).select(*self.store.columns("entity_mentions")))
        rel = edges.withColumnsRenamed({"src": "src_id", "tgt": "tgt_id"}).withColumns({**told, "ord": F.concat_ws("|", F.lit(doc), "src_id", "tgt_id")})
        rel = scratch.save(rel.select(*self.store.columns("relation_mentions")))
        self.store.upsert("text_chunks", rows)
        self.store.append("entity_mentions", ent)
        self.store.append("relation_mentions", rel)
        self._reduce(ent.select("entity_name").distinct(), _pairs(rel))
        self._index_chunks(rows)

    def _extract(self, chunks: DataFrame) -> None:
        """Ask for records of the written ``chunks``, again for malformed and for missed ones, and reduce what they touch."""
        cfg = self.config
        scratch = Scratch(self.spark, "extract")  # the model is asked once a round
        base = chunks.select("id", "content", "full_doc_id", "file_path", "time_label")
        ask, found = base.withColumn("_p", F.col("content")), None
        keys = (["source_id", "entity_name"], ["source_id", "src_id", "tgt_id"])

        def told(ask: DataFrame, round_: int) -> DataFrame:
            nonlocal found
            recs = scratch.save(E.records(E.ask(ask, cfg.generate, "_p"), "answer").drop("answer", "_p"))
            place = F.lpad((F.col("ord") + round_ * 10_000_000).cast("string"), 9, "0")
            rows = recs.drop("content").withColumn("source_id", F.col("id")).withColumn("ord", F.concat_ws("|", "full_doc_id", "id", place))
            new = (E.entities(rows, "time_label"), E.relations(rows, "time_label"))
            found = new if found is None else tuple(E.gleaned(f, n, k) for f, n, k in zip(found, new, keys))
            return recs

        for round_ in range(1 + RETRIES):
            recs = told(ask, round_)
            bad = E.malformed(recs).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.array_join("fields", E.FIELD))), "\n").alias("_b"))
            if bad.limit(1).count() == 0:
                break
            ask = scratch.save(base.join(bad, "id").withColumn("_p", F.concat("content", F.lit(AGAIN), "_b")).drop("_b"))
        for round_ in range(cfg.glean_rounds):
            names = found[0].groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("entity_name")), "\n").alias("_f"))
            told(scratch.save(base.join(names, "id", "left").withColumn("_p", F.concat("content", F.lit(MISSED), F.coalesce("_f", F.lit("")))).drop("_f")), 1 + RETRIES + round_)
        ent, rel = (scratch.save(f.select(*self.store.columns(n))) for f, n in zip(found, ("entity_mentions", "relation_mentions")))
        again = chunks.select(F.col("id").alias("source_id"))
        before_ent = scratch.save(self.store.read("entity_mentions").join(again, "source_id", "left_semi").select("entity_name").distinct())
        before_rel = scratch.save(_pairs(self.store.read("relation_mentions").join(again, "source_id", "left_semi")))
        self.store.replace("entity_mentions", again, ["source_id"], ent)
        self.store.replace("relation_mentions", again, ["source_id"], rel)
        self._reduce(before_ent.union(ent.select("entity_name")).distinct(), before_rel.union(_pairs(rel)).distinct())
        self._index_chunks(chunks)

    def _told_once(self, mentions: DataFrame, key: str, rows: DataFrame, on: list[str]) -> DataFrame:
        """Rows with the summaries of descriptions that are too long to be joined, where a model is configured."""
        if self.config.summarize is None:
            return rows
        first = mentions.where("description <> ''").groupBy(key, "description").agg(F.min("ord").alias("ord"))
        told = D.summarize(first, key, "ord", "description", self.config.summarize, X.SEP)
        return rows.withColumn(key, F.concat_ws(_PAIR, *on)).join(told, key, "left").withColumn("description", F.coalesce("summary", "description")).drop("summary", *({key} - set(on)))

    def _reduce(self, names: DataFrame, pairs: DataFrame) -> None:
        """Reduce the touched names and pairs again from all their mentions."""
        store, cfg = self.store, self.config
        scratch = Scratch(self.spark, "reduce")
        pairs = scratch.save(pairs)
        m = store.read("relation_mentions").withColumns({"src": F.least("src_id", "tgt_id"), "tgt": F.greatest("src_id", "tgt_id")}).join(pairs, ["src", "tgt"], "left_semi")
        m = m.withColumn("_k", F.concat_ws(_PAIR, "src", "tgt"))
        made = self._told_once(m, "_k", R.merge_edges(m.drop("src", "tgt", "_k")), ["src", "tgt"])
        made = scratch.save(made.select(*store.columns("edges")))
        store.replace("edges", pairs, ["src", "tgt"], made)
        touched = scratch.save(names.union(pairs.select(F.explode(F.array("src", "tgt")).alias("entity_name"))).distinct())
        e = store.read("entity_mentions").join(touched, "entity_name", "left_semi")
        own = scratch.save(self._told_once(e, "entity_name", R.merge_nodes(e), ["entity_name"]).select(*store.columns("nodes")))
        near = store.read("edges").join(touched.toDF("src"), "src", "left_semi").union(store.read("edges").join(touched.toDF("tgt"), "tgt", "left_semi").select(*store.columns("edges"))).distinct()
        known = own.select("entity_name").union(store.read("nodes").join(touched, "entity_name", "left_anti").select("entity_name"))
        lost = R.missing_endpoints(near, known)
        if cfg.describe:
            asked = lost.drop("entity_type").withColumn("_p", F.concat_ws("\n", "entity_name", "description"))
            lost = D.describe_orphans(asked.withColumnRenamed("description", "_d"), list(cfg.entity_types), cfg.describe, "_p")
            lost = lost.withColumn("description", F.when(F.col("description") != "", F.col("description")).otherwise(F.col("_d")))
        lost = lost.withColumns({"mentions": F.lit(0).cast("bigint"), "file_path": F.lit(X.UNKNOWN_SOURCE)})
        nodes = scratch.save(own.unionByName(lost.select(*store.columns("nodes"))))
        store.replace("nodes", touched, ["entity_name"], nodes)
        self._index(touched, nodes, pairs, made)

    def _index(self, names: DataFrame, nodes: DataFrame, pairs: DataFrame, edges: DataFrame) -> None:
        """Vectors of the touched rows; a row whose content is unchanged keeps its vector."""
        scratch = Scratch(self.spark, "index")
        ent = nodes.select(X.record_id("ent-", F.col("entity_name")).alias("id"), "entity_name", F.concat_ws("\n", "entity_name", "description").alias("content"))
        rel = edges.select(X.record_id("rel-", F.col("src"), F.col("tgt")).alias("id"), "src", "tgt", F.concat(F.coalesce("keywords", F.lit("")), F.lit("\t"), "src", F.lit("\n"), "tgt", F.lit("\n"), F.coalesce("description", F.lit(""))).alias("content"))
        gone_ent = scratch.save(names.select(X.record_id("ent-", F.col("entity_name")).alias("id")))
        gone_rel = scratch.save(pairs.select(X.record_id("rel-", F.col("src"), F.col("tgt")).alias("id")))
        for name, rows, gone in (("vdb_entities", ent, gone_ent), ("vdb_relationships", rel, gone_rel)):
            old = self.store.read(name).join(gone, "id", "left_semi").select("id", "content", "vector").dropDuplicates(["id"])
            kept = rows.join(old, ["id", "content"])
            fresh = V.embed(rows.join(old.select("id", "content"), ["id", "content"], "left_anti"), self.config.embed, "content")
            self.store.replace(name, gone, ["id"], scratch.save(kept.unionByName(fresh.select(*kept.columns))))

    def _index_chunks(self, chunks: DataFrame) -> None:
        scratch = Scratch(self.spark, "index")
        new = chunks.select("id", "full_doc_id", "content").dropDuplicates(["id"])
        self.store.upsert("vdb_chunks", scratch.save(V.embed(new, self.config.embed, "content").select(*self.store.columns("vdb_chunks"))))

    def discover_types(self, model, least: int = 1) -> DataFrame:
        """Entity types that a model suggests for the stored chunks, with how many name each."""
        return D.discover_types(self.store.read("text_chunks"), model, "content", least)

    # -- query --

    def _vector(self, text: str) -> list[float]:
        return self.config.embed([text])[0]

    def _tokens(self, text: str) -> int:
        return len((self.config.tokenize or X.default_spans)(text))

    def build_index(self, name: str) -> int:
        """Index a vector table for searches; it serves until the table changes. The number of its lists."""
        rows, (version, _) = self.store.read(name), self.store._manifest(name)
        head = rows.where("vector IS NOT NULL").select(F.size("vector")).first()
        if head is None:
            return 0
        made = I.build(rows, f"{self.store.root}/index/{name}/{version}", head[0])
        self._indexes[name] = version
        return made

    def search(self, name: str, vector: list[float], k: int) -> DataFrame:
        """The most similar rows of a vector table: by its index where one is up to date, else by a scan with a top-k in each task."""
        version = self.store._manifest(name)[0]
        if self._indexes.get(name) == version:
            return I.search(self.spark, f"{self.store.root}/index/{name}/{version}", vector, k, threshold=self.config.cosine_threshold)
        return V.top_k(self.store.read(name), vector, k, "id", threshold=self.config.cosine_threshold)

    def keywords(self, query: str, param: QueryParam) -> QueryParam:
        """The parameters with the query's keywords; those given by the caller stay."""
        p = param
        if p.hl_keywords or p.ll_keywords:
            return p
        said = {}
        if self.config.keywords:
            answer = self.config.keywords([query])[0] or ""
            try:
                said = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
            except ValueError:
                said = {}
        read = lambda k: tuple(str(x) for x in said.get(k) or () if x)
        high, low = read("high_level_keywords"), read("low_level_keywords")
        if not high and not low and len(query) < 50:
            low = (query,)
        return replace(p, hl_keywords=high, ll_keywords=low)

    def retrieve(self, query: str, param: QueryParam | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(entities, relations, chunks)`` in order of ``pos``, within the token budgets."""
        p = self.keywords(query, param or QueryParam())
        store, cfg = self.store, self.config
        scratch = Scratch(self.spark, "retrieve")
        low, high = " ".join(p.ll_keywords) or query, " ".join(p.hl_keywords) or query
        nodes, edges = store.read("nodes"), store.read("edges")
        ent_lists, rel_lists, chunk_lists = [], [], []
        if p.mode in ("local", "hybrid", "mix"):
            hit = self.search("vdb_entities", self._vector(low), p.top_k)
            seeds = _place(hit.select("entity_name", "score"), F.desc("score"), "entity_name")
            ent_lists.append(seeds.select("entity_name", "rank"))
            inner = G.best(G.induced(edges, seeds), p.top_k)
            rel_lists.append(_place(inner, F.desc("rank"), F.desc("weight"), "src", "tgt").select("src", "tgt", "rank"))
        if p.mode in ("global", "hybrid", "mix"):
            hit = self.search("vdb_relationships", self._vector(high), p.top_k)
            rel = _place(hit.select("src", "tgt", "score"), F.desc("score"), "src", "tgt")
            rel_lists.append(rel.select("src", "tgt", "rank"))
            ends = G.endpoints_in_order(rel.withColumnRenamed("rank", "ord"))
            ent_lists.append(_place(ends, "first").select("entity_name", "rank"))
        if p.mode in ("naive", "mix"):
            hit = self.search("vdb_chunks", self._vector(query), p.chunk_top_k or p.top_k)
            chunk_lists.append(_place(hit, F.desc("score"), "id").select("id", "rank"))
        if ent_lists:
            ents = Q.round_robin(["entity_name"], *ent_lists).withColumnRenamed("rank", "_k")
            ents = scratch.save(_place(ents, "_k", "source").select("entity_name", F.col("rank").cast("bigint").alias("pos"), F.lit("query").alias("method")))
            rels = _place(Q.round_robin(["src", "tgt"], *rel_lists).withColumnRenamed("rank", "_k"), "_k", "source").select("src", "tgt", F.col("rank").cast("bigint").alias("pos"))
            ents, rels = self._expand(ents, scratch.save(rels), edges, low, high, p)
        else:
            ents = nodes.select("entity_name", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("method")).limit(0)
            rels = edges.select("src", "tgt", F.lit(0).cast("bigint").alias("pos")).limit(0)
        entities = ents.join(nodes, "entity_name").join(G.node_degree(edges, ents).withColumnRenamed("degree", "rank"), "entity_name")
        entities = scratch.save(Q.mentions_budget(entities, "description", p.max_entity_tokens, F.col("pos"), F.col("entity_name"), tokenizer=cfg.tokenize))
        relations = Q.mentions_budget(rels.join(edges, ["src", "tgt"]), "description", p.max_relation_tokens, F.col("pos"), F.col("src"), F.col("tgt"), tokenizer=cfg.tokenize)
        relations = scratch.save(relations)
        if p.enable_recognition and cfg.recognize and ent_lists:
            numbered = relations.withColumn("pos", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos", "src", "tgt")) - 1).cast("bigint"))  # at most the budget's rows
            relations = scratch.save(Q.recognize(scratch.save(numbered), query, cfg.recognize, p.recognition_batch_size).select(*relations.columns))
            ends = relations.select(F.explode(F.array("src", "tgt")).alias("entity_name")).distinct()
            if relations.limit(1).count():
                entities = scratch.save(entities.join(ends, "entity_name", "left_semi"))
        if ent_lists:
            c = G.related_chunks(entities.withColumn("source_id", _first(F.col("source_id"), p.related_chunk_number)), "pos")
            chunk_lists.append(_place(c, F.desc("occurrences"), "first", "id").select("id", "rank"))
            r = G.related_chunks(relations.withColumn("source_id", _first(F.col("source_id"), p.related_chunk_number)), "pos").join(c.select("id"), "id", "left_anti")
            chunk_lists.append(_place(r, F.desc("occurrences"), "first", "id").select("id", "rank"))
        order = _place(Q.round_robin(["id"], *chunk_lists).withColumnRenamed("rank", "_k"), "_k", "source").select("id", F.col("rank").alias("pos"))
        found = order.join(store.read("text_chunks"), "id")
        if p.enable_rerank and cfg.rerank:
            found = Q.rerank(found, lambda texts: cfg.rerank(query, texts), "content")
        else:
            found = found.withColumn("score", F.lit(None).cast("double"))
        used = lambda d: d.agg(F.coalesce(F.sum(X.n_tokens(F.concat_ws(" ", *[c for c in ("entity_name", "src", "tgt", "keywords", "description") if c in d.columns]), cfg.tokenize)), F.lit(0))).first()[0]
        budget = Q.chunk_budget(p.max_total_tokens, used(entities), used(relations), self._tokens(self._prompt(query, "", p)))
        chunks = Q.process_chunks(found, 0.0, p.chunk_top_k, budget)
        return entities, relations, chunks

    def _expand(self, ents: DataFrame, rels: DataFrame, edges: DataFrame, low: str, high: str, p: QueryParam) -> tuple[DataFrame, DataFrame]:
        """Entities and relations of the query, then those that hops, PageRank and structure bring, in that order."""
        if not (p.max_hop or p.top_ppr_nodes or p.top_fastrp_nodes):
            return ents, rels
        scratch = Scratch(self.spark, "expand")
        esim = scratch.save(V.scored(self.store.read("vdb_entities"), self._vector(low)).select("entity_name", F.col("score").alias("sim")))
        rsim = scratch.save(V.scored(self.store.read("vdb_relationships"), self._vector(high)).select("src", "tgt", F.col("score").alias("sim")))
        more: list[tuple[str, DataFrame]] = []
        paths = None
        if p.max_hop:
            hop = scratch.save(Q.multi_hop(edges, ents, esim, rsim, p.max_hop, p.top_neighbors, p.multi_hop_relevance_threshold))
            paths = hop.select(F.least("via", "entity_name").alias("src"), F.greatest("via", "entity_name").alias("tgt"), "hop", "score")
            more.append(("multihop", _place(hop, "hop", F.desc("score"), "entity_name")))
        if p.top_ppr_nodes:
            best = Q.query_aware_pagerank(edges, ents, esim, rsim, p.top_ppr_nodes, self.config.pagerank_iterations).withColumnRenamed("rank", "score")
            more.append(("ppr", _place(best, F.desc("score"), "entity_name")))
        if p.top_fastrp_nodes:
            score = Q.structural_scores(Q.fastrp(edges, self.config.fastrp_dim), ents)
            more.append(("fastrp", _place(score.orderBy(F.desc("score"), "entity_name").limit(p.top_fastrp_nodes), F.desc("score"), "entity_name")))
        found = scratch.save(Q.merge_entities(*more).join(ents.select("entity_name"), "entity_name", "left_anti"))
        places = [d.select("entity_name", (F.lit(1_000_000 * (i + 1)) + F.col("rank")).cast("bigint").alias("pos")) for i, (_, d) in enumerate(more)]
        first = places[0]
        for d in places[1:]:
            first = first.unionByName(d)
        pos = first.groupBy("entity_name").agg(F.min("pos").alias("pos"))
        every = scratch.save(ents.unionByName(found.join(pos, "entity_name").select("entity_name", "pos", F.col("discovery_method").alias("method"))))
        lists = [rels.select("src", "tgt"), *([paths.select("src", "tgt")] if paths is not None else []), G.induced(edges, every)]
        merged = Q.merge_relations(*lists).join(rels, ["src", "tgt"], "left").join(G.edge_degree(edges).select("src", "tgt", "degree", F.col("weight").alias("_w")), ["src", "tgt"])
        ranked = _place(merged, "source", F.asc_nulls_last("pos"), F.desc("degree"), F.desc("_w"), "src", "tgt").select("src", "tgt", F.col("rank").cast("bigint").alias("pos"))
        return every, ranked

    def history(self, p: QueryParam) -> str:
        """The last ``history_turns`` pairs of the conversation."""
        if not p.history_turns or not p.conversation:
            return ""
        rows = [(0, i, role, text) for i, (role, text) in enumerate(p.conversation)]
        told = T.turns(self.spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), p.history_turns)
        return told.first()["history"]

    def _prompt(self, query: str, context: str, p: QueryParam) -> str:
        history = self.history(p)
        before = f"{history}\n\n" if history else ""
        return f"{p.user_prompt}\n\n{before}{context}\n\nQuestion: {query}\nAnswer as: {p.response_type}"

    def query(self, query: str, param: QueryParam | None = None) -> Answer:
        """The answer and its context; cached by the query and all settings."""
        p = param or QueryParam()
        if p.mode == "bypass":
            return Answer(self.config.generate([f"{self.history(p)}\n\n{query}" if self.history(p) else query])[0], "")
        digest = p.digest(query)
        hit = self.store.read("llm_response_cache").where(F.col("digest") == digest).first()
        if hit:
            return Answer(hit["answer"], hit["context"])
        entities, relations, chunks = self.retrieve(query, p)
        part = lambda d, cols, *o: d.transform(lambda x: Q.render(x, cols, *o, form=p.context_format)).first()[0] or ""
        context = "\n\n".join(
            [
                "Entities\n" + part(entities, ["entity_name", "entity_type", "description", "rank"], F.col("pos"), F.col("entity_name")),
                "Relations\n" + part(relations, ["src", "tgt", "keywords", "description", "weight"], F.col("pos"), F.col("src")),
                "Chunks\n" + part(chunks, ["content", "file_path"], F.col("pos")),
            ]
        )
        if p.only_need_context:
            return Answer("", context)
        prompt = self._prompt(query, context, p)
        if p.only_need_prompt:
            return Answer(prompt, context)
        answer = self.config.generate([prompt])[0]
        self.store.append("llm_response_cache", self.spark.createDataFrame([(digest, answer, context)], "digest string, answer string, context string"))
        return Answer(answer, context)

    def clear_cache(self) -> None:
        self.store.drop("llm_response_cache")

    # -- maintenance --

    def delete_document(self, doc: str) -> bool:
        """Delete a document, its chunks and mentions; reduce again only what they touched."""
        store = self.store
        scratch = Scratch(self.spark, "delete")  # a document may hold a tenth of all rows: nothing comes to the driver
        if not M.exists(store.read("doc_status"), F.col("id") == doc):
            return False
        gone = scratch.save(store.read("text_chunks").where(F.col("full_doc_id") == doc).select(F.col("id").alias("source_id")))
        names = scratch.save(store.read("entity_mentions").join(gone, "source_id", "left_semi").select("entity_name").distinct())
        pairs = scratch.save(_pairs(store.read("relation_mentions").join(gone, "source_id", "left_semi")))
        ids = gone.select(F.col("source_id").alias("id"))
        store.replace("entity_mentions", gone, ["source_id"])
        store.replace("relation_mentions", gone, ["source_id"])
        store.replace("text_chunks", ids, ["id"])
        store.replace("vdb_chunks", ids, ["id"])
        self._reduce(names, pairs)
        one = self.spark.createDataFrame([(doc,)], "id string")
        store.replace("full_docs", one, ["id"])
        store.replace("doc_status", one, ["id"])
        return True

    def _rename(self, to: DataFrame) -> None:
        """Replace ``old`` names by ``new`` ones (a written table) in all mentions and reduce what that touches."""
        store = self.store
        scratch = Scratch(self.spark, "rename")
        put = lambda d, c: d.join(to.toDF(c, "_n"), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        touched = scratch.save(to.select(F.explode(F.array("old", "new")).alias("entity_name")).distinct())
        near = G.adjacency(store.read("edges"), touched)
        old = scratch.save(near.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct())
        hit = store.read("entity_mentions").join(to.select(F.col("old").alias("entity_name")), "entity_name", "left_semi").select("source_id")
        ent = scratch.save(hit.distinct())
        store.replace("entity_mentions", ent, ["source_id"], scratch.save(put(store.read("entity_mentions").join(ent, "source_id", "left_semi"), "entity_name")))
        ends = store.read("relation_mentions").select("source_id", F.explode(F.array("src_id", "tgt_id")).alias("old")).join(to, "old", "left_semi").select("source_id")
        rel = scratch.save(ends.distinct())
        changed = put(put(store.read("relation_mentions").join(rel, "source_id", "left_semi"), "src_id"), "tgt_id").where("src_id <> tgt_id")
        store.replace("relation_mentions", rel, ["source_id"], scratch.save(changed))
        new = put(put(old, "src"), "tgt").where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"))
        self._reduce(touched, old.union(new).distinct())

    def merge(self, sources: list[str], target: str) -> None:
        """Merge entities into a target; their mentions follow, so later rebuilds agree."""
        rows = [(s, target) for s in sources if s != target]
        if rows:
            self._rename(self.spark.createDataFrame(rows, "old string, new string"))

    def rename_entity(self, old: str, new: str) -> None:
        """An entity under a new name; an error when that name is taken."""
        nodes = self.store.read("nodes")
        if not M.exists(nodes, F.col("entity_name") == old):
            raise KeyError(old)
        if M.exists(nodes, F.col("entity_name") == new):
            raise ValueError(f"{new} exists")
        self.merge([old], new)

    def merge_duplicates(self, rounds: int | None = None) -> int:
        """Find similar entities, let the decision log and the model judge them, merge, embed anew, and repeat until stable."""
        cfg, done = self.config, 0
        for _ in range(cfg.merge_rounds if rounds is None else rounds):
            scratch = Scratch(self.spark, "duplicates")
            rows = scratch.save(self.store.read("vdb_entities").select("entity_name", "content", "vector", F.xxhash64("id").alias("n")))
            head = rows.where("vector IS NOT NULL").select(F.size("vector")).first()
            if head is None:
                break
            found = V.near_pairs(rows, "n", "vector", cfg.merge_threshold, head[0])
            side = lambda c: rows.select(F.col("n").alias(c), F.col("entity_name").alias(f"n{c}"), F.col("content").alias(f"t{c}"), F.md5("content").alias(f"h{c}"))
            both = found.join(side("a"), "a").join(side("b"), "b")
            first = F.col("na") < F.col("nb")
            pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
            pairs = scratch.save(both.select(pick("na", "nb").alias("a"), pick("nb", "na").alias("b"), pick("ha", "hb").alias("hash_a"), pick("hb", "ha").alias("hash_b"), pick("ta", "tb").alias("text_a"), pick("tb", "ta").alias("text_b"), "score"))
            merge, _, ask = M.merge_decisions(pairs, self.store.read("merge_log"))
            if cfg.decide:
                prompt = F.concat_ws("\n\n", "text_a", "text_b")
                judged = scratch.save(E.ask(ask.withColumn("_p", F.concat(prompt, F.lit(UNITED))), cfg.decide, "_p", "said").drop("_p"))
            else:  # the threshold alone decides
                judged = scratch.save(ask.withColumn("said", F.lit("yes")))
            yes = F.lower(F.trim("said")).startswith("yes")
            log = judged.select("a", "b", "hash_a", "hash_b", F.when(yes, "merged").otherwise("skipped").alias("decision"), F.current_timestamp().alias("decided_at"))
            self.store.append("merge_log", scratch.save(log))
            chosen = scratch.save(M.greedy_matching(merge.select("a", "b", "score").unionByName(judged.where(yes).select("a", "b", "score"))))
            if chosen.limit(1).count() == 0:
                break
            self._rename(scratch.save(chosen.select(F.col("b").alias("old"), F.col("a").alias("new"))))
            done += 1
        return done

    def _vectors_of(self, names: DataFrame, pairs: DataFrame) -> None:
        nodes = self.store.read("nodes").join(names, "entity_name", "left_semi")
        edges = self.store.read("edges").join(pairs, ["src", "tgt"], "left_semi")
        self._index(names, nodes, pairs, edges)

    def _no_names(self) -> DataFrame:
        return self.spark.createDataFrame([], "entity_name string")

    def _no_pairs(self) -> DataFrame:
        return self.spark.createDataFrame([], "src string, tgt string")

    def edit_entity(self, name: str, changes: dict) -> None:
        """Set attributes of an entity and embed it again; a later rebuild from mentions replaces them."""
        rows = self.store.read("nodes").where(F.col("entity_name") == name)
        if not M.exists(rows, F.lit(True)):
            raise KeyError(name)
        new = Scratch(self.spark, "edit").save(rows.withColumns({k: F.lit(v) for k, v in changes.items()}))
        self.store.upsert("nodes", new)
        self._vectors_of(self.spark.createDataFrame([(name,)], "entity_name string"), self._no_pairs())

    def edit_relation(self, a: str, b: str, changes: dict) -> None:
        """Set attributes of a relation and embed it again."""
        src, tgt = sorted((a, b))
        rows = self.store.read("edges").where((F.col("src") == src) & (F.col("tgt") == tgt))
        if not M.exists(rows, F.lit(True)):
            raise KeyError((a, b))
        new = Scratch(self.spark, "edit").save(rows.withColumns({k: F.lit(v) for k, v in changes.items()}))
        self.store.upsert("edges", new)
        self._vectors_of(self._no_names(), self.spark.createDataFrame([(src, tgt)], "src string, tgt string"))

    def create_entity(self, name: str, entity_type: str, description: str) -> None:
        if M.exists(self.store.read("nodes"), F.col("entity_name") == name):
            raise ValueError(f"{name} exists")
        self._mention([(name, entity_type, description, "manual", "manual", None, name)], [])

    def create_relation(self, a: str, b: str, description: str, keywords: str = "", weight: float = 1.0) -> None:
        src, tgt = sorted((a, b))
        for x in (a, b):
            if not M.exists(self.store.read("nodes"), F.col("entity_name") == x):
                raise KeyError(x)
        if M.exists(self.store.read("edges"), (F.col("src") == src) & (F.col("tgt") == tgt)):
            raise ValueError(f"{a}, {b} exist")
        self._mention([], [(src, tgt, weight, keywords, description, "manual", "manual", None, f"{src}|{tgt}")])

    def _mention(self, ent: list, rel: list) -> None:
        from weftgraph.tables import SCHEMAS

        e, r = self.spark.createDataFrame(ent, SCHEMAS["entity_mentions"]), self.spark.createDataFrame(rel, SCHEMAS["relation_mentions"])
        self.store.append("entity_mentions", e)
        self.store.append("relation_mentions", r)
        self._reduce(e.select("entity_name"), _pairs(r))

    def delete_entity(self, name: str) -> bool:
        """An entity with its mentions and relations."""
        store = self.store
        if not M.exists(store.read("nodes"), F.col("entity_name") == name):
            return False
        scratch = Scratch(self.spark, "delete")
        one = self.spark.createDataFrame([(name,)], "entity_name string")
        near = scratch.save(G.adjacency(store.read("edges"), one).select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct())
        store.replace("entity_mentions", one, ["entity_name"])
        for c in ("src_id", "tgt_id"):
            store.replace("relation_mentions", one.toDF(c), [c])
        self._reduce(one, near)
        return True

    def delete_relation(self, a: str, b: str) -> bool:
        """A relation with its mentions, in either order."""
        src, tgt = sorted((a, b))
        if not M.exists(self.store.read("edges"), (F.col("src") == src) & (F.col("tgt") == tgt)):
            return False
        self.store.replace("relation_mentions", self.spark.createDataFrame([(a, b), (b, a)], "src_id string, tgt_id string"), ["src_id", "tgt_id"])
        self._reduce(self._no_names(), self.spark.createDataFrame([(src, tgt)], "src string, tgt string"))
        return True

    def entity_info(self, names: list[str]) -> DataFrame:
        return M.info(self.store.read("nodes"), self.store.read("vdb_entities"), self.spark.createDataFrame([(n,) for n in names], "entity_name string"))

    def relation_info(self, a: str, b: str) -> DataFrame:
        return G.get_edges(self.store.read("edges"), self.spark.createDataFrame([(a, b)], "a string, b string"))

    def subgraph(self, label: str = "*", depth: int = 3, most: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
        return Q.knowledge_graph(self.store.read("edges"), label, depth, most)

    def export(self, path: str, form: str = "csv", vectors: bool = False) -> None:
        """Entities and relations as ``csv``, ``md`` or ``txt``, with a column of the vectors on request; written by all executors."""
        rows = M.export_rows(self.store.read("nodes"), self.store.read("edges"))
        text = F.col("description")
        if vectors:
            ent = self.store.read("vdb_entities").select(F.lit("entity").alias("kind"), F.col("entity_name").alias("a"), F.lit("").alias("_b"), F.array_join("vector", " ").alias("vector"))
            rel = self.store.read("vdb_relationships").select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("tgt").alias("_b"), F.array_join("vector", " ").alias("vector"))
            held = ent.union(rel).union(rel.select("kind", F.col("_b"), F.col("a"), "vector")).dropDuplicates(["kind", "a", "_b"])
            rows = rows.withColumn("_b", F.coalesce("b", F.lit(""))).join(held, ["kind", "a", "_b"], "left").drop("_b")
        if form == "csv":
            rows.write.mode("overwrite").option("header", True).csv(path)
        elif form in ("md", "txt"):
            mark = "| " if form == "md" else ""
            parts = ["kind", "a", F.coalesce("b", F.lit("")), F.coalesce(text, F.lit("")), *(["vector"] if vectors else [])]
            rows.select(F.concat(F.lit(mark), F.concat_ws(" | " if form == "md" else "\t", *parts)).alias("value")).write.mode("overwrite").text(path)
        else:
            raise ValueError(f"unknown form {form}")


def _pairs(mentions: DataFrame) -> DataFrame:
    """Distinct ``src, tgt`` of relation mentions."""
    return mentions.select(F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt")).distinct()


def _place(rows: DataFrame, *order) -> DataFrame:
    """``rank`` from 1 by an order: of lists bounded by the query's settings only."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _first(sources, n: int):
    """The first ``n`` ids of a joined list."""
    return F.array_join(F.slice(F.split(sources, X.SEP), 1, n), X.SEP)
