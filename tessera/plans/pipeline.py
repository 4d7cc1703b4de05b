"""The retrieval pipeline and the question tool."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import summary
from tessera.functions.vector import Embed, with_embedding
from tessera.operators import chunking, context, dedup, fusion, ranking, research
from tessera.plans.store import ChunkStore
from tessera.sources.tables import written


@dataclass(frozen=True)
class Settings:
    """Defaults of every stage."""

    chunking_strategy: str = "semantic"
    chunk_size: int = 1000
    chunk_overlap: int = 100
    enable_query_rewrite: bool = True
    query_rewrite_strategy: str = "multi"
    min_retrieval_results: int = 3
    min_top_score: float = 0.3
    hybrid_search: bool = True
    fusion_mode: str = "rrf"
    rrf_k: int = 60
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    rerank_top_k: int = 10
    similarity_threshold: float | None = None
    dedup_threshold: float = 0.85
    max_results: int = 10
    knowledge_store_mode: str = "supplement"


class Pipeline:
    """Queries and documents to cited contexts, for any number of queries at once.

    ``model`` is an injected language model (column to column) for rewriting,
    ``reranker`` an injected model of (query, content); both may be missing.
    """

    def __init__(self, settings: Settings, embed: Embed, model: Callable[[Column], Column] | None = None, store: ChunkStore | None = None, reranker=None):
        self.s, self.embed, self.model, self.store, self.reranker = settings, embed, model, store, reranker

    def chunks(self, docs: DataFrame) -> DataFrame:
        if self.s.chunking_strategy == "fixed":
            made = chunking.fixed_chunks(docs, self.s.chunk_size, self.s.chunk_overlap)
        else:
            made = chunking.chunker(self.s.chunking_strategy, self.embed)(docs)
        # written, as the range sort of every search reads its input twice: texts are split and embedded once
        return written(with_embedding(made, self.embed).withColumn("pos", F.struct("doc_id", "chunk_index")), "chunks")

    def _variants(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        if not self.s.enable_query_rewrite:
            return research.query_variants(queries, None, None)
        lacking = None
        if self.s.query_rewrite_strategy == "auto" and self.model is not None:
            first = self._search(queries, chunks)
            lacking = research.insufficient(queries, first, self.s.min_retrieval_results, self.s.min_top_score)
        return research.query_variants(queries, self.s.query_rewrite_strategy, self.model, lacking)

    def _search(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        mode = self.s.fusion_mode if self.s.hybrid_search else "vector"
        embedded = with_embedding(queries, self.embed, "query")
        return fusion.hybrid(embedded, chunks, 2 * self.s.rerank_top_k, mode, k=self.s.rrf_k, weights=(self.s.bm25_weight, self.s.vector_weight))

    def _finish(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """Reranks hits (query_id, pos: their order, ...) by the original query."""
        if self.reranker:
            best = ranking.rerank_by(queries, hits, self.reranker, self.s.rerank_top_k)
        else:
            best = ranking.rerank(with_embedding(queries, self.embed, "query"), hits, self.s.rerank_top_k)
        return best.drop("pos").withColumnRenamed("rerank_rank", "pos")

    def hits(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        """Reranked chunks of each query (query_id, query); stored ones come first, then those of ``docs``."""
        columns = ["query_id", "pos", "content", "source", "title", "vector_score", "bm25_score", "hybrid_score", "embedding"]
        chunks = self.chunks(docs)
        variants = self._variants(queries, chunks).withColumn("variant_id", F.struct("query_id", "variant"))
        asked = variants.select(F.col("variant_id").alias("query_id"), "query")
        found = self._search(asked, chunks)
        found = found.select(F.col("query_id.query_id").alias("query_id"), F.struct(F.lit(1).alias("side"), F.col("query_id.variant").alias("variant"), F.col("rank").cast("long").alias("rank")).alias("pos"), *columns[2:])
        if self.store is not None and self.store.filled():
            stored = self.store.retrieve(queries, 2 * self.s.rerank_top_k)
            stored = stored.select("query_id", F.struct(F.lit(0).alias("side"), F.lit(0).alias("variant"), F.col("rank").cast("long").alias("rank")).alias("pos"), *columns[2:])
            if self.s.knowledge_store_mode == "primary":
                # queries that the store answers take nothing else; the others fall through to the documents
                found = found.join(stored.select("query_id").distinct(), "query_id", "left_anti")
            found = stored.unionByName(found)
        return self._finish(queries, dedup.first_wins(found, ["query_id", "content"]))

    def process(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        """(query_id, context); a query without hits has an empty one."""
        made = context.compressed(self.hits(queries, docs), self.s.max_results, self.s.dedup_threshold, self.s.similarity_threshold, most_hits=self.s.rerank_top_k)
        return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


class QuestionTool:
    """C11: questions against the store alone."""

    def __init__(self, pipeline: Pipeline):
        self.pipeline = pipeline

    def hits(self, questions: DataFrame) -> DataFrame:
        p = self.pipeline
        variants = research.query_variants(questions, p.s.query_rewrite_strategy if p.s.enable_query_rewrite else None, p.model)
        asked = variants.select(F.struct("query_id", "variant").alias("query_id"), "query")
        found = p.store.retrieve(asked, 2 * p.s.rerank_top_k)
        found = found.withColumn("pos", F.struct(F.col("query_id.variant").alias("variant"), "rank")).withColumn("query_id", F.col("query_id.query_id"))
        return p._finish(questions, dedup.first_wins(found.drop("rank"), ["query_id", "content"]))

    def query(self, questions: DataFrame) -> DataFrame:
        """(query_id, context, sources, chunks): sources with their first title, chunks with a short text and a score."""
        hits = self.hits(questions)
        contexts = context.compressed(hits, self.pipeline.s.max_results, self.pipeline.s.dedup_threshold, most_hits=self.pipeline.s.rerank_top_k)
        named = hits.where("source <> ''").groupBy("query_id", "source").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
        sources = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "title"))).alias("sources"))
        short = F.struct("pos", summary("content").alias("content"), "source", F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.col("vector_score")).alias("score"))
        chunks = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(short)).alias("chunks"))
        return questions.join(contexts, "query_id", "left").join(sources, "query_id", "left").join(chunks, "query_id", "left")

    def search(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        """The store's hits with all four scores."""
        found = self.pipeline.store.retrieve(questions, top_k)
        return found.select("query_id", "rank", "content", "source", "title", "vector_score", "bm25_score", "hybrid_score", F.lit(0.0).alias("rerank_score"))
