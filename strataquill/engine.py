"""One object over the tables of snapshots: build a snapshot from a file tree, then ask.

Tables live below a folder as Parquet partitioned by snapshot_id: files, symbols, edges, communities, chunks, terms and
symbol_edges. Every method that asks returns a DataFrame; only ``build`` and ``delete`` write. One driver at a time builds a
snapshot. Jobs of one build run under a tag, so ``cancel`` stops them and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.functions import paths, text
from strataquill.operators import analyzers, graph, manifest, references, reports, retrieval, symbols
from strataquill.session import cut, ship
from strataquill.sources import snapshots
from strataquill.sources.locks import Lease
from strataquill.sources.results import Results, fingerprint
from strataquill.sources.tree import read_tree

TABLES = ("files", "symbols", "edges", "communities", "chunks", "terms", "symbol_edges")


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.columns = snapshots.layout()
        #: Steps that failed without failing what they were part of, by snapshot, or by snapshot and step.
        self.failures: dict[str, str] = {}
        self.results = Results(spark, f"{self.folder}/_results")
        ship(spark)

    def table(self, name: str, snapshot_id: str | None = None) -> DataFrame:
        return snapshots.read_as(self.spark, f"{self.folder}/{name}", self.columns[name], snapshot_id)

    def _write(self, name: str, snapshot_id: str, rows: DataFrame) -> None:
        snapshots.replace(rows.withColumn("snapshot_id", F.lit(snapshot_id)), f"{self.folder}/{name}")

    # Building ------------------------------------------------------------------------------------------------------

    def build(self, snapshot_id: str, tree: str | DataFrame, ignores: list[str] | None = None, rebuild: bool = True) -> None:
        """Fills all tables of a snapshot from a folder, or from a table with rel_path, size_bytes and content."""
        have = lambda name: snapshots.built(self.spark, f"{self.folder}/{name}", snapshot_id)
        with Lease(self.spark, f"{self.folder}/_locks/{snapshot_id}"):
            if not rebuild and have("chunks"):
                if not have("terms"):  # the statistics alone
                    self._write("terms", snapshot_id, retrieval.chunk_terms(self.table("chunks", snapshot_id)))
                return
            self._build(snapshot_id, tree, ignores)

    def _build(self, snapshot_id: str, tree: str | DataFrame, ignores: list[str] | None) -> None:
        tag = f"build-{snapshot_id}"
        self.spark.addTag(tag)
        try:
            raw = read_tree(self.spark, tree, ignores) if isinstance(tree, str) else manifest.visible(tree, ignores)
            first = F.regexp_extract(F.coalesce("content", F.lit("")), r"^[^\n]*", 0)
            told = raw.select("rel_path", "size_bytes", "content", paths.language(F.col("rel_path"), first).alias("language"), paths.category(F.col("rel_path")).alias("category"), F.sha1(F.coalesce("content", F.lit(""))).alias("checksum"), (F.col("mtime_ns") if "mtime_ns" in raw.columns else F.lit(None)).cast("long").alias("mtime_ns"))
            self._write("files", snapshot_id, told)
            files = self.table("files", snapshot_id)
            self._write("symbols", snapshot_id, symbols.symbols(files))

            code = files.where(F.col("category").isin("source", "infra"))
            nodes = graph.graph_nodes(code)
            imports = symbols.imports_of(code).unionByName(graph.script_imports(code.where(F.col("rel_path").rlike(r"\.(?:tsx?|jsx?)$"))).select("src_path", "target"))
            self._write("edges", snapshot_id, graph.build_edges(imports.distinct(), code))
            self.failures.pop(snapshot_id, None)
            try:
                pairs = cut(graph.reresolve(self.table("edges", snapshot_id).drop("snapshot_id"), nodes))
                found = cut(graph.communities(pairs, nodes))
                self._write("communities", snapshot_id, graph.absorb_singletons(found, pairs))
            except Exception as error:
                self.failures[snapshot_id] = f"communities: {error}"
            self._write("symbol_edges", snapshot_id, references.symbol_edges(code))

            # Text and settings are cut by length, code along its definitions.
            prose = files.where(F.col("category").isin("docs", "config") | F.col("language").isNull())
            parts = symbols.syntax_chunks(files.join(prose.select("rel_path"), "rel_path", "left_anti").where(~F.col("category").isin("generated", "asset", "secret-risk", "other")))
            parts = parts.join(files.select("rel_path", "category", "language"), "rel_path").select("rel_path", "category", "language", "chunk_index", text.normalize_space(F.col("content")).alias("content"))
            parts = parts.where("content <> ''").withColumn("token_estimate", text.token_estimate(F.col("content")))
            self._write("chunks", snapshot_id, retrieval.flat_chunks(prose).unionByName(parts))
            self._write("terms", snapshot_id, retrieval.chunk_terms(self.table("chunks", snapshot_id)))
        finally:
            self.spark.removeTag(tag)

    def cancel(self, snapshot_id: str) -> None:
        self.spark.interruptTag(f"build-{snapshot_id}")

    def delete(self, snapshot_ids: list[str]) -> None:
        for name in TABLES:
            snapshots.drop(self.spark, f"{self.folder}/{name}", snapshot_ids)
        self.results.drop(snapshot_ids)

    # Files ---------------------------------------------------------------------------------------------------------

    def files(self, snapshot_id: str, limit: int = 200) -> DataFrame:
        return manifest.preview(self.table("files", snapshot_id).drop("content"), limit)

    def tree(self, snapshot_id: str) -> DataFrame:
        return manifest.tree(self.table("files", snapshot_id))

    def changes(self, snapshot_id: str, before: str) -> DataFrame:
        return manifest.delta(self.table("files", snapshot_id), self.table("files", before))

    def estimate(self, snapshot_id: str) -> DataFrame:
        return manifest.estimate_tokens(self.table("files", snapshot_id))

    # Symbols -------------------------------------------------------------------------------------------------------

    def symbols(self, snapshot_id: str, prefix: str = "", limit: int = 500) -> DataFrame:
        return symbols.by_prefix(self.table("symbols", snapshot_id), prefix, limit)

    def search(self, snapshot_id: str, asked: str) -> DataFrame:
        return symbols.search(self.table("symbols", snapshot_id), asked)

    def export_symbols(self, snapshot_id: str, with_tests: bool = False) -> DataFrame:
        return symbols.export_lines(self.table("symbols", snapshot_id), snapshot_id, with_tests)

    # Graph ---------------------------------------------------------------------------------------------------------

    def edges(self, snapshot_id: str) -> DataFrame:
        return self.table("edges", snapshot_id).drop("snapshot_id")

    def central(self, snapshot_id: str) -> DataFrame:
        return graph.top_central(graph.centrality(self.edges(snapshot_id)))

    def neighbours(self, snapshot_id: str, seed: str, hops: int = 1, limit: int = 2000) -> DataFrame:
        return graph.neighbours(self.edges(snapshot_id), seed, hops, limit)

    def cycles(self, snapshot_id: str) -> DataFrame:
        return graph.cycles(self.edges(snapshot_id))

    def communities(self, snapshot_id: str) -> DataFrame:
        members = self.table("communities", snapshot_id).drop("snapshot_id")
        pairs = self.edges(snapshot_id).where(~F.col("is_external")).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()
        return graph.community_summaries(members, pairs)

    def export_graph(self, snapshot_id: str) -> DataFrame:
        return graph.export_json(self.edges(snapshot_id), self.table("communities", snapshot_id).drop("snapshot_id"), self.cycles(snapshot_id))

    # Retrieval -----------------------------------------------------------------------------------------------------

    def _asked(self, snapshot_id: str, query: str, section: str, budget: int) -> DataFrame:
        chunks = self.table("chunks", snapshot_id)
        inner = self.edges(snapshot_id).where(~F.col("is_external"))
        refs = references.file_references(self.table("symbol_edges", snapshot_id))
        members = self.table("communities", snapshot_id).select("rel_path", "community_id")
        terms = self.table("terms", snapshot_id).drop("snapshot_id") if snapshots.built(self.spark, f"{self.folder}/terms", snapshot_id) else None
        return retrieval.two_stage(chunks, query, inner, members, refs, self.central(snapshot_id), section, budget, terms, lexical=terms is None)

    def retrieve(self, snapshot_id: str, query: str, section: str = "architecture", budget: int | None = None) -> DataFrame:
        """Ranked chunks with their content, within the budget."""
        chunks = self.table("chunks", snapshot_id)
        found = self._asked(snapshot_id, query, section, retrieval.BUDGETS[section] if budget is None else budget)
        return found.join(chunks.select("rel_path", "chunk_index", "content"), ["rel_path", "chunk_index"]).orderBy(F.desc("score"), "rel_path", "chunk_index")

    def bundle(self, snapshot_id: str, query: str, section: str = "architecture", budget: int | None = None, mode: str = "hybrid", limit: int = 80) -> DataFrame:
        """The evidence bundle of a query, one row: by two stages, or, if they fail, by one pass; then ``failures`` says why."""
        budget = retrieval.BUDGETS[section] if budget is None else budget
        asked, chunks = retrieval.terms_of(query), self.table("chunks", snapshot_id)
        try:
            found = cut(retrieval.evidence(self._asked(snapshot_id, query, section, budget), chunks))
        except Exception as error:
            self.failures[f"{snapshot_id}/{section}"] = f"two stages: {error}"
            ranked = Window.orderBy(F.desc("score"), F.desc("indegree"), "rel_path")  # of thirty rows
            central = self.central(snapshot_id).select("rel_path", F.row_number().over(ranked).alias("central_rank"))
            found = retrieval.single_pass_evidence(chunks, cut(retrieval.scores_of(chunks, asked)), central, asked, section, mode, limit, budget)
        return retrieval.bundle(found, query, section, budget, mode)

    def prefetch(self, snapshot_id: str, queries: dict[str, str]) -> dict[str, DataFrame]:
        """Bundles of several sections at once (section -> query): their jobs run side by side; those that fail are left out and
        recorded in ``failures``."""
        return self._at_once(snapshot_id, {section: (lambda q=q, section=section: self.bundle(snapshot_id, q, section)) for section, q in queries.items()})

    def _at_once(self, snapshot_id: str, reads: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Reads by name, each in a scheduler pool of its own, so that a long one doesn't hold up the others."""
        from concurrent.futures import ThreadPoolExecutor

        from pyspark import inheritable_thread_target

        def read(name: str) -> DataFrame | None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"read-{name}")
            try:
                return cut(reads[name]())
            except Exception as error:
                self.failures[f"{snapshot_id}/{name}"] = str(error)
                return None
            finally:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        with ThreadPoolExecutor(4) as pool:
            found = dict(zip(reads, pool.map(inheritable_thread_target(self.spark)(read), reads), strict=True))
        return {k: v for k, v in found.items() if v is not None}

    def context(self, snapshot_id: str, characters: int = 4000) -> dict[str, DataFrame]:
        """What the sections of a report share, read at once: ``architecture`` (a bundle), ``tree``, ``documents`` and
        ``manifests`` (rel_path, content: their first chunks, cut to ``characters``). Without documents, chunks of important
        files stand for them."""
        chunks = self.table("chunks", snapshot_id)

        def named(names: tuple[str, ...], most: int) -> DataFrame:
            parts = retrieval.named_files(chunks, names, most).groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
            return parts.select("rel_path", F.substring(F.array_join(F.transform("parts", lambda x: x["content"]), "\n"), 1, characters).alias("content"))

        def documents() -> DataFrame:
            found = cut(named(retrieval.DOCUMENTS, 4))
            if not found.isEmpty():
                return found
            few = self.retrieve(snapshot_id, retrieval.NO_DOCUMENTS, "important_files")
            return few.limit(12).select("rel_path", F.substring("content", 1, 1000).alias("content"))

        return self._at_once(snapshot_id, {
            "architecture": lambda: self.bundle(snapshot_id, retrieval.STRUCTURE), "tree": lambda: self.tree(snapshot_id),
            "documents": documents, "manifests": lambda: named(retrieval.MANIFESTS, 6),
        })

    # Analysis ------------------------------------------------------------------------------------------------------

    def static(self, snapshot_id: str, name: str) -> DataFrame:
        """A static result (``risks`` or one of ``conventions``), kept until the files of the snapshot change: a section that
        is written again reads neither files nor chunks for it."""
        makers = {"risks": lambda: self.risks(snapshot_id)} | {k: (lambda k=k: self.conventions(snapshot_id)[k]) for k in ("suffixes", "folders", "styles", "layers")}
        inputs = fingerprint(self.table("files", snapshot_id).select("rel_path", "checksum"))
        return self.results.get(name, snapshot_id, inputs, {"tables": TABLES, "layout": 1}, makers[name])

    def rerun(self, snapshot_id: str, letter: str, history: DataFrame, report_id: str, answer: Callable[[str, DataFrame], dict] | None = None) -> tuple[dict, DataFrame]:
        """A section made anew from the kept static results, and the history of versions with it."""
        context = self.static(snapshot_id, "risks" if letter == "J" else "folders")
        section = reports.run_section(letter, context, answer)
        return section, reports.patched(history, report_id, letter, json.dumps(section, sort_keys=True))

    def risks(self, snapshot_id: str) -> DataFrame:
        """The findings of all detectors that didn't fail."""
        files, chunks = self.table("files", snapshot_id), self.table("chunks", snapshot_id)
        all_six = analyzers.detectors(files, self.table("symbols", snapshot_id), chunks, lambda: self.cycles(snapshot_id), self.central(snapshot_id))
        found, _ = analyzers.risk_report(all_six)
        return self.spark.createDataFrame([], "category string, severity string, title string, rank long") if found is None else found

    def conventions(self, snapshot_id: str) -> dict[str, DataFrame]:
        files, found = self.table("files", snapshot_id), self.table("symbols", snapshot_id)
        return {
            "suffixes": analyzers.suffix_histogram(found), "folders": analyzers.folder_roles(files), "styles": analyzers.class_function_style(found),
            "layers": analyzers.layer_violations(self.edges(snapshot_id)),
        }
