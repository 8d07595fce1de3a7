"""Chunking, BM25 statistics, candidate scoring, graph expansion and packing to a token budget.

Scoring joins an inverted table (chunk, term, f) with the few query terms, so contents aren't scanned for terms; the
budget fold runs on the driver, over blocks of bounded size. Scores are rounded to 6 places before they rank, and all
orders end in (rel_path, chunk_index), so results don't depend on the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import text
from strataquill.session import cut

K1, B = 2.0, 0.75
CANDIDATES, SEEDS, MOST_NEIGHBOURS = 100, 20, 50
HINT, SYMBOL, COMMUNITY, CENTRAL, DECAY = 1.4, 1.5, 1.3, 2.6, 0.08

#: Budgets in tokens and favoured categories of the sections. (fixed values)
BUDGETS = {"architecture": 14000, "conventions": 10000, "feature_map": 14000, "important_files": 12000, "glossary": 7000}
HINTS = {
    "architecture": ("source", "config", "infra"), "conventions": ("source", "test", "config"), "feature_map": ("source", "docs"),
    "important_files": ("source", "config", "infra"), "glossary": ("source", "docs"),
}

#: File names that tell what a project is. (fixed values)
MANIFEST_NAMES = ("pyproject.toml", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg", "pom.xml", "build.gradle", "composer.json", "Gemfile", "Package.swift")
DOC_NAMES = ("README.md", "README.rst", "README.txt", "README", "CHANGELOG.md", "CONTRIBUTING.md", "ARCHITECTURE.md")

#: Files that say what a repository is, and those that say how it is built. (fixed values)
DOCUMENTS = ("README.md", "README.rst", "README.txt", "README", "CHANGELOG.md", "CONTRIBUTING.md", "ARCHITECTURE.md")
MANIFESTS = ("pyproject.toml", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg", "pom.xml", "build.gradle", "composer.json", "Gemfile", "Package.swift")

#: Queries for the structure of a repository, and for what stands in for missing documents. (fixed values)
STRUCTURE = "framework entrypoint bootstrap layer service router handler middleware folder module package structure boundary domain"
NO_DOCUMENTS = "main application entry point module class service domain model purpose"


def terms_of(query: str) -> list[str]:
    """The terms of a query; an error if there are none."""
    found = [t for t in dict.fromkeys(w.lower() for w in re.findall(text.WORD, query)) if len(t) > 1]
    if not found:
        raise ValueError("the query has no terms")
    return found


def flat_chunks(files: DataFrame) -> DataFrame:
    """rel_path, category, language, chunk_index, content, token_estimate of files (rel_path, category, language, content)."""
    clean = text.normalize_space(F.col("content"))
    # A condition on the cleaned text would clean it twice.
    told = files.where(~F.col("category").isin("generated", "asset", "secret-risk", "other")).where(F.col("content").rlike(r"(?U)\S"))
    sized = told.select(
        "rel_path", "category", "language", clean.alias("clean"), text.chunk_size(F.col("category"), F.col("language")).alias("size")
    )
    pieces = sized.select("rel_path", "category", "language", F.posexplode(text.sliding_chunks(F.col("clean"), F.col("size"))).alias("chunk_index", "content"))
    return pieces.select("rel_path", "category", "language", F.col("chunk_index").cast("long"), "content", text.token_estimate(F.col("content")).alias("token_estimate"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """The inverted table: rel_path, chunk_index, term, f, dl."""
    told = chunks.select("rel_path", "chunk_index", text.corpus_tokens(F.col("content")).alias("tokens"))
    each = told.select("rel_path", "chunk_index", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("rel_path", "chunk_index", "dl", "term").agg(F.count(F.lit(1)).alias("f"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequencies(files: DataFrame) -> DataFrame:
    """term, df of the chunks of files, and a row without a term: the number of chunks.

    A chunk has each term once, so only terms meet, and those of a map task are counted there. Chunks of files that share a
    path may be the same one to :func:`chunk_terms`; the terms of these, and of no others, meet by chunk first.
    """
    path = F.col("rel_path").alias("path")
    repeated = files.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    alone, same = files, None
    if not repeated.isEmpty():
        alone, same = (files.join(repeated, F.col("rel_path").eqNullSafe(F.col("path")), kind) for kind in ("left_anti", "left_semi"))
    of_none = F.lit(None).cast("string")
    found = flat_chunks(alone).select(F.explode(F.array_append(F.array_distinct(text.corpus_tokens(F.col("content"))), of_none)).alias("term"))
    if same is not None:
        chunks = flat_chunks(same)
        found = found.unionByName(chunk_terms(chunks).select("term")).unionByName(chunks.select(of_none.alias("term")))
    return document_frequency(found)


def corpus_stats(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """n chunks and avgdl, one row; with the inverted table no content is read."""
    if terms is not None:
        n = chunks.select("rel_path").agg(F.count(F.lit(1))).scalar()
        return terms.agg(n.alias("n"), (F.sum("f") / n).alias("avgdl"))
    return chunks.select(F.size(text.corpus_tokens(F.col("content"))).cast("long").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """Terms in at least two chunks: term, df, idf. ``stats`` has one row."""
    n = stats.select("n").scalar()
    return frequency.where("df >= 2").select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def bm25(terms: DataFrame, weights: DataFrame, stats: DataFrame, query: list[str], present: DataFrame | None = None) -> DataFrame:
    """rel_path, chunk_index, bm25 of chunks with a positive score. A term in the path scores its idf once more, even where
    the content lacks it; an empty chunk scores nothing. ``present``: the chunks with tokens, by default those in ``terms``."""
    asked = weights.where(F.col("term").isin(*query) & (F.col("idf") > 0)).select("term", "idf")
    ratio = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / stats.select("avgdl").scalar()))
    # At most as many rows as the query has terms.
    found = terms.where(F.col("term").isin(*query)).join(F.broadcast(asked), "term")
    inside = found.select("rel_path", "chunk_index", (F.col("idf") * ratio).alias("part"))
    held = asked.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf")))).scalar()
    low = F.lower(F.col("rel_path"))
    in_path = [F.contains(low, F.lit(t)) for t in query]
    hits = (terms if present is None else present).select("rel_path", "chunk_index").where(reduce(Column.__or__, in_path)).distinct()
    part = sum((F.when(hit, F.coalesce(F.try_element_at(held, F.lit(t)), F.lit(0.0))).otherwise(0.0) for t, hit in zip(query, in_path, strict=True)), F.lit(0.0))
    total = inside.unionByName(hits.select("rel_path", "chunk_index", part.alias("part"))).groupBy("rel_path", "chunk_index").agg(F.round(F.sum("part"), 6).alias("bm25"))
    return total.where("bm25 > 0")


def scores_of(chunks: DataFrame, query: list[str], terms: DataFrame | None = None) -> DataFrame:
    """rel_path, chunk_index, bm25 for a query. Without an inverted table contents are read once, and only the query's terms
    are kept of them."""
    if terms is not None:
        asked = terms.where(F.col("term").isin(*query))
        stats = corpus_stats(chunks, terms)
        return bm25(asked, idf(document_frequency(asked), stats), stats, query, terms)
    tokens = chunks.select("rel_path", "chunk_index", text.corpus_tokens(F.col("content")).alias("tokens"))
    light = cut(tokens.select("rel_path", "chunk_index", F.size("tokens").cast("long").alias("dl"), F.filter("tokens", lambda t: t.isin(*query)).alias("hits")))
    stats = light.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    counted = light.select("rel_path", "chunk_index", "dl", F.explode("hits").alias("term")).groupBy("rel_path", "chunk_index", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
    return bm25(counted, idf(document_frequency(counted), stats), stats, query, light.where("dl > 0"))


def scores_of_many(chunks: DataFrame, queries: list[list[str]], limit: int = CANDIDATES) -> DataFrame:
    """query_no, rel_path, chunk_index, bm25, rank: the best chunks of each of several queries. Contents are read once for all
    of them, and only the queries' terms are kept."""
    spark, wanted = chunks.sparkSession, sorted({t for q in queries for t in q})
    tokens = chunks.select("rel_path", "chunk_index", text.corpus_tokens(F.col("content")).alias("tokens"))
    light = cut(tokens.select("rel_path", "chunk_index", F.size("tokens").cast("long").alias("dl"), F.filter("tokens", lambda t: t.isin(*wanted)).alias("hits")))
    stats = light.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    counted = light.select("rel_path", "chunk_index", "dl", F.explode("hits").alias("term")).groupBy("rel_path", "chunk_index", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
    weights = idf(document_frequency(counted), stats).where("idf > 0").select("term", "idf")
    asked = spark.createDataFrame([(k, t) for k, q in enumerate(queries) for t in q], "query_no long, term string").join(weights, "term")
    asked = cut(asked)  # a row for each term of a query
    ratio = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / stats.select("avgdl").scalar()))
    inside = counted.join(F.broadcast(asked), "term").select("query_no", "rel_path", "chunk_index", (F.col("idf") * ratio).alias("part"))
    low = F.lower(F.col("rel_path"))
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    hits = light.where("dl > 0").select("rel_path", "chunk_index", F.explode(found).alias("term")).join(F.broadcast(asked), "term").select("query_no", "rel_path", "chunk_index", F.col("idf").alias("part"))
    total = inside.unionByName(hits).groupBy("query_no", "rel_path", "chunk_index").agg(F.round(F.sum("part"), 6).alias("bm25")).where("bm25 > 0")
    best = Window.partitionBy("query_no").orderBy(F.desc("bm25"), "rel_path", "chunk_index")
    return total.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= limit)


def lexical_scores(chunks: DataFrame, query: list[str]) -> DataFrame:
    """The fallback where there are no statistics: occurrences, in the column bm25."""
    score = text.lexical_score(F.col("content"), F.col("rel_path"), query).cast("double")
    return chunks.select("rel_path", "chunk_index", score.alias("bm25")).where("bm25 > 0")


def top(scored: DataFrame, score: str, limit: int = CANDIDATES) -> DataFrame:
    return scored.orderBy(F.desc(score), "rel_path", "chunk_index").limit(limit)


def ranked(rows: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Numbers rows that a limit has bounded."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "rel_path", "chunk_index")).cast("long"))


def expansion(seeds: DataFrame, edges: DataFrame, communities: DataFrame, references: DataFrame) -> DataFrame:
    """(seed_path, path, source) around seed files: referenced symbols' files, community members, 1-hop neighbours.

    ``edges``: src_path, dst_path, internal ones only; ``communities``: rel_path, community_id; ``references``: src_path,
    dst_path. ``seeds`` are few, so they are broadcast.
    """
    few = F.broadcast(seeds.select(F.col("rel_path").alias("seed_path")).distinct())
    other = references.join(few, F.col("src_path") == F.col("seed_path")).select("seed_path", F.col("dst_path").alias("path"), F.lit("reference").alias("source"))
    own = communities.join(few, F.col("rel_path") == F.col("seed_path")).select("seed_path", "community_id")
    near = communities.join(F.broadcast(own), "community_id").where("rel_path <> seed_path").select("seed_path", F.col("rel_path").alias("path"), F.lit("community").alias("source"))
    both = edges.select(F.col("src_path").alias("a"), F.col("dst_path").alias("b")).unionByName(edges.select(F.col("dst_path").alias("a"), F.col("src_path").alias("b")))
    hop = both.where("a <> b").join(few, F.col("a") == F.col("seed_path")).select("seed_path", F.col("b").alias("path")).distinct()
    first = hop.withColumn("__rn", F.row_number().over(Window.partitionBy("seed_path").orderBy("path"))).where(F.col("__rn") <= MOST_NEIGHBOURS)
    return other.unionByName(near).unionByName(first.select("seed_path", "path", F.lit("neighbour").alias("source"))).distinct()


def candidates(stage1: DataFrame, expanded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stage-1 chunks and all chunks of files that only the expansion reached: rel_path, chunk_index."""
    new = expanded.select(F.col("path").alias("rel_path")).distinct().join(stage1.select("rel_path").distinct(), "rel_path", "left_anti")
    return stage1.select("rel_path", "chunk_index").unionByName(chunks.join(new, "rel_path").select("rel_path", "chunk_index"))


def stage3(cands: DataFrame, chunks: DataFrame, scores: DataFrame, stage1: DataFrame, seeds: DataFrame, communities: DataFrame, central: DataFrame, section: str) -> DataFrame:
    """Candidates of a positive score, with its components."""
    files = F.broadcast(stage1.select("rel_path").distinct().withColumn("in_stage1", F.lit(True)))
    seed_communities = F.broadcast(communities.join(seeds.select("rel_path").distinct(), "rel_path").select("community_id").distinct().withColumn("near", F.lit(True)))
    near = communities.join(seed_communities, "community_id").select("rel_path", "near")
    rows = cands.join(chunks.select("rel_path", "chunk_index", "category", "token_estimate"), ["rel_path", "chunk_index"])
    rows = rows.join(scores, ["rel_path", "chunk_index"], "left").join(files, "rel_path", "left").join(near, "rel_path", "left")
    # Central files are a top list; without a limit of their own they are joined as they come.
    rows = rows.join(central.select("rel_path").distinct().withColumn("is_central", F.lit(True)), "rel_path", "left")
    base = F.coalesce("bm25", F.lit(0.0)) + F.when(F.col("category").isin(*HINTS[section]), HINT).otherwise(0.0)
    symbol, module = F.when(F.col("in_stage1"), SYMBOL).otherwise(1.0), F.when(F.col("near"), COMMUNITY).otherwise(1.0)
    rows = rows.select("rel_path", "chunk_index", "token_estimate", F.round(base, 6).alias("bm25_component"), symbol.alias("symbol_bonus"), module.alias("module_bonus"), F.when(F.col("is_central"), CENTRAL).otherwise(0.0).alias("centrality_bonus"))
    # Decimals, whose product is exact.
    product = F.col("bm25_component").cast("decimal(18,6)") * F.col("symbol_bonus").cast("decimal(3,1)") * F.col("module_bonus").cast("decimal(3,1)") + F.col("centrality_bonus").cast("decimal(3,1)")
    return rows.withColumn("score", F.round(product, 6).cast("double")).where("score > 0")


def pack(rows: DataFrame, budget: int, score: str = "score", block: int = 4096, most: int | None = None) -> DataFrame:
    """The rows that fit a token budget, best first, at most ``most``; one that would overflow is skipped and smaller ones
    may follow.

    Any number of rows: they are folded in blocks of bounded size, each of the best rows after the block before that don't
    exceed what is left of the budget. The first row of a block always fits, so blocks are at most as many as kept rows, plus
    one. Token estimates aren't negative, and (rel_path, chunk_index) is unique."""
    keys = rows.select(F.struct((-F.col(score)).alias("neg"), "rel_path", "chunk_index", F.col("token_estimate").alias("t")).alias("x"))
    fields = keys.schema["x"].dataType.fields
    used, kept, last = 0, [], None
    while most is None or len(kept) < most:
        left = keys.where(F.col("x.t") <= budget - used)
        if last is not None:
            left = left.where(F.col("x") > F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in fields]))
        found = [r["x"] for r in left.orderBy("x").limit(block).collect()]
        for x in found:
            if used + x["t"] <= budget and (most is None or len(kept) < most):
                used += x["t"]
                kept.append((x["rel_path"], x["chunk_index"]))
        if len(found) < block:
            break
        last = found[-1]
    places = rows.sparkSession.createDataFrame(kept, "rel_path string, chunk_index long")
    # A row takes a token at least or the budget bounds nothing; the places are as many as the rows kept.
    return rows.join(places, ["rel_path", "chunk_index"])


def two_stage(chunks: DataFrame, query: str, edges: DataFrame, communities: DataFrame, references: DataFrame, central: DataFrame, section: str = "architecture", budget: int | None = None, terms: DataFrame | None = None, lexical: bool = False) -> DataFrame:
    """Candidates by BM25, expansion around the best, rescoring, packing: ranked chunks within the budget. With ``lexical``,
    for corpora without statistics, occurrences stand for BM25."""
    asked = terms_of(query)
    # Scores and candidates are used again and again below.
    scores = cut(lexical_scores(chunks, asked) if lexical else scores_of(chunks, asked, terms))
    stage1 = cut(ranked(top(scores, "bm25"), "bm25"))
    seeds = stage1.where(F.col("rank") <= SEEDS)
    grown = expansion(seeds, edges, communities, references)
    # At most the chunks of the files around twenty seeds.
    rows = cut(stage3(candidates(stage1, grown, chunks), chunks, scores, stage1, seeds, communities, central, section))
    return pack(rows, BUDGETS[section] if budget is None else budget)


def evidence(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Packed rows of two stages as evidence: rel_path, chunk_index, reason_codes, score, token_estimate, excerpt."""
    grown = (F.col("symbol_bonus") > 1) | (F.col("module_bonus") > 1)
    codes = F.when(grown, F.array(F.lit("2stage-bm25"), F.lit("graph-expand"))).otherwise(F.array(F.lit("2stage-bm25")))
    held = rows.withColumn("reason_codes", codes).join(chunks.select("rel_path", "chunk_index", F.col("content").alias("excerpt")), ["rel_path", "chunk_index"])
    return held.select("rel_path", "chunk_index", "reason_codes", "score", "token_estimate", "excerpt")


def bundle(evidence: DataFrame, query: str, section: str, budget: int, mode: str = "hybrid") -> DataFrame:
    """One row: query, section, mode, budget_tokens, used_tokens and the evidences, best first. What fits a budget is few."""
    each = F.struct((-F.col("score")).alias("neg"), *evidence.columns)
    one = evidence.agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("long").alias("used_tokens"), F.sort_array(F.collect_list(each)).alias("e"))
    evidences = F.transform("e", lambda x: x.dropFields("neg")).alias("evidences")
    return one.select(F.lit(query).alias("query"), F.lit(section).alias("section"), F.lit(mode).alias("mode"), F.lit(budget).cast("long").alias("budget_tokens"), "used_tokens", evidences)


def single_pass_scores(chunks: DataFrame, scores: DataFrame, central: DataFrame, query: list[str], section: str, mode: str = "hybrid", lexical: bool = False) -> DataFrame:
    """Positive scores in one pass with their reasons; ``central``: rel_path, central_rank. Modes: hybrid, vectorless."""
    low, ranks = F.lower(F.col("rel_path")), F.col("central_rank").isNotNull()
    rows = scores.join(chunks.select("rel_path", "chunk_index", "category", "token_estimate"), ["rel_path", "chunk_index"]).join(central, "rel_path", "left")
    hinted = F.col("category").isin(*HINTS[section])
    score = F.col("bm25") + F.when(hinted, HINT).otherwise(0.0) + F.when(ranks, F.greatest(F.lit(0.0), CENTRAL - F.col("central_rank") * DECAY)).otherwise(0.0)
    codes = [F.lit("lexical-hit" if lexical else "bm25-hit"), F.when(hinted, "section-category-match"), F.when(ranks, "graph-centrality-hint")]
    if mode == "vectorless":
        score = score + F.when(ranks, 1.8).otherwise(0.0) + F.when(low.rlike("index|router|service"), 0.9).otherwise(0.0)
        codes.append(F.lit("vectorless-graph-prior"))
    else:
        hits = sum((F.when(F.contains(low, F.lit(t)), 0.6).otherwise(0.0) for t in query), F.lit(0.0))
        score = score + hits
        codes.append(F.when(hits > 0, "symbol-path-hint"))
    return rows.select("rel_path", "chunk_index", "token_estimate", F.round(score, 6).alias("score"), F.array_compact(F.array(*codes)).alias("reason_codes"))


def single_pass(chunks: DataFrame, scores: DataFrame, central: DataFrame, query: list[str], section: str, mode: str = "hybrid", limit: int = 80) -> DataFrame:
    """The best chunks of one pass, whatever their tokens."""
    return top(single_pass_scores(chunks, scores, central, query, section, mode).drop("reason_codes"), "score", max(1, min(limit, 80)))


def single_pass_evidence(chunks: DataFrame, scores: DataFrame, central: DataFrame, query: list[str], section: str, mode: str = "hybrid", limit: int = 80, budget: int | None = None, lexical: bool = False) -> DataFrame:
    """The fallback of two stages as evidence: the best chunks of one pass, those that end inside a block with the next one
    appended, that fit the budget so grown."""
    rows = single_pass_scores(chunks, scores, central, query, section, mode, lexical).drop("token_estimate")
    # What a chunk costs when grown is known without its text; texts are read for those that are kept, of which there are few.
    priced = cut(rows.join(expanded_chunks(chunks).drop("content"), ["rel_path", "chunk_index"]))
    kept = cut(pack(priced, BUDGETS[section] if budget is None else budget, most=max(1, min(limit, 80))))
    held = F.broadcast(kept.select("rel_path", "chunk_index", "expanded"))
    # The first part of an excerpt is the chunk, the second, if it grew, the next chunk.
    own = chunks.join(held, ["rel_path", "chunk_index"]).select("rel_path", "chunk_index", F.lit(0).alias("part"), "content")
    after = chunks.join(held.where("expanded").select("rel_path", (F.col("chunk_index") + 1).alias("chunk_index")), ["rel_path", "chunk_index"]).select("rel_path", (F.col("chunk_index") - 1).alias("chunk_index"), F.lit(1).alias("part"), "content")
    texts = own.unionByName(after).groupBy("rel_path", "chunk_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "\n").alias("excerpt"))
    reasons = F.when(F.col("expanded"), F.array_append("reason_codes", F.lit("boundary-expanded"))).otherwise(F.col("reason_codes")).alias("reason_codes")
    return kept.join(texts, ["rel_path", "chunk_index"]).select("rel_path", "chunk_index", reasons, "score", "token_estimate", "excerpt")


def expanded_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that seem to end inside a block get the next chunk of the file appended, once."""
    w = Window.partitionBy("rel_path").orderBy("chunk_index")
    rows = chunks.withColumn("next", F.when(F.lead("chunk_index").over(w) == F.col("chunk_index") + 1, F.lead("content").over(w)))
    grows = text.ends_open(F.col("content"), F.col("language")) & F.col("next").isNotNull()
    content = F.when(grows, F.concat("content", F.lit("\n"), "next")).otherwise(F.col("content"))
    return rows.select("rel_path", "chunk_index", grows.alias("expanded"), content.alias("content"), F.when(grows, text.token_estimate(content)).otherwise(F.col("token_estimate")).alias("token_estimate"))


def merge_bundles(bundles: DataFrame) -> DataFrame:
    """Evidence of several queries (query_no, rel_path, chunk_index, score, token_estimate): the first of each chunk stays."""
    w = Window.partitionBy("rel_path", "chunk_index").orderBy("query_no", F.desc("score"))
    return bundles.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merged_totals(bundles: DataFrame) -> DataFrame:
    """The sums of a merge of bundles (query_no, budget_tokens, used_tokens): budgets and used tokens over all queries, one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return bundles.agg(F.count(F.lit(1)).alias("n_queries"), total("budget_tokens"), total("used_tokens"))


def retrieve_many(ask: Callable[[str], DataFrame], queries: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The merged evidence of several queries, numbered in order, and the errors of those that failed; a failing query
    doesn't fail the others."""
    found, failed = None, {}
    for k, q in enumerate(queries):
        try:
            rows = cut(ask(q)).withColumn("query_no", F.lit(k).cast("long"))
        except Exception as error:
            failed[q] = str(error)
            continue
        found = rows if found is None else found.unionByName(rows)
    return (None if found is None else merge_bundles(found)), failed


def precision_by_reason(evidence: DataFrame, relevant: DataFrame, first: int = 5) -> DataFrame:
    """reason, n, precision: how many of a list's first rows with a reason code are of relevant files (rel_path)."""
    best = ranked(top(evidence, "score", first), "score").select("rel_path", F.explode("reason_codes").alias("reason"))
    marked = best.join(relevant.select("rel_path", F.lit(1).alias("hit")).distinct(), "rel_path", "left")
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("precision"))


def hit_rate(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """n_cited, n_hit, rate: how many cited files (rel_path) the evidence holds, one row."""
    held = evidence.select("rel_path", F.lit(1).alias("hit")).distinct()
    one = cited.select("rel_path").distinct().join(held, "rel_path", "left").agg(F.count(F.lit(1)).alias("n_cited"), F.count("hit").alias("n_hit"))
    return one.withColumn("rate", F.when(F.col("n_cited") > 0, F.round(F.col("n_hit") / F.col("n_cited"), 6)).otherwise(0.0))


def best_per_file(rows: DataFrame) -> DataFrame:
    """Each file's best chunk."""
    w = Window.partitionBy("rel_path").orderBy(F.desc("score"), "chunk_index")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def compare(a: DataFrame, b: DataFrame, first: int = 5) -> DataFrame:
    """Overlap and token totals of two result lists, one row."""
    mark = lambda rows, name: ranked(rows, "score").select("rel_path", "chunk_index", F.col("rank").alias(f"rank_{name}"), F.col("token_estimate").alias(f"tokens_{name}"))
    both = mark(a, "a").join(mark(b, "b"), ["rel_path", "chunk_index"], "full_outer")
    shared = (F.col("rank_a") <= first) & (F.col("rank_b") <= first)
    return both.agg(
        F.count("rank_a").alias("n_a"), F.count("rank_b").alias("n_b"), F.count_if(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()).alias("n_both"),
        F.count_if(shared).alias("n_both_first"), (F.coalesce(F.sum("tokens_b"), F.lit(0)) - F.coalesce(F.sum("tokens_a"), F.lit(0))).cast("long").alias("token_delta"),
    )


def named_files(chunks: DataFrame, endings: tuple[str, ...], limit: int) -> DataFrame:
    """Chunks of files whose paths end in a name, in any case; shortest paths first. The limit counts chunks."""
    hit = F.lit(False)
    for e in endings:
        hit = hit | F.col("rel_path").ilike(f"%{e}")
    return chunks.where(hit).orderBy(F.char_length("rel_path"), "rel_path", "chunk_index").limit(limit)


def supplement(evidence: DataFrame, limit: int = 15) -> DataFrame:
    """New evidence (ord, rel_path, excerpt) without repeats of path and first 100 characters, in order, up to a limit."""
    w = Window.partitionBy("rel_path", F.substring("excerpt", 1, 100)).orderBy("ord")
    return evidence.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").orderBy("ord").limit(limit)


def rendered(evidence: DataFrame) -> DataFrame:
    """One text of ranked evidence (rel_path, chunk_index, score, content, expanded), best first; the rows are few."""
    block = F.concat(F.lit("=== "), "rel_path", F.lit(" #"), F.col("chunk_index").cast("string"), F.lit(" ===\n"), text.excerpt(F.col("content"), F.col("expanded")))
    one = evidence.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "rel_path", "chunk_index", block.alias("block")))).alias("blocks"))
    return one.select(F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("evidence"))
