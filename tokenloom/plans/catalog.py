"""The query catalog: one callable per implemented job, taking (spark, sf_dir).

Parameters that the oracle SQL repeats (limits, k, caps) are module constants so both sides
always agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators import corpus as C
from tokenloom.operators import ledger
from tokenloom.operators import references as R
from tokenloom.operators import cells as CE
from tokenloom.operators import changes as CH
from tokenloom.operators import vectors as V
from tokenloom.operators import tree as TR
from tokenloom.operators import config as CF
from tokenloom.operators import outline as O
from tokenloom.operators import postings as PO
from tokenloom.plans import code_corpus as CC
from tokenloom.plans import domain
from tokenloom.session import discard, scratch, stored
from tokenloom.sources import index_store as IS

# Parameters of the registered queries (also used by plans/oracle.py).
ADMISSION_LIMIT = 5_000          # global daily limit for the admission query
PROJECT_LIMIT = 250              # per-project daily limit for the severity query
AS_OF = "2024-01-15 12:00:00"    # moment of the status query
EXEMPT_SOURCES = ["click"]       # sources that are neither checked nor recorded
RETRIEVAL_LIMIT = 20_000         # daily limit of the admitted retrieval
GLOBAL_CONFIG = '{"daily_limit": 150000, "theme": "dark"}'

Query = Callable[[SparkSession, str], DataFrame]


def budget_status_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.budget_status(domain.usage(spark, sf_dir), ledger.DEFAULT_DAILY_LIMIT)


def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admission(domain.usage(spark, sf_dir), ADMISSION_LIMIT)


def budget_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.budget_status(domain.usage(spark, sf_dir), PROJECT_LIMIT, scope=["project"])


def usage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage_by_source(domain.usage(spark, sf_dir))


def budget_status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every project has left on the day of the ledger's noon of 2024-01-15."""
    return ledger.status_as_of(domain.usage(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), PROJECT_LIMIT, scope=["project"])


def budget_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission with a limit per project on one shared daily total; reports of one source are exempt."""
    return ledger.admission_shared(domain.usage(spark, sf_dir), domain.project_limits(spark, sf_dir),
                                   default_limit=ADMISSION_LIMIT, exempt_sources=EXEMPT_SOURCES)


def doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fingerprints(domain.corpus(spark, sf_dir))


def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    corp = C.with_path_parts(domain.corpus(spark, sf_dir))
    return (corp.filter(C.indexable("path") & (F.col("status") == "ok"))
            .select("project", "path", "name", "ext", F.sha2("path", 256).alias("doc_id"),
                    F.length("content").cast("bigint").alias("n_chars")))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_counts(domain.corpus(spark, sf_dir))


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comment_stripped(domain.corpus(spark, sf_dir))


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = domain.read_table(spark, sf_dir, "conversations")
    return (conv.groupBy("conv_id", "role")
            .agg(F.sum(T.token_estimate("text")).cast("bigint").alias("tokens"),
                 F.count(F.lit(1)).alias("turns")))


def _matches(spark: SparkSession, sf_dir: str, word: bool = False, store: bool = False, attach: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches of all symbols: the files are scanned once into a posting index, which is then searched. With ``store`` the lines found
    are stored, and the index, which only this query knows, goes."""
    root = scratch(spark, "postings")
    PO.build(domain.corpus(spark, sf_dir), root)
    syms = stored(domain.symbol_queries(spark, sf_dir), "symbols")
    found = PO.search(spark, root, 0, syms, word, attach=attach or R.shown_columns(), store=store)
    if store:
        discard(spark, root)
    return found, syms


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = R.shown_columns()
    return R.reference_lines(_matches(spark, sf_dir, store=True, attach={k: shown[k] for k in ("display", "is_long")})[0])


def reference_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers with whole lines; what the search tool would show is a label."""
    shown = R.shown_columns()
    del shown["display"]                                                   # the result row has it
    m, syms = _matches(spark, sf_dir, store=True, attach=shown | R.header())
    return R.result_rows(m, syms, cap=R.RESULT_CAP)


def multi_symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_file(_matches(spark, sf_dir)[0])


def reference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word form of the reference search, matches per file."""
    return R.per_file(_matches(spark, sf_dir, word=True)[0])


def references_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per file in an index that was built over the corpus and brought up to date by the change feed."""
    root = scratch(spark, "postings")
    PO.build(domain.corpus(spark, sf_dir), root)
    last = domain.change_texts(spark, sf_dir)(CH.latest_change(domain.change_keys(spark, sf_dir)))
    PO.apply_changes(last, root, 1)
    return R.per_file(PO.search(spark, root, 1, stored(domain.symbol_queries(spark, sf_dir), "symbols"), attach=R.shown_columns()))


def index_cols() -> list:
    return ["project", "doc_id", "path", F.sha2("content", 256).alias("content_sha"),
            F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("label"),
            F.col("embedding").isNotNull().alias("has_embedding")]


def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = domain.vectors(spark, sf_dir)
    q = V.centroids(vec.withColumn("_all", F.lit(0)), "_all").first()
    return V.knn_single(vec, list(q["embedding"]), V.DEFAULT_K)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = domain.vectors(spark, sf_dir)
    queries = V.centroids(vec, "label").withColumnRenamed("label", "query_id")
    return V.knn_batch(vec, queries, V.DEFAULT_K)


def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from the index stored by cells, of which only those in reach are read."""
    vec = domain.vectors(spark, sf_dir)
    path = scratch(spark, "vector-cells")
    CE.build(vec, path)
    hits, _ = CE.search(spark, path, V.centroids(vec, "label").withColumnRenamed("label", "query_id"), V.DEFAULT_K)
    return hits


def _knn_index(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        idx = domain.mirrored_index(spark, sf_dir)
        asked = V.centroids(domain.vector_keys(spark, sf_dir), "label").withColumnRenamed("label", "query_id")
        return V.knn_batch(idx, asked, V.DEFAULT_K, metric)
    query.__doc__ = f"Top-k ({metric}) in an index with keys without a vector and with tied vectors."
    return query


def indexed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indexed_count(domain.corpus(spark, sf_dir))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.upsert(domain.vectors(spark, sf_dir), domain.index_batch(spark, sf_dir)).select(*index_cols())


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = V.upsert(domain.vectors(spark, sf_dir), domain.index_batch(spark, sf_dir))
    gone = (CH.latest_change(domain.change_keys(spark, sf_dir)).filter(F.col("op") == "deleted")
            .select(F.sha2("path", 256).alias("doc_id")))
    return V.delete(idx, gone).select(*index_cols())


def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the stored index, read after the last one was written: vectors, the batch upserted, deleted paths gone."""
    root = scratch(spark, "index-versions")
    index = domain.vectors(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    IS.replace(index, root)
    IS.upsert(domain.index_batch(spark, sf_dir).select(*index.columns), root, schema)
    gone = (CH.latest_change(domain.change_keys(spark, sf_dir)).filter(F.col("op") == "deleted")
            .select(F.sha2("path", 256).alias("doc_id")))
    IS.delete(IS.read(spark, root, schema).join(gone, "doc_id", "left_semi"), root, schema)
    out = None
    for v in IS.versions(spark, root):
        one = IS.read(spark, root, schema, v).select(F.lit(v).alias("version"), *index_cols())
        out = one if out is None else out.unionByName(one)
    return out


def latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = domain.change_texts(spark, sf_dir)(CH.latest_change(domain.change_keys(spark, sf_dir)))
    return last.select("path", "op", "seq", F.sha2("content", 256).alias("content_sha"))


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.sync_index(domain.vectors(spark, sf_dir), domain.change_keys(spark, sf_dir),
                         attach=domain.change_texts(spark, sf_dir)).select(*index_cols())


TREE_ROOT = "site"


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = TR.with_last_flag(TR.nodes(domain.page_paths(spark, sf_dir).select("path", "is_dir")))
    return nodes.select("path", "depth", "name", "is_dir", "is_last")


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.listing(domain.page_paths(spark, sf_dir).select("path", "is_dir"), TREE_ROOT)


def project_root_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = domain.page_paths(spark, sf_dir).filter(~F.col("is_dir")).select("path").distinct()
    return CF.project_roots(files, domain.markers(spark, sf_dir))


def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CF.merge_layers(domain.project_layers(spark, sf_dir), global_json=GLOBAL_CONFIG)


def outline_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = CC.code_files(spark, sf_dir)
    return O.python_outline(files.filter(F.col("path").endswith(".py")))


def outline_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.functions import paths as P

    files = CC.code_files(spark, sf_dir)
    return O.js_outline(files.filter(P.brace_lang("path").isNotNull()))


def function_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.function_blocks(CC.code_files(spark, sf_dir), CC.block_requests(spark, sf_dir))


def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.functions import paths as P

    files = CC.code_files(spark, sf_dir).withColumns({
        "raw_tokens": T.token_estimate("content"), "ext": F.lower(P.suffix(P.name("path")))})
    j = O.reduced_view(files, keep=("raw_tokens", "ext"))
    return (j.groupBy("ext", "stage")
            .agg(F.count(F.lit(1)).alias("files"),
                 F.sum("raw_tokens").cast("bigint").alias("raw_tokens"),
                 F.sum("tokens").cast("bigint").alias("reduced_tokens"))
            .withColumn("ratio", F.col("reduced_tokens") / F.col("raw_tokens")))


def corpus_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced view of every file of the given corpus (prose: outlines are empty or fall through)."""
    view = O.reduced_view(domain.corpus(spark, sf_dir, heavy=True))
    return view.select("path", "stage", F.sha2("text", 256).alias("text_sha"), "tokens")


RETRIEVAL_K = 7    # more than the search tool shows; within_max marks the hits it would


def knn_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full retrieval: top-k per query -> the hit's current reduced view (or its stored text for
    hits without a path) -> tokens per hit and per query. Texts are fetched for the hits only."""
    return _retrieval(spark, sf_dir)


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = domain.vector_keys(spark, sf_dir)
    queries = V.centroids(vec, "label").withColumnRenamed("label", "query_id")
    hits = V.knn_batch(vec, queries, RETRIEVAL_K)
    files = domain.corpus(spark, sf_dir).join(hits.select("path").distinct(), "path", "left_semi")     # before the views are made
    out = V.retrieve(hits, domain.vectors(spark, sf_dir), O.reduced_view(files))
    return out.select("query_id", "rank", "doc_id", "path", "stage", F.sha2("text", 256).alias("content_sha"), "tokens", "within_max", "query_tokens")


def retrieval_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the retrieval requests (one per query, a minute apart) that the day's limit admits."""
    asked = _retrieval(spark, sf_dir).groupBy("query_id").agg(F.max("query_tokens").alias("tokens"))
    requests = ledger.as_usage(asked.select(
        F.col("query_id").alias("event_id"), (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(mins=F.col("query_id").cast("int"))).alias("ts"),
        "tokens", F.lit("search").alias("source")))
    return ledger.admitted_ledger(requests, RETRIEVAL_LIMIT).select("event_id", "tokens", "source", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES: dict[str, Query] = {
    "budget_status_daily": budget_status_daily,
    "budget_admission": budget_admission,
    "budget_severity": budget_severity,
    "usage_by_source": usage_by_source,
    "doc_fingerprints": doc_fingerprints,
    "indexable_files": indexable_files,
    "token_counts": token_counts,
    "strip_comments": strip_comments,
    "conversation_tokens": conversation_tokens,
    "reference_lines": reference_lines,
    "reference_capped": reference_capped,
    "multi_symbol_references": multi_symbol_references,
    "knn_single": knn_single,
    "knn_batch": knn_batch,
    "index_upsert": index_upsert,
    "index_delete": index_delete,
    "index_versions": index_versions,
    "latest_change": latest_change,
    "index_sync": index_sync,
    "tree_nodes": tree_nodes,
    "tree_listing": tree_listing,
    "project_root_join": project_root_join,
    "config_merge": config_merge,
    "outline_python": outline_python,
    "outline_js": outline_js,
    "function_blocks": function_blocks,
    "reduction_report": reduction_report,
    "corpus_views": corpus_views,
    "knn_pruned": knn_pruned,
    "knn_retrieval": knn_retrieval,
    "retrieval_admitted": retrieval_admitted,
    "budget_status_as_of": budget_status_as_of,
    "budget_limits": budget_limits,
    "reference_words": reference_words,
    "references_after_sync": references_after_sync,
    "knn_index_l2sq": _knn_index("l2sq"),
    "knn_index_cosine": _knn_index("cosine"),
    "knn_index_ip": _knn_index("ip"),
    "indexed_count": indexed_count,
}
