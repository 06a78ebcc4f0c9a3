"""How the driver's tables stand in for this domain's inputs.

Each function reads whole driver tables and derives a domain table with Spark; nothing is
sampled or capped. The same derivations are written in SQL in ``plans/oracle.py`` so the
DuckDB oracle sees identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import ledger
from tokenloom.sources.tables import read_table


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> token ledger: tokens = floor(value), project per user, source = event type."""
    ev = read_table(spark, sf_dir, "events")
    return ledger.as_usage(ev.select(
        "event_id",
        "ts",
        F.floor("value").cast("bigint").alias("tokens"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project"),
    ))


# Folder and suffix a document is filed under (by doc_id), so the path predicates have
# excluded, hidden, non-indexable and binary cases to act on.
CORPUS_DIRS = ["src", "lib", "docs", "node_modules", ".cache", "build", "pkg"]
CORPUS_EXTS = [".py", ".md", ".txt", ".js", ".ts", ".tsx", ".jsx", ".PY", ".png"]


def corpus_path(doc_id, source, lang):
    d = F.element_at(F.array(*[F.lit(x) for x in CORPUS_DIRS]),
                     (F.pmod(doc_id, F.lit(len(CORPUS_DIRS))) + 1).cast("int"))
    e = F.element_at(F.array(*[F.lit(x) for x in CORPUS_EXTS]),
                     (F.pmod(doc_id, F.lit(len(CORPUS_EXTS))) + 1).cast("int"))
    return F.concat_ws("/", source, lang, d, F.concat(F.lit("doc"), doc_id.cast("string"), e))


def corpus(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """documents -> corpus(project, path, content, status): one file per document; ``heavy`` as in ``session.spread``."""
    from tokenloom.functions import text as T

    from tokenloom.session import spread

    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id", heavy=heavy)
    content = T.normalize_newlines("text")
    return docs.select(
        F.col("doc_id").alias("src_id"),
        F.col("source").alias("project"),
        corpus_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"),
        content.alias("content"),
        F.when(F.col("text").isNull(), "undecodable").otherwise("ok").alias("status"),
    )


def symbol_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark -> symbol queries: every distinct word; a symbol is its own query id."""
    b = read_table(spark, sf_dir, "benchmark")
    return (b.select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), 0)).alias("symbol")).distinct()
            .select(F.col("symbol").alias("query_id"), "symbol"))


def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index without texts: (project, doc_id, path, embedding, label)."""
    emb = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("project"), corpus_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"))
    j = emb.join(docs, emb["vec_id"] == docs["doc_id"], "left")
    key = F.coalesce(F.col("path"), F.concat(F.lit("vec/"), F.col("vec_id").cast("string")))
    return j.select(F.coalesce(F.col("project"), F.lit("global")).alias("project"), F.sha2(key, 256).alias("doc_id"),
                    "path", "embedding", "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> vector index rows; a vector carries its document's path and text when the
    corpus has a document with the same id (``vec_id = doc_id``), else it has no path."""
    emb = read_table(spark, sf_dir, "embeddings")
    docs = corpus(spark, sf_dir).select("src_id", "project", "path", "content")
    j = emb.join(docs, emb["vec_id"] == docs["src_id"], "left")
    key = F.coalesce(F.col("path"), F.concat(F.lit("vec/"), F.col("vec_id").cast("string")))
    return j.select(
        F.coalesce(F.col("project"), F.lit("global")).alias("project"),
        F.sha2(key, 256).alias("doc_id"),
        "path", "content", "embedding", "label",
    )


def index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index job's batch: every indexable, readable corpus file, with its vector if any."""
    from tokenloom.operators import corpus as C

    corp = corpus(spark, sf_dir).filter(C.indexable("path") & (F.col("status") == "ok"))
    emb = read_table(spark, sf_dir, "embeddings")
    j = corp.join(emb, corp["src_id"] == emb["vec_id"], "left")
    return j.select("project", F.sha2("path", 256).alias("doc_id"), "path", "content", "embedding", "label")


# Change-feed operation per event type.
CHANGE_OPS = {"signup": "created", "error": "deleted"}   # every other type is 'modified'


def change_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> change feed without texts: (path, op, ts, seq, _doc). Each event touches the
    file of document ``user_id`` (a path under ``missing/`` where there is none, so that no change is
    lost); created/modified rows get a new revision of its text."""
    ev = read_table(spark, sf_dir, "events")
    meta = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    j = ev.join(meta, ev["user_id"] == meta["doc_id"], "left")
    op = F.lit("modified")
    for t, o in CHANGE_OPS.items():
        op = F.when(F.col("event_type") == t, F.lit(o)).otherwise(op)
    return j.select(
        F.when(F.col("doc_id").isNull(), F.concat(F.lit("missing/"), F.col("user_id").cast("string")))
         .otherwise(corpus_path(F.col("doc_id"), F.col("source"), F.col("lang"))).alias("path"),
        op.alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("doc_id").alias("_doc"),
    )


def change_texts(spark: SparkSession, sf_dir: str):
    """A function attaching ``content`` to change keys (after the rows have been chosen, so
    only surviving rows carry a text)."""
    from tokenloom.functions import text as T

    def attach(keys: DataFrame) -> DataFrame:
        text = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), "text")
        content = F.concat(T.normalize_newlines("text"), F.lit("\n# rev "), F.col("seq").cast("string"))
        return keys.join(text, "_doc", "left").select(
            "path", "op", F.when(F.col("op") != "deleted", content).alias("content"), "ts", "seq")

    return attach


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full change feed (path, op, content, ts, seq)."""
    return change_texts(spark, sf_dir)(change_keys(spark, sf_dir))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.url -> path table: scheme, query and fragment removed; a trailing '/' marks a
    directory. Also returns the scheme and whether a query string was present."""
    p = read_table(spark, sf_dir, "pages")
    m = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://([^?#]*)", 2)
    return p.select(
        F.regexp_replace(m, "/+$", "").alias("path"),
        m.endswith("/").alias("is_dir"),
        F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
        F.col("url").contains("?").alias("has_query"),
    ).filter(F.col("path") != "")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker table derived from pages: an https host is a git checkout; the language folder
    (host/lang) of a page with a query string holds a project marker."""
    pp = page_paths(spark, sf_dir)
    parts = F.split("path", "/")
    git = pp.filter((F.col("scheme") == "https")).select(F.element_at(parts, 1).alias("dir"),
                                                          F.lit("git").alias("kind"))
    proj = pp.filter(F.col("has_query") & (F.size(parts) >= 3)).select(
        F.array_join(F.slice(parts, 1, 2), "/").alias("dir"), F.lit("project").alias("kind"))
    return git.unionByName(proj).distinct()


def project_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props -> one project config text per project: the latest write wins. Every fifth project has
    text after its object, every fifth repeats a key."""
    ev = read_table(spark, sf_dir, "events")
    latest = ev.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("json"))
    own = (F.when(F.pmod("user_id", F.lit(5)) == 1, F.concat("json", F.lit(" trailing")))
           .when(F.pmod("user_id", F.lit(5)) == 2, F.concat(F.lit('{"k": 0, "daily_limit": 1, '), F.expr("substr(json, 2)")))
           .otherwise(F.col("json")))
    return latest.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project"), own.alias("json"))


def project_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily limit for two of three projects (the others have the default)."""
    users = read_table(spark, sf_dir, "events").select("user_id").distinct().where(F.pmod("user_id", F.lit(3)) > 0)
    return users.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project"),
                        (F.pmod("user_id", F.lit(3)) * 1500 + 500).cast("bigint").alias("daily_limit"))


def mirrored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after an upsert (some keys have no vector), and every vector once more under another
    key, so that each distance occurs twice."""
    from tokenloom.operators import vectors as V

    idx = V.upsert(vectors(spark, sf_dir), index_batch(spark, sf_dir)).select("doc_id", "path", "embedding", "label")
    return idx.unionByName(idx.select(F.sha2(F.concat("doc_id", F.lit("#2")), 256).alias("doc_id"), "path", "embedding", "label"))
