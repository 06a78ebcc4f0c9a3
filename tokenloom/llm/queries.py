"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import (byte_bpe, conversation_repair, decontaminate, fingerprints, jaccard_join, language, line_dedup, mixing, quality,
                           suffix_dedup, treap_search, url_filter, warc)
from tokenloom.llm.common import fold, materialize, table

# ---- operator 1 ---------------------------------------------------------------------------------

def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_shared")


# ---- operator 2 ---------------------------------------------------------------------------------

def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints.with_next(docs, ["text"], {"fp": fingerprints.fingerprint(F.col("text"))})
    rows = rows.select("doc_id", "text", "fp", F.col("next.fp").alias("next_fp"),
                       fingerprints.edited(F.col("text"), F.col("next.text")).alias("edited"))
    rows = rows.withColumn("edited_fp", fingerprints.fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


# ---- operator 3 ---------------------------------------------------------------------------------

def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"),
                      F.size("removed_runs").cast("bigint").alias("n_runs"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP3_CTE = f"""
raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
al AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM raw),
l AS (SELECT doc_id, line, line_no, len([x for x in regexp_split_to_array(line, '\\s+') if x <> '']) AS w FROM al),
q AS (SELECT doc_id, line, line_no, w, row_number() OVER d AS i, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3,
             lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM l WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
n AS (SELECT doc_id, i, line_no, unnest([1, 2, 3]) AS need, line, l2, l3, w, w2 FROM q),
k AS (SELECT * FROM n WHERE (need = 1 AND w >= {line_dedup.MIN_WORDS}) OR (need = 2 AND w + w2 >= {line_dedup.MIN_WORDS}) OR (need = 3 AND l3 IS NOT NULL)),
f AS (SELECT doc_id, i, need, row_number() OVER (PARTITION BY need, line, CASE WHEN need > 1 THEN l2 END, CASE WHEN need > 2 THEN l3 END ORDER BY doc_id, i) AS nth
      FROM k),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(need)) AS k FROM f WHERE nth > 1)),
isl AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM g),
runs AS (SELECT isl.doc_id, grp, min(line_no) AS lo, max(line_no) AS hi FROM isl JOIN q ON q.doc_id = isl.doc_id AND q.i = isl.i GROUP BY isl.doc_id, grp),
gone AS (SELECT DISTINCT al.doc_id, al.line_no FROM al JOIN runs ON runs.doc_id = al.doc_id AND al.line_no BETWEEN lo AND hi),
kept AS (SELECT al.doc_id, string_agg(al.line, chr(10) ORDER BY al.line_no) AS kept FROM al ANTI JOIN gone ON gone.doc_id = al.doc_id AND gone.line_no = al.line_no GROUP BY al.doc_id)
"""
OP3_SQL = f"""
WITH {OP3_CTE}
SELECT raw.doc_id, len(ls) AS n_lines, coalesce(r.gone, 0) AS n_removed, coalesce(r.runs, 0) AS n_runs, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM raw LEFT JOIN kept ON kept.doc_id = raw.doc_id
LEFT JOIN (SELECT doc_id, sum(hi - lo + 1) AS gone, count(*) AS runs FROM runs GROUP BY doc_id) r ON r.doc_id = raw.doc_id
"""


# ---- operator 4 ---------------------------------------------------------------------------------

# Domains of the labelled table, and the share of tokens that each is to have.
MIX_TARGETS = {"good": 0.90, "toxic": 0.02, "low": 0.08}


def label_domains(labels: DataFrame) -> DataFrame:
    """labels -> (doc_id, domain); rows without a quality are not labelled."""
    return labels.where("quality is not null").select(
        "doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)
    return out.select("doc_id", "n_tokens", "domain", *[F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(sorted(MIX_TARGETS))], "rate")


# ---- operator 5 ---------------------------------------------------------------------------------

def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.fit(docs.where(fold("doc_id", 4) != 2))
    docs = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language.predict(docs, prototypes, keep=("doc_id", "held_out"))


# ---- operator 6 ---------------------------------------------------------------------------------

# The rules the query is asked to apply.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# A page is put on the list of canonical urls where a label of its host has one of these words.
LISTED_WORDS = ["spam", "casino", "porn", "phishing", "malware"]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    host, path = url_filter.url_parts(F.col("url"))
    listed = (pages.select(url_filter.canonical(host, path).alias("url"), host.alias("host"))
              .where(F.col("host").rlike("|".join(LISTED_WORDS))).select("url"))
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES {_RULES_SQL}),
best AS (SELECT h.host, h.path, max_by(rh || rp, length(rh || rp) * 10000 + length(rh)) AS rule,
                max_by(rv, length(rh || rp) * 10000 + length(rh)) AS rv
         FROM (SELECT DISTINCT host, path FROM p WHERE host <> '') h JOIN r ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp)
         GROUP BY h.host, h.path)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.rv, CASE WHEN regexp_matches(p.host, '{"|".join(LISTED_WORDS)}') THEN 'block' ELSE 'allow' END) AS verdict,
       regexp_matches(p.host, '{"|".join(LISTED_WORDS)}') AS listed
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

# ---- operator 7 ---------------------------------------------------------------------------------

def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    docs = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return quality.score(docs, field).select("doc_id", "held_out", "score",
                                             F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


# ---- operator 8 ---------------------------------------------------------------------------------

def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_shingles", "n_copies", "n_links", "n_text_links")


OP8_SQL = """
WITH RECURSIVE
w AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '\\s+') if x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
c AS (SELECT min(doc_id) AS c, count(*) AS copies, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT c, copies, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS an, any_value(b.n) AS bn, any_value(b.copies) AS copies, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c),
l AS (SELECT a, b, copies FROM p WHERE k >= 0.8 * (an + bn - k) - 1e-9),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS c, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a AS c, count(*) AS t, sum(copies) AS d FROM l GROUP BY a)
SELECT s.doc_id, coalesce(g.class_id, s.doc_id) AS class_id, len(s.s) AS n_shingles, coalesce(c.copies, 1) AS n_copies,
       coalesce(n.d, 0) + coalesce(c.copies, 1) - 1 AS n_links, coalesce(n.t, 0) AS n_text_links
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN g ON g.c = c.c LEFT JOIN n ON n.c = c.c
"""


# ---- operator 9 ---------------------------------------------------------------------------------

def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


# ---- operator 10 --------------------------------------------------------------------------------

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + (r["last"] - r["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# ---- operator 11 --------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the query repairs: by crc32 of conversation and turn, modulo 20."""
    one = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                       conversation_repair.chance(F.col("conv_id"), F.col("turn"), 20).alias("kind")).where("kind <> 0")
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("copy", F.explode(copies))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = materialize(conversation_repair.repair(rows, given), "repairs")
    sha = conversation_repair.digest(conversation_repair.apply(rows, found)).withColumnRenamed("conv_id", "id")
    out = found.join(sha, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return out.select("conv_id", *conversation_repair.RESULT, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op11_sql() -> str:
    """A value is eight digits of cost, the audit, a separator and the repaired lines; of two values of equal cost no audit is the
    beginning of the other, so their order as strings is the order by cost and audit."""
    def add(v: str, cost: str, edit: str, line: str = "''") -> str:
        at = f"strpos({v}, chr(1))"
        return f"(lpad(CAST(CAST(substr({v}, 1, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({v}, 9, {at} - 9) || '{edit}' || substr({v}, {at}) || {line})"

    def move(p: int, role: str) -> str:
        """From s[p], row x kept or rerolled into a turn of the role."""
        keep = add(f"s[{p}]", "CAST(x[5] AS INT)", "K", "chr(10) || x[3] || ':' || x[4]")
        change = add(f"s[{p}]", "CAST(x[5] AS INT) + 3", "R", f"chr(10) || '{role}:' || x[4]")
        return f"CASE WHEN x[2] = 'fault' THEN NULL WHEN x[1] = '{role[0]}' THEN {keep} ELSE {change} END"

    user, bot = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    kept = add("s[1]", "CAST(x[5] AS INT)", "K", "chr(10) || x[3] || ':' || x[4]")
    taken = (f"[{add('s[1]', '4', 'D')}, least({add('s[2]', '4', 'D')}, CASE WHEN x[2] <> 'fault' AND x[1] = 's' THEN {kept} END), "
             f"least({add('s[3]', '4', 'D')}, {move(1, 'user')}, {move(2, 'user')}, {move(4, 'user')}), least({add('s[4]', '4', 'D')}, {move(3, 'assistant')})]")
    with_user = f"[s[1], s[2], least(s[3], {add('s[1]', '3', 'I', user)}, {add('s[2]', '3', 'I', user)}, {add('s[4]', '3', 'I', user)}), s[4]]"
    with_bot = f"[s[1], s[2], s[3], least(s[4], {add('s[3]', '3', 'I', bot)})]"
    step = f"CASE x[2] WHEN 'user' THEN {with_user} WHEN 'bot' THEN {with_bot} ELSE {taken} END"
    return f"""
WITH g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                      for c in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')])),
                      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind
           FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM g WHERE kind <> 0),
o AS (SELECT *, rtrim(text, {" || ".join(f"chr({ord(c)})" for c in conversation_repair.BLANKS)}) AS body,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN substr(body, -1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list([substr(role, 1, 1), CASE WHEN fault IN ('blank', 'duplicate') THEN 'fault' ELSE '' END, role, text, CASE WHEN fault = 'truncated' THEN '3' ELSE '0' END]
                  ORDER BY i) AS rows FROM f GROUP BY conv_id),
s AS (SELECT * EXCLUDE rows, list_reduce(list_prepend(['00000000' || chr(1), NULL, NULL, NULL, NULL],
                 flatten([[['', 'user'], ['', 'bot'], ['', 'user'], x, ['', 'user'], ['', 'bot'], ['', 'user']] for x in rows])),
                 lambda s, x: {step}) AS s FROM c),
v AS (SELECT * EXCLUDE s, least(s[1], s[4]) AS v FROM s)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(substr(v, 1, 8), '0') AS BIGINT) AS cost, coalesce(substr(v, 9, strpos(v, chr(1)) - 9), '') AS audit,
       sha256(coalesce(substr(v, strpos(v, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN v ON a.conv_id IS NOT DISTINCT FROM v.conv_id
"""


# ---- operator 12 --------------------------------------------------------------------------------

def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = byte_bpe.decode(coded, ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- operator 13 --------------------------------------------------------------------------------

def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP13_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM g) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * n.n * (SELECT docs FROM g)) // (SELECT len FROM g))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id) GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_treap_search": op13_treap_search,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_conversation_repair": _op11_sql(),
    "op13_treap_search": OP13_SQL,
}
