"""More registered queries: encoders that SQL can state, splitters by recursive SQL,
files written and read back, and operators with injected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.functions import text, treebank
from ragstone.functions.vectors import CityBlock
from ragstone.operators import analytics, dense, generate, hybrid, lexical, metrics, rerank, sampling, windows
from ragstone.plans.catalog import BM25, BM_RUN, CHUNKED, FOUND, K, LINE_SQL, PAIRS, QRELS, RUN, TOP, V, WORD_PIECES, WORDS, bm25_run, corpus, dense_run, digest, half_judged, label_qrels, query, questions, read, six, vecs
from ragstone.session import shared_path
from ragstone.sources import readers, sinks

#: what Python's strip() takes off, as a SQL string
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def folder(spark: SparkSession) -> str:
    return shared_path(spark, "results")


# text expressions

_T, _X = (f"trim(coalesce({c}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))" for c in ("source", "text"))


@query("text_forms", f"SELECT doc_id AS id, md5(CASE WHEN t <> '' AND x <> '' THEN t || '. ' || x WHEN t <> '' THEN t ELSE x END) AS sentence, md5('passage: ' || text) AS prompted FROM (SELECT *, {_T} AS t, {_X} AS x FROM documents)")
def _(spark, d):
    return corpus(spark, d).select("id", F.md5(text.title_sentence(F.col("title"), F.col("text"))).alias("sentence"), F.md5(text.prompted(F.col("text"), "passage: ")).alias("prompted"))


@query("enhanced_queries", "SELECT doc_id AS id, md5(text" + "".join(f" || CASE WHEN regexp_matches(lower(text), '{w}') THEN '{more}' ELSE '' END" for w, more in text.ENHANCEMENTS) + ") AS enhanced FROM documents")
def _(spark, d):
    return corpus(spark, d).select("id", F.md5(text.enhanced(F.col("text"))).alias("enhanced"))


@query("word_mark_tokens", r"SELECT doc_id AS id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([a-z])(n''t)\b', '\1 \2', 'g'), '(''s|''m|''d|''ll|''re|''ve)\b', ' \1', 'g'), 'n''t|''(?:s|m|d|ll|re|ve)\b|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS w FROM documents)")
def _(spark, d):
    w = text.word_marks(F.col("text"))
    return corpus(spark, d).select("id", w.alias("w")).select("id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


# dense retrieval: more blocks than one, and a score of one's own

@query("dense_blocks", f"WITH {RUN} SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM run")
def _(spark, d):
    v = vecs(spark, d)
    return six(dense.dense_topk(v, v, K, block=150))


city_block = CityBlock()


@query("dense_own_score", f"WITH {V}, pairs AS (SELECT a.id AS query_id, b.id AS corpus_id, -list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))) AS score FROM v a JOIN v b ON a.id <> b.id) SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM (SELECT *, {TOP} AS rank FROM pairs) WHERE rank <= {K}")
def _(spark, d):
    v = vecs(spark, d)
    return six(dense.dense_topk(v, v, K, city_block))


# an encoder that SQL can state: how often each letter occurs

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(rows: DataFrame) -> DataFrame:
    """id, embedding of rows (id, text)."""
    low = F.lower("text")
    return rows.select("id", F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in LETTERS)).alias("embedding"))


def letters_run(spark, d, k):
    return dense.dense_topk(letters(questions(spark, d)), letters(corpus(spark, d).select("id", "text")), k)


_COUNTS = "[" + ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"
# ids of questions and documents are compared, so that none is found for itself
DENSE = f"qe AS (SELECT item_id AS query_id, {_COUNTS} AS e FROM benchmark), de AS (SELECT doc_id AS corpus_id, {_COUNTS} AS e FROM documents), lp AS (SELECT query_id, corpus_id, coalesce(list_cosine_similarity(qe.e, de.e), -1) AS score FROM qe JOIN de ON query_id <> corpus_id), lp2 AS (SELECT query_id, corpus_id, CASE WHEN isnan(score) THEN -1 ELSE score END AS score FROM lp)"


@query("dense_letters_topk", f"WITH {DENSE} SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM (SELECT *, {TOP} AS rank FROM lp2) WHERE rank <= {K}")
def _(spark, d):
    return six(letters_run(spark, d, K))


_SCALE = "CASE WHEN max({0}) OVER p = min({0}) OVER p THEN 1.0 ELSE ({0} - min({0}) OVER p) / (max({0}) OVER p - min({0}) OVER p) END"


@query("hybrid_search_topk", f"WITH {BM25}, {DENSE}, ca AS (SELECT query_id, corpus_id, score FROM (SELECT *, {TOP} AS rank FROM lp2) WHERE rank <= {2 * K}), b AS (SELECT ca.query_id, ca.corpus_id, ca.score AS s1, coalesce(bm.score, 0) AS s2 FROM ca LEFT JOIN bm USING (query_id, corpus_id)), f AS (SELECT query_id, corpus_id, 0.6 * {_SCALE.format('s1')} + 0.4 * {_SCALE.format('s2')} AS score FROM b WINDOW p AS (PARTITION BY query_id)) SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM (SELECT *, {TOP} AS rank FROM f) WHERE rank <= {K}")
def _(spark, d):
    return six(hybrid.hybrid_search(questions(spark, d), corpus(spark, d).select("id", "text"), letters_run(spark, d, 2 * K), K))


# treebank words: the rules in DuckDB's syntax, abbreviations counted over the documents

def _sql(text: str) -> str:
    return text.replace("'", "''")


def _rules(value: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        value = f"regexp_replace({value}, '{_sql(pattern)}', '{_sql(to)}', 'g')"
    return value


_BLANKS = "[ \\t\\n\\r\\f]+"
_TYPES = f"ty AS (SELECT regexp_replace(w, '\\.$', '') AS token, w LIKE '%.' AS stop FROM (SELECT lower({_rules('w', [(treebank.OPENING, ''), (treebank.CLOSING, '')])}) AS w FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '{_BLANKS}')) AS w FROM documents) WHERE w <> '') WHERE regexp_matches(regexp_replace(w, '\\.$', ''), '^\\p{{L}}[\\p{{L}}.]*$')), ct AS (SELECT token, count(*) AS n, count(*) FILTER (stop) AS k FROM ty GROUP BY 1), tt AS (SELECT sum(k) / sum(n) AS p FROM ct)"
ABBREVIATIONS = _TYPES + f", sc AS (SELECT token, n, k, length(replace(token, '.', '')) AS l, length(token) - length(replace(token, '.', '')) AS d, -2 * ((k * ln(p) + (n - k) * ln(1 - p)) - (k * ln({treebank.SURE}) + (n - k) * ln({1 - treebank.SURE}))) AS ll FROM ct, tt WHERE k > 0 AND p < 1), ab AS (SELECT token, n, k AS with_stop, ll * exp(-l) * (d + 1) * pow(l, k - n) AS score FROM sc WHERE ll * exp(-l) * (d + 1) * pow(l, k - n) >= {treebank.LEAST})"
_TREEBANK = f"list_filter(string_split_regex({{0}}, '{_BLANKS}'), lambda x: x <> '')"
_FULL = _TREEBANK.format(_rules(f"(' ' || {_rules('part', treebank.RULES)} || ' ')", treebank.ENDINGS))
_OPEN = _TREEBANK.format(_rules(f"(' ' || {_rules('part', [r for r in treebank.RULES if r[0] != treebank.FINAL])} || ' ')", treebank.ENDINGS))


@query("abbreviations", f"WITH {ABBREVIATIONS} SELECT token, n, with_stop, round(score, 6) AS score FROM ab")
def _(spark, d):
    return six(treebank.abbreviations(corpus(spark, d)))


@query("treebank_tokens", f"WITH {ABBREVIATIONS}, pa AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i, len(p) AS m FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{_sql(treebank.END)}', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)), lw AS (SELECT *, regexp_replace(regexp_extract(part, '(\\S+)$', 1), '{_sql(treebank.OPENING)}', '') AS w FROM pa), go AS (SELECT doc_id, i, part, w LIKE '%.' AND (w LIKE '%..' OR regexp_matches(lower(regexp_replace(w, '\\.$', '')), '^\\p{{L}}$') OR lower(regexp_replace(w, '\\.$', '')) IN (SELECT token FROM ab)) AND i < m AS go FROM lw), tw AS (SELECT doc_id, i, CASE WHEN go THEN {_OPEN} ELSE {_FULL} END AS w FROM go) SELECT doc_id AS id, CAST(sum(len(w)) AS BIGINT) AS n_tokens, md5(string_agg(array_to_string(w, ' '), ' ' ORDER BY i) FILTER (len(w) > 0)) AS tokens_md5 FROM tw GROUP BY 1")
def _(spark, d):
    known = [r[0] for r in treebank.abbreviations(corpus(spark, d)).select("token").collect()]
    w = treebank.treebank_words(F.col("text"), known)
    return corpus(spark, d).select("id", w.alias("w")).select("id", F.size("w").cast("long").alias("n_tokens"), F.when(F.size("w") > 0, F.md5(F.array_join("w", " "))).alias("tokens_md5"))


# BM25 over every document

@query("bm25_all_documents", f"WITH {BM25}, al AS (SELECT b.item_id AS query_id, d.doc_id AS corpus_id, coalesce(bm.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.query_id = b.item_id AND bm.corpus_id = d.doc_id), rk AS (SELECT *, {TOP} AS rank FROM al) SELECT query_id, count(*) AS n_docs, count(*) FILTER (score = 0) AS n_zero, round(sum(score), 4) AS total, max_by(corpus_id, rank) AS last FROM rk GROUP BY 1")
def _(spark, d):
    run = lexical.bm25_topk(questions(spark, d), corpus(spark, d), None)
    return run.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") == 0).alias("n_zero"), F.round(F.sum("score"), 4).alias("total"), F.max_by("corpus_id", "rank").alias("last"))


class OverlapModel:
    """A lexical model of a shard of documents: the distinct words of a question that a document
    holds, a little less for longer ones."""

    def __init__(self, docs: list[list[str]]):
        self.docs = [(set(d), len(d)) for d in docs]

    def get_scores(self, tokens: list[str]) -> list[float]:
        asked = set(tokens)
        return [len(asked & d) / (1.0 + n / 1000.0) for d, n in self.docs]


#: every document's distinct words that a question has
_SHARED = "tok AS (SELECT doc_id, " + WORDS.format("text") + " AS w FROM documents), dw AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM tok), qw AS (SELECT DISTINCT item_id, unnest(" + WORDS.format("text") + ") AS token FROM benchmark), sh AS (SELECT item_id, doc_id, count(*) AS n FROM qw JOIN dw USING (token) GROUP BY 1, 2)"


@query("lexical_model_topk", f"WITH {_SHARED}, s AS (SELECT b.item_id AS query_id, t.doc_id AS corpus_id, coalesce(n, 0) / (1.0 + len(w) / 1000.0) AS score FROM benchmark b CROSS JOIN tok t LEFT JOIN sh ON sh.item_id = b.item_id AND sh.doc_id = t.doc_id) SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM (SELECT *, {TOP} AS rank FROM s) WHERE rank <= {K}")
def _(spark, d):
    return six(lexical.shard_topk(questions(spark, d), corpus(spark, d), OverlapModel, K))


# rerankers and messages with injected parts

class LengthEncoder:
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(t) % 97 / 97 for _, t in pairs]


@query("rerank_model", f"WITH {BM_RUN}, o AS (SELECT query_id, corpus_id, length(trim(coalesce(source, '') || ' ' || coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) % 97 / 97.0 AS score FROM run JOIN documents ON doc_id = corpus_id) SELECT query_id, corpus_id, round(score, 6) AS score, {TOP} AS rank FROM o")
def _(spark, d):
    return six(rerank.rerank(bm25_run(spark, d), questions(spark, d), corpus(spark, d), LengthEncoder(), K))


def _prepare(question: str, documents: list) -> list[dict]:
    return [{"role": "user", "content": f"{question}\n{documents[0][0]}\n{len(documents)}"}]


@query("messages_custom", f"WITH {BM_RUN} SELECT CAST(query_id AS VARCHAR) AS query_id, 1 AS n_messages, md5(b.text || chr(10) || concat_ws(' ', source, d.text) || chr(10) || n) AS content_md5 FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM run) JOIN documents d ON doc_id = corpus_id JOIN benchmark b ON item_id = query_id WHERE rank = 1")
def _(spark, d):
    m = generate.custom_messages(bm25_run(spark, d), questions(spark, d), corpus(spark, d), _prepare)
    return m.select("query_id", F.size("messages").alias("n_messages"), F.md5(F.col("messages")[0]["content"]).alias("content_md5"))


# analytics over runs

BOTH = f"WITH {BM_RUN}, {PAIRS}, drun AS (SELECT * FROM (SELECT *, {TOP} AS rank FROM pairs) WHERE rank <= {K}), u AS (SELECT 'bm25' AS name, query_id, corpus_id, score FROM run UNION ALL SELECT 'dense', query_id, corpus_id, score FROM drun)"


def both_runs(spark, d):
    return analytics.union_runs([r.select(F.lit(n).alias("name"), "query_id", "corpus_id", "score") for n, r in (("bm25", bm25_run(spark, d)), ("dense", dense_run(spark, d)))])


query("score_stats_by_run", f"{BOTH} SELECT name, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM u GROUP BY 1")(lambda s, d: six(analytics.score_stats(both_runs(s, d), "name"), "mean", "low", "high"))
query("score_gain", f"{BOTH} SELECT round(max(score) FILTER (name = 'bm25') - max(score) FILTER (name = 'dense'), 6) AS gain FROM u")(lambda s, d: six(analytics.score_gain(bm25_run(s, d), dense_run(s, d)), "gain"))
query("nested_run", f"WITH {BM_RUN} SELECT query_id, string_agg(CAST(corpus_id AS VARCHAR), ' ' ORDER BY rank) AS ids, count(*) AS n FROM run GROUP BY 1")(lambda s, d: analytics.nested_run(bm25_run(s, d)).select("query_id", F.array_join(F.transform("results", lambda x: x["corpus_id"].cast("string")), " ").alias("ids"), F.size("results").cast("long").alias("n")))
query("nested_qrels", f"WITH {BM_RUN} SELECT query_id, string_agg(doc_id || ':' || quality, ' ' ORDER BY doc_id) AS judged FROM run JOIN labels ON doc_id = corpus_id GROUP BY 1")(lambda s, d: analytics.nested_qrels(half_judged(s, d)).select("query_id", F.array_join(F.transform(F.array_sort(F.map_entries("relevant")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), " ").alias("judged")))
query("without_self", f"WITH {V} SELECT a.label, count(*) AS n FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id GROUP BY 1")(lambda s, d: metrics.without_self(vecs(s, d).select(F.col("id").alias("query_id"), "label").join(vecs(s, d).select(F.col("id").alias("corpus_id"), "label"), "label")).groupBy("label").agg(F.count("*").alias("n")))
query("strategy_choices", "SELECT CASE WHEN list_contains(c, 'table_query') THEN 'table-aware' WHEN list_contains(c, 'specific_fact') THEN 'small' WHEN list_contains(c, 'contextual') THEN 'large' ELSE 'medium' END AS strategy, count(*) AS n FROM (SELECT list_filter([" + ", ".join("CASE WHEN regexp_matches(lower(text), '%s') THEN '%s' END" % ("|".join(p), n) for n, p in text.QUERY_PATTERNS.items()) + "], lambda x: x IS NOT NULL) AS c FROM documents) GROUP BY 1")(lambda s, d: analytics.choices(corpus(s, d).select(text.route(text.query_classes(F.col("text"))).alias("strategy")), "strategy"))
query("run_summary", f"WITH {FOUND.format(k=K)}, per AS (SELECT query_id, sum(rel / log2(rank + 1)) / idcg AS ndcg FROM found JOIN ideal USING (query_id) GROUP BY query_id, idcg) SELECT round(avg(ndcg), 6) AS ndcg, count(*) AS num_queries, (SELECT count(DISTINCT query_id) FROM qrels) AS num_qrels FROM per")(lambda s, d: six(metrics.summary(dense_run(s, d), label_qrels(s, d), K), "ndcg"))
query("demo_document", "WITH f AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20) SELECT md5(coalesce((SELECT min_by(text, doc_id) FROM f WHERE length(text) > 2000), (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FROM (SELECT * FROM f ORDER BY doc_id LIMIT 5)))) AS text_md5")(lambda s, d: sampling.demo_document(corpus(s, d)).select(F.md5("text").alias("text_md5")))


# region chunks by words

_NAMED = "named AS (SELECT doc_id AS did, coalesce(source, '') AS title, coalesce(text, '') AS body FROM documents), long_text AS (SELECT * FROM named WHERE length(body) >= 500), "
_WORD = WORD_PIECES.replace("[text]", "[b]")
REGION_WORDS = ("WITH " + _NAMED + LINE_SQL.format(k="did", t="body", f="long_text")
                + ", ro AS (SELECT id, s, e, row_number() OVER (PARTITION BY id ORDER BY s) AS k, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY s) AS p FROM reg), sg AS (SELECT id, 2 * k - 1 AS seq, p AS s, s AS e, false AS t FROM ro UNION ALL SELECT id, 2 * k, s, e, true FROM ro UNION ALL SELECT l.did, 1000000, coalesce((SELECT max_by(e, k) FROM ro WHERE ro.id = l.did), 0), len(string_split(l.body, chr(10))), false FROM long_text l), "
                "sb AS (SELECT id, seq, t, title, array_to_string(string_split(body, chr(10))[s + 1 : e], chr(10)) AS b FROM sg JOIN long_text ON did = id WHERE e > s), sw AS (SELECT id, seq, t, title, b, list_filter(string_split_regex(b, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM sb WHERE t OR trim(b, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> '' UNION ALL SELECT did, 0, false, title, body, list_filter(string_split_regex(body, '[ \\t\\n\\r]+'), lambda x: x <> '') FROM named WHERE length(body) < 500), "
                "pc AS (SELECT id, seq, t, CASE WHEN t THEN ['[TABLE from ' || title || ']' || chr(10) || b] ELSE list_transform(" + _WORD + ", lambda x: '[' || title || '] ' || x) END AS pieces FROM sw), ch AS (SELECT id AS doc_id, t, c, row_number() OVER (PARTITION BY id ORDER BY seq, i) - 1 AS n FROM (SELECT id, seq, t, unnest(pieces) AS c, generate_subscripts(pieces, 1) AS i FROM pc)) SELECT CAST(doc_id AS VARCHAR) || CASE WHEN t THEN '_t' ELSE '_c' END || CAST(n AS VARCHAR) AS chunk_id, doc_id, n AS chunk_index, md5(c) AS text_md5, t AS is_table FROM ch")


@query("region_word_chunks", REGION_WORDS)
def _(spark, d):
    c = windows.region_word_chunks(corpus(spark, d))
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"), "is_table")


# the character splitter: a chunk is a range s .. e of pieces, the next one follows from it

def packed_sql(size: int, overlap: int, sep: str) -> str:
    """Rows doc_id, i, c: the chunks of documents by pieces between sep."""
    blank = " || ".join(f"chr({ord(c)})" for c in BLANK)
    mark, n = " || ".join(f"chr({ord(c)})" for c in sep), len(sep)
    return f"""
    WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, {mark}), lambda x: x <> '') AS w FROM documents WHERE trim(text, {blank}) <> ''),
    u AS (SELECT doc_id, generate_subscripts(w, 1) AS j, unnest(w) AS x FROM p),
    l AS (SELECT doc_id, list(c ORDER BY j) AS c FROM (SELECT doc_id, j, sum(length(x) + {n}) OVER (PARTITION BY doc_id ORDER BY j) AS c FROM u) GROUP BY 1),
    q AS (SELECT p.doc_id, w, len(w) AS m, c FROM p JOIN l USING (doc_id) WHERE len(w) > 0),
    r(doc_id, i, s, e) AS (
      SELECT doc_id, 1, 1, greatest(1, len(list_filter(c, lambda y: y - {n} <= {size}))) FROM q
      UNION ALL
      SELECT doc_id, i + 1, s2, greatest(e + 1, len(list_filter(c, lambda y: y - b2 - {n} <= {size})))
      FROM (SELECT *, CASE WHEN s2 > 1 THEN c[s2 - 1] ELSE 0 END AS b2
            FROM (SELECT r.doc_id, i, e, c, coalesce(list_filter(range(s + 1, e + 1), lambda k: c[e] - c[k - 1] - {n} <= {overlap} AND c[e + 1] - c[k - 1] - {n} <= {size})[1], e + 1) AS s2
                  FROM r JOIN q USING (doc_id) WHERE e < m)))
    SELECT doc_id, i, trim(array_to_string(w[s : e], {mark}), {blank}) AS c FROM r JOIN q USING (doc_id) WHERE trim(array_to_string(w[s : e], {mark}), {blank}) <> ''"""


def _packed(method: str, size: int, overlap: int, **options):
    def run(spark, d):
        from ragstone.operators.splitters import chunk_corpus

        return digest(chunk_corpus(corpus(spark, d), method, size, overlap, **options))

    return run


for _name, _how, _sep in (("chunk_character", ("character", 1500, 300), "\n"), ("chunk_fixed", ("fixed", 512, 50), " ")):
    query(_name, CHUNKED.format(packed_sql(*_how[1:], _sep)))(_packed(*_how))
query("chunk_character_sentences", CHUNKED.format(packed_sql(600, 120, ". ")))(_packed("character", 600, 120, sep=". "))


@query("retriever_info", f"SELECT num_documents, num_chunks, num_chunks / num_documents AS expansion, 64 AS dimension, 'balanced' AS strategy FROM (SELECT count(*) AS num_documents FROM documents), (SELECT count(*) AS num_chunks FROM ({packed_sql(1500, 300, chr(10))}))")
def _(spark, d):
    from ragstone.operators.retrievers import ChunkedRetriever

    return ChunkedRetriever(corpus(spark, d)).info()


# files: what is written is read back

@query("saved_results", f"WITH {BM_RUN} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(corpus_id AS VARCHAR) AS corpus_id FROM run")
def _(spark, d):
    path = sinks.save_results(None, bm25_run(spark, d), folder(spark), "task", K)
    return spark.read.csv(path, header=True)


@query("saved_answers", f"WITH {BM_RUN} SELECT query_id, 'answer ' || corpus_id AS answer FROM run WHERE rank = 1")
def _(spark, d):
    answers = generate.best_documents(bm25_run(spark, d)).select("query_id", F.concat(F.lit("answer "), F.col("corpus_id").cast("string")).alias("answer"))
    return spark.read.json(sinks.save_answers(answers, folder(spark), "task"))


@query("saved_chunks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) || '_chunk_0' AS chunk_id, 0 AS chunk_index, 1 AS total_chunks, md5(text) AS text_md5 FROM documents")
def _(spark, d):
    path = sinks.save_chunks(windows.no_chunking(corpus(spark, d).withColumn("id", F.col("id").cast("string"))), folder(spark), nested=True)
    return readers.read_chunks(spark, path).select("doc_id", "chunk_id", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


@query("saved_tables", "SELECT lang, count(*) AS n, 'csv' AS kind FROM documents GROUP BY 1 UNION ALL SELECT lang, count(*), 'json' FROM documents GROUP BY 1")
def _(spark, d):
    t = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    base = folder(spark)
    csv, json = sinks.save_table(t, f"{base}/t.csv"), sinks.save_json(t, f"{base}/t.json")
    return spark.read.schema("lang string, n long").csv(csv, header=True).withColumn("kind", F.lit("csv")).unionByName(spark.read.schema("lang string, n long").json(json).withColumn("kind", F.lit("json")))


@query("loaded_dataset", "SELECT 'corpus' AS part, CAST(doc_id AS VARCHAR) AS id, md5(source || ' ' || text) AS content FROM documents UNION ALL SELECT 'queries', CAST(item_id AS VARCHAR), md5(text) FROM benchmark UNION ALL SELECT 'qrels', CAST(doc_id AS VARCHAR), CAST(max(quality) AS VARCHAR) FROM labels GROUP BY 1, 2")
def _(spark, d):
    """A dataset's files by their usual names: JSON lines and tab-separated judgments."""
    base = folder(spark)
    corpus(spark, d).select(F.col("id").cast("string").alias("_id"), "title", "text").write.json(f"{base}/finqa_corpus.jsonl/corpus.jsonl")
    questions(spark, d).select(F.col("id").cast("string").alias("_id"), F.lit("").alias("title"), "text").write.json(f"{base}/finqa_queries.jsonl/queries.jsonl")
    read(spark, d, "labels").select(F.lit("q").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score")).write.csv(f"{base}/{readers.QRELS_FILES['finqa']}", sep="\t", header=True)
    c, q, r = readers.load_dataset(spark, "finqa", base)
    parts = [c.select(F.lit("corpus").alias("part"), "id", F.md5(F.concat_ws(" ", "title", "text")).alias("content")), q.select(F.lit("queries").alias("part"), "id", F.md5("text").alias("content")), r.select(F.lit("qrels").alias("part"), F.col("corpus_id").alias("id"), F.col("score").cast("string").alias("content"))]
    return analytics.union_runs(parts)
