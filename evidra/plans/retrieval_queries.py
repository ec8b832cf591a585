"""Registered queries: tokenising, ranking, search, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import lexicon
from evidra.functions.embedding import hashing_embedding
from evidra.functions.text import query_language
from evidra.operators import matching, retrieval, search, tokenize
from evidra.plans import shapes
from evidra.session import load_table, materialize

_GROUPS_SQL = ", ".join(
    f"('{name}', '{term}')" for name, terms in lexicon.KEYWORD_ALIASES.items() for term in terms
)
_SEARCH_GROUPS_SQL = ", ".join(
    f"('{name}', '{term}')" for name, terms in lexicon.SEARCH_ALIASES.items() for term in terms
)


WORDS = "'[\\p{L}\\p{N}_]+'"


def _match(token: str, text: str) -> str:
    """Token rule on a text without a prepared word list (small tables only)."""
    return (
        f"CASE WHEN regexp_matches({token}, '^[a-z0-9]{{1,2}}$') "
        f"THEN list_contains(regexp_extract_all({text}, {WORDS}), {token}) ELSE contains({text}, {token}) END"
    )


def _matched(name: str, source: str, keys: str, text: str, terms: str, term: str, whole_word: str) -> str:
    """CTEs: {name} = distinct (keys, term) with whole-word terms by equality on words."""
    return f"""
{name}_words AS MATERIALIZED (SELECT {keys}, unnest(list_distinct(regexp_extract_all({text}, {WORDS}))) AS word FROM {source}),
{name} AS MATERIALIZED (
  SELECT {keys}, {term} FROM {name}_words JOIN {terms} ON word = {term} WHERE {whole_word}
  UNION ALL
  SELECT {keys}, {term} FROM {source} JOIN (SELECT * FROM {terms} WHERE NOT ({whole_word})) ON contains({text}, {term}))"""


SHORT = "regexp_matches(token, '^[a-z0-9]{1,2}$')"
ASCII_WORD = "regexp_matches(term, '^[a-z0-9]+$')"


def _keyword(term: str, text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({term}, '^[a-z0-9]+$') "
        f"THEN list_contains(regexp_extract_all({text}, {WORDS}), {term}) ELSE contains({text}, {term}) END"
    )


TOKENS_SQL = f"""
groups(canonical, term) AS (VALUES {_GROUPS_SQL}),
qtext AS (SELECT item_id AS query_id, lower(trim(text)) AS t FROM benchmark),
tokens AS MATERIALIZED (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(t, '[a-z0-9\\-]+')) AS token FROM qtext
  UNION
  SELECT query_id, canonical FROM qtext JOIN groups ON {_match('term', 't')}
  UNION
  SELECT query_id, unnest(regexp_extract_all(t, '[一-鿿]')) FROM qtext)"""

KEYWORD_SQL = f"""{TOKENS_SQL}, {shapes.CORPUS_SQL},
terms AS (SELECT DISTINCT token FROM tokens),
{_matched('in_text', 'items', 'item_id', 'abstract', 'terms', 'token', SHORT)},
{_matched('in_title', 'items', 'item_id', 'title', 'terms', 'token', SHORT)},
matched AS MATERIALIZED (
  SELECT item_id, token, max(w) AS w FROM (
    SELECT item_id, token, 1 AS w FROM in_text UNION ALL SELECT item_id, token, 3 FROM in_title) GROUP BY ALL),
idf AS MATERIALIZED (
  SELECT token, CASE WHEN df > n * 0.5 THEN 0.0 ELSE ln((n + 1) / (df + 1)) + 1 END AS idf, df
  FROM (SELECT token, count(*) AS df FROM matched GROUP BY token), (SELECT count(*) AS n FROM items)),
scores AS (
  SELECT query_id, item_id, sum(w * idf) AS score
  FROM matched JOIN idf USING (token) JOIN tokens USING (token) GROUP BY ALL HAVING sum(w * idf) > 0),
ranked AS (
  SELECT query_id, item_id, score, year, ord, real_ev,
         CASE WHEN source_type = 'pubmed' THEN 1 ELSE 0 END AS bonus,
         row_number() OVER (PARTITION BY query_id ORDER BY real_ev DESC, round(score, 9) DESC,
           CASE WHEN source_type = 'pubmed' THEN 1 ELSE 0 END DESC, year DESC, ord) AS rank
  FROM scores JOIN items USING (item_id))"""


def query_tokens(spark, sf):
    return materialize(tokenize.tokenize_queries(shapes.questions(spark, sf)))


def _ranked(spark, sf, k):
    queries = shapes.questions(spark, sf)
    tokens = query_tokens(spark, sf)
    return retrieval.rank_keyword(queries, shapes.corpus(spark, sf), tokens, k=k, stop_share=lexicon.IDF_STOP_SHARE)


def keyword_ranking(spark, sf):
    return _ranked(spark, sf, 10).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), "bonus", "year", "rank"
    )


def _idf(spark, sf, stop_share, stop_above=0):
    items = shapes.corpus(spark, sf)
    _, _, held = retrieval.match_candidates(items, None, query_tokens(spark, sf))
    return retrieval.token_idf(held, items, stop_share, stop_above).select("token", "df", F.round("idf", 6).alias("idf"))


def token_idf(spark, sf):
    """The source system's rule: tokens in more than half of the documents weigh nothing, where there are more than a hundred."""
    return _idf(spark, sf, lexicon.IDF_STOP_SHARE, lexicon.IDF_STOP_ABOVE)


def token_idf_stopped(spark, sf):
    """Tokens in more than half of the documents weigh nothing, whatever the corpus size."""
    return _idf(spark, sf, lexicon.IDF_STOP_SHARE)


def phrase_frequencies(spark, sf):
    """Pairs of neighbouring words of the questions, and pairs made of a title's last word and a language's name, as phrases over
    documents with three fields."""
    items = _phrase_items(spark, sf)
    words = F.split(F.lower(F.trim("text")), " +")
    pairs = load_table(spark, sf, "benchmark").select(F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).alias("term"))
    ends = items.select(F.concat_ws(" ", F.regexp_extract(F.lower("title"), "([^ ]+)$", 1), F.element_at("keywords", 1)).alias("term"))
    terms = pairs.unionByName(ends).where("term rlike '^[^ ]+ [^ ]+$'").distinct()
    index = retrieval.item_index(items)
    _, _, held = retrieval.match_candidates(items, None, terms.select(F.lit(0).alias("query_id"), F.col("term").alias("token")), index)
    return held.groupBy(F.col("term").alias("phrase")).agg(F.count("*").alias("n_items"))


def _phrase_items(spark, sf):
    return shapes.corpus(spark, sf).withColumn("keywords", F.array("lang", "source"))


PHRASE_SQL = """
WITH item AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lang, lower(split_part(text, chr(10), 1)) || ' ' || lang || ' ' || source || '    ' || lower(text) AS whole FROM documents),
word AS (SELECT string_split_regex(lower(trim(text)), ' +') AS w FROM benchmark),
term AS (SELECT DISTINCT t FROM (SELECT w[i] || ' ' || w[i + 1] AS t FROM (SELECT w, unnest(range(1, len(w))) AS i FROM word)
  UNION ALL SELECT regexp_extract(title, '([^ ]+)$', 1) || ' ' || lang FROM item) WHERE regexp_full_match(t, '(?s)[^ ]+ [^ ]+'))
SELECT t AS phrase, count(*) AS n_items FROM item JOIN term ON contains(whole, t) GROUP BY t"""


def chinese_terms(spark, sf):
    """Question words in Chinese signs (a-z as 一, 丁, ...), written without marks or spaces, as terms over titles written so."""
    letters, signs = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))
    han = lambda c: F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), letters, signs)
    docs = load_table(spark, sf, "documents").select("doc_id", han(F.split_part("text", F.lit("\n"), F.lit(1))).alias("text"))
    words = load_table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(han(F.col("w")).alias("term"))
    index = matching.build_index(docs, ["doc_id"], {"text": F.col("text")})
    found = matching.match_index(index, words.where("length(term) between 1 and 8"))
    return found.groupBy(F.md5("term").alias("term_md5"), F.length("term").alias("n_signs")).agg(F.count("*").alias("n_docs"))


_SIGNS = "".join(chr(0x4E00 + i) for i in range(26))
CHINESE_SQL = f"""
WITH d AS (SELECT doc_id, translate(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{_SIGNS}') AS t FROM documents),
w AS (SELECT DISTINCT translate(regexp_replace(lower(unnest(string_split(text, ' '))), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{_SIGNS}') AS term FROM benchmark)
SELECT md5(term) AS term_md5, CAST(length(term) AS INTEGER) AS n_signs, count(*) AS n_docs FROM w JOIN d ON contains(t, term) WHERE length(term) BETWEEN 1 AND 8 GROUP BY term"""


def query_languages(spark, sf):
    docs = load_table(spark, sf, "documents")
    return docs.groupBy("lang", query_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


def chunk_ranking(spark, sf):
    queries = shapes.questions(spark, sf)
    tokens = query_tokens(spark, sf)
    ranked = retrieval.rank_keyword(
        queries, shapes.conversation_items(spark, sf), tokens, shapes.conversation_chunks(spark, sf), k=5, stop_share=lexicon.IDF_STOP_SHARE
    )
    return ranked.select("query_id", "item_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


CHUNK_SQL = f"""WITH {TOKENS_SQL},
chunks AS MATERIALIZED (SELECT conv_id AS item_id, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS chunk_id, lower(text) AS t, turn FROM conversations),
items AS (SELECT item_id, min_by(t, turn) AS title, count(*) AS year FROM chunks GROUP BY 1),
terms AS (SELECT DISTINCT token FROM tokens),
{_matched('im', 'items', 'item_id', 'title', 'terms', 'token', SHORT)},
{_matched('cm', 'chunks', 'item_id, chunk_id', 't', 'terms', 'token', SHORT)},
idf AS MATERIALIZED (
  SELECT token, CASE WHEN df > n * 0.5 THEN 0.0 ELSE ln((n + 1) / (df + 1)) + 1 END AS idf
  FROM (SELECT token, count(DISTINCT item_id) AS df FROM (SELECT item_id, token FROM im UNION ALL SELECT item_id, token FROM cm) GROUP BY 1),
       (SELECT count(*) AS n FROM items)),
best AS (
  SELECT item_id, chunk_id, token, max(w) AS w FROM (
    SELECT im.item_id, chunk_id, token, 3 AS w FROM im JOIN chunks USING (item_id)
    UNION ALL SELECT item_id, chunk_id, token, 1 FROM cm) GROUP BY ALL),
scores AS (SELECT query_id, item_id, chunk_id, sum(w * idf) AS score
  FROM best JOIN idf USING (token) JOIN tokens USING (token) GROUP BY ALL HAVING sum(w * idf) > 0)
SELECT query_id, item_id, chunk_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, year DESC, item_id, chunk_id) AS rank
  FROM scores JOIN items USING (item_id)) WHERE rank <= 5"""


def tag_bonus(spark, sf):
    """Canonical tokens inside item tags; the tags of a document are its title words."""
    queries = shapes.questions(spark, sf)
    tokens = query_tokens(spark, sf)
    items = shapes.corpus(spark, sf).select("item_id", F.split("title", " ").alias("evidence_tags"))
    canonical = tokens.select("token").distinct()
    return retrieval.tag_bonus(items, "item_id", tokens, canonical, lexicon.ITEM_TAG_BONUS).select(
        "query_id", "item_id", "bonus"
    )


TAG_SQL = f"""WITH {TOKENS_SQL},
owner AS (SELECT doc_id AS item_id, unnest(string_split(split_part(text, chr(10), 1), ' ')) AS tag FROM documents),
canon AS (SELECT DISTINCT token FROM tokens),
hit AS (SELECT DISTINCT item_id, token FROM (SELECT DISTINCT tag, token FROM (SELECT DISTINCT tag FROM owner) JOIN canon ON contains(tag, token)) JOIN owner USING (tag))
SELECT query_id, item_id, CAST(count(*) * 2 AS DOUBLE) AS bonus FROM hit JOIN tokens USING (token) GROUP BY ALL"""


SEARCH_SQL = f"""
groups(canonical, term) AS (VALUES {_SEARCH_GROUPS_SQL}),
qtext AS (SELECT item_id AS query_id, lower(trim(text)) AS t FROM benchmark),
terms AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(t, '[a-z0-9][a-z0-9\\-]*')) AS term FROM qtext
  UNION SELECT query_id, unnest(regexp_extract_all(t, '[一-鿿]+')) FROM qtext
  UNION SELECT query_id, m.term FROM qtext JOIN groups g ON {_keyword('g.term', 't')} JOIN groups m ON m.canonical = g.canonical),
{shapes.CORPUS_SQL},
dterms AS (SELECT DISTINCT term FROM terms),
{_matched('in_text', 'items', 'item_id', 'abstract', 'dterms', 'term', ASCII_WORD)},
{_matched('in_title', 'items', 'item_id', 'title', 'dterms', 'term', ASCII_WORD)},
hits AS (
  SELECT item_id, term, sum(w) AS w FROM (
    SELECT item_id, term, 1 AS w FROM in_text UNION ALL SELECT item_id, term, 4 FROM in_title) GROUP BY ALL),
scores AS MATERIALIZED (SELECT query_id, item_id, CAST(sum(w) AS INTEGER) AS score FROM hits JOIN terms USING (term) GROUP BY ALL)"""


def _search(spark, sf, **kw):
    return search.search_literature(shapes.questions(spark, sf), shapes.corpus(spark, sf), **kw)


def literature_search(spark, sf):
    return _search(spark, sf, page=2, page_size=10)[0]


def literature_search_by_year(spark, sf):
    return _search(spark, sf, sort="year_desc", source="cn_literature", page_size=5)[0]


def literature_search_oldest(spark, sf):
    return _search(spark, sf, sort="year_asc", source="pubmed", page_size=5)[0]


def literature_search_totals(spark, sf):
    return _search(spark, sf)[1]


_DISEASE = [t.lower() for t in lexicon.SEARCH_ALIASES["disease"]]


def broad_search(spark, sf):
    """Questions that name only the disease, in either language, keep the corpus order behind the language; every third one adds a word of
    its own and is scored. Every second title names the disease."""
    q, d, n = F.col("query_id"), F.col("item_id"), len(_DISEASE)
    names = F.array(*[F.lit(t) for t in _DISEASE])
    named = lambda i: F.element_at(names, (i % n + 1).cast("int"))
    word = F.element_at(F.split("text", " "), 1)
    asked = shapes.questions(spark, sf).withColumn("text", F.when(q % 3 == 2, F.concat_ws(" ", named(q), word)).otherwise(named(q)))
    items = shapes.corpus(spark, sf).withColumn("title", F.when(d % 2 == 0, F.concat_ws(" ", "title", named(F.floor(d / 2)))).otherwise(F.col("title")))
    return search.search_literature(asked, items, page_size=20)[0]


_DISEASE_LIST = "[" + ", ".join(f"'{t}'" for t in _DISEASE) + "]"
BROAD_SQL = "WITH " + SEARCH_SQL.replace(
    "SELECT item_id AS query_id, lower(trim(text)) AS t FROM benchmark",
    f"SELECT item_id AS query_id, lower({_DISEASE_LIST}[item_id % {len(_DISEASE)} + 1] || CASE WHEN item_id % 3 = 2 THEN ' ' || string_split(text, ' ')[1] ELSE '' END) AS t FROM benchmark",
).replace(
    "lower(split_part(text, chr(10), 1)) AS title",
    f"lower(split_part(text, chr(10), 1)) || CASE WHEN doc_id % 2 = 0 THEN ' ' || {_DISEASE_LIST}[doc_id // 2 % {len(_DISEASE)} + 1] ELSE '' END AS title",
) + f""",
broad AS (SELECT query_id, bool_and(list_contains({_DISEASE_LIST}, term)) AS broad FROM terms GROUP BY 1)
SELECT query_id, item_id, score, bonus, year, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bonus DESC, CASE WHEN NOT broad THEN score END DESC, CASE WHEN NOT broad THEN year END DESC, ord) AS position FROM (
    SELECT query_id, item_id, score, year, ord, broad, CASE WHEN source_type = CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'cn_literature' ELSE 'pubmed' END THEN 1 ELSE 0 END AS bonus
    FROM scores JOIN items USING (item_id) JOIN qtext USING (query_id) JOIN broad USING (query_id)))
WHERE position <= 20"""


def _search_page_sql(order: str, where: str, first: int, last: int) -> str:
    return f"""WITH {SEARCH_SQL}
SELECT query_id, item_id, score, bonus, year, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM (
    SELECT query_id, item_id, score, year, ord, source_type, CASE WHEN source_type = 'pubmed' THEN 1 ELSE 0 END AS bonus
    FROM scores JOIN items USING (item_id)) WHERE {where})
WHERE position BETWEEN {first} AND {last}"""


def vector_neighbours(spark, sf):
    """For every vector the ten nearest vectors by inner product."""
    vectors = load_table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = retrieval.vector_top_k(queries, vectors.select("vec_id", F.col("embedding").alias("vec")), 10)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def vector_neighbours_by_cells(spark, sf):
    """The same neighbours with cells of about 64 vectors, most of which a query can leave out where the vectors form clusters."""
    vectors = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    found, _ = retrieval.pruned_top_k(queries, vectors, 10, cell_rows=64)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


_NEIGHBOURS = """
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""


def hashing_similarity(spark, sf):
    """Hashing embedding of every document against its first line (cosine support score)."""
    docs = load_table(spark, sf, "documents")
    a, b = F.col("whole"), F.col("head")
    return docs.select(
        "doc_id", hashing_embedding("text").alias("whole"),
        hashing_embedding(F.split_part("text", F.lit("\n"), F.lit(1))).alias("head"),
    ).select("doc_id", F.round(retrieval.cosine(a, b), 4).alias("support"))


# the 128 dimensions repeat 16 bits of the digest eight times; a text without tokens is the first unit vector
_HASH_SQL = """
token AS (SELECT id, side, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+') || regexp_extract_all(t, '[一-鿿]')) AS token FROM text),
digest AS (SELECT token, md5(token) AS h FROM (SELECT DISTINCT token FROM token)),
sign AS (SELECT token, i, 2 * ((CAST('0x' || substr(h, 1 + 2 * i, 2) AS INTEGER) >> (i % 8)) & 1) - 1 AS s FROM digest, (SELECT CAST(unnest(range(16)) AS INTEGER) AS i)),
place AS (SELECT id, side, i, sum(n * s) AS v FROM (SELECT id, side, token, count(*) AS n FROM token GROUP BY ALL) JOIN sign USING (token) GROUP BY ALL)"""

SUPPORT_SQL = f"""WITH text AS (SELECT doc_id AS id, 'whole' AS side, lower(coalesce(text, '')) AS t FROM documents
  UNION ALL SELECT doc_id, 'head', lower(split_part(coalesce(text, ''), chr(10), 1)) FROM documents), {_HASH_SQL},
pair AS (SELECT id, i, coalesce(sum(v) FILTER (side = 'whole'), 0) AS a, coalesce(sum(v) FILTER (side = 'head'), 0) AS b FROM place GROUP BY ALL),
total AS (SELECT id, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a) FILTER (i = 0) AS a0, sum(b) FILTER (i = 0) AS b0 FROM pair GROUP BY 1)
SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN coalesce(aa, 0) = 0 AND coalesce(bb, 0) = 0 THEN 1.0 WHEN aa = 0 THEN b0 / sqrt(8 * bb) WHEN bb = 0 THEN a0 / sqrt(8 * aa)
  ELSE ab / (sqrt(aa) * sqrt(bb)) END)), 4) AS support FROM documents LEFT JOIN total ON id = doc_id"""


def _fusion_lists(spark, sf):
    vectors = load_table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    near = materialize(retrieval.vector_top_k(queries, vectors.select("vec_id", F.col("embedding").alias("vec")), 50))  # read twice
    flipped = queries.withColumn("qvec", F.reverse("qvec"))
    other = materialize(retrieval.vector_top_k(flipped, vectors.select("vec_id", F.col("embedding").alias("vec")), 50))
    shape = lambda df, no: df.select(
        "query_id", F.col("vec_id").alias("item_id"), F.lit("_").alias("chunk_id"), "score", "rank",
        F.lit(0).alias("bonus"), (F.lit(2000) + F.col("vec_id") % 7).cast("int").alias("year"), F.lit(no).alias("list_no"),
    )
    order = [F.desc("score"), F.asc("item_id")]
    limit = lexicon.RRF_LIST_LIMIT
    return [retrieval.list_heads(shape(df, no), no, order, limit) for no, df in ((0, near), (1, other))]


def rank_fusion(spark, sf):
    fused = retrieval.fuse(_fusion_lists(spark, sf), k=20)
    return fused.select("query_id", "item_id", F.round("rrf", 8).alias("rrf"), "score", "rank")


FUSION_SQL = """WITH pairs AS (
  SELECT 0 AS list_no, q.vec_id AS query_id, v.vec_id AS item_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v
  UNION ALL
  SELECT 1, q.vec_id, v.vec_id, list_inner_product(CAST(list_reverse(q.embedding) AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
  FROM embeddings q, embeddings v),
heads AS (SELECT *, row_number() OVER (PARTITION BY list_no, query_id ORDER BY score DESC, item_id) AS r FROM pairs WHERE score > 0),
fused AS (SELECT query_id, item_id, sum(1.0 / (60 + r)) AS rrf, CAST(2000 + item_id % 7 AS INTEGER) AS year, min(list_no * 1000 + r) AS seen
  FROM heads WHERE r <= 50 GROUP BY query_id, item_id)
SELECT query_id, item_id, round(rrf, 8) AS rrf, pool - rank + 1 AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, year DESC, seen) AS rank,
         count(*) OVER (PARTITION BY query_id) AS pool FROM fused) WHERE rank <= 20"""


def hybrid_ranking(spark, sf):
    """Keyword and hashing-vector lists over conversation turns, fused."""
    queries = shapes.questions(spark, sf)
    ranked = retrieval.rank_hybrid(
        queries, shapes.conversation_items(spark, sf), query_tokens(spark, sf),
        shapes.conversation_chunks(spark, sf), k=10, encode=hashing_embedding, stop_share=lexicon.IDF_STOP_SHARE,
    )
    return ranked.select("query_id", "item_id", "chunk_id", F.round("rrf", 8).alias("rrf"), "score", "rank")


# keyword list of CHUNK_SQL (unscored chunks where a question has none), vector list over the hashed turns, fused
HYBRID_SQL = CHUNK_SQL.split("SELECT query_id, item_id, chunk_id, round(score, 6)")[0].rstrip() + f""",
text AS (SELECT 'q' || CAST(item_id AS VARCHAR) AS id, 'q' AS side, lower(text) AS t FROM benchmark UNION ALL SELECT chunk_id, 'c', t FROM chunks), {_HASH_SQL},
norm AS (SELECT id, sqrt(8 * sum(v * v)) AS n FROM place GROUP BY 1),
unit AS (SELECT text.id, text.side, list(CAST(CASE WHEN n > 0 THEN coalesce(v, 0) / n WHEN d = 0 THEN 1.0 ELSE 0.0 END AS FLOAT) ORDER BY d) AS u
  FROM text CROSS JOIN (SELECT CAST(unnest(range(128)) AS INTEGER) AS d) LEFT JOIN norm USING (id) LEFT JOIN place ON place.id = text.id AND place.i = d % 16 GROUP BY ALL),
near AS (SELECT CAST(substr(q.id, 2) AS BIGINT) AS query_id, c.id AS chunk_id, list_inner_product(CAST(q.u AS DOUBLE[]), CAST(c.u AS DOUBLE[])) AS s FROM unit q, unit c WHERE q.side = 'q' AND c.side = 'c'),
vector AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM near QUALIFY r <= 50),
keyword AS (SELECT query_id, item_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, year DESC, item_id, chunk_id) AS r
  FROM scores JOIN items USING (item_id) QUALIFY r <= 50),
unscored AS (SELECT item_id, chunk_id, row_number() OVER (ORDER BY year DESC, item_id, chunk_id) AS r FROM chunks JOIN items USING (item_id) QUALIFY r <= 50),
lists AS (SELECT 0 AS list_no, query_id, chunk_id, r FROM keyword
  UNION ALL SELECT 0, item_id, chunk_id, r FROM (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM keyword)) CROSS JOIN (SELECT chunk_id, r FROM unscored)
  UNION ALL SELECT 1, query_id, chunk_id, r FROM vector),
fused AS (SELECT query_id, item_id, chunk_id, sum(1.0 / (60 + r)) AS rrf, year, min(list_no * 1000 + r) AS seen FROM lists JOIN chunks USING (chunk_id) JOIN items USING (item_id) GROUP BY ALL)
SELECT query_id, item_id, chunk_id, round(rrf, 8) AS rrf, pool - rank + 1 AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, year DESC, seen) AS rank, count(*) OVER (PARTITION BY query_id) AS pool FROM fused) WHERE rank <= 10"""


def first_candidate_per_item(spark, sf):
    """Best turn per conversation for every question, first ten conversations."""
    queries = shapes.questions(spark, sf)
    candidates = retrieval.keyword_candidates(
        queries, shapes.conversation_items(spark, sf), query_tokens(spark, sf),
        shapes.conversation_chunks(spark, sf), stop_share=lexicon.IDF_STOP_SHARE,
    )
    return retrieval.first_per_item(candidates, 10)


FIRST_SQL = CHUNK_SQL.replace(
    "SELECT query_id, item_id, chunk_id, round(score, 6) AS score, rank FROM (",
    "SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM (",
).replace(") WHERE rank <= 5", ") GROUP BY query_id, item_id) WHERE rank <= 10")


def entity_aliases(spark, sf):
    """Regions as formulas over their nations: every name with the tokens it brings in."""
    nations, regions = load_table(spark, sf, "nation"), load_table(spark, sf, "region")
    herb_id = F.concat(F.lit("herb-"), F.col("n_nationkey").cast("string"))
    herbs = nations.select(herb_id.alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("pinyin"), F.lit("").alias("latin_name"))
    members = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(herb_id)).alias("herb_ids"))
    formulas = regions.join(members, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.concat(F.lit("formula-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("").alias("pinyin"), "herb_ids")
    return tokenize.entity_alias_table(formulas, herbs)


def entity_alias_tokens(spark, sf):
    return entity_aliases(spark, sf).select(F.array_join("terms", ",").alias("terms"), F.array_join(F.sort_array("tokens"), ",").alias("tokens"))


def _dictionary(spark, sf):
    parts = load_table(spark, sf, "part")
    return parts.groupBy(F.col("p_type").alias("canonical")).agg(F.collect_set("p_name").alias("en"), F.collect_set("p_brand").alias("zh"))


def domain_vocabulary(spark, sf):
    """Part names, brands and types as a bilingual dictionary, with the entity names."""
    return tokenize.domain_vocabulary(spark, None, _dictionary(spark, sf), entity_aliases(spark, sf))


def bridged_tokens(spark, sf):
    """Part names (widgets, bolts, ...) as queries, expanded through the dictionary."""
    queries = load_table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    tokens = tokenize.tokenize_queries(queries, None, _dictionary(spark, sf).select("canonical", F.array(F.lit("skipped")).alias("zh"), "en"), None)
    return tokens.groupBy("query_id").agg(F.count("*").alias("n_tokens"))


def chunkless_items(spark, sf):
    """Documents without labels as items without chunks."""
    items = load_table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    chunks = load_table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return retrieval.chunkless_candidates(items, chunks).select("item_id", "score")


def rank_scores(spark, sf):
    """Orders of every customer by price: rank turned into a descending score."""
    orders = load_table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("price"))
    ranked = retrieval.rank_candidates(orders, [F.desc("price"), F.asc("item_id")])
    return retrieval.rank_to_score(ranked).select("query_id", "item_id", "rank", "score")


_ALIAS_SQL = """SELECT lower(r_name) AS terms, array_to_string(list_sort(list_concat(['formula-' || r_regionkey, 'formula'], list('herb-' || n_nationkey))), ',') AS tokens FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
UNION ALL SELECT lower(n_name), array_to_string(list_sort(['herb-' || n_nationkey, 'herb', 'formula-' || n_regionkey]), ',') FROM nation"""


QUERIES = {
    "entity_aliases": (entity_alias_tokens, _ALIAS_SQL),
    "domain_vocabulary": (
        domain_vocabulary,
        f"""WITH groups(canonical, term) AS (VALUES {_GROUPS_SQL}), a AS ({_ALIAS_SQL})
        SELECT DISTINCT token FROM (SELECT canonical AS token FROM groups UNION ALL SELECT lower(p_name) FROM part UNION ALL SELECT lower(p_brand) FROM part UNION ALL SELECT lower(p_type) FROM part
        UNION ALL SELECT unnest(string_split(terms, ',')) FROM a UNION ALL SELECT unnest(string_split(tokens, ',')) FROM a)""",
    ),
    "bridged_tokens": (
        bridged_tokens,
        """WITH q AS (SELECT p_partkey AS query_id, p_name AS t FROM part), d AS (SELECT DISTINCT p_type, p_name FROM part),
        tk AS (SELECT query_id, unnest(regexp_extract_all(t, '[a-z0-9\\-]+')) AS token FROM q UNION SELECT query_id, unnest(['skipped', p_type]) FROM q JOIN d ON contains(t, p_name))
        SELECT query_id, count(*) AS n_tokens FROM tk GROUP BY 1""",
    ),
    "chunkless_items": (chunkless_items, "SELECT doc_id AS item_id, 0.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "rank_scores": (
        rank_scores,
        "SELECT o_custkey AS query_id, o_orderkey AS item_id, CAST(row_number() OVER w AS INTEGER) AS rank, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w + 1 AS score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    ),
    "query_tokens": (query_tokens, f"WITH {TOKENS_SQL} SELECT query_id, token FROM tokens"),
    "keyword_ranking": (
        keyword_ranking,
        f"WITH {KEYWORD_SQL} SELECT query_id, item_id, round(score, 6) AS score, bonus, year, rank FROM ranked WHERE rank <= 10",
    ),
    "token_idf": (token_idf, f"WITH {KEYWORD_SQL} SELECT token, df, round(CASE WHEN n > 100 AND df > n * 0.5 THEN 0.0 ELSE ln((n + 1) / (df + 1)) + 1 END, 6) AS idf FROM idf, (SELECT count(*) AS n FROM items)"),
    "token_idf_stopped": (token_idf_stopped, f"WITH {KEYWORD_SQL} SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "phrase_frequencies": (phrase_frequencies, PHRASE_SQL),
    "chinese_terms": (chinese_terms, CHINESE_SQL),
    "query_languages": (
        query_languages,
        "SELECT lang, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY ALL",
    ),
    "chunk_ranking": (chunk_ranking, CHUNK_SQL),
    "tag_bonus": (tag_bonus, TAG_SQL),
    "literature_search": (
        literature_search, _search_page_sql("bonus DESC, score DESC, year DESC, ord", "true", 11, 20),
    ),
    "broad_search": (broad_search, BROAD_SQL),
    "literature_search_by_year": (
        literature_search_by_year,
        _search_page_sql("year DESC, score DESC, bonus DESC, ord", "source_type = 'cn_literature'", 1, 5),
    ),
    "literature_search_oldest": (
        literature_search_oldest,
        _search_page_sql("year ASC, score DESC, bonus DESC, ord", "source_type = 'pubmed'", 1, 5),
    ),
    "literature_search_totals": (
        literature_search_totals,
        f"""WITH {SEARCH_SQL} SELECT query_id, coalesce(total, 0) AS total, 1 AS page, 10 AS page_size,
        CAST(ceil(coalesce(total, 0) / 10) AS BIGINT) AS total_pages
        FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN (SELECT query_id, count(*) AS total FROM scores GROUP BY 1) USING (query_id)""",
    ),
    "vector_neighbours": (
        vector_neighbours,
        f"WITH {_NEIGHBOURS} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM near WHERE rank <= 10",
    ),
    "vector_neighbours_by_cells": (
        vector_neighbours_by_cells,
        f"WITH {_NEIGHBOURS} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM near WHERE rank <= 10",
    ),
    "hashing_similarity": (hashing_similarity, SUPPORT_SQL),
    "rank_fusion": (rank_fusion, FUSION_SQL),
    "hybrid_ranking": (hybrid_ranking, HYBRID_SQL),
    "first_candidate_per_item": (first_candidate_per_item, FIRST_SQL),
}
