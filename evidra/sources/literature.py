"""Literature sources and sinks: corpus, chunks, evaluation sets, dictionaries, article XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.sources.positions import positioned

ITEM_SCHEMA = (
    "id string, title string, language string, source_type string, source string, record_origin string, year int, "
    "snippet string, authors array<string>, keywords array<string>, evidence_tags array<string>, abstract string, "
    "citation_url string, pubmed_id string, doi string, pdf_upload_id string, pdf_file_name string, pdf_parse_status string, "
    "pdf_parse_message string, pdf_parse_started_at string, pdf_parse_finished_at string, last_parse_trigger string, "
    "parse_attempt_count int, related_entity_ids array<string>"
)
CHUNK_SCHEMA = (
    "chunk_id string, literature_id string, section string, text string, source_quote string, evidence_tags array<string>, "
    "related_entity_ids array<string>, source_type string, pdf_upload_id string"
)
QUESTION_SCHEMA = (
    "id string, question string, source_preference string, difficulty string, expected_literature_ids array<string>, "
    "expected_chunk_ids array<string>, must_include array<string>, must_not_include array<string>, compliance_notes string"
)
PAIR_SCHEMA = "id string, claim string, chunk_text string, supported boolean, note string"
REAL_PAIR_SCHEMA = (
    "claim string, premise string, premise_chunk_id string, premise_literature_id string, support_label string, "
    "source string, semantic_score_bge double, label_note string"
)
LIVE_SOURCE = "PubMed live sync"


def record_origin(source: Column, given: Column) -> Column:
    derived = F.when(source == LIVE_SOURCE, F.lit("pubmed_live")).otherwise(F.lit("seed_sample"))
    return F.coalesce(F.when(given != "", given), derived)


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON list files (or JSON lines written by this library) under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with derived origin and ``ord``, the input position ties fall back to."""
    raw = positioned(read_json_list(spark, path, ITEM_SCHEMA), "ord")
    return raw.withColumn("record_origin", record_origin(F.col("source"), F.col("record_origin")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return positioned(read_json_list(spark, path, CHUNK_SCHEMA), "ord")


def chunks_of(chunks: DataFrame, literature_id: str) -> DataFrame:
    """Chunks of one item; an equality filter that reaches the scan."""
    return chunks.where(F.col("literature_id") == literature_id)


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_json_list(spark, path, QUESTION_SCHEMA)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_list(spark, path, PAIR_SCHEMA)


def read_real_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_list(spark, path, REAL_PAIR_SCHEMA)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Bilingual terms of ``{"terms": [...]}``; a malformed file gives no terms, never an error.
    Longest terms come first in ``ord``."""
    schema = "terms array<struct<zh:string,en:array<string>,canonical:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = raw.select(F.posexplode("terms").alias("pos", "t")).select(
        F.col("t.zh").alias("zh"), F.coalesce("t.en", F.array().cast("array<string>")).alias("en"),
        F.coalesce("t.canonical", F.lit("")).alias("canonical"), F.col("pos").cast("bigint").alias("ord"))
    return rows.where("zh is not null")


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    schema = "alias_map array<struct<canonical:string,zh:array<string>,en:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    none = F.array().cast("array<string>")
    return raw.select(F.explode("alias_map").alias("a")).select(
        F.coalesce("a.canonical", F.lit("")).alias("canonical"), F.coalesce("a.zh", none).alias("zh"), F.coalesce("a.en", none).alias("en"))


# --- article XML ---------------------------------------------------------------------------------


def _text(xml: Column, path: str) -> Column:
    return F.trim(F.xpath_string(xml, F.lit(path)))


def _year(xml: Column) -> Column:
    base = "/PubmedArticle/MedlineCitation/Article"
    candidates = []
    for path in ("ArticleDate/Year", "Journal/JournalIssue/PubDate/Year", "Journal/JournalIssue/PubDate/MedlineDate"):
        text = _text(xml, f"{base}/{path}")
        head = F.regexp_extract(text, "^(\\d+)(?=$|[\\s-])", 1)
        candidates.append(F.when(head != "", head.cast("int")))
    return F.coalesce(*candidates)


def parse_articles(rows: DataFrame) -> DataFrame:
    """(xml: one ``PubmedArticle``) -> bibliographic columns; rows without pmid or title drop.

    Mixed content keeps its text. Every author is read on its own, so missing parts of one
    author do not shift the next one's.
    """
    base = "/PubmedArticle/MedlineCitation"
    art = f"{base}/Article"
    xml = F.col("xml")

    pieces = F.transform(
        F.regexp_extract_all(xml, F.lit("(?s)(<AbstractText(?:\\s[^>]*)?>.*?</AbstractText>)"), F.lit(1)),
        lambda p: F.struct(
            F.regexp_extract(p, "^<AbstractText[^>]*\\bLabel=\"([^\"]*)\"", 1).alias("label"), inner_text(p).alias("text")),
    )
    abstract = F.array_join(
        F.transform(
            F.filter(pieces, lambda p: p["text"] != ""),
            lambda p: F.when(p["label"] != "", F.concat(p["label"], F.lit(": "), p["text"])).otherwise(p["text"])), " ")
    authors = F.transform(
        F.regexp_extract_all(xml, F.lit("(?s)<Author(?:\\s[^>]*)?>(.*?)</Author>"), F.lit(1)), _author_name)
    keywords = F.array_distinct(F.filter(
        F.transform(F.regexp_extract_all(xml, F.lit("(?s)<Keyword(?:\\s[^>]*)?>(.*?)</Keyword>"), F.lit(1)), inner_text), lambda k: k != ""))
    journal = F.coalesce(*[
        F.when(_text(xml, f"{art}/{p}") != "", _text(xml, f"{art}/{p}")) for p in ("Journal/Title", "Journal/ISOAbbreviation")])
    doi = _text(xml, "/PubmedArticle/PubmedData/ArticleIdList/ArticleId[@IdType='doi']")
    parsed = rows.select(
        _text(xml, f"{base}/PMID").alias("pmid"), _text(xml, f"{art}/ArticleTitle").alias("title"), F.trim(abstract).alias("abstract"),
        F.filter(authors, lambda a: a.isNotNull()).alias("authors"), keywords.alias("keywords"), _year(xml).alias("year"),
        journal.alias("journal"), F.when(doi != "", doi).alias("doi"))
    return parsed.where("pmid <> '' and title <> ''")


def inner_text(fragment: Column) -> Column:
    """Text of an XML fragment: tags removed, the five standard entities and spaces resolved."""
    text = F.regexp_replace(fragment, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def _author_name(author: Column) -> Column:
    part = lambda tag: inner_text(F.regexp_extract(author, f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1))
    collective, last, fore = part("CollectiveName"), part("LastName"), part("ForeName")
    full = F.concat_ws(" ", F.when(last != "", last), F.when(fore != "", fore))
    return F.when(collective != "", collective).when(full != "", full)


def split_articles(documents: DataFrame, column: str = "xml") -> DataFrame:
    """One row per article of a fetched set."""
    pattern = "(?s)(<PubmedArticle(?:\\s[^>]*)?>.*?</PubmedArticle>)"
    return documents.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("xml"))


def search_ids(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Article ids of a search response, in order."""
    ids = F.xpath(column, F.lit("/eSearchResult/IdList/Id/text()"))
    return documents.select(F.posexplode(ids).alias("position", "pmid"))


def records_to_items(records: DataFrame) -> DataFrame:
    """Fetched records as corpus items."""
    abstract = F.coalesce("abstract", F.lit(""))
    return records.select(
        F.concat(F.lit("pmid-"), "pmid").alias("id"), "title", F.lit("en").alias("language"), F.lit("pubmed").alias("source_type"),
        F.lit(LIVE_SOURCE).alias("source"), F.lit("pubmed_live").alias("record_origin"), F.coalesce("year", F.lit(0)).alias("year"),
        F.when(abstract != "", F.substring(abstract, 1, 280)).otherwise(F.col("title")).alias("snippet"),
        F.when(abstract != "", abstract).alias("abstract"), "authors", "keywords", F.array().cast("array<string>").alias("evidence_tags"),
        F.col("pmid").alias("pubmed_id"), "doi", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("citation_url"))


def with_preview(docs: DataFrame, column: str, max_chars: int = 300) -> DataFrame:
    """Adds ``preview``: the most readable window of a text. Lines and the best start are
    columns of their own, so neither is computed twice."""
    staged = docs.withColumn("_lines", tx.preview_lines(F.col(column)))
    scores = F.transform("_lines", lambda l, i: F.struct(tx.preview_line_score(l).alias("s"), (-i).alias("i")))
    staged = staged.withColumn("_start", F.when(F.size("_lines") > 0, -F.array_max(scores)["i"]).otherwise(F.lit(0)))
    return staged.withColumn("preview", tx.preview_window(F.col(column), F.col("_lines"), F.col("_start"), max_chars)).drop("_lines", "_start")


# --- sinks -----------------------------------------------------------------------------------------


# Fields a sync owns; all others belong to the user's uploads.
SYNCED_FIELDS = [
    "title", "abstract", "authors", "year", "keywords", "evidence_tags", "source", "snippet", "citation_url", "doi",
    "pubmed_id", "language", "source_type", "record_origin",
]


def upsert_items(existing: DataFrame, incoming: DataFrame, key: str = "id", owned: list[str] | None = None) -> DataFrame:
    """Existing and incoming items merged, with ``sync_state`` created / updated / kept.

    Only owned fields are overwritten. ``incoming`` holds one row per key.
    """
    owned = [f for f in (owned or SYNCED_FIELDS) if f in incoming.columns]
    new = incoming.select(F.col(key), F.struct(*incoming.columns).alias("_new"))
    old = existing.select(F.col(key), F.struct(*existing.columns).alias("_old"))
    joined = old.join(new, key, "full_outer")
    has_new, has_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    columns = []
    for name in existing.columns:
        if name == key:
            columns.append(F.col(key))
        elif name in owned:
            columns.append(F.when(has_new, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}")).alias(name))
        elif name in incoming.columns:
            columns.append(F.when(has_old, F.col(f"_old.{name}")).otherwise(F.col(f"_new.{name}")).alias(name))
        else:
            columns.append(F.col(f"_old.{name}").alias(name))
    state = F.when(has_new & has_old, F.lit("updated")).when(has_new, F.lit("created")).otherwise(F.lit("kept"))
    return joined.select(*columns, state.alias("sync_state"))


def sync_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("sync_state") == "created").alias("created"), F.count_if(F.col("sync_state") == "updated").alias("updated"))


DEFAULT_ENTITY = "disease:atopic-dermatitis"


def upsert_chunks(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploaded chunks (with ``seq``) replace or join the table; the last upload of a key wins."""
    shape = [c for c in chunks.columns if c in uploads.columns]
    last = uploads.groupBy("chunk_id").agg(F.max_by(F.struct(*uploads.columns), "seq").alias("r")).select("r.*")
    entities = F.when(F.size("related_entity_ids") > 0, F.col("related_entity_ids")).otherwise(F.array(F.lit(DEFAULT_ENTITY)))
    fresh = last.withColumn("related_entity_ids", entities).select(*shape)
    kept = chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select(*shape)
    return kept.unionByName(fresh)


def attach_uploads(items: DataFrame, uploads: DataFrame) -> DataFrame:
    """The last upload per item (id, pdf_upload_id, pdf_file_name, seq) resets its parse fields."""
    last = uploads.groupBy("id").agg(F.max_by(F.struct("pdf_upload_id", "pdf_file_name"), "seq").alias("u"))
    hit = F.col("u").isNotNull()
    reset = {"pdf_parse_message": None, "pdf_parse_started_at": None, "pdf_parse_finished_at": None, "last_parse_trigger": None,
             "pdf_parse_status": "pending", "parse_attempt_count": 0}
    joined = items.join(last, "id", "left")
    for name in ("pdf_upload_id", "pdf_file_name"):
        joined = joined.withColumn(name, F.when(hit, F.col(f"u.{name}")).otherwise(F.col(name)))
    for name, value in reset.items():
        if name in items.columns:
            joined = joined.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return joined.drop("u")


def parse_status_states(items: DataFrame, updates: DataFrame) -> DataFrame:
    """State of every status update: not_found, missing_metadata, conflict or ok."""
    known = items.select("id", F.col("pdf_upload_id").alias("have_id"), F.col("pdf_file_name").alias("have_name"), F.lit(True).alias("found"))
    rows = updates.join(known, "id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    differs = lambda want, have: F.col(want).isNotNull() & (F.col(want) != F.col(have))
    state = (
        F.when(F.col("found").isNull(), F.lit("not_found"))
        .when(blank("have_id") | blank("have_name"), F.lit("missing_metadata"))
        .when(differs("expected_pdf_upload_id", "have_id") | differs("expected_file_name", "have_name"), F.lit("conflict"))
        .otherwise(F.lit("ok"))
    )
    return rows.select(*updates.columns, state.alias("state"))


def apply_parse_status(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items after all accepted updates: the last status, one attempt counted per update."""
    ok = parse_status_states(items, updates).where("state = 'ok'")
    last = ok.groupBy("id").agg(F.max_by("pdf_parse_status", "seq").alias("_s"), F.max_by("trigger", "seq").alias("_t"), F.count("*").alias("_n"))
    joined = items.join(last, "id", "left")
    return joined.withColumn("pdf_parse_status", F.coalesce("_s", "pdf_parse_status")).withColumn(
        "last_parse_trigger", F.coalesce("_t", "last_parse_trigger")).withColumn(
        "parse_attempt_count", (F.coalesce("parse_attempt_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).drop("_s", "_t", "_n")
