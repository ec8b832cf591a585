"""Query expansion with dictionary tables (retrieval and search variants)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import lexicon
from evidra.functions.text import (
    CJK_CLASS, cjk_chars, normalized, plain_tokens, replace_first,
)
from evidra.operators.matching import KEYWORD, match_texts
from evidra.session import union_all


def _group_table(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    rows = [(name, term) for name, terms in groups.items() for term in terms]
    return spark.createDataFrame(rows, "canonical string, term string")


def keyword_alias_table(spark: SparkSession) -> DataFrame:
    return _group_table(spark, lexicon.KEYWORD_ALIASES)


def search_alias_table(spark: SparkSession) -> DataFrame:
    return _group_table(spark, lexicon.SEARCH_ALIASES)


def entity_alias_table(formulas: DataFrame, herbs: DataFrame) -> DataFrame:
    """Formula and herb names as (terms, tokens): a name brings in its own id, its kind and
    the ids linked with it."""
    named = (F.length(F.trim("id")) > 0) & (F.length(F.trim("name")) > 0)
    clean = lambda *cols: F.array_distinct(
        F.filter(F.array(*[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in cols]), lambda t: t != "")
    )
    formula_rows = formulas.where(named).select(
        clean(F.col("name"), F.col("pinyin")).alias("terms"),
        F.array_distinct(
            F.concat(F.array("id", F.lit("formula")), F.coalesce("herb_ids", F.array().cast("array<string>")))
        ).alias("tokens"),
    )
    linked = (
        formulas.where("length(trim(id)) > 0").select(F.explode("herb_ids").alias("id"), F.col("id").alias("formula_id"))
        .groupBy("id").agg(F.collect_set("formula_id").alias("formula_ids"))
    )
    herb_rows = herbs.where(named).join(linked, "id", "left").select(
        clean(F.col("name"), F.col("pinyin"), F.col("latin_name")).alias("terms"),
        F.concat(
            F.array("id", F.lit("herb")), F.coalesce("formula_ids", F.array().cast("array<string>"))
        ).alias("tokens"),
    )
    return formula_rows.unionByName(herb_rows)


def canonical_tokens(
    spark: SparkSession, cjk_terms: DataFrame | None = None, alias_map: DataFrame | None = None
) -> DataFrame:
    """Tokens that may earn the tag bonus: the union of all canonical names."""
    parts = [keyword_alias_table(spark).select(F.col("canonical").alias("token"))]
    for table in (alias_map, cjk_terms):
        if table is not None:
            parts.append(table.where("canonical <> ''").select(F.col("canonical").alias("token")))
    return union_all(parts).distinct()


def domain_vocabulary(
    spark: SparkSession,
    cjk_terms: DataFrame | None = None,
    alias_map: DataFrame | None = None,
    entity_aliases: DataFrame | None = None,
) -> DataFrame:
    """All lower-cased dictionary terms, tokens and canonical names."""
    parts = [canonical_tokens(spark, cjk_terms, alias_map)]
    if alias_map is not None:
        parts += [alias_map.select(F.explode(c).alias("token")) for c in ("zh", "en")]
    if cjk_terms is not None:
        parts += [cjk_terms.select(F.explode("en").alias("token")), cjk_terms.select(F.col("zh").alias("token"))]
    if entity_aliases is not None:
        parts += [entity_aliases.select(F.explode(c).alias("token")) for c in ("terms", "tokens")]
    merged = union_all(parts)
    return merged.select(F.lower("token").alias("token")).where("token <> ''").distinct()


def tokenize_queries(
    queries: DataFrame,
    cjk_terms: DataFrame | None = None,
    alias_map: DataFrame | None = None,
    entity_aliases: DataFrame | None = None,
) -> DataFrame:
    """(query_id, text) -> distinct (query_id, token).

    Plain tokens; keys of alias groups; dictionary terms with their translations, whose
    characters are then no longer taken one by one; the bilingual bridge in both
    directions; entity ids behind formula and herb names.
    """
    spark = queries.sparkSession
    texts = queries.select("query_id", normalized(F.col("text")).alias("text"))
    # (term, token): a matched term brings in the token
    bridges = [keyword_alias_table(spark).select("term", F.col("canonical").alias("token"))]
    def bridge_of(table: DataFrame, terms, tokens) -> DataFrame:
        # one generator carries term and tokens together
        entries = F.transform(terms, lambda t: F.struct(t.alias("term"), tokens.alias("tokens")))
        return table.select(F.explode(entries).alias("e")).select(F.col("e.term").alias("term"), F.explode("e.tokens").alias("token"))

    def with_canonical(tokens: str):
        return F.array_union(tokens, F.array_compact(F.array(F.when(F.col("canonical") != "", F.col("canonical")))))

    if cjk_terms is not None:
        bridges.append(bridge_of(cjk_terms, F.array("zh"), with_canonical("en")))
    if alias_map is not None:
        for have, give in (("zh", "en"), ("en", "zh")):
            bridges.append(bridge_of(alias_map, F.col(have), with_canonical(give)))
    if entity_aliases is not None:
        bridges.append(bridge_of(entity_aliases, F.col("terms"), F.col("tokens")))
    bridge = union_all(bridges).where("term <> ''").distinct()
    matched = match_texts(texts, bridge.select("term"), ["query_id"])
    injected = matched.join(bridge, "term").select("query_id", "token")
    plain = texts.select("query_id", F.explode(plain_tokens(F.col("text"))).alias("token"))
    chars = leftover_characters(texts, matched, cjk_terms)
    return plain.unionByName(injected).unionByName(chars).distinct()


def leftover_characters(
    texts: DataFrame, matched: DataFrame, cjk_terms: DataFrame | None
) -> DataFrame:
    """Single CJK characters left after each matched dictionary term is cut out once,
    longest term first."""
    remaining = texts.where(F.col("text").rlike(CJK_CLASS))
    if cjk_terms is None:
        return remaining.select("query_id", F.explode(cjk_chars(F.col("text"))).alias("token"))
    if "ord" not in cjk_terms.columns:
        cjk_terms = cjk_terms.withColumn("ord", F.monotonically_increasing_id())
    terms = cjk_terms.where("zh <> ''").select(F.col("zh").alias("term"), "ord")
    cuts = matched.join(terms, "term").groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.length("term")).alias("n"), F.col("ord"), F.col("term")))
        ).alias("cuts")
    )
    cut = F.reduce(
        F.coalesce("cuts", F.array().cast("array<struct<n:int,ord:bigint,term:string>>")),
        F.col("text"),
        lambda acc, c: replace_first(acc, c["term"], F.lit(" ")),
    )
    return remaining.join(cuts, "query_id", "left").select(
        "query_id", F.explode(cjk_chars(cut)).alias("token")
    )


def tokenize_searches(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> distinct (query_id, term) of the literature search: ASCII words,
    CJK runs and every member of an alias group that is mentioned."""
    spark = queries.sparkSession
    text = normalized(F.col("text"))
    words = F.regexp_extract_all(text, F.lit("([a-z0-9][a-z0-9\\-]*)"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(f"({CJK_CLASS}+)"), F.lit(1))
    plain = queries.select("query_id", F.explode(F.array_distinct(F.concat(words, runs))).alias("term"))
    aliases = search_alias_table(spark)
    texts = queries.select("query_id", text.alias("text"))
    matched = match_texts(texts, aliases.select("term"), ["query_id"], matcher=KEYWORD)
    groups = matched.join(aliases, "term").select("query_id", "canonical").distinct()
    return plain.unionByName(groups.join(aliases, "canonical").select("query_id", "term")).distinct()


def broad_disease_queries(search_terms: DataFrame) -> DataFrame:
    """query_id of queries that name only the disease."""
    disease = [t.lower() for t in lexicon.SEARCH_ALIASES["disease"]]
    return (
        search_terms.groupBy("query_id")
        .agg(F.bool_and(F.lower("term").isin(disease)).alias("broad"))
        .where("broad").select("query_id")
    )
