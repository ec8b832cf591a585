"""Citation selection and answer texts for a batch of questions.

ranked: query_id, item_id, chunk_id, score, bonus, real, year, rank (positive candidates);
``rank`` may be a number or an order key, it is only ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import lexicon
from evidra.functions.text import confidence_prior, entity_token_variants, strip_space

# Topic label per evidence tag.
TOPIC_LABELS = {
    "skin_barrier": "皮肤屏障", "filaggrin": "丝聚蛋白与皮肤屏障", "gut_skin_axis": "肠-皮肤轴",
    "microbiome": "肠道菌群与皮肤微生物", "immune_pathway": "免疫通路与细胞因子信号",
    "pathway": "信号通路与细胞因子调控", "neuroimmune": "神经免疫", "pruritus": "瘙痒",
    "formula": "中药复方", "network_pharmacology": "网络药理学线索", "tcm_syndrome": "中医证候辨证",
    "guideline": "诊疗共识与皮肤屏障维护", "clinical_management": "长期临床管理", "review": "证据综述",
    "pathogenesis": "发病机制", "severity": "严重度关联", "flare": "急性发作",
    "targeted_therapy": "靶向治疗", "systematic_review": "系统综述", "pediatric": "儿童分层",
    "uploaded_pdf": "上传 PDF 解析片段", "pdf_parse": "PDF 解析", "atopic_dermatitis": "特应性皮炎主题",
}


def topical_queries(ranked: DataFrame, tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id of questions with a top score of at least 3 and a non-generic domain token."""
    strong = (
        tokens.where(~F.col("token").isin(lexicon.GENERIC_INTENT_TOKENS))
        .join(vocabulary, "token", "left_semi").select("query_id").distinct()
    )
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top"))
    return top.where(F.col("top") >= lexicon.RELEVANCE_MIN_TOP_SCORE).select("query_id").join(strong, "query_id", "left_semi")


def is_entity() -> Column:
    """Whether ``token`` names an entity."""
    found = F.lit(False)
    for prefix in lexicon.ENTITY_TOKEN_PREFIXES:
        found = found | F.col("token").startswith(prefix)
    return found


def wanted_entities(tokens: DataFrame) -> DataFrame:
    """(query_id, entity) of all spellings of the entities a query names."""
    return tokens.where(is_entity()).select("query_id", F.explode(entity_token_variants(F.col("token"))).alias("entity")).distinct()


def linked_entities(owners: DataFrame, key: str) -> DataFrame:
    """(key, entity) of the entities that items or chunks are linked with."""
    return owners.select(key, F.explode("related_entity_ids").alias("entity")).select(key, F.lower("entity").alias("entity")).distinct()


def entity_matches(ranked: DataFrame, tokens: DataFrame, items: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """(query_id, item_id, chunk_id) of candidates linked with an entity the query names."""
    wanted, item_ids = wanted_entities(tokens), linked_entities(items, "item_id")
    keys = ranked.select("query_id", "item_id", "chunk_id")
    hits = wanted.join(item_ids, "entity").select("query_id", "item_id").distinct()
    by_item = keys.join(hits, ["query_id", "item_id"], "left_semi")
    if chunks is None or "related_entity_ids" not in chunks.columns:
        return by_item
    chunk_hits = wanted.join(linked_entities(chunks, "chunk_id"), "entity").select("query_id", "chunk_id").distinct()
    return by_item.unionByName(keys.join(chunk_hits, ["query_id", "chunk_id"], "left_semi").select(keys.columns)).distinct()


def domain_order(ranked: DataFrame, items: DataFrame, tokens: DataFrame) -> DataFrame:
    """Questions with the ``network`` token are ordered by origin, two topic tags, language,
    score and year; the others keep their order. ``rank`` becomes the new order key."""
    rows = ranked.join(domain_tags(items), "item_id").join(network_queries(tokens), "query_id", "left")
    return rows.withColumn("rank", domain_key(F.col("rank"))).drop("np", "tt", "asked")


def network_queries(tokens: DataFrame) -> DataFrame:
    """(query_id, asked) of the queries that name the network domain."""
    return tokens.where("token = 'network'").select("query_id").distinct().withColumn("asked", F.lit(1))


def domain_tags(items: DataFrame) -> DataFrame:
    """(item_id, np, tt): whether an item has the two tags that come first there."""
    flag = lambda tag: F.array_contains("evidence_tags", tag).cast("int")
    return items.select("item_id", flag("network_pharmacology").alias("np"), flag("targeted_therapy").alias("tt"))


def domain_key(before: Column) -> Column:
    """The order of ``domain_order`` as one ascending struct, from asked, np, tt and the keys of a candidate and its order ``before``."""
    on = lambda c, of: F.when(F.col("asked") == 1, -of.cast("double")).otherwise(F.lit(0.0)).alias(c)
    # sums of equal parts differ in their last digits from run to run, so scores are compared after nine, as in every order
    plain = lambda c: on(c, F.col(c))
    return F.struct(
        plain("real"), plain("np"), plain("tt"), plain("bonus"), on("_score", F.round("score", 9)), plain("year"), before.alias("before"))


def select_citations(
    ranked: DataFrame, topical: DataFrame, entities: DataFrame | None, top_k: int = 2, source: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """(selected candidates with position and match_score, per-query counts).

    Entity matches form the pool when a query has any, otherwise all positive candidates;
    with three or more slots and one language only, the last slot goes to the best candidate
    of the other language that has a chunk.
    """
    pool = ranked.join(topical, "query_id", "left_semi")
    if entities is not None:
        marked = entities.withColumn("_e", F.lit(1)).withColumn("_chunk", F.coalesce("chunk_id", F.lit("_"))).drop("chunk_id")
        pool = pool.withColumn("_chunk", F.coalesce("chunk_id", F.lit("_"))).join(
            marked, ["query_id", "item_id", "_chunk"], "left").drop("_chunk")
        any_match = marked.select("query_id").distinct().withColumn("_any", F.lit(1))
        pool = pool.join(any_match, "query_id", "left")
        citable = pool.where(F.col("_any").isNull() | (F.col("_e") == 1)).drop("_e", "_any")
    else:
        citable = pool
    w = Window.partitionBy("query_id").orderBy("rank")
    chosen = citable.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_k)
    if top_k >= 3 and source == "all":
        chosen = _swap_last(chosen, pool, top_k)
    available = citable.groupBy("query_id").agg(F.count("*").alias("available_citation_count"))
    best = chosen.groupBy("query_id").agg(F.max("score").alias("_max"))
    scored = chosen.join(best, "query_id").withColumn(
        "match_score", F.when(F.col("_max") > 0, F.round(F.col("score") / F.col("_max"), 4)).otherwise(F.lit(0.0))
    ).drop("_max")
    return scored, available


def available_counts(totals: DataFrame, topical: DataFrame) -> DataFrame:
    """(query_id, available_citation_count) of the topical queries, as ``select_citations`` counts them."""
    return totals.join(topical, "query_id", "left_semi").select("query_id", "available_citation_count")


def _swap_last(chosen: DataFrame, pool: DataFrame, top_k: int) -> DataFrame:
    same_language = chosen.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("bonus").alias("low")
    ).where((F.col("n") == top_k) & (F.col("low") == 1)).select("query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    # every selected candidate has bonus 1 there, so a candidate with bonus 0 is never selected yet
    other = (
        pool.where((F.col("bonus") == 0) & F.col("chunk_id").isNotNull())
        .join(same_language, "query_id", "left_semi")
        .withColumn("position", F.row_number().over(w)).where("position = 1")
        .withColumn("position", F.lit(top_k)).select(*chosen.columns)
    )
    kept = chosen.join(
        other.select("query_id", "position"), ["query_id", "position"], "left_anti"
    ).select(*chosen.columns)
    return kept.unionByName(other)


def citation_cards(selected: DataFrame, items: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """Selected candidates with the card's texts, reason and confidence."""
    item_cols = items.select(
        "item_id", "title", "source", "snippet", F.col("evidence_tags").alias("_item_tags"),
        F.col("source_type").alias("_item_source_type"),
    )
    rows = selected.drop("title", "source", "snippet").join(item_cols, "item_id")
    if chunks is not None:
        chunk_cols = chunks.select(
            "chunk_id", F.col("source_quote").alias("quote"), F.col("evidence_tags").alias("_chunk_tags"))
        rows = rows.join(chunk_cols, "chunk_id", "left")
    else:
        rows = rows.withColumn("quote", F.lit(None).cast("string")).withColumn("_chunk_tags", F.lit(None).cast("array<string>"))
    tags = F.when(F.size("_chunk_tags") > 0, F.col("_chunk_tags")).otherwise(F.col("_item_tags"))
    reason = F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 2), ", "))
    return rows.select(
        "query_id", "position", F.col("item_id").cast("string").alias("literature_id"), "chunk_id", "title", "source",
        "snippet", "quote", reason.alias("reason"), confidence_prior(F.col("_item_source_type")).alias("confidence"),
        "match_score",
    )


def _ordered(col: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("position", col.alias("v")))), lambda s: s["v"])


def evidence_packs(cards: DataFrame) -> DataFrame:
    """Per question one text block per citation, in order (the writer's only evidence)."""
    has_quote = F.length("quote") > 0
    line = lambda label, value: F.concat(F.lit(label), value)
    evidence = "证据文本（claim 只能基于此字段）："
    parts = F.array_compact(F.array(
        line("引用 ", F.col("position").cast("string")),
        line("证据ID：", F.coalesce(F.when(F.length("chunk_id") > 0, F.col("chunk_id")), F.col("literature_id"))),
        line("标题（元数据）：", F.col("title")), line("来源（元数据）：", F.col("source")),
        F.when(has_quote, line("片段摘要（元数据）：", F.col("snippet"))),
        F.when(has_quote, line(evidence, strip_space(F.col("quote")))).otherwise(line(evidence, F.col("snippet"))),
        F.when(F.length("reason") > 0, line("匹配依据（元数据）：", F.col("reason"))),
        line("置信度（元数据）：", F.format_string("%.2f", F.col("confidence"))),
        line("文献ID（元数据）：", F.col("literature_id")),
    ))
    blocks = cards.withColumn("block", F.array_join(parts, "\n"))
    return blocks.groupBy("query_id").agg(F.array_join(_ordered(F.col("block")), "\n\n").alias("evidence_text"))


def extractive_answers(queries: DataFrame, cards: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Numbered evidence lines and topics per question; an honest notice without evidence."""
    labels = F.create_map(*[F.lit(x) for kv in TOPIC_LABELS.items() for x in kv])
    topics = F.filter(
        F.transform(F.split("reason", ","), lambda t: F.try_element_at(labels, F.trim(t))), lambda t: t.isNotNull())
    evidence = strip_space(F.coalesce(F.when(F.length("quote") > 0, F.col("quote")), F.col("snippet"), F.lit("")))
    lines = F.concat(F.col("position").cast("string"), F.lit(".《"), "title", F.lit("》（"), "source", F.lit("）："), evidence)
    per_query = cards.withColumn("line", lines).withColumn("topics", F.coalesce(topics, F.array().cast("array<string>"))).groupBy("query_id").agg(
        F.count("*").alias("n"), F.array_join(_ordered(F.col("line")), "\n").alias("block"),
        F.array_distinct(F.flatten(_ordered(F.col("topics")))).alias("topics"),
    )
    rows = queries.join(per_query, "query_id", "left")
    rows = rows.join(matched, "query_id", "left") if matched is not None else rows.withColumn("entity_matched", F.lit(None).cast("boolean"))
    question = F.trim("text")
    lead = F.when(question != "", F.concat(F.lit("针对「"), question, F.lit("」，"))).otherwise(F.lit(""))
    topic_text = F.when(F.size("topics") > 0, F.array_join("topics", "、")).otherwise(F.lit("暂无主题映射"))
    n = F.col("n").cast("string")
    direct = F.concat(lead, F.lit("在当前样本文献中检索到 "), n, F.lit(" 条相关证据片段，按相关度排序：\n"), "block",
                      F.lit("\n涉及主题："), topic_text, F.lit("。"), F.lit(_CLOSING.format("系统检索命中的原文证据片段")))
    nearby = F.concat(lead, F.lit("在当前样本文献中未检索到与所问实体直接对应的证据片段；以下为按相关度排列的 "), n,
                      F.lit(" 条邻近证据片段，与所问问题的对应性未经证实，仅供横向参考：\n"), "block",
                      F.lit("\n涉及主题："), topic_text, F.lit("。"), F.lit(_CLOSING.format("按相关度排列的样本文献原文片段")))
    answer = (
        F.when(F.col("n").isNull(), F.lit(_NO_EVIDENCE))
        .when(~F.coalesce("entity_matched", F.lit(True)), nearby).otherwise(direct)
    )
    return rows.select("query_id", answer.alias("answer"), F.coalesce("n", F.lit(0)).alias("citation_count"))


# Closing and no-evidence wording.
_CLOSING = (
    "以上为{}，未经真实模型综合改写（deterministic retrieval）；请结合引用来源逐条核对，相关结论仍属非诊断结论、需结合临床。"
)
_NO_EVIDENCE = (
    "当前特应性皮炎（AD）证据样本库中没有检索到足够匹配的证据片段。本工作台仅覆盖 AD 中医药相关文献，"
    "请确认问题属于该领域，或调整问题关键词、切换来源后重试。"
)


def estimated_cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float) -> Column:
    """USD from token counts and prices per million; null without usage or prices."""
    cost = F.coalesce(input_tokens, F.lit(0)) / 1e6 * price_in + F.coalesce(output_tokens, F.lit(0)) / 1e6 * price_out
    unknown = (input_tokens.isNull() & output_tokens.isNull()) | F.lit(price_in <= 0 and price_out <= 0)
    return F.when(~unknown, F.round(cost, 6))


def answer_questions(
    queries: DataFrame, ranked: DataFrame, items: DataFrame, chunks: DataFrame | None, tokens: DataFrame,
    vocabulary: DataFrame, top_k: int = 2, source: str = "all", totals: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, citation cards) of a batch of questions from ranked candidates. ``totals``: what ``shortlist.citable_candidates`` says of
    all candidates (source ``all``), where ``ranked`` holds its rows alone."""
    if source == "all" and "evidence_tags" in items.columns:
        ranked = domain_order(ranked, items, tokens)
    topical = topical_queries(ranked if totals is None else totals, tokens, vocabulary)
    entities = entity_matches(ranked, tokens, items, chunks) if "related_entity_ids" in items.columns else None
    selected, available = select_citations(ranked, topical, entities, top_k, source)
    available = available if totals is None else available_counts(totals, topical)
    cards = citation_cards(selected, items, chunks)
    matched = None
    if entities is not None:
        named = tokens.where(is_entity()).select("query_id").distinct().join(topical, "query_id", "left_semi")
        matched = named.join(entities.select("query_id").distinct().withColumn("_m", F.lit(True)), "query_id", "left").select(
            "query_id", F.coalesce("_m", F.lit(False)).alias("entity_matched"))
    answers = extractive_answers(queries, cards, matched).join(available, "query_id", "left").na.fill(0, ["available_citation_count"])
    return answers, cards
