"""Query-expansion groups, weights and labels (must equal the source system's)."""

# Canonical alias -> keywords that inject it into a retrieval query.
KEYWORD_ALIASES = {
    "gut": ["肠道", "gut", "microbiome", "菌群"],
    "skin_barrier": ["屏障", "barrier", "filaggrin"],
    "immune": ["免疫", "inflammation", "immune", "th2", "jak", "cytokine"],
    "targeted_therapy": ["后续", "线索", "therapeutic target", "targeted therapy"],
    "pruritus": ["瘙痒", "itch", "il-31"],
    "formula": ["复方", "方剂", "formula", "herbal"],
    "network": [
        "网络药理学", "network pharmacology", "分子对接", "分子模拟", "molecular docking",
        "molecular simulation", "靶点", "通路", "target", "pathway",
    ],
    "pediatric": ["儿童", "pediatric"],
}

# Alias groups of the literature search; the first group names the disease.
SEARCH_ALIASES = {
    "disease": ["特应性皮炎", "atopic dermatitis", "atopic", "dermatitis", "ad"],
    "gut_skin_axis": [
        "肠", "肠道", "肠道菌群", "肠-脑-皮肤轴", "gut", "gut-skin", "microbiome", "菌群",
    ],
    "skin_barrier": ["屏障", "皮肤屏障", "barrier", "filaggrin", "ceramide"],
    "immune": ["免疫", "炎症", "inflammation", "immune", "th2", "jak", "cytokine"],
    "pruritus": ["瘙痒", "itch", "itching", "il-31", "pruritus"],
    "formula": ["复方", "方剂", "中药", "formula", "herbal", "消风散"],
    "network": ["网络药理学", "靶点", "通路", "network pharmacology", "target", "pathway"],
    "pediatric": ["儿童", "pediatric", "children"],
}

# Retrieval weight per field (best matching field counts once per token).
ITEM_FIELD_WEIGHTS = {
    "title": 3, "keywords": 2, "evidence_tags": 2, "related_entity_ids": 2,
    "snippet": 1, "abstract": 1,
}
CHUNK_FIELD_WEIGHTS = {"text": 1, "evidence_tags": 2, "related_entity_ids": 2}
ITEM_TAG_BONUS = 2
CHUNK_TAG_BONUS = 7

# Search weight per field (all matching fields add up).
SEARCH_FIELD_WEIGHTS = {
    "title": 4, "keywords": 3, "evidence_tags": 2, "snippet": 2, "abstract": 1, "authors": 1,
}

# Citation selection.
GENERIC_INTENT_TOKENS = [
    "therapy", "treatment", "intervention", "acupuncture", "topical", "external",
]
ENTITY_TOKEN_PREFIXES = ["formula-", "herb-", "compound-", "target-", "pathway-"]
RELEVANCE_MIN_TOP_SCORE = 3
CONFIDENCE_BY_SOURCE_TYPE = {"cn_literature": 0.86, "pubmed": 0.74}
RRF_K = 60
RRF_LIST_LIMIT = 50

# Fixed value: share of the items above which a token of a large corpus weighs nothing.
IDF_STOP_SHARE = 0.5
# Fixed value: a corpus of more items than these is large.
IDF_STOP_ABOVE = 100
