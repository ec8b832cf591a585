"""Text column expressions: tokens, term matching, language, claims, quality, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions import lexicon

CJK_CLASS = "[\\u4e00-\\u9fff]"
SHORT_ASCII = "^[a-z0-9]{1,2}$"


def normalized(text: Column) -> Column:
    return F.lower(F.trim(text))


def plain_tokens(text: Column) -> Column:
    """Distinct ``[a-z0-9-]`` runs of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(normalized(text), F.lit("([a-z0-9\\-]+)"), F.lit(1)))


def cjk_chars(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CJK_CLASS})"), F.lit(1)))


def token_matches(token: Column, haystack: Column) -> Column:
    """One- and two-character ASCII tokens match whole words only, all others as substrings."""
    return F.when(
        token.rlike(SHORT_ASCII),
        F.regexp_like(haystack, F.concat(F.lit("(?U)\\b"), token, F.lit("\\b"))),
    ).otherwise(F.contains(haystack, token))


def keyword_in_text(keyword: Column, haystack: Column) -> Column:
    """Search rule: ASCII terms on word boundaries, everything else as a substring."""
    return F.when(
        keyword.rlike("^[a-z0-9][a-z0-9\\-]*$"),
        F.regexp_like(haystack, F.concat(F.lit("(?U)\\b"), keyword, F.lit("\\b"))),
    ).otherwise(F.contains(haystack, keyword))


def query_language(text: Column) -> Column:
    return F.when(text.rlike(CJK_CLASS), F.lit("zh")).otherwise(F.lit("en"))


def preferred_source_type(text: Column) -> Column:
    return F.when(query_language(text) == "zh", F.lit("cn_literature")).otherwise(F.lit("pubmed"))


def id_language(literature_id: Column) -> Column:
    return (
        F.when(literature_id.startswith("cn-"), F.lit("cn"))
        .when(literature_id.startswith("pmid-"), F.lit("pubmed"))
        .otherwise(F.lit("unknown"))
    )


def confidence_prior(source_type: Column) -> Column:
    expr = F.lit(None).cast("double")
    for name, value in lexicon.CONFIDENCE_BY_SOURCE_TYPE.items():
        expr = F.when(source_type == name, F.lit(value)).otherwise(expr)
    return expr


def entity_token_variants(token: Column) -> Column:
    """``kind-rest`` also stands for ``kind:rest`` (first dash only)."""
    return F.when(
        token.rlike("(?s)^[^-]*-.+"),
        F.array(token, F.regexp_replace(token, "(?s)^([^-]*)-(.*)$", "$1:$2")),
    ).otherwise(F.array(token))


def replace_first(text: Column, needle: Column, by: Column) -> Column:
    at = F.position(needle, text)
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            by,
            F.substring(text, at + F.length(needle), F.length(text)),
        ),
    ).otherwise(text)


# --- answers and claims ------------------------------------------------------------------

# Reference and list-marker patterns (must equal the source system's).
REF_PATTERN = "[\\[［]([A-Za-z0-9][A-Za-z0-9_.:-]*)[\\]］]"
CLAIM_PREFIX = "^\\s*(?:[-*•]|\\d+[.、）)])\\s*"


def bracketed_refs(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(REF_PATTERN), F.lit(1)))


def claim_sentences(answer: Column) -> Column:
    """Sentence parts with list bullets removed; parts without claim text are dropped."""
    unified = F.regexp_replace(F.regexp_replace(answer, "\\r\\n", "\n"), "\\r", "\n")
    parts = F.transform(
        F.split(unified, "(?<=[。！？!?])|\\n+"),
        lambda p: F.regexp_replace(strip_space(p), CLAIM_PREFIX, ""),
    )
    return F.filter(
        parts,
        lambda p: F.length(
            strip_space(F.regexp_replace(F.regexp_replace(p, REF_PATTERN, ""), "[*_`>#]", ""))
        )
        > 0,
    )


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def structured_answer(claims: Column) -> Column:
    """Claims (struct<text, evidence_refs>) as one text with their references."""
    sentences = F.transform(
        claims,
        lambda c: F.concat(
            F.regexp_replace(c["text"], "[。！？!? ]+$", ""),
            F.lit(" "),
            F.array_join(F.transform(c["evidence_refs"], lambda r: F.concat(F.lit("["), r, F.lit("]"))), " "),
            F.lit("。"),
        ),
    )
    return F.array_join(sentences, "")


CLAIMS_SCHEMA = "array<struct<text:string,evidence_refs:array<string>>>"


def parse_structured_claims(answer: Column) -> Column:
    """Fenced or bare JSON -> claims; null when the text is not of the declared shape."""
    fence = "(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$"
    payload = F.when(answer.rlike(fence), F.regexp_extract(answer, fence, 1)).otherwise(answer)
    doc = F.try_parse_json(payload)
    raw = F.try_variant_get(doc, "$.claims", "array<variant>")
    typed = F.transform(
        raw,
        lambda c: F.struct(
            F.when(
                F.schema_of_variant(c).startswith("OBJECT")
                & (F.schema_of_variant(F.try_variant_get(c, "$.text", "variant")) == "STRING"),
                strip_space(F.try_variant_get(c, "$.text", "string")),
            ).alias("text"),
            F.when(
                F.schema_of_variant(F.try_variant_get(c, "$.evidence_refs", "variant")).isin(
                    "ARRAY<STRING>", "ARRAY<VOID>"
                ),
                F.array_distinct(F.try_variant_get(c, "$.evidence_refs", "array<string>")),
            ).alias("evidence_refs"),
        ),
    )
    malformed = F.exists(typed, lambda c: c["text"].isNull() | c["evidence_refs"].isNull())
    return F.when(raw.isNotNull() & ~F.coalesce(malformed, F.lit(True)), typed)


# --- text quality ------------------------------------------------------------------------

NUL = "\\x00"


def char_count(text: Column, pattern: str) -> Column:
    """Characters of one class, counted by what disappears when they are removed."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def nul_ratio(text: Column) -> Column:
    """Share of NUL characters; 0 for an empty text, null for none."""
    return char_count(text, NUL) / F.greatest(F.length(text), F.lit(1))


def cjk_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, char_count(text, CJK_CLASS) / F.length(text)).otherwise(F.lit(0.0))


def low_text_density(text: Column) -> Column:
    alnum = char_count(text, "[\\p{L}\\p{N}]")
    return (F.length(text) >= 10) & (alnum / F.length(text) < 0.2)


def nul_warning(text: Column) -> Column:
    nul = char_count(text, NUL)
    return (F.length(text) > 0) & (
        (nul >= 3) | ((nul > 0) & (nul / F.greatest(F.length(text), F.lit(1)) >= 0.05))
    )


# Lines taken for headers, footers and reference lists.
NOISE_PATTERNS = [
    "(?U)^\\s*\\d+\\s*$", "(?U)^\\s*第\\s*\\d+\\s*(卷|期|页)\\s*$",
    "(?iU)^\\s*(参考文献|references)\\s*$", "(?U)^\\s*\\[\\d+\\]",
]
# Words that mark body text.
BODY_SIGNALS = [
    "摘要", "目的", "方法", "结果", "结论", "特应性皮炎", "异位性皮炎", "atopic dermatitis",
    "methods", "results", "conclusion", "skin barrier",
]


def preview_noise(line: Column) -> Column:
    stripped = strip_space(line)
    noise = F.length(stripped) == 0
    for pattern in NOISE_PATTERNS:
        noise = noise | stripped.rlike(pattern)
    nul = char_count(stripped, NUL)
    return noise | low_text_density(stripped) | (
        (nul >= 5) & (nul / F.greatest(F.length(stripped), F.lit(1)) >= 0.15)
    )


def preview_line_score(line: Column) -> Column:
    lowered = F.lower(line)
    score = F.lit(0)
    for signal in BODY_SIGNALS:
        score = score + F.when(F.contains(lowered, F.lit(signal)), 4).otherwise(0)
    score = score + F.when(cjk_ratio(line) >= 0.2, 1).otherwise(0)
    return score + F.when(F.length(strip_space(line)) >= 24, 1).otherwise(0)


def preview_lines(text: Column) -> Column:
    """Stripped lines that are no noise."""
    kept = F.filter(F.split(text, "[\\r\\n]+"), lambda l: ~preview_noise(l))
    return F.transform(kept, strip_space)


def preview_window(text: Column, lines: Column, start: Column, max_chars: int = 300) -> Column:
    """Lines from ``start`` on, until the length passes ``max_chars``."""
    empty = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def add(acc, line):
        fits = (acc["t"] == "") | (F.length(acc["t"]) + 1 + F.length(line) <= max_chars)
        joined = F.when(acc["t"] == "", line).otherwise(F.concat(acc["t"], F.lit("\n"), line))
        return F.struct(F.when(~acc["done"] & fits, joined).otherwise(acc["t"]).alias("t"), (acc["done"] | ~fits).alias("done"))

    tail = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    window = F.reduce(tail, empty, add)["t"]
    return strip_space(F.substring(F.when(F.size(lines) == 0, text).otherwise(window), 1, max_chars))


def trim_header_footer(page_text: Column, top: float = 0.15, bottom: float = 0.15) -> Column:
    """Drop the first and last lines of a page (at least one each when over three lines)."""
    lines = F.split(page_text, "\n")
    n = F.size(lines)
    head = F.greatest(F.lit(1), F.floor(n * F.lit(top)).cast("int"))
    tail = F.greatest(F.lit(1), F.floor(n * F.lit(bottom)).cast("int"))
    middle = F.slice(lines, head + 1, F.greatest(n - head - tail, F.lit(0)))
    return F.when(n <= 3, strip_space(page_text)).otherwise(strip_space(F.array_join(middle, "\n")))


def spike_flags(text: Column, min_chars: int = 120, min_cjk: float = 0.15) -> Column:
    flags = F.array_compact(
        F.array(
            F.when(nul_warning(text), F.lit("nul_warning")),
            F.when(text.rlike("\\(cid:\\d+\\)"), F.lit("cid_tokens")),
            F.when(F.contains(text, F.lit("\ufffd")), F.lit("replacement_chars")),
            F.when(F.length(strip_space(text)) < min_chars, F.lit("short_text")),
            F.when(cjk_ratio(text) < min_cjk, F.lit("low_cjk_ratio")),
        )
    )
    return F.when(F.length(text) == 0, F.array(F.lit("empty_text"))).otherwise(flags)


# Secrets that never reach a review document.
SECRET_PATTERNS = ["(?i)[a-z0-9_]*API_KEY\\s*=\\s*\\S+", "(?i)[a-z0-9_]+_API_KEY", "sk-[A-Za-z0-9_-]{8,}"]


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return strip_space(text)


def escape_table_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\|", "\\\\|"), "\\r?\\n", " ")


def normalized_symbols(symbols: Column) -> Column:
    """Upper-cased, trimmed, blank-free, distinct and sorted symbols."""
    cleaned = F.transform(symbols, lambda s: F.upper(strip_space(s)))
    return F.sort_array(F.array_distinct(F.filter(cleaned, lambda s: F.length(s) > 0)))
