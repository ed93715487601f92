"""What a question is after, and how that weighs the ranking signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import blank_split

#: relevance, structure, type coverage, cohesion
WEIGHTS = {
    "architecture_broad": (0.60, 0.15, 0.05, 0.20),
    "debugging": (0.80, 0.10, 0.05, 0.05),
    "definition_lookup": (0.90, 0.04, 0.04, 0.02),
    "general": (0.80, 0.08, 0.04, 0.08),
    "usage_search": (0.65, 0.20, 0.05, 0.10),
}
#: Alternatives by intent, over the lower-case question; also valid in RE2.
PATTERNS = {
    "definition_lookup": r"\bwhere\s+is\b.*\bdefin|\bdefini(?:tion|ed)\s+of\b|\bimplement(?:s|ation)\s+of\b|\bsource\s+(?:code\s+)?(?:for|of)\b",
    "debugging": r"\b(?:error|bug|traceback|fail(?:ing|ure|s)?)\b|exception|\bcrash|\bstack\s*trace\b|\bwhy\s+does\b.*\b(?:return|raise|throw)\b",
    "usage_search": r"\bwho\s+calls\b|\bwhere\s+is\b.*\bused\b|\bcallers?\s+of\b|\busage\s+of\b|\bwhat\s+(?:imports|uses|calls)\b|\breferences?\s+to\b",
    "architecture_broad": r"\barchitectur|\b(?:pipeline|middleware|overview|flow|lifecycle)\b|\bsystem\s+design\b|\bhow\s+does\b.*\b(?:routing|system)\b",
}
IDENTIFIER = r"[A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+_[a-z_]+|[a-zA-Z]+\.[a-zA-Z]+|[A-Z][A-Z_]{2,}"
#: A question with this share of identifiers among its words looks for definitions.
IDENTIFIER_SHARE = 0.20


def classify(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    names = F.size(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    out = F.when(low.rlike(PATTERNS["definition_lookup"]), "definition_lookup")
    for kind in ("debugging", "usage_search"):
        out = out.when(low.rlike(PATTERNS[kind]), kind)
    out = out.when((names > 0) & (names >= F.size(blank_split(question)) * IDENTIFIER_SHARE), "definition_lookup")
    return out.when(low.rlike(PATTERNS["architecture_broad"]), "architecture_broad").otherwise("general")


def weights_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in WEIGHTS.items()], "intent string, w_relevance double, w_structural double, w_type double, w_cohesion double")


def with_weights(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with their intent and its four weights; the table of weights has five rows."""
    return questions.withColumn("intent", classify(F.col(question))).join(F.broadcast(weights_table(questions.sparkSession)), "intent")
