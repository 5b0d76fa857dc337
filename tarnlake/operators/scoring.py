"""Topic relevance by a weighted lexicon with negation, joined with a model's score if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexicon; the three terms listed twice count twice.
LEXICON = [
    "diabetes", "diabetic", "insulin", "glucose", "blood sugar", "hyperglycemia", "hypoglycemia", "type 1", "type 2", "ketoacidosis",
    "hba1c", "glycemic", "metformin", "glycosylated hemoglobin", "pancreas", "islet cells", "neuropathy", "retinopathy", "nephropathy",
    "tiểu đường", "đái tháo đường", "tăng đường huyết", "hba1c", "insulin", "metformin", "biến chứng tiểu đường", "suy thận",
    "tổn thương thần kinh", "bệnh võng mạc",
]
HEAVY, MIDDLE = ["hba1c", "insulin", "metformin", "ketoacidosis"], ["type 1", "type 2", "neuropathy", "retinopathy"]
NEGATIONS = ["not", "no", "non-", "without", "never", "rarely", "không", "chưa", "chẳng"]
WEIGHTED = [(t, 0.3 if t in HEAVY else 0.2 if t in MIDDLE else 0.15) for t in LEXICON]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def is_negated(low: Column, term: Column, negations: list[str] = NEGATIONS, whole_words: bool = False) -> Column:
    """Whether a negation stands in the 100 characters before the term's first occurrence; anywhere in a word unless whole_words."""
    at = F.position(term, low)

    def found(before: Column) -> Column:
        if whole_words:
            return before.rlike(r"(?U)(?<!\w)(" + "|".join(n.replace("-", "\\-") for n in negations) + r")(?!\w)")
        return F.exists(F.lit(negations), lambda n: F.contains(before, n))

    return let(F.substring(low, F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100))), found)


def lexicon_hits(text: Column, lexicon: list[tuple[str, float]] = WEIGHTED, **options) -> Column:
    """Weights of the entries that occur without negation; an entry listed twice gives two."""
    entries = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in lexicon])

    def hits(low: Column) -> Column:
        own = F.filter(entries, lambda e: F.contains(low, e["term"]) & ~is_negated(low, e["term"], **options))
        return F.transform(own, lambda e: e["weight"])

    return let(F.lower(text), hits)


def relevance(text: Column, topic: Column | None = None, lifestyle: Column | None = None, lexicon: list[tuple[str, float]] = WEIGHTED, hits: Callable[..., Column] = lexicon_hits, **options) -> Column:
    """Relevance from 0 to 1, to three places; hits gives the weights (words.lexicon_hits_at_once for a large lexicon). topic and lifestyle are a model's scores, 0 without a model; blank text scores 0."""
    d, side = (F.lit(0.0) if x is None else F.coalesce(x.cast("double"), F.lit(0.0)) for x in (topic, lifestyle))
    clean = F.coalesce(text, F.lit(""))

    def score(h: Column) -> Column:
        c, w = h["count"], h["weight"]
        return (
            F.when(side > 0.6, 0.0)
            .when((d < 0.3) & (c == 0), 0.0)
            .when(c >= 3, F.least(0.4 + w, F.lit(1.0)))
            .when((c >= 2) & (d > 0.25), F.least(d + 0.3 + w, F.lit(0.9)))
            .when((c >= 1) & (d > 0.4), F.least(d + 0.25 + w, F.lit(0.8)))
            .otherwise(F.greatest(d * 0.7, w * 0.8))
        )

    def counted(weights: Column) -> Column:
        return F.struct(F.size(weights).alias("count"), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x).alias("weight"))

    value = let(let(hits(clean, lexicon, **options), counted), score)
    return F.round(F.when(F.trim(clean) == "", 0.0).otherwise(value), 3)
