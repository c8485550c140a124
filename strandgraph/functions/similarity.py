"""Set and type similarities as column expressions: no Python runs on rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Weights of labels, mandatory and optional properties (sum 1), of ends, and the tolerance gamma."""

    label: float = 0.5
    mandatory: float = 0.25
    optional: float = 0.25
    endpoint: float = 0.5
    gamma: float = 0.15
    cardinality: float = 0.0

    def __post_init__(self):
        if abs(self.label + self.mandatory + self.optional - 1.0) > 1e-9:
            raise ValueError("the weights of labels, mandatory and optional properties must sum to 1")

    @classmethod
    def with_cardinality(cls, **given: float) -> Weights:
        return cls(endpoint=1 / 3, cardinality=1 / 3, **given)


def sig(*columns: str) -> Column:
    """One number for the values of columns."""
    return F.xxhash64(*columns)


def dice(a: Column, b: Column) -> Column:
    """2|A n B| / (|A| + |B|); 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B|; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column, frequency: Column) -> Column:
    """Jaccard with weight 1/sqrt(frequency), a map, for each element; 1 if both are empty."""
    total = lambda xs: F.aggregate(F.array_sort(xs), F.lit(0.0), lambda s, x: s + 1.0 / F.sqrt(frequency[x].cast("double")))
    union = F.array_union(a, b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total(F.array_intersect(a, b)) / total(union)))


def bigrams(text: Column) -> Column:
    """Two-character substrings, repeats kept."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice of the multisets of two-character substrings; 1 if equal, 0 if one has none."""
    x, y = bigrams(a), bigrams(b)
    count = lambda xs, g: F.size(F.filter(xs, lambda v: v == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def node_similarity(a: Column, b: Column, w: Weights) -> Column:
    """Of structs (labels, mandatory, optional); 0 unless the labels overlap or both are empty."""
    labels = dice(a["labels"], b["labels"])
    rest = w.mandatory * dice(a["mandatory"], b["mandatory"]) + w.optional * dice(a["optional"], b["optional"])
    return F.when(labels == 0.0, F.lit(0.0)).otherwise(w.label * labels + rest)


def edge_similarity(a: Column, b: Column, w: Weights) -> Column:
    """Of structs (rel_type, mandatory, optional, src, dst); ``b`` is the schema's and has card_error."""
    meets = (a["rel_type"] == b["rel_type"]) & F.arrays_overlap(a["src"]["labels"], b["src"]["labels"]) & F.arrays_overlap(a["dst"]["labels"], b["dst"]["labels"])
    ends = (node_similarity(a["src"], b["src"], w) + node_similarity(a["dst"], b["dst"], w)) / 2.0
    own = w.label + w.mandatory * dice(a["mandatory"], b["mandatory"]) + w.optional * dice(a["optional"], b["optional"])
    cardinality = F.when(b["card_error"], F.lit(0.0)).otherwise(F.lit(1.0))
    body = 1.0 - w.endpoint - w.cardinality
    return F.when(meets, w.endpoint * ends + body * own + w.cardinality * cardinality).otherwise(F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean; 0 if the sum is 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2.0 * a * b / (a + b))
