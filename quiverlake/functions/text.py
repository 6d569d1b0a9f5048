"""Ids, names and the token-group text embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverlake.functions.vectors import let, norm

PREFIX = "document:"
# Groups of words that count as one.
DEFAULT_GROUPS: tuple[tuple[str, ...], ...] = (
    ("postgres", "postgresql", "sql", "database"),
    ("python", "pytest", "script", "sdk"),
    ("music", "song", "audio", "playlist"),
    ("shipping", "delivery", "warehouse", "order"),
)


def vector_id_of(document_id: Column) -> Column:
    return F.concat(F.lit(PREFIX), document_id.cast("string"))


def document_id_of(vector_id: Column) -> Column:
    """What stands behind the prefix; null if there is no prefix or nothing behind it."""
    return F.nullif(F.regexp_extract(vector_id, f"^{PREFIX}([\\s\\S]+)$", 1), F.lit(""))


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token, inside words too."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def group_counts(text: Column, groups=DEFAULT_GROUPS) -> Column:
    """Occurrences of each group's tokens. The text is put in lower case once; sizes in bytes tell occurrences as well as those in characters."""

    def counted(low: Column) -> Column:
        size = F.octet_length(low)
        counts = []
        for tokens in groups:
            total = F.lit(0)
            for t in tokens:
                total = total + ((size - F.octet_length(F.replace(low, F.lit(t), F.lit("")))) / len(t.encode())).cast("int")
            counts.append(total.cast("double"))
        return F.array(*counts)

    return let(F.lower(F.coalesce(text, F.lit(""))), counted)


def embed_text(text: Column, groups=DEFAULT_GROUPS) -> Column:
    """Counts of each group's tokens, with unit length; a text without any has its weight in the first component."""
    first = F.lit([1.0] + [0.0] * (len(groups) - 1)).cast("array<double>")

    def scaled(counts: Column) -> Column:
        return F.when(F.forall(counts, lambda x: x == 0), first).otherwise(let(F.struct(counts.alias("c"), norm(counts).alias("n")), lambda p: F.transform(p["c"], lambda x: x / p["n"])))

    return let(group_counts(text, groups), scaled)


def mode_name(approximate: bool, rerank: bool, suffix: str = "") -> str:
    """exact-hybrid, compressed-hybrid or compressed-reranked-hybrid, with a suffix for how it is observed."""
    base = "exact-hybrid" if not approximate else "compressed-reranked-hybrid" if rerank else "compressed-hybrid"
    return f"{base}-{suffix}" if suffix else base
