"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, limits: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of at most limits[label] rows a label: those with the lowest text hash, equal texts once.

    docs(doc_id, text), labels(doc_id, label); learn says which rows of docs may be used. Hashes are ranked without their
    texts, so the driver gets the texts of the sample alone; each partition sends it at most that many hashes.
    """
    known = docs.filter(learn).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = known.select("doc_id", "h").join(labels.select("doc_id", "label"), "doc_id").select("h", "label").distinct()
    chosen = {}
    for label, n in limits.items():
        top = keyed.filter(F.col("label") == label).select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
        if top is not None:
            chosen[label] = top
    if not chosen:
        return []
    low = known.filter(F.col("h") <= max(chosen.values())).join(labels.select("doc_id", "label"), "doc_id")
    keep = F.lit(False)
    for label, top in chosen.items():
        keep = keep | ((F.col("label") == label) & (F.col("h") <= top))
    rows = low.filter(keep).select("h", "text", "label").dropDuplicates(["h", "text", "label"]).toLocalIterator()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.label, r.h, r.text))]
