"""Short test items inside long documents: size-partitioned MinHash sketches, verified by exact shingle containment.

Items are partitioned by size. Each item keeps its lowest shingle hashes, as many as its partition needs: if a document
holds a share of THRESHOLD of n shingles, it misses n - ceil(THRESHOLD * n) at most, so it has one of any more than
that. Hence a bottom-k MinHash sketch of that size, searched in whole documents, misses no document. Banded signatures
of whole documents would: the Jaccard similarity of a short item and a long document is close to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwell.plans.runtime import materialize, small

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch hashes that are broadcast at once, 16 bytes each.
SKETCH_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs without ASCII white space; null and blank texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _hashes(w: Column, size: int) -> Column:
    """Hash of each shingle by its first word's place; fewer words are one shingle, none have none."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(size)]))).otherwise(F.array().cast("array<long>"))


def _shingles(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Distinct (keys, h, shingle) of df(keys, w)."""
    spread = df.select(*keys, "w", F.posexplode(_hashes(F.col("w"), size)).alias("at", "h"))
    return spread.select(*keys, "h", F.concat_ws(" ", F.slice("w", F.col("at") + 1, size)).alias("shingle")).distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) of every document that has `threshold` of an item's shingles.

    docs(doc_id, text), items(item_id, text); other columns are ignored. shared: the item's distinct shingles that the
    document has. Items and documents without words are in no result. Rows with equal id and text give one row, rows
    with equal id and other texts a row each, null ids take part like others. Empty tables give an empty result.
    Very long texts count whole. No Python; documents are not shuffled, only what their shingles hit: sketches beyond
    what may be broadcast are dealt to rounds, each of which reads the documents once.
    """
    return matches(docs, items, threshold, size).drop("dkey")


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """`contained` with dkey, the hash of the document's text: (doc_id, dkey) names a document."""
    item = items.select("item_id", F.xxhash64("text").alias("ikey"), words(F.col("text")).alias("w"))
    own = _shingles(item, ["item_id", "ikey"], size)
    per_item = Window.partitionBy("item_id", "ikey")
    own = own.withColumn("n", F.count("*").over(per_item)).withColumn("rank", F.row_number().over(per_item.orderBy("h", "shingle")))
    # a partition has sizes up to its power of two; all its items keep what its largest size needs
    top = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    keep = top - F.ceil(top * threshold - 1e-9) + 1
    own = materialize(own.withColumn("sketch", F.col("rank") <= keep), "item-shingles")
    doc = docs.select("doc_id", F.xxhash64("text").alias("dkey"), words(F.col("text")).alias("w"))
    sketch = materialize(own.filter("sketch").select("h").distinct(), "contain-sketch")
    rounds = max(1, -(-sketch.count() // SKETCH_ROWS))
    spread = doc.select("doc_id", "dkey", F.explode(_hashes(F.col("w"), size)).alias("h"))
    found = None
    for k in range(rounds):  # each holds SKETCH_ROWS hashes, more or less: a broadcast of bounded size
        part = sketch if rounds == 1 else sketch.filter(F.pmod("h", F.lit(rounds)) == k)
        now = spread.join(F.broadcast(part), "h").select("doc_id", "dkey").distinct()
        found = now if found is None else found.unionByName(now)
    found = materialize(found.distinct() if rounds > 1 else found, "contain-candidates")
    near = doc.join(small(found.select(F.col("doc_id").alias("fid"), F.col("dkey").alias("fkey"))), F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("dkey") == F.col("fkey")), "left_semi")
    spread = near.select("doc_id", "dkey", "w", F.posexplode(_hashes(F.col("w"), size)).alias("at", "h"))
    hit = spread.join(small(own), "h").filter(F.concat_ws(" ", F.slice("w", F.col("at") + 1, size)) == F.col("shingle")).select("doc_id", "dkey", "item_id", "ikey", "n", "rank", "sketch").distinct()
    per = hit.groupBy("doc_id", "dkey", "item_id", "ikey").agg(F.count("*").alias("shared"), F.max("n").alias("shingles"), F.max("sketch").alias("sketched"))
    return per.filter(F.col("sketched") & (F.col("shared") >= F.col("shingles") * F.lit(threshold) - 1e-9)).select("doc_id", "dkey", "item_id", "shared", "shingles", F.round(F.col("shared") / F.col("shingles"), 6).alias("containment"))


ORACLE = """
with w as (select doc_id, text, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+') if x <> ''] w from documents),
iw as (select item_id, text, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+') if x <> ''] w from benchmark),
s as (select distinct doc_id, text, array_to_string(w[i:i+4], ' ') g from (select doc_id, text, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from w where len(w) > 0)),
t as (select distinct item_id, text, array_to_string(w[i:i+4], ' ') g from (select item_id, text, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from iw where len(w) > 0)),
n as (select item_id, text, count(*) n from t group by all),
h as (select s.doc_id, s.text dt, t.item_id, t.text it, count(*) shared from s join t on s.g = t.g group by all)
select h.doc_id, h.item_id, cast(shared as bigint) shared, cast(n as bigint) shingles, round(shared / n, 6) containment
from h join n on h.item_id = n.item_id and h.it = n.text where shared >= n * 0.8 - 1e-9
"""
