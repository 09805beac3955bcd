"""Benchmark decontamination by spaced-seed hashing (operator 7), DataFrame operations only.

Texts become lower-case tokens (runs of letters and digits). A mask of fixed positions is
laid over every place of a text; the tokens it keeps are hashed, the others are ignored,
so a substituted token under an ignored position does no harm. Hashes of the benchmark and
of the training documents are joined, and around each hit the two texts are compared token
by token: the pair is reported if some window of ``overlap`` aligned tokens around the
seed has at least ``percent`` per cent equal tokens.

With the default masks every window of 16 tokens with up to three substitutions has a hit.
Items shorter than ``overlap`` have seeds of their own: the longest run of neighbouring tokens
that must be equal somewhere if ``percent`` per cent of the item are (all tokens of an item of
up to four). Only run lengths that the benchmark asks for are laid over the documents. So the
seeds lose nothing that the verification would accept, at any length of the item.

A seed carries only the tokens that the comparison around it can reach, so its size does not
follow the length of the item. Document tokens are hashed and probed within the scan: nothing
but hits leaves it, as long as all seeds of the benchmark take at most ``BROADCAST_BYTES``;
beyond it both sides are shuffled, the documents with the tokens around each place too.

Defined results: null and empty texts have no tokens and no hits; items shorter than
``overlap`` are compared over their whole length, down to a single token; a text shorter
than that has no hits; equal documents or items are all reported; repeated rows
are reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("111011", "110111")  # 1: the token is hashed, 0: it is ignored
OVERLAP = 16
PERCENT = 80
SEPARATOR = "[^\\p{L}\\p{N}]+"
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def short_run(n: int, percent: int) -> int:
    """Tokens of the longest run that is equal in every accepted comparison with an item of n tokens."""
    equal = -(-n * percent // 100)
    return -(-equal // (n - equal + 1))


def places(df: DataFrame, words: str, masks: dict[int, str], use: dict[int, Column] | None = None) -> DataFrame:
    """One row for each mask (by its number) at each place of ``words``: place, seed. ``use``: the rows that a mask is for."""
    n, span = F.size(words), min(map(len, masks.values()))
    at = df.withColumn("place", F.explode(F.when(n >= span, F.sequence(F.lit(0), n - span))))

    def seed(number: int, mask: str) -> Column:
        kept = [F.get(words, F.col("place") + i) for i, bit in enumerate(mask) if bit == "1"]
        fits = F.col("place") + len(mask) <= n
        return F.when(fits & use[number] if use else fits, F.xxhash64(F.lit(number), *kept))

    seeds = F.array(*(seed(i, m) for i, m in masks.items()))
    return at.withColumn("seed", F.explode(seeds)).where("seed is not null")


def around(words: str, place: str, overlap: int, span: int) -> tuple[Column, Column]:
    """How many tokens before the place a comparison can reach, and all tokens that it can reach."""
    before = F.least(F.lit(overlap - 1), F.col(place))
    return before, F.slice(words, F.col(place) - before + 1, before + overlap + span)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
             item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
             overlap: int = OVERLAP, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, matched, compared): benchmark items that a document contains.

    ``matched`` of ``compared`` aligned tokens are equal in the best window."""
    item = items.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item"))
    # items shorter than a window take runs, numbered by their length below zero, the others the masks
    n = F.size("item")
    short = {r["n"]: short_run(r["n"], percent)
             for r in item.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < overlap)).distinct().collect()}
    runs = {-g: "1" * g for g in sorted(set(short.values())) if g}
    all_masks = dict(enumerate(masks)) | runs
    wanted = F.array(*(F.lit(-short.get(size, 0)) for size in range(overlap)))  # run of an item, by its size
    use = {i: n >= overlap for i in range(len(masks))} | {i: F.get(wanted, n) == i for i in runs}
    span = max(map(len, all_masks.values()))
    item_before, item_part = around("item", "place", overlap, span)
    seeds = places(item, "item", all_masks, use).select(
        "seed", "item_id", F.least(F.lit(overlap), F.size("item")).alias("compared"), item_before.alias("item_before"),
        item_part.alias("item_part")).distinct()
    seed_bytes = 64 + 16 * F.size("item_part") + F.octet_length(F.concat_ws("", "item_part"))
    fits = (seeds.agg(F.sum(seed_bytes)).first()[0] or 0) <= broadcast_bytes
    doc = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(doc_text)).alias("doc"))
    doc_before, doc_part = around("doc", "place", overlap, span)
    near = ["doc_id", "seed", doc_before.alias("doc_before"), doc_part.alias("doc_part")]
    if fits:  # the tokens around a place are cut out for hits only
        hits = places(doc, "doc", all_masks).join(F.broadcast(seeds), "seed").select(*near, *seeds.columns[1:])
    else:
        hits = places(doc, "doc", all_masks).select(*near).join(seeds, "seed")
    # the part around the seed where both texts have tokens, and how many of them are equal up to each
    before = F.least(F.col("compared") - 1, F.col("doc_before"), F.col("item_before"))
    length = before + F.least(F.col("compared") + span, F.size("doc_part") - F.col("doc_before"),
                              F.size("item_part") - F.col("item_before"))
    part = hits.select("doc_id", "item_id", "compared",
                       F.slice("doc_part", F.col("doc_before") - before + 1, length).alias("x"),
                       F.slice("item_part", F.col("item_before") - before + 1, length).alias("y"))
    equal = F.zip_with("x", "y", lambda a, b: F.when(a == b, 1).otherwise(0))
    # the one-element explode keeps the optimizer from repeating the comparison in every filter
    part = (part.where(F.size("x") >= F.col("compared"))
            .select("doc_id", "item_id", "compared", F.explode(F.array(equal)).alias("equal")))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("compared") + 1),
                                   lambda s: F.aggregate(F.slice("equal", s, F.col("compared")), F.lit(0),
                                                         lambda total, e: total + e)))
    enough = F.aggregate("equal", F.lit(0), lambda total, e: total + e) * 100 >= F.col("compared") * percent
    found = part.where(enough).withColumn("matched", best).where(F.col("matched") * 100 >= F.col("compared") * percent)
    return (found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"),
                                                   F.max("compared").alias("compared")))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                                      lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                                       lambda x: x <> '') AS v FROM benchmark),
     dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS p FROM d WHERE len(w) >= 6),
     bp AS (SELECT item_id, v, unnest(range(1, len(v) - 4)) AS q FROM b WHERE len(v) >= 6),
     ds AS (SELECT doc_id, p, ['0', w[p], w[p + 1], w[p + 2], w[p + 4], w[p + 5]]::VARCHAR AS s FROM dp
            UNION ALL SELECT doc_id, p, ['1', w[p], w[p + 1], w[p + 3], w[p + 4], w[p + 5]]::VARCHAR FROM dp),
     bs AS (SELECT item_id, q, ['0', v[q], v[q + 1], v[q + 2], v[q + 4], v[q + 5]]::VARCHAR AS s FROM bp
            UNION ALL SELECT item_id, q, ['1', v[q], v[q + 1], v[q + 3], v[q + 4], v[q + 5]]::VARCHAR FROM bp),
     hit AS (SELECT DISTINCT doc_id, item_id, p, q FROM ds JOIN bs USING (s)),
     span AS (SELECT doc_id, item_id, w, v, p, q, least(16, len(v)) AS r,
                     least(least(16, len(v)) - 1, p - 1, q - 1) AS back
              FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
     part AS (SELECT doc_id, item_id, r,
                     list_transform(range(0, back + least(r + 6, len(w) - p + 1, len(v) - q + 1)),
                                    lambda i: (w[p - back + i] = v[q - back + i])::INT) AS e FROM span),
     win AS (SELECT doc_id, item_id, r, list_max(list_transform(range(1, len(e) - r + 2),
                                                 lambda k: list_sum(e[k:k + r - 1]))) AS m
             FROM part WHERE len(e) >= r)
SELECT doc_id, item_id, max(m)::INT AS matched, max(r)::INT AS compared FROM win WHERE m * 100 >= r * 80
GROUP BY doc_id, item_id
"""
