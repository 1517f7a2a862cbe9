"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is the multiset of its runs of five words (all words as one run if it has
fewer); words are runs without ASCII white space, ASCII case folded.  Two texts
are linked if the weighted Jaccard similarity of their multisets is 0.8 or more,
and a class is a connected component of links.

1. One pass over the texts makes a content key (equal for equal multisets), the
   weight and 24 band keys of 6 coordinates each, so that a pair at similarity
   0.8 shares a band with probability 0.9993, at 0.85 with 0.99999.
2. Rows with equal content collapse to one node, with partial aggregation.
3. In every bucket of a band the node with the most company is the pivot, and all
   others are compared with it, exactly.  A comparison gives the difference set of
   node and pivot: elements that one of them has.
4. A bucket in one component has no link left to lose.  In the others, nodes u and
   v with difference sets A and B to their pivot are linked if A and B share
   t = (|A| + |B| - (|u| + |v|) / 9) / 2 elements or more, and t is above 0 unless
   both are linked to the pivot.  So the pairs that can still be linked come from
   a join on the rarest elements of the difference sets: what near copies have in
   common with their pivot is in no difference set, and what is particular to one
   copy meets no partner.  Those pairs are compared exactly.

All pairs of nodes that share a bucket are decided so, whatever a bucket's size.

Defined cases: a null text and one without words is in no group: its class is
its own doc_id; repeated rows are copies of each other; a text of any length is signed and compared
whole, its darts thrown in blocks of `THROWN`; class_id is the least
doc_id of the class, null only if all are null; extra columns are not carried
(`keep_one` keeps all); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, count_rows, settle, small, table
from rankforge.llm.components import components
from rankforge.llm.minhash import band_keys, signatures
from rankforge.llm.words import mix, occurrences, shingles, words_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Shingles whose darts are thrown together: bounds the working memory.
THROWN = 1 << 15

_SALTS = np.array([0x8CB92BA72F3D8DD7, 0x3C6EF372FE94F82B], dtype=np.uint64)


def content_key(shingle: np.ndarray) -> bytes:
    """128 bits that depend on the multiset alone."""
    return b"".join(int(mix(shingle + salt).sum(dtype=np.uint64)).to_bytes(8, "big") for salt in _SALTS)


def elements(shingle: np.ndarray) -> np.ndarray:
    """The multiset as a set: the j-th occurrence of a shingle is an element of its own."""
    ordered = np.sort(shingle)
    if not len(ordered):
        return ordered
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    return mix(ordered + (np.arange(len(ordered)) - start).astype(np.uint64) * _SALTS[0])


def text_tag(text: Column) -> Column:
    """Names a text among the rows of one doc_id."""
    return F.xxhash64(text)


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, tag, node (content key, null without words), weight and bands for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            node, weight, keys = [None] * len(texts), [0] * len(texts), [[]] * len(texts)
            rows, held, size = [], [], 0
            for i in range(len(texts) + 1):
                if held and (i == len(texts) or size > THROWN or len(held) == 256):
                    counted = [occurrences(x) for x in held]
                    owner = np.repeat(np.arange(len(held)), [len(v) for v, _ in counted])
                    made = signatures(owner, np.concatenate([v for v, _ in counted]), np.concatenate([c for _, c in counted]).astype(np.float64), len(held), BANDS * ROWS)
                    for row, key in zip(rows, band_keys(made, BANDS).view(np.int64), strict=True):
                        keys[row] = key
                    rows, held, size = [], [], 0
                if i < len(texts):
                    run = shingles(words_of(texts[i].as_py() or ""), words)
                    if len(run):
                        node[i], weight[i] = content_key(run), len(run)
                        rows.append(i), held.append(run)
                        size += len(run)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(weight, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "tag", "node", "weight", "bands"],
            )

    text = F.col("text").cast("string")
    return arrow_map(docs.select("doc_id", text_tag(text).alias("tag"), text.alias("text")), sign, f"doc_id {kind}, tag long, node binary, weight long, bands array<long>")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, elements for the (id, node) rows of `wanted`, from one of each node's texts."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [elements(shingles(words_of(t.as_py()), words)).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, made)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["id", "elements"])

    pick = rows.join(wanted, "node").groupBy("id").agg(F.min(F.struct("doc_id", "tag")).alias("pick"))
    pick = settle(pick.select("id", F.col("pick.doc_id").alias("pick_id"), F.col("pick.tag").alias("pick_tag")))
    text = F.col("text").cast("string")
    same = F.col("doc_id").eqNullSafe(F.col("pick_id")) & (text_tag(F.col("text")) == F.col("pick_tag"))
    found = docs.select("doc_id", text.alias("text")).join(small(pick), same)
    found = settle(arrow_map(found.select("id", "text"), expand, "id long, elements array<long>"))
    # only rows that are there several times give a set several times
    return found if count_rows(found) == count_rows(pick) else settle(found.dropDuplicates(["id"]))


def _merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after more edges; only the edges between components are worked on."""
    at = lambda end: small(found).select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    ends = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    ends = ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    moved = components(ends)
    after = found.join(small(moved).select(F.col("node").alias("root"), F.col("root").alias("moved")), "root", "left")
    return settle(after.select("node", F.coalesce("moved", "root").alias("root")).unionByName(moved))


def _reach(least: float) -> float:
    """Two multisets are linked if their difference is at most this share of their sizes' sum."""
    return (1 - least) / (1 + least)


def _members(nodes: DataFrame) -> DataFrame:
    """key, id, n (the bucket's nodes), weight and rank for the nodes of buckets with two or more; the pivot has the largest rank."""
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    # a bucket of two is known from its ends; only larger ones are looked up
    shared = settle(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    larger = keyed.join(small(shared.where("n > 2").select("key", "n")), "key").select("key", "id", "n")
    members = shared.where("n = 2").select("key", F.explode(F.array("low", "high")).alias("id"), "n").unionByName(larger)
    company = F.sum("n").over(Window.partitionBy("id"))  # a node has BANDS buckets at most
    return settle(members.join(nodes.select("id", "weight", "draw"), "id").withColumn("rank", F.struct(company.alias("company"), "draw", "id")).drop("draw"))


def _differences(members: DataFrame, pivots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """p, u, sizes, d (elements that one of the two has), linked, and the difference set where the bucket has more than two nodes.

    An element of the pivot alone is stored with its bits inverted.
    """
    pairs = members.join(small(pivots), "key").where("id != p").groupBy("p", F.col("id").alias("u")).agg(F.max("n").alias("n"))
    own = sets.select(F.col("id").alias("u"), F.col("elements").alias("a"))
    pivot = sets.select(F.col("id").alias("p"), F.col("elements").alias("b"))
    both = pairs.join(own, "u").join(pivot, "p")
    apart = F.concat(F.array_except("a", "b"), F.transform(F.array_except("b", "a"), lambda e: F.bitwise_not(e)))
    made = both.select("p", "u", "n", F.size("a").alias("size"), F.size("b").alias("p_size"), apart.alias("apart"))
    made = made.withColumn("d", F.size("apart"))
    linked = F.col("d") <= F.lit(_reach(least)) * (F.col("size") + F.col("p_size")) + 1e-9
    return settle(made.select("p", "u", "size", "p_size", "d", linked.alias("linked"), F.when(F.col("n") > 2, F.col("apart")).alias("apart")))


def _open_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(u, v, p): the pairs of different components that their difference sets to a common pivot don't rule out.

    `rows` has p, u, part, size, p_size, d, linked and apart.  Elements are ordered
    by how many of the pivot's nodes have them.  Where a pair needs t common
    elements, its first one in that order has t - 1 or more after it in both sets.
    """
    reach = F.lit(_reach(least))
    over = (F.col("d") - reach * (F.col("size") + F.col("p_size"))) / (1 + reach)  # partners of all kinds
    beside = (F.col("d") + reach * (F.col("p_size") - F.col("size"))) / 2  # only partners that the pivot isn't linked to
    needed = F.greatest(F.lit(1), F.ceil(F.when(F.col("linked"), beside).otherwise(over) - 1e-9))
    single = rows.withColumn("prefix", F.col("d") - needed + 1).select("p", "u", "d", "prefix", F.explode("apart").alias("e"))
    counts = single.groupBy("p", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # what only one node has comes first, and only its number counts
    ordered = single.join(counts, ["p", "e"]).groupBy("p", "u", "d", "prefix").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("common"))
    alone = F.col("d") - F.size("common")
    placed = ordered.select("p", "u", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), F.greatest(F.lit(0), (F.col("prefix") - alone).cast("int")))))
    placed = placed.select("p", "u", (F.col("alone") + F.col("pos")).alias("place"), F.col("col.e").alias("e"))
    listed = settle(placed.join(rows.select("p", "u", "part", "size", "d", "linked"), ["p", "u"]))
    # pairs lie across components: every one has an end outside of the component that most of an element's nodes are in
    held = listed.groupBy("p", "e", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("p", "e").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    held = settle(held.where("parts > 1").select("p", "e", "main"))
    minor = listed.join(held, ["p", "e"]).where("part != main").drop("main")
    other = listed.select("p", "e", *[F.col(c).alias(f"v_{c}") for c in ("u", "part", "size", "d", "place", "linked")])
    t = (F.col("d") + F.col("v_d") - reach * (F.col("size") + F.col("v_size"))) / 2
    rest = F.least(F.col("d") - F.col("place"), F.col("v_d") - F.col("v_place"))
    open_ = (F.col("part") != F.col("v_part")) & ~(F.col("linked") & F.col("v_linked")) & (rest >= t - 1e-9)
    found = minor.join(other, ["p", "e"]).where(open_)
    return found.groupBy(F.least("u", "v_u").alias("u"), F.greatest("u", "v_u").alias("v")).agg(F.min("p").alias("p"))


def _links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, least: float, words: int) -> DataFrame:
    """(node, root) of the ids that have a link, but for the roots."""
    members = _members(nodes)
    sets = _sets(docs, rows, members.select("id").distinct().join(nodes.select("id", "node"), "id"), words)
    pivots = settle(members.groupBy("key").agg(F.max("rank").alias("top")).select("key", F.col("top.id").alias("p")))
    compared = _differences(members, pivots, sets, least)
    found = settle(components(compared.where("linked").select("u", F.col("p").alias("v"))))

    placed = members.where("n > 2").join(small(found).select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    split = settle(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key"))
    wanted = placed.join(small(split), "key").join(small(pivots), "key").select("p", F.col("id").alias("u"), "part").distinct()
    apart = settle(compared.join(wanted, ["p", "u"]))
    end = lambda name: apart.select("p", F.col("u").alias(name), F.col("apart").alias(f"{name}_apart"), F.col("d").alias(f"{name}_d"), F.col("size").alias(f"{name}_size"))
    pairs = _open_pairs(apart, least).join(end("u"), ["p", "u"]).join(end("v"), ["p", "v"])
    difference = F.col("u_d") + F.col("v_d") - 2 * F.size(F.array_intersect("u_apart", "v_apart"))
    fresh = pairs.where(difference <= F.lit(_reach(least)) * (F.col("u_size") + F.col("v_size")) + 1e-9).select("u", "v")
    return _merged(found, settle(fresh))


def classes(docs: DataFrame, least: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, tag, root and class_id for every row; root is null without words."""
    rows = settle(describe(docs, words))
    known = rows.where("node IS NOT NULL").select("doc_id", "tag", "node")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.max("weight").alias("weight"), F.any_value("bands").alias("bands"), F.min("doc_id").alias("least_id"))
    # ids are names only; the order of pivots comes from the content
    nodes = settle(nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("draw", F.xxhash64("node")))
    found = _links(docs, known, nodes, least, words)
    placed = nodes.select("node", "id", "least_id").join(found.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = placed.select("node", F.coalesce("root", "id").alias("root"), "least_id")
    named = placed.select("node", "root").join(placed.groupBy("root").agg(F.min("least_id").alias("class_id")), "root")
    alone = rows.where("node IS NULL").select("doc_id", "tag", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"))
    return known.join(named, "node").select("doc_id", "tag", "root", "class_id").unionByName(alone)


def keep_one(docs: DataFrame, least: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The documents, all columns, with one row of each class: that of the least doc_id."""
    found = settle(classes(docs, least, words).where("root IS NOT NULL"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("kept_id"), F.col("first.tag").alias("kept_tag"))
    counted = found.groupBy("root", "doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).join(first, "root")
    is_first = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag"))
    counted = settle(counted.where(~is_first | (F.col("n") > 1)).select("doc_id", "tag", is_first.alias("is_first")))
    # the input row is a struct, so that no column of it clashes with these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("id", F.col("row.doc_id")).withColumn("of", text_tag(F.col("row.text").cast("string")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("tag"))
    kept = rows.join(small(counted.select("doc_id", "tag")), same, "left_anti")
    repeated = counted.where("is_first")
    if not repeated.isEmpty():
        # a row to keep that is there several times: one of them
        again = rows.join(small(repeated.select("doc_id", "tag")), same, "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["id", "of"]))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
