"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Sketch: every distinct ``shingle``-word run of a document has weight 1 + ln(count).  Its
arrivals form a Poisson process of that rate, and each arrival falls on one of ``BANDS *
ROWS`` components; a component keeps the run that arrives first.  A run stops arriving as
soon as its time is beyond the latest of all components.  Two components agree with the
probability Jaccard similarity of the weighted runs, which is the Jaccard similarity where
no run repeats.  As links are verified by set similarity, which repeats can lift above the
weighted one, a document with repeated runs is banded a second time with all weights 1 (the
two sketches of any other document are the same): every two documents meet with the
probability that their set similarity gives, however often their runs repeat.

Documents of one word sequence (128 bits of its SHA-256) collapse to their smallest id
before anything is paired, so exact copies never make pairs.  The others meet in buckets (a
band's components).  Each bucket tests its members against its smallest id, then, as long as
its members are in different components, against other leaders.  What is left is tested
between components: pair by pair in buckets of up to ``CROWD`` members, and in larger ones
by blocks of bounded size, where matrix products count the common shingles of all members
and only links that join two components come out.  So no link between different components
is lost, and no group's pairs are ever written down.  Every link is verified with the
Jaccard similarity of the whole shingle sets (64-bit hashes of shingles).  Classes are the
connected components of the links: each round's links are drawn between the components
found so far, whose own components are found by large-star/small-star.

What is dealt out by a bucket or by a hub is always a written table joined with a written
table of one row for each key, so that Spark can split the hot ones.

Cases: null and empty texts, and texts without words, are alone in their class; a text of
fewer words than a shingle is one shingle; very long texts are read whole; ``doc_id`` names
a document, and rows that repeat it share a class; of ties (copies) the smallest id names
the class; rows with null ``doc_id`` join no class but their own copies', whose id may be
null; an empty table has no classes; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import IS_WORD, U, Words, mix, slices, utf8

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 4
#: Rounds of new leaders before the components left in a bucket are compared directly.
LEADER_ROUNDS = 2
#: Buckets of more members are compared in blocks.
CROWD = 24
#: Shingles and documents in a block at most; a crowd is dealt out in ``DEAL`` blocks as long
#: as these have ``FEW`` documents.  Cells of the table of common shingles that are filled at
#: once.
BLOCK_ITEMS, BLOCK_NODES = 1_000_000, 4096
DEAL, FEW = 16, 256
CELLS = 1 << 22

SKETCH = "doc_id long, print binary, n_words long, bands array<long>"


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document and their weights."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    return doc[at], shingle[at], 1 + np.log(count)


def prob_min_hash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m: for each component the item that arrives there first."""
    first = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, dtype=U)
    time, draw = np.zeros(len(item)), 0
    while len(item):
        draw += 1
        z = mix(item + U(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((z >> U(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        slot = doc * m + (mix(z ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        kept[slot[won]] = item[won]
        live = time < first.reshape(n_docs, m).max(axis=1)[doc]
        doc, item, weight, time = doc[live], item[live], weight[live], time[live]
    return kept.reshape(n_docs, m)


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(kept), bands), dtype=U)
    for r in range(rows):
        key = mix(key * U(0xD6E8FEB86659FD93) + kept.reshape(-1, bands, rows)[:, :, r])
    return mix(key + np.arange(bands, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))


def bucket_keys(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each document, document by document, and how many each has: one per band,
    and as many again, of weights 1, where a run repeats."""
    keys = band_keys(prob_min_hash(doc, item, weight, n_docs, bands * rows), bands, rows)
    again = np.zeros(n_docs, dtype=bool)
    again[doc[weight > 1]] = True
    of = np.flatnonzero(again)
    own = again[doc]
    flat = prob_min_hash((np.cumsum(again) - 1)[doc[own]], item[own], np.ones(own.sum()), len(of), bands * rows)
    owner = np.concatenate([np.arange(n_docs), of])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([keys, band_keys(flat, bands, rows)])[order].ravel(), bands * (1 + again)


def sequence_prints(words: Words, at: np.ndarray) -> list[bytes]:
    """128 bits for the word sequence of each document of a slice."""
    inside = IS_WORD[words.low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    starts = at[:-1][np.diff(at) > 0]
    keep[starts] = inside[starts]
    body = np.where(inside, words.low, 32)[keep].astype(np.uint8)
    bounds = np.concatenate([[0], np.cumsum(keep)])[at]
    return [hashlib.sha256(body[a:b].tobytes().rstrip(b" ")).digest()[:16] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                n = last - first
                count = np.diff(words.first)
                keys, held = bucket_keys(*weighted(*words.shingles(shingle)), n, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), pa.array(sequence_prints(words, offsets), pa.binary()), pa.array(count, pa.int64()), lists],
                    ["doc_id", "print", "n_words", "bands"],
                )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                doc, item, _ = weighted(*Words(part, offsets).shingles(shingle))
                bounds = np.searchsorted(doc, np.arange(last - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(item.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(first, last - first), lists], ["node", "items"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``links`` (a, b) is connected to.

    Alternates large-star and small-star until the links are stars; every round is a
    grouped minimum and a join, so a hub is only ever a joined key.
    """
    links = shared.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = shared.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        after = shared.materialize(small, "links")
        # Stars: no node is both a leaf and a centre, and no leaf has two centres.
        inner = after.select("a").intersect(after.select(F.col("b").alias("a")))
        if inner.isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = after


def merged(label: DataFrame, tested: DataFrame) -> DataFrame:
    """``label`` (node, root) after the links among ``tested`` have joined components."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = tested.filter("linked").select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("root_a <> root_b")
    between = shared.materialize(between.select("root_a", "root_b").distinct(), "between")
    if between.isEmpty():
        return label
    moved = components(between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("into"))
    return shared.materialize(label.join(moved, "root", "left").select("node", F.coalesce("into", "root").alias("root")), "label")


def classes(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its class), n_words."""
    return resolve(docs, shingle, threshold, bands, rows)[0]


def links(docs: DataFrame, **options) -> DataFrame:
    """a, b, similarity: verified links that connect every class, between the smallest ids of
    its different texts."""
    return resolve(docs, **options)[1]


def resolve(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``classes`` and of ``links``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = shared.materialize(docs.mapInArrow(_sketches(shingle, bands, rows), SKETCH), "sketch")
    nodes = sketch.filter("n_words > 0").groupBy("print").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"))
    nodes = shared.materialize(nodes, "nodes")
    bucket = nodes.filter("node is not null").select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    crowded = bucket.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    crowded = shared.materialize(crowded.select("bucket", "leader"), "crowded")
    member = shared.materialize(bucket.join(crowded, "bucket").select("bucket", "node", "leader"), "member")

    sets = _candidate_sets(docs, member, shingle)
    label = shared.materialize(member.select("node").distinct().select("node", F.col("node").alias("root")), "label")
    pairs = member.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    tested = shared.materialize(_verify(pairs, sets, threshold), "tested")
    label = merged(label, tested)
    rest = []
    for turn in range(LEADER_ROUNDS):
        pairs = _pairs_with_leader(_open_members(member, label), turn).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = shared.materialize(_verify(pairs, sets, threshold), "tested")
        tested, label = tested.union(more), merged(label, more)
    open_member = _open_members(member, label)
    pairs = _pairs_between(open_member.filter(F.col("members") <= CROWD)).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest.append(shared.materialize(_verify(pairs, sets, threshold), "tested"))
    label = merged(label, rest[-1])
    crowds = open_member.filter(F.col("members") > CROWD)
    if not crowds.isEmpty():
        crowds = _open_members(member, label).filter(F.col("members") > CROWD)
        rest.append(shared.materialize(_links_in_crowds(crowds, sets, threshold), "crowds"))
        label = merged(label, rest[-1])
    own = nodes.select("print", "node").join(label, "node", "left").select("print", F.coalesce("root", "node").alias("class_id"))
    # Written, so that the join deals out plain rows, which Spark can split where copies are many.
    own = shared.materialize(own, "own")
    rows_with = sketch.select("doc_id", "print", "n_words").filter("n_words > 0").join(own, "print").select("doc_id", "class_id", "n_words")
    alone = sketch.filter("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), "n_words")
    linked = shared.union_all([tested, *rest]).filter("linked").select("a", "b", "similarity").dropDuplicates(["a", "b"])
    return rows_with.union(alone), linked


def _candidate_sets(docs: DataFrame, member: DataFrame, shingle: int) -> DataFrame:
    """node, items: whole shingle sets of the nodes that meet another in some bucket."""
    wanted = member.select("node").distinct()
    texts = docs.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi")
    return shared.materialize(texts.mapInArrow(_sets(shingle), "node long, items array<long>"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of their shingle sets, linked: whether it reaches the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return pairs.join(a, "a").join(b, "b").select("a", "b", (common / union).alias("similarity"), (common >= threshold * union - 1e-9).alias("linked"))


def _open_members(member: DataFrame, root: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    known = member.join(root, "node").select("bucket", "node", "root")
    known = shared.materialize(known, "known")
    several = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    several = shared.materialize(several.filter("low < high").select("bucket", "members"), "several")
    return shared.materialize(known.join(several, "bucket"), "open")


def _links_in_crowds(member: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity, linked: for every block pair of every bucket, links that join its components."""
    items = sets.select(F.col("node").alias("own"), "items")
    rows = member.join(items, F.col("node") == F.col("own")).select("bucket", "node", "root", "items")
    size = member.join(sets.select(F.col("node").alias("own"), F.size("items").alias("size")), F.col("node") == F.col("own"))
    size = size.groupBy("bucket").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_ITEMS, F.count("*") / BLOCK_NODES, F.least(F.lit(DEAL), F.count("*") / FEW))).cast("int").alias("blocks"))
    rows = rows.join(shared.materialize(size, "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("low"), F.greatest(k, "block").alias("high")))
    dealt = rows.select("bucket", "node", "root", "items", F.explode(others).alias("pair"))
    dealt = dealt.select("bucket", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "node", "root", "items")
    return dealt.groupBy("bucket", "low", "high").applyInArrow(_joiner(threshold), "a long, b long, similarity double, linked boolean")


def _joiner(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        nodes, roots = group["node"].to_numpy(), group["root"].to_numpy()
        lists = group["items"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = joining_links(nodes, roots, size, lists.flatten().to_numpy(), threshold)
        a, b, similarity = ([x[k] for x in found] for k in range(3))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64()), "linked": pa.array([True] * len(a), pa.bool_())})

    return run


def joining_links(nodes: np.ndarray, roots: np.ndarray, size: np.ndarray, items: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links, with their similarity, that join the components of these nodes, as few as join
    all that can be.

    Rows of the table of common shingles are filled some at a time; each row's near nodes are
    joined at once, so no list of pairs is ever held, and the work ends when all are one."""
    n = len(nodes)
    kinds, group, many = np.unique(roots, return_inverse=True, return_counts=True)
    if len(kinds) < 2:
        return []
    rest = np.flatnonzero(group != many.argmax())
    doc = np.repeat(np.arange(n), size)
    _, column, uses = np.unique(items, return_inverse=True, return_counts=True)
    place = np.full(len(uses), -1)
    place[uses > 1] = np.arange((uses > 1).sum())
    column, doc = place[column][uses[column] > 1], doc[uses[column] > 1]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    left, links, total = len(kinds), [], size.astype(np.float32)
    step, high = max(256, (1 << 22) // n), max(1, CELLS // n)
    for own in np.array_split(rest, -(-len(rest) // high)):
        common = np.zeros((len(own), n), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, (low, low + step))
            part = np.zeros((n, step), np.float32)
            part[doc[a:b], column[a:b] - low] = 1
            common += part[own] @ part.T
        for i, shared_items in zip(own.tolist(), common, strict=True):
            union = total[i] + total - shared_items
            near = np.flatnonzero(shared_items >= threshold * union - 1e-3)
            near = near[(group[near] != group[i]) & (shared_items[near] >= threshold * union[near].astype(np.float64) - 1e-9)]
            for k in np.unique(group[near], return_index=True)[1]:
                j = int(near[k])
                links.append((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j])), float(shared_items[j]) / float(union[j])))
                group[group == group[j]] = group[i]
                left -= 1
        if left == 1:
            break
    return links


def _pairs_with_leader(member: DataFrame, turn: int) -> DataFrame:
    """Each member with the member that a hash, another in each turn, puts first, if they
    are in different components."""
    order = F.struct(F.xxhash64(F.lit(turn), "root"), F.xxhash64(F.lit(turn), "node"), "node", "root")
    lead = member.groupBy("bucket").agg(F.min(order).alias("lead")).select("bucket", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"))
    lead = shared.materialize(lead, "lead")
    other = member.join(lead, "bucket").filter("root <> lead_root")
    return other.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()


def _pairs_between(member: DataFrame) -> DataFrame:
    """Members of one bucket that are in different components."""
    left = member.select("bucket", F.col("node").alias("a"), F.col("root").alias("root_a"))
    right = member.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return left.join(right, "bucket").filter("a > b and root_a <> root_b").select("a", "b").distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that name their class, with all their columns; rows with null
    ``doc_id`` stay."""
    found = classes(docs, **options)
    stay = found.filter("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.filter("doc_id is not null").join(stay, docs["doc_id"].cast("long") == stay["kept_id"], "left_semi")
    return kept.unionByName(docs.filter("doc_id is null"))
