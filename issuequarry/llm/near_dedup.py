"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles; its sketch keeps the ``KEPT`` smallest.

1. Documents with equal sets are one class, counted inside the map tasks, so thousands of copies are one row from here.
2. Inverted lists of retained values: two sets with the asked similarity share far more than ``SHARED`` of their
   retained values (all but about 3.5 pairs in 10**10 at the threshold; sets of up to 15 shingles always). So it is enough
   to list each class under its rarest values, all but the ``SHARED - 1`` most frequent ones: values of a passage that
   many documents hold are hardly ever used. Lists are rows of a value and a class, without the sketches.
   Lists of more than ``CROWDED`` classes, say of texts that have one passage in common and nothing else, would still
   cost the square of their size. Their classes are listed anew, under the rarest values of their full sets, all but as
   many as a similar set must share less one: no link is lost, and a class with enough words of its own takes no list.
3. Within a list, pairs are not spelt out. Every class first meets the list's class with the most lists, which has the
   fewest values of its own, so there are no more pairs than list rows; classes already connected are then left alone,
   and what is outside a list's largest component meets a centre chosen by hash among its own, again and again while
   that connects at least half of it and all meetings of what is apart would be more than ``MEETINGS`` for each entry of
   a list. What is still apart meets every class of another component; there a pair is a row only under the smallest
   list that it shares.
   Two tests keep pairs without a chance from being compared: the parities of ``ODD_BITS`` buckets, which
   differ in no more places than the sets have unshared values (so no link is lost), and the union-sketch estimate.
4. Survivors are verified on full sets, which only classes in such lists rebuild from their texts, and connected.

No link between components is lost: any two classes of one list are compared, or already connected. Scratch tables
are emptied as soon as nothing reads them any more.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than
a shingle have one; rows of one doc_id are one node; rows without id take their class's component, else null, and are
kept only then; repeated rows share a class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from issuequarry.llm.common import Scratch, batches, fresh_names, hash_runs, hash_spans, lower_ascii, mix, spans_of, text_bytes

SHINGLE = 4
KEPT = 32
SHARED = 10
PERCENT = 80
FILTER_BITS = 22
CROWDED = 64
MEETINGS = 64
LISTS_SEEN = 64
ODD_BITS = 1024

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed 64-bit numbers."""
    data, starts = text_bytes(column)
    data = lower_ascii(data)
    begin, end = spans_of(~_BLANK[data])
    words = hash_spans(data, begin, end)
    bound = np.searchsorted(begin, starts)
    runs = hash_runs(words, shingle).view(np.int64)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(runs[a : b - shingle + 1])
        else:
            yield hash_runs(words[a:b], b - a).view(np.int64) if b > a else runs[:0]


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    x = own.view(np.uint64)
    hi = mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    lo = mix(x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(x))).sum(dtype=np.uint64)
    return int(hi.view(np.int64)), int(lo.view(np.int64))


def odd_bits(own: np.ndarray) -> np.ndarray:
    """One bit per bucket: whether an odd number of the set's values falls into it."""
    bucket = (mix(own.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) % np.uint64(ODD_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=ODD_BITS).astype(np.uint8) & 1).view(np.int64)


def _sketches(shingle: int, kept: int):
    def sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            size, hi, lo, low, odd = [], [], [], [], []
            for own in shingle_sets(batch.column("text"), shingle):
                a, b = set_key(own)
                size.append(len(own)), hi.append(a), lo.append(b), low.append(own[:kept]), odd.append(odd_bits(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("name"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "name", "n", "hi", "lo", "sketch", "odd"],
            )

    return sketch


def _sets(shingle: int):
    """Class key and full set of every text, for texts of classes that are asked for."""

    def full(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            keys, sets = [], []
            for own in shingle_sets(batch.column("text"), shingle):
                keys.append(set_key(own))
                sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sets, pa.binary())],
                names=["hi", "lo", "shingles"],
            )

    return full


def _exploded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per value of the sets, a set at a time."""
    for batch in stream:
        for cid, own in zip(batch.column("cid").to_pylist(), batch.column("shingles")):
            values = np.frombuffer(own.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), cid)), pa.array(np.full(len(values), len(values))), pa.array(values)], names=["cid", "n", "value"])


def _verified(percent: int):
    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            linked = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                merged = np.sort(np.concatenate((x, y)))
                both = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return verify


def _facts() -> dict[str, Column]:
    """What tells two edge sets apart: their size, and all bits of the edges' hashes, combined in two ways."""
    full = F.xxhash64("u", "v")
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(full), "s": F.sum(full.cast("decimal(20,0)"))}


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and comp, the smallest node of its component, by alternating large and small stars.

    Stars are a minimum per node and a join back on it, so a node of any degree is never gathered in one place. The
    minima are written first, so that the edges of a node of high degree can be split at run time. Stars are reached when
    every node has larger neighbours alone or one neighbour; the minima are the labels then.
    """
    scratch = Scratch(edges.sparkSession) if scratch is None else scratch
    now, before = scratch.counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", **_facts())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        found = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        least, seen = scratch.counted(found, "edges-least", n=F.count_if(F.expr("m < u AND degree > 1")))
        if not seen.get("n"):
            break
        large = both.filter("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.kept(large, "edges-large")
        fewest = scratch.kept(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        small = large.join(fewest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
            F.col("e.v").alias("u"), F.col("e.m").alias("v"),
        ).filter("u <> v").distinct()
        after, facts = scratch.counted(small, "edges", **_facts())
        scratch.drop(now, least, large, fewest)
        if facts == before:
            raise RuntimeError("the edges are no stars and do not change")
        now, before = after, facts
    labels = scratch.kept(least.select(F.col("u").alias("node"), F.col("m").alias("comp")), "edges-labels")
    scratch.drop(now, least)
    return labels


def _few_unshared(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """With the asked similarity at most (100 - percent) of (100 + percent) parts of both sizes are unshared."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return differing * (100 + percent) <= (na + nb) * (100 - percent)


def _plausible(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Sizes allow the similarity, and so does the estimate from the union's ``KEPT`` smallest values."""
    union = F.sort_array(F.array_union(a, b))
    cut = F.coalesce(F.get(union, F.lit(KEPT - 1)), F.element_at(union, -1))
    hits = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= cut))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (hits >= F.least(F.lit(SHARED), F.ceil(F.least(na, nb) * percent / 100)))


def _listed(postings: DataFrame, needed: Column, scratch: Scratch) -> DataFrame:
    """Inverted lists (value, cid) of postings (cid, n, value): every class under its rarest values that another class
    has too, all but ``needed`` less one."""
    shared = scratch.kept(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "near-shared")
    met = postings.join(shared, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"))
    rare = F.size("met") - needed + 1  # values of one class alone would come first in the order, and take no list
    entries = met.filter(rare > 0).select("cid", F.explode(F.slice("met", F.lit(1), rare.cast("int"))).alias("e")).select("cid", F.col("e.value").alias("value"))
    entries = scratch.kept(entries, "near-entries")
    many = scratch.kept(entries.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1").select("value"), "near-many")
    lists = scratch.kept(entries.join(many, "value"), "near-lists")
    scratch.drop(shared, entries, many)
    return lists


def _uncrowded(lists: DataFrame, sets: DataFrame, overlap: Column, scratch: Scratch) -> DataFrame:
    """The lists of at most ``CROWDED`` classes, and new ones by the full sets for the classes of all others."""
    counts = lists.groupBy("value").agg(F.count("*").alias("m"))
    crowded, seen = scratch.counted(counts.filter(F.col("m") > CROWDED).select("value"), "near-crowded", n=F.count(F.lit(1)))
    if not seen.get("n"):
        scratch.drop(crowded)
        return lists
    hot = lists.join(crowded, "value", "left_semi").select("cid").distinct()
    full = scratch.kept(sets.join(hot, "cid", "left_semi").mapInArrow(_exploded, "cid bigint, n bigint, value bigint"), "near-full")
    finer = _listed(full, overlap, scratch)
    # Values of both kinds of lists are kept apart.
    renamed = finer.select(F.xxhash64("value").alias("value"), "cid")
    fewer = scratch.kept(lists.join(crowded, "value", "left_anti").select("value", "cid").unionByName(renamed), "near-lists")
    scratch.drop(crowded, full, finer, lists)
    return fewer


def _sets_of(docs: DataFrame, classes: DataFrame, lists: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """Full sets (cid, shingles) of the listed classes alone, rebuilt from one document of each.

    The filter over ids has a fixed size whatever the corpus; what it lets through by chance falls out in the join.
    """
    wanted = classes.select("cid", "hi", "lo", "rep").join(lists.select("cid").distinct(), "cid", "left_semi")
    wanted = scratch.kept(wanted, "near-wanted")
    slot = F.pmod("rep", F.lit(1 << FILTER_BITS)).cast("int")
    slots = wanted.select(slot.alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[slots] = True

    def known_sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sets(shingle)(b.filter(pa.array(bits[b.column("s").to_numpy(zero_copy_only=False)])) for b in stream)

    keyed = docs.select("text", F.pmod(_named(docs), F.lit(1 << FILTER_BITS)).cast("int").alias("s"))
    sets = keyed.mapInArrow(known_sets, "hi bigint, lo bigint, shingles binary")
    # One set per class: copies are dropped inside the map tasks first.
    sets = sets.join(wanted.select("cid", "hi", "lo"), ["hi", "lo"]).groupBy("cid").agg(F.first("shingles").alias("shingles"))
    sets = scratch.kept(sets, "near-sets")
    scratch.drop(wanted)
    return sets


def _named(docs: DataFrame) -> Column:
    """A number that names a row for the filter: of its id, or of its text where it has none."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\n"), F.col("text"))))


def _components(docs: DataFrame, shingle: int, percent: int, one_node_per_id: bool, scratch: Scratch) -> DataFrame:
    """doc_id, n, hi, lo, comp of every row; the classes of a component share ``comp``, null without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lean = docs.select("doc_id", "text", _named(docs).alias("name"))
    sketched = lean.mapInArrow(_sketches(shingle, KEPT), f"doc_id {kind}, name bigint, n bigint, hi bigint, lo bigint, sketch array<bigint>, odd array<bigint>")
    rows = scratch.kept(sketched, "near-sketches")
    classes = rows.filter("n > 0").groupBy("hi", "lo", "n", "sketch", "odd").agg(F.min("name").alias("rep"))
    classes = scratch.kept(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    rows_of = classes.select("hi", "lo", "cid")
    overlap = F.ceil(F.col("n") * percent / 100)  # what a set of n values shares with any that is similar enough
    lists = _listed(classes.select("cid", "n", F.explode("sketch").alias("value")), F.least(F.lit(SHARED), overlap), scratch)
    sets = _sets_of(docs, classes, lists, shingle, scratch)
    lists = _uncrowded(lists, sets, overlap, scratch)
    known = classes.select("cid", "n", "sketch", "odd")

    def fits(a: str, b: str) -> Column:
        at = {side: {x: F.col(f"{side}.{x}") for x in ("n", "sketch", "odd")} for side in (a, b)}
        few = _few_unshared(at[a]["odd"], at[b]["odd"], at[a]["n"], at[b]["n"], percent)
        return few & _plausible(at[a]["sketch"], at[b]["sketch"], at[a]["n"], at[b]["n"], percent)

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a bigint, b bigint")

    def with_centres(members: DataFrame, centres: DataFrame) -> DataFrame:
        """Every member with its list's one centre: as many rows as lists have, tested once they are distinct."""
        met = members.join(centres.select("value", F.col("cid").alias("c"), F.col("comp").alias("c_comp")), "value")
        asked = scratch.kept(met.filter("cid <> c AND comp <> c_comp").select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct(), "near-asked")
        x, y = known.alias("x"), known.alias("y")
        tried = asked.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid")).filter(fits("x", "y"))
        pairs = scratch.kept(tried.select("a", "b"), "near-pairs")
        scratch.drop(asked)
        return pairs

    def with_all(members: DataFrame, others: DataFrame) -> DataFrame:
        """Every member with every other of its lists and another component; one row a pair, under its smallest list."""
        def side(entries: DataFrame) -> DataFrame:
            lists = F.slice(F.sort_array(F.collect_list("value")), 1, LISTS_SEEN)
            per = entries.groupBy("cid").agg(lists.alias("lists"), F.first("comp").alias("comp"))
            return entries.select("cid", "value").join(per.join(known, "cid"), "cid")

        x, y = side(members).alias("x"), side(others).alias("y")
        # Of very many lists a class carries the smallest alone; a pair that meets again beyond them is a row twice.
        smaller = F.array_min(F.array_intersect("x.lists", "y.lists")) < F.col("x.value")
        once = ~F.coalesce(smaller, F.lit(False))
        met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.comp") != F.col("y.comp")) & once & fits("x", "y"))
        return scratch.kept(met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct(), "near-pairs")

    def joined(edges: DataFrame, labels: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = scratch.kept(edges.unionByName(links(pairs)), "near-links")
        now = connected(more, scratch)
        scratch.drop(pairs, edges, *([] if labels is None else [labels]))
        return more, now

    if one_node_per_id:
        # An id whose rows have different sets ties their classes together.
        owned = rows.filter("n > 0 AND doc_id IS NOT NULL").join(rows_of, ["hi", "lo"]).select("doc_id", "cid").distinct()
        edges = owned.join(owned.groupBy("doc_id").agg(F.min("cid").alias("b"), F.count("*").alias("k")).filter("k > 1"), "doc_id").select(F.col("cid").alias("a"), "b").filter("a <> b")
    else:
        edges = rows_of.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
    edges = scratch.kept(edges.distinct(), "near-links")
    member = lists.select("value", "cid", F.col("cid").alias("comp"))
    often = member.join(lists.groupBy("cid").agg(F.count("*").alias("k")), "cid")
    centres = often.groupBy("value").agg(F.max_by("cid", F.struct("k", "cid")).alias("cid")).withColumn("comp", F.col("cid"))
    edges, labels = joined(edges, None, with_centres(member, scratch.kept(centres, "near-centres")))
    turn, left = 0, None
    while True:
        placed = lists.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        placed, entries = scratch.counted(placed, "near-placed", n=F.count(F.lit(1)))
        # Per list: its largest component, and whether there is another.
        sizes = placed.groupBy("value", "comp").agg(F.count("*").alias("size")).groupBy("value").agg(
            F.max_by("comp", F.struct("size", "comp")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("all"), F.max("size").alias("largest"))
        meetings = F.sum(F.col("all").cast("double") * (F.col("all") - F.col("largest")))
        sizes, met = scratch.counted(sizes.filter("parts > 1"), "near-sizes", n=meetings)
        still = scratch.kept(placed.join(sizes.select("value", "most"), "value"), "near-open")
        outside, seen = scratch.counted(still.filter("comp <> most").drop("most"), "near-outside", n=F.count(F.lit(1)))
        now = seen.get("n") or 0
        if not now:
            break
        few = (met.get("n") or 0) <= MEETINGS * entries["n"]
        if few or left is not None and 2 * now > left:
            edges, labels = joined(edges, labels, with_all(still, outside))
            break
        turn, left = turn + 1, now
        chosen = outside.groupBy("value").agg(F.min_by(F.struct("cid", "comp"), F.xxhash64(F.lit(turn), "value", "cid")).alias("c"))
        chosen = scratch.kept(chosen.select("value", "c.cid", "c.comp"), "near-centres")
        edges, labels = joined(edges, labels, with_centres(still, chosen))
        scratch.drop(placed, sizes, still, outside, chosen)
    scratch.drop(lists, sets, edges)
    of_class = scratch.kept(rows_of.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("hi", "lo", F.coalesce("comp", "cid").alias("comp")), "near-components")
    found = rows.select("doc_id", "n", "hi", "lo").join(of_class, ["hi", "lo"], "left")
    result = scratch.kept(found.select("doc_id", "n", "hi", "lo", F.when(F.col("n") > 0, F.col("comp")).alias("comp")), "near-found")
    scratch.drop_all_but(result)
    return result


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    found = _components(docs, shingle, percent, True, scratch)
    least = scratch.kept(found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")), "near-least")
    placed = found.join(least, "comp", "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
    ).withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


def kept(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, one row of each component: the smallest id, no id last, of equal ids one row.

    Rows are nodes by what they say, so an id that names several texts ties nothing together; rows without words all
    stay. A row is found again by its id; only rows that share an id or have none are told apart by their set.
    """
    scratch = Scratch(docs.sparkSession)
    found = _components(docs, shingle, percent, False, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("hi").alias("hi"), F.col("lo").alias("lo"))
    first = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("f"))
    twice = found.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("t_id"))
    id_, hi, lo, nth = fresh_names(docs, 4)
    first = scratch.kept(first.select(F.col("f.id").alias(id_), F.col("f.hi").alias(hi), F.col("f.lo").alias(lo)), "near-first")
    twice = scratch.kept(twice.withColumnRenamed("t_id", id_), "near-twice")
    scratch.drop(found)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same_id = F.col("doc_id").eqNullSafe(F.col(id_))
    once = first.join(twice, first[id_].eqNullSafe(twice[id_]), "left_anti").select(id_)
    single = docs.filter(worded).join(once, same_id, "left_semi")
    # Rows of ids that stand for several rows: their sets say which row is meant, and of equal ones one stays.
    again = _with_class(docs.filter(worded).join(twice, same_id, "left_semi"), shingle, hi, lo)
    chosen = first.withColumnsRenamed({hi: f"{hi}_", lo: f"{lo}_"})
    again = again.join(chosen, same_id & (F.col(hi) == F.col(f"{hi}_")) & (F.col(lo) == F.col(f"{lo}_")), "left_semi")
    each = Window.partitionBy("doc_id", hi, lo).orderBy(F.xxhash64("text"))
    again = again.withColumn(nth, F.row_number().over(each)).filter(F.col(nth) == 1)
    return docs.filter(~worded).unionByName(single).unionByName(again.select(*docs.columns)).select(*docs.columns)


def _with_class(docs: DataFrame, shingle: int, hi: str, lo: str) -> DataFrame:
    """The documents with the key of their set in two more columns."""
    schema = StructType([*docs.schema.fields, StructField(hi, LongType()), StructField(lo, LongType())])

    def keyed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            keys = [set_key(own) for own in shingle_sets(batch.column("text"), shingle)]
            columns = [*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, hi, lo])

    return docs.mapInArrow(keyed, schema)
