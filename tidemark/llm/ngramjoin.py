"""N-gram Jaccard self-join by a grouped prefix join, and the components of its links.

Documents are sets of five-word shingles. 1. One pass over the texts sends 48-bit shingle digests, packed per
bucket, to tasks that mark which of them two documents share; only the number of shared shingles returns
to each document. A document whose shared shingles are fewer than 75 % of its set links with nothing and is done.
2. For the rest, exact 64-bit sets are made once; equal sets collapse into a class. 3. Classes order their
shingles by class frequency (rare first); those of one class only can't match and just shorten the prefix.
Classes with identical prefix and size form a group. 4. Group pairs that share a prefix shingle are candidates; they are filtered as groups:
by size, by the place of the shared shingle, and by what is known to differ from both whole prefixes. Only pairs that pass are expanded into
members and verified by exact intersection.

Links only matter through the components they make, so near copies need not all be compared: in some rounds each posting list compares its
groups with one hub, links merge components, and lists whose members are all in one component are finished. What is left after the
rounds goes through the filters of step 4, across components only. Long posting lists and large groups are dealt into blocks whose pairs are
tasks of their own. No link that could join two components goes unchecked.

Edge cases: null, empty and word-less texts have no shingle and link with nothing; fewer than five words make one
shingle of them all; a very long text is handled whole, as a slice of its own; a similarity of exactly 0.75 links; ties between equally frequent
shingles go by their hash, those between hubs by their id, and neither changes a component; rows with a null id get a null component;
rows that repeat an id are judged by their own text, and their links count for the id; other input columns are not used; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, merge_links
from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import U64, shingle_sets, slices, utf8

#: Shingles packed together by one task before they are sent out.
CHUNK_SHINGLES = 1_000_000
#: Bits of the broadcast filter of documents that stay: so many for each, up to a fixed size (8 MB). A fuller one only
#: lets more documents through.
BITS_EACH, STAY_BITS = 64, 1 << 26
#: Rounds that compare with hubs before the exact rest.
HUB_ROUNDS = 3
#: Bytes of text whose shingles go to one bucket, and bits of the bucket number at most (2 TB of text at that size, larger buckets beyond).
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 20
#: Groups of a posting list and members of a group that are compared in one cell of their joins.
LIST_BLOCK, MEMBER_BLOCK = 1024, 256
#: Bits of the parity signature of a set; sets that differ in d shingles have signatures that differ in d bits at most.
PARITY_BITS = 512


def _send(width: int, bucket_bits: int, id_type: pa.DataType):
    """Packs digests by bucket; a chunk's ids and set sizes go along in a row of their own (negative bucket)."""
    schema = pa.schema(
        [("bucket", pa.int32()), ("chunk", pa.int64()), ("digest", pa.binary()), ("doc", pa.binary()),
         ("ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int32()))]
    )
    edges = np.arange(1 << bucket_bits, dtype=U64) << U64(64 - bucket_bits)

    def pack(chunk: int, ids: list[pa.Array], grams: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(sizes)
        flat = np.concatenate(grams)
        doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        order = np.argsort(flat)
        flat, doc = flat[order], doc[order]
        cut = np.append(np.searchsorted(flat, edges), len(flat))
        digest = ((flat << U64(bucket_bits)) >> U64(32)).astype(np.uint32)
        full = np.flatnonzero(np.diff(cut))
        own = pa.concat_arrays(ids)
        return pa.RecordBatch.from_pydict(
            {
                "bucket": [*full.tolist(), -1 - chunk % 997],
                "chunk": [chunk] * (len(full) + 1),
                "digest": [*(digest[cut[i] : cut[i + 1]].tobytes() for i in full), None],
                "doc": [*(doc[cut[i] : cut[i + 1]].tobytes() for i in full), None],
                "ids": pa.array([None] * len(full) + [own.to_pylist()], pa.list_(id_type)),
                "sizes": [None] * len(full) + [n.tolist()],
            },
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = ([], [], [])
        docs = total = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                for a in range(lo, hi, 10_000):
                    b = min(hi, a + 10_000)
                    grams, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                    for store, x in zip(held, (batch.column(0).slice(a, b - a), grams, np.diff(bounds)), strict=True):
                        store.append(x)
                    docs, total = docs + b - a, total + len(grams)
                    if total >= CHUNK_SHINGLES or docs >= 50_000:
                        yield pack(chunk, *held)
                        held, docs, total, chunk = ([], [], []), 0, 0, chunk + 1
        if docs:
            yield pack(chunk, *held)

    return run


def _mark(id_type: pa.DataType):
    """Per bucket: for each chunk, how many of each document's digests another document has too."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc", pa.binary()), ("count", pa.binary()), ("ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int32()))]
    )

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            nothing = pa.nulls(table.num_rows, pa.binary())
            return pa.Table.from_arrays([table["chunk"], nothing, nothing, table["ids"], table["sizes"]], schema=schema)
        digests = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["digest"]]
        flat = np.concatenate(digests)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.zeros(len(flat), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        docs, counts, at = [], [], 0
        for x, d in zip(digests, table["doc"], strict=True):
            count = np.bincount(np.frombuffer(d.as_buffer(), np.uint16)[shared[at : at + len(x)]])
            at += len(x)
            full = np.flatnonzero(count)
            docs.append(full.astype(np.uint16).tobytes())
            counts.append(count[full].astype(np.uint32).tobytes())
        none = [None] * len(docs)
        return pa.Table.from_pydict(
            {"chunk": table["chunk"], "doc": docs, "count": counts, "ids": none, "sizes": none}, schema=schema
        )

    return run


def _sum_up(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n", pa.int32()), ("shared", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        own = next(i for i, x in enumerate(table["sizes"].is_valid().to_pylist()) if x)
        ids, sizes = table["ids"][own].values, table["sizes"][own].values
        total = np.zeros(len(sizes), np.int64)
        for d, c in zip(table["doc"], table["count"], strict=True):
            if d.is_valid:
                total[np.frombuffer(d.as_buffer(), np.uint16)] += np.frombuffer(c.as_buffer(), np.uint32)
        return pa.Table.from_arrays([ids, sizes, pa.array(total)], schema=schema)

    return run


def _exact_sets(width: int, stay, id_type: pa.DataType):
    """Sets of the documents whose bit is set in the filter."""
    schema = pa.schema([("id", id_type), ("n", pa.int32()), ("sig", pa.binary()), ("parity", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = stay.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            chosen = batch.filter(pa.array(hit))
            data, offsets = utf8(chosen.column(1))
            for lo, hi in slices(offsets):
                grams, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                bit = np.repeat(np.arange(hi - lo), np.diff(bounds)) * PARITY_BITS + (grams >> U64(55)).astype(np.int64)
                odd = (np.bincount(bit, minlength=(hi - lo) * PARITY_BITS) & 1).astype(np.uint8)
                parity = pa.array(np.packbits(odd).view(np.int64))
                pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        chosen.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds), pa.int32()),
                        pa.array([hashlib.sha256(grams[a:b].tobytes()).digest()[:16] for a, b in pairs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * (PARITY_BITS // 64), pa.int32()), parity),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(grams.view(np.int64))),
                    ],
                    schema=schema,
                )

    return run


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the bit of each id set: built on the executors, at most ``bits`` bits."""
    at = F.col("at") + 1
    pages = (
        ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at"))
        .groupBy(F.bitmap_bucket_number(at).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for page, bitmap in pages:
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(bitmap, np.uint8)
    return out


def _verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Those (a, b) whose exact Jaccard similarity is 0.75 or more."""
    side = lambda x: items.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), (F.col("na") + F.col("nb")).alias("sum"))
    return both.where("4 * common >= 3 * (sum - common)").select("a", "b")


_SIZES_FIT = "4 * least(na, nb) >= 3 * greatest(na, nb)"


def _split_lists(post: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self-join of posting lists, with (g, i, j) as the key: a list of c groups is dealt into c / LIST_BLOCK blocks, and
    each pair of blocks is a cell of its own, so that a frequent shingle is no single task's."""
    dealt = post.join(counts, "g").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "own")))
    side = lambda df, x: df.select("g", "i", "j", *[F.col(c).alias(c + x) for c in ("gid", "n", "k", "lo", "hi")])
    return side(left, "a"), side(right, "b")


def _group_pairs(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """(ga, gb, ba, bb): pairs of groups, also of a group with itself, that may hold a link between two components, and their blocks of members.

    ``spans`` gives each group's least and greatest component and its blocks. Lists whose groups are all in one component are finished.
    """
    post = groups.select("gid", "n", "alone", F.posexplode("prefix.g").alias("at", "g")).join(spans.drop("blocks"), "gid")
    post = post.select("gid", "n", "g", (F.col("alone") + F.col("at")).alias("k"), "lo", "hi")
    counts = post.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.ceil(F.count("*") / LIST_BLOCK).alias("blocks")).where("lo <> hi")
    counts = materialize(counts.select("g", "blocks"), "open")
    post = materialize(post.join(counts.select("g"), "g", "left_semi"), "rest")
    a, b = _split_lists(post, counts)
    # Jaccard >= 3/4 needs 3/7 of the summed sizes in common, so at most 1/7 of it differs.
    need = F.ceil((F.col("na") + F.col("nb")) * 3 / 7)
    pairs = (
        a.join(b, ["g", "i", "j"]).where("i < j or gida <= gidb").where("not (loa = hia and lob = hib and loa = lob)").where(_SIZES_FIT)
        .where(F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= need)
        .select(F.least("gida", "gidb").alias("ga"), F.greatest("gida", "gidb").alias("gb")).distinct()
    )
    known_of = groups.join(spans.select("gid", "blocks"), "gid")
    side = lambda x: known_of.select(F.col("gid").alias(f"g{x}"), F.col("blocks").alias(f"b{x}"), *[F.col(c).alias(c + x) for c in ("n", "alone", "prefix")])
    both = pairs.join(side("b"), "gb").join(side("a"), "ga")
    # Up to the lesser of the last prefix shingles both sets are known: what only one of them has there differs for certain.
    known = F.least(F.element_at("prefixa", -1), F.element_at("prefixb", -1))
    only = lambda x, y: F.size(F.filter(F.array_except(x, y), lambda t: t <= F.col("known")))
    both = both.withColumn("known", known)
    differ = F.col("alonea") + F.col("aloneb") + only("prefixa", "prefixb") + only("prefixb", "prefixa")
    out = materialize(both.where(differ * 7 <= F.col("na") + F.col("nb")).select("ga", "gb", "ba", "bb"), "group_pairs")
    drop(post, counts)
    return out


def _member_pairs(pairs: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """Members (a, b) of different components of the surviving group pairs, by blocks of members, as far as their parities allow a link."""
    dealt = members.join(spans.select("gid", "blocks"), "gid").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = pairs.withColumn("ia", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ba") - 1)))
    cells = cells.withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bb") - 1))).where("ga < gb or ia <= ib").select("ga", "gb", "ia", "ib")
    side = lambda x: dealt.select(F.col("gid").alias(f"g{x}"), F.col("block").alias(f"i{x}"), *[F.col(c).alias(c + x) for c in ("rep", "n", "component", "parity")])
    both = cells.join(side("a"), ["ga", "ia"]).join(side("b"), ["gb", "ib"]).where("componenta <> componentb").where("ga < gb or ia < ib or repa < repb")
    differ = sum((F.bit_count(F.col("paritya")[i].bitwiseXOR(F.col("parityb")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    both = both.where(differ * 7 <= F.col("na") + F.col("nb"))
    return both.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"))


def class_components(classes: DataFrame) -> DataFrame:
    """From (rep, n, parity, grams) of distinct sets: (node, component) of every rep that links with another."""
    grams = classes.select("rep", F.explode("grams").alias("g"))
    freq = materialize(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "freq")
    ranked = grams.join(freq, "g").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("ranked"))
    items = (
        classes.select("rep", "n", "parity")
        .join(ranked, "rep")
        .where("4 * size(ranked) >= 3 * n")
        # Shingles of one class only come first and match nothing: what remains of the prefix starts after them.
        .withColumn("leading", F.expr("slice(ranked, 1, size(ranked) - cast(ceil(3 * n / 4) as int) + 1)"))
        .select("rep", "n", "parity", F.col("ranked.g").alias("toks"), F.col("leading.g").alias("prefix"), "leading", (F.col("n") - F.size("ranked")).alias("alone"))
        .withColumn("gkey", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>")), 256))
    )
    items = materialize(items, "items")
    drop(freq)
    groups = items.groupBy("gkey").agg(F.min("rep").alias("leader"), *[F.first(c).alias(c) for c in ("n", "alone", "prefix", "leading")])
    groups = materialize(groups, "groups")
    first = items.join(groups.select("gkey", "leader"), "gkey").where("rep <> leader")
    links = materialize(_verified(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")), items), "inner")
    labels = components(links)
    for round_no in range(HUB_ROUNDS):
        # Round 0 compares groups by their leaders; later rounds expand the groups into members.
        who = groups.select(F.col("leader").alias("who"), "n", "prefix") if round_no == 0 else items.select(F.col("rep").alias("who"), "n", "prefix")
        post = (
            who.select("who", "n", F.explode("prefix").alias("g"))
            .join(labels.withColumnRenamed("node", "who"), "who", "left")
            .select("g", "who", "n", F.coalesce("component", "who").alias("comp"))
        )
        # First one hub for as many lists as possible; then, per list, a random member of its largest component.
        turn = F.xxhash64("who") if round_no == 0 else F.xxhash64(F.lit(round_no), "g", "who")
        parts = post.groupBy("g", "comp").agg(F.count("*").alias("size"), F.min(F.struct(turn.alias("turn"), "who", "n")).alias("hub"))
        best = F.max(F.struct(F.lit(0) - F.col("hub.turn") / 2 if round_no == 0 else F.col("size"), "hub.who", "hub.n", "comp"))
        hubs = parts.groupBy("g").agg(F.count("*").alias("parts"), best.alias("hub")).where("parts > 1")
        hubs = materialize(hubs.select("g", "hub.who", "hub.n", "hub.comp").toDF("g", "a", "na", "ca"), "hubs")
        pairs = (
            post.join(hubs, "g").where("comp <> ca")
            .select("a", F.col("who").alias("b"), "na", F.col("n").alias("nb")).where(_SIZES_FIT)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        found = materialize(_verified(pairs, items), "found")
        drop(hubs)
        if not found.limit(1).count():
            break
        labels = merge_links(labels, found)
    # The rest: pairs of groups that pass the filters, expanded into members of different components.
    members = items.select("rep", "gkey", "n", "parity").join(groups.select("gkey", F.col("leader").alias("gid")), "gkey")
    members = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "rep", "n", "parity", F.coalesce("component", "rep").alias("component"))
    members = materialize(members, "members")
    blocks = F.ceil(F.count("*") / MEMBER_BLOCK).alias("blocks")
    spans = materialize(members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks), "spans")
    pairs = _group_pairs(groups.select(F.col("leader").alias("gid"), "n", "alone", F.col("leading").alias("prefix")), spans)
    found = materialize(_verified(_member_pairs(pairs, members, spans), items), "found")
    drop(items, groups, members, spans, pairs)
    return merge_links(labels, found)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Per row: id, n_shingles (long) and component_id, the smallest id reachable by links of similarity >= 0.75."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    size = base.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = 5
    while bits < MOST_BUCKETS and BUCKET_BYTES << bits < size:
        bits += 1
    sent = base.mapInArrow(
        _send(width, bits, id_type), f"bucket int, chunk long, digest binary, doc binary, ids array<{kind}>, sizes array<int>"
    )
    marked = sent.groupBy("bucket").applyInArrow(
        _mark(id_type), f"chunk long, doc binary, count binary, ids array<{kind}>, sizes array<int>"
    )
    counts = materialize(marked.groupBy("chunk").applyInArrow(_sum_up(id_type), f"id {kind}, n int, shared long"), "counts")
    stay = counts.where("n > 0 and 4 * shared >= 3 * n and id is not null")
    stay_bits, wanted = 1 << 15, min(STAY_BITS, BITS_EACH * stay.count())
    while stay_bits < wanted:
        stay_bits *= 2
    chosen = spark.sparkContext.broadcast(_filter_of(stay, stay_bits))
    sets = base.where("id is not null").select("id", "body", F.pmod(F.xxhash64("id"), F.lit(stay_bits)).alias("at"))
    sets = sets.mapInArrow(_exact_sets(width, chosen, id_type), f"id {kind}, n int, sig binary, parity array<long>, grams array<long>")
    sets = materialize(sets.where("n > 0"), "sets")
    classes = sets.groupBy("sig").agg(F.min(F.struct("id", "n", "parity", "grams")).alias("x"))
    classes = materialize(classes.select("sig", F.col("x.id").alias("rep"), "x.n", "x.parity", "x.grams"), "classes")
    labels = class_components(classes)
    reps = materialize(classes.select("sig", "rep"), "reps")
    drop(classes)
    of_class = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", F.coalesce("component", "rep").alias("component")
    )
    of_class = materialize(of_class, "of_class")
    members = materialize(
        sets.select("id", "n", "sig").join(of_class, "sig").groupBy("id", "n").agg(F.min("component").alias("component")), "members"
    )
    drop(sets, reps, of_class, labels)
    return (
        counts.join(members, ["id", "n"], "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
