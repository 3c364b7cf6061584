"""N-gram Jaccard join with prefix trees: near-duplicate links and components of whole texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import byte_chunks, discard, materialize, table, utf8_parts
from .components import components
from .trie_join import contained, join_block, needed

U64 = np.uint64
#: Shingles of a set that a posting carries, and the part of them (one of SKETCH_PART) that a linked pair must share.
#: Of the smallest 48 of a union at least four fifths are shared on average where Jaccard is
#: 0.8 or more; fewer than a third (16) shared has a chance below 1e-10 for such a pair.
SKETCH, SKETCH_PART = 48, 3
#: Prefix tokens that are posted at most. In hash order each token of a union is shared with a
#: chance of 0.8 or more, so that a linked pair shares none of 16 with a chance of 7e-12; sets
#: of under 80 shingles post the whole exact prefix. For each frequent token left out others follow,
#: so many that the odds stay.
PREFIX = 16
#: Sets of one key, or of one key and size class, which meet in one task, and their shingles in all; more
#: are dealt out.
STRIP, STRIP_SHINGLES = 768, 1 << 21
#: Tokens in the sketches of more than STRIP sets, as far as that shows in a sample of so many sets, where more
#: than so many hold them, are frequent.
FREQUENT_SAMPLE, FREQUENT_LEAST = 1 << 16, 8
#: Bits, at most, of the filter that tells which texts are read again.
FILTER_BITS = 1 << 26


def _sketches(batches: Iterator[pa.RecordBatch], k: int, sketch: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_chunks(batch, "text"):
            sets = kernels.shingle_sets(*utf8_parts(part.column(2)), k)
            digests = [kernels.set_digest(s) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([s[:sketch].tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "h", "n", "d1", "d2", "sk"],
            )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.frombuffer(b"".join(x[: 8 * SKETCH] for x in batch.column(0).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["key"])


def _frequent(classes: DataFrame) -> np.ndarray:
    """Ascending frequent tokens: some 2 * FREQUENT_SAMPLE * SKETCH / FREQUENT_LEAST of them at most. They decide which
    tokens are posted, not which pairs link; a frequent one that the sample misses is posted like others."""
    n = classes.count()
    share = max(1, n // FREQUENT_SAMPLE)
    least = max(FREQUENT_LEAST, STRIP // share)
    if n <= least:
        return np.zeros(0, U64)
    some = classes.where(F.pmod("d1", F.lit(share)) == 0).select("body").mapInArrow(_tokens, "key long")
    found = some.groupBy("key").count().where(F.col("count") > least).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(U64))


def _may_miss(num: int, den: int, prefix: int | None, sketch: int | None) -> np.ndarray:
    """For each number w of smallest tokens of a union, how many of them the posted ones may leave out: the most x for
    which fewer than x + 1 of w are shared with a chance of q ** prefix at most, where q is the part that a
    linked pair doesn't share at most; -1 for none."""
    out = [-1]
    q = 1 - num / den
    for w in range(1, (sketch or 4 * (prefix or 0)) + 1):
        chance, x = 0.0, -1
        while prefix is not None and x + 1 < w:
            chance += math.comb(w, x + 1) * (1 - q) ** (x + 1) * q ** (w - x - 1)
            if chance > q**prefix * (1 + 1e-9):
                break
            x += 1
        out.append(x)
    return np.array(out)


def _posted(often: np.ndarray, n: int, exact: int, want: int, may_miss: np.ndarray, whole: bool) -> tuple[np.ndarray, int]:
    """Which of its smallest tokens a set posts, some of which are frequent, and whether it is one of many frequent
    tokens (1).

    It posts tokens that are not frequent, until as many stand in the prefix as a linked pair
    shares one of (by the exact count, or by odds). Where too many are frequent, the set posts the
    frequent ones of its plain prefix as well, and all others that it has here: it meets
    its like by the former, other sets by the latter.
    """
    rare = ~often
    nth = np.cumsum(rare)
    w = min(len(often), len(may_miss) - 1)
    enough = np.flatnonzero(np.arange(1, w + 1) - nth[:w] <= may_miss[1 : w + 1])
    most = min(exact, int(nth[enough[0]])) if len(enough) else exact if whole else None
    if most is not None and nth[-1] >= most:
        return rare & (nth <= most), 0
    return rare | (np.arange(len(often)) < want), 1


def _postings(
    batches: Iterator[pa.RecordBatch], late: np.ndarray, num: int, den: int, prefix: int | None, sketch: int | None
) -> Iterator[pa.RecordBatch]:
    may_miss = _may_miss(num, den, prefix, sketch)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rep, n = (batch.column(i).to_numpy() for i in (0, 1))
        body = batch.column(2).to_pylist()
        lens = np.array([len(x) // 8 for x in body])
        flat, owner = np.frombuffer(b"".join(body), U64), np.repeat(np.arange(len(n)), lens)
        ends = np.cumsum(lens)
        # the exact prefix: a set shares num / den of itself or more with any partner
        exact = n - -(-num * n // den) + 1
        want = exact if prefix is None else np.minimum(prefix, exact)
        post = np.arange(len(flat)) - np.repeat(ends - lens, lens) < np.repeat(want, lens)
        often = np.zeros(len(n), np.int32)
        if len(late):
            frequent = contained(flat, late)
            for i in np.unique(owner[frequent]).tolist():
                at = slice(ends[i] - lens[i], ends[i])
                # the sketches of the set and of its partners are whole
                whole = sketch is None or n[i] * den <= sketch * num
                post[at], often[i] = _posted(frequent[at], int(n[i]), int(exact[i]), int(want[i]), may_miss, whole)
        own = owner[post]
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat[post].view(np.int64)), pa.array(rep[own]), pa.array(n[own]), pa.array(often[own])], names=["key", "rep", "n", "often"]
        )


#: Columns that name a block, and what goes on of its rows. probe: 1 for a probe, and 2 more for a set of many
#: frequent tokens.
BLOCK = ("key", "bucket", "bi", "bj")
ROW = (*BLOCK, "probe", "rep", "n", "m")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of one block in sorted input."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(i).to_numpy() for i in range(len(BLOCK))]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(int(c[lo]) for c in cols)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _block(group: pa.Table):
    """Rows of a block, probes first. Its pairs are probe by other row, and, where bi is bj, probe by
    probe too."""
    kind = group.column("probe").to_numpy()
    order = np.argsort(kind & 1 == 0, kind="stable")
    same = group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
    pivot = U64(np.int64(group.column("key")[0].as_py()).view(np.uint64))
    return group.take(pa.array(order)), int((kind & 1).sum()), same, pivot, kind[order] & 2 > 0


def _candidates(
    batches: Iterator[pa.RecordBatch], num: int, den: int, sketch: int | None, late: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows that have a possible partner in their block, judged by sketches (by whole sets where ``sketch`` is None)."""

    def below(a, small, big):
        # a sketch that is cut may have lost common tokens: no exact bound where any set below is cut
        exact = needed(a, small, num, den)
        if sketch is None:
            return exact
        return np.where((np.asarray(a) <= sketch) & (big <= sketch), exact, np.minimum(exact, sketch // SKETCH_PART))

    def least(a, b):
        return below(a, b, b)

    for group in _groups(batches):
        if group.num_rows < 2:
            continue
        group, n_probe, same, pivot, often = _block(group)
        body = [np.frombuffer(x, U64) for x in group.column("body").to_pylist()]
        sizes = group.column("n").to_numpy()
        hit = np.zeros(group.num_rows, bool)

        def emit(i, probes):
            hit[i] = True
            hit[probes] = True

        join_block(body, sizes, least, pivot, n_probe, same, emit, num, den, below, late, often)
        if hit.any():
            out = group.filter(pa.array(hit)).select(list(ROW)).combine_chunks()
            yield from out.to_batches()


_LINK = "a long, b long, w long"


def _links(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact join of whole sets: links that span each block, and each row's number of links."""
    for group in _groups(batches):
        if group.num_rows < 2:
            continue
        group, n_probe, same, pivot, often = _block(group)
        texts = (part for batch in group.select(["text"]).to_batches() for part in byte_chunks(batch, "text"))
        body = [s for part in texts for s in kernels.shingle_sets(*utf8_parts(part.column(0)), k)]
        sizes, rep, m = (group.column(c).to_numpy() for c in ("n", "rep", "m"))
        label = np.arange(group.num_rows)
        weight = np.zeros(group.num_rows, np.int64)
        found: list[tuple[int, int]] = []

        def emit(i, probes):
            weight[i] += m[probes].sum()
            weight[probes] += m[i]
            for lab in np.unique(label[probes]).tolist():
                if lab != label[i]:
                    found.append((int(rep[i]), int(rep[probes[label[probes] == lab][0]])))
                    label[label == lab] = label[i]

        join_block(body, sizes, lambda a, b: needed(a, b, num, den), pivot, n_probe, same, emit, num, den, None, late, often)
        linked = np.flatnonzero(weight)
        if len(linked):
            a = [x for x, _ in found] + rep[linked].tolist()
            b = [y for _, y in found] + [None] * len(linked)
            w = [None] * len(found) + weight[linked].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, w)], names=["a", "b", "w"])


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def _blocks(posted: DataFrame, num: int, den: int) -> DataFrame:
    """(*BLOCK, probe, rep) from postings (key, rep, n, often).

    A key of up to STRIP sets (and STRIP_SHINGLES shingles) is one block. Beyond, sizes of linked sets
    differ by den / num at most, so that a set meets only those of its own and of the next size class:
    the block of a key and class holds the sets of the class as probes and those of the next class
    beside them. A class of more sets or shingles is dealt over pairs of strips.
    """
    often = posted.groupBy("key").agg(F.count("*").alias("of_key"), F.sum("n").alias("v")).where("of_key > 1")
    width = math.log(den / num * 1.0001)  # a little wide, so that rounding loses no pair
    many = (F.col("of_key") > STRIP) | (F.col("v") > STRIP_SHINGLES)
    size_class = F.when(many, F.floor(F.log("n") / width)).otherwise(-1).cast("int")
    stored = rows = materialize(posted.join(often, "key").select("key", "rep", "n", "often", size_class.alias("bucket")), "shared")
    strips = F.ceil(F.greatest(F.count("*") / STRIP, F.sum("n") / STRIP_SHINGLES)).cast("int")
    counts = rows.groupBy("key", "bucket").agg(F.count("*").alias("g"), strips.alias("ns"))
    rows = rows.drop("n")
    above = counts.where("bucket > 0").select("key", (F.col("bucket") - 1).alias("bucket"), F.col("g").alias("gu"), F.col("ns").alias("nu"))
    made = counts.join(above, ["key", "bucket"], "left").where("g + coalesce(gu, 0) > 1")
    made = made.select("key", "bucket", "ns", F.coalesce("nu", F.lit(0)).alias("nu"))
    own = rows.withColumn("probe", F.lit(1))
    upper = rows.where("bucket > 0").withColumn("bucket", F.col("bucket") - 1).withColumn("probe", F.lit(0))
    out = own.union(upper).join(made, ["key", "bucket"])
    out = out.withColumn("s", F.pmod(F.xxhash64("rep"), F.when(F.col("probe") == 1, F.col("ns")).otherwise(F.col("nu"))).cast("int"))
    places = F.expr(
        """CASE WHEN ns = 1 AND nu <= 1 THEN array(named_struct('bi', 0, 'bj', 0, 'probe', probe))
             WHEN probe = 0 THEN transform(sequence(0, ns - 1), i -> named_struct('bi', i, 'bj', ns + s, 'probe', 0))
             ELSE concat(transform(sequence(s, ns + nu - 1), j -> named_struct('bi', s, 'bj', j, 'probe', 1)),
                         transform(filter(sequence(0, s), i -> i < s), i -> named_struct('bi', i, 'bj', s, 'probe', 0))) END"""
    )
    out = out.select("key", "bucket", "rep", "often", F.explode(places).alias("at"))
    out = out.select("key", "bucket", "at.bi", "at.bj", (F.col("at.probe") + 2 * F.col("often")).cast("int").alias("probe"), "rep")
    out._stored_at = stored._stored_at
    return out


def _named_row(id_col: str, h: str) -> list[Column]:
    """(no_id, at_id, at_h): id and hash of a row, by which rows with a null id join as well."""
    return [F.col(id_col).isNull().alias("no_id"), F.coalesce(id_col, F.lit(0)).alias("at_id"), F.col(h).alias("at_h")]


PLACE = ["no_id", "at_id", "at_h"]


def _filtered(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of which PLACE may be one of ``wanted``, told by a broadcast bitmap of FILTER_BITS at most: all that are, and
    a few others (more, the more rows are wanted)."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (64 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*PLACE), F.lit(bits))
    part, place = F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("place")
    maps = wanted.select(part, place).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.withColumns({"part": part, "place": place}).join(F.broadcast(maps), "part")
    mask = F.expr("shiftleft(1L, CAST(place & 7 AS INT))")
    return met.where(byte.bitwiseAND(mask) != 0).drop("part", "place", "bits")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    prefix: int | None = PREFIX,
    sketch: int | None = SKETCH,
) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, n_links).

    Two texts link when ``den * |A and B| >= num * |A or B|`` of their sets of ``k``-word shingles
    (lower-cased A-Z). component_id is the smallest id reachable by links, itself included;
    n_links counts the other rows that link directly.

    How: equal sets become one class; classes post the first tokens of the global (hash) order, leaving out
    those that very many sets hold and going on for so many more (`_posted`);
    blocks of a key walk a prefix tree over bottom sketches to find rows with a possible
    partner; only these get their whole sets, in the one block of a pair's smallest common
    token, where a second prefix-tree walk decides exactly. Within a key of many sets they
    meet only those of like size; size classes of many sets are dealt over strip pairs of bounded size.

    ``prefix`` and ``sketch`` bound the tokens that a set posts and that a posting carries; the odds that a
    link is lost by them are below 1e-9 each (PREFIX, SKETCH). None for both is the exact join: whole
    prefixes are posted and whole sets are walked, for some four times the postings.

    Null or empty text, or text without words: n_shingles 0, linked with nothing, component_id
    its own id. Null ids link like others; component_id is the smallest id of the component, null
    where no row of it has one. Rows that repeat an id are nodes of their own, by their texts.
    Repeated rows stay. Very long texts are taken whole. Extra columns are ignored. Empty input gives
    no rows.
    """
    found = classify(docs, id_col, text_col, k, num, den, prefix, sketch)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")


def classify(
    docs: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 80, den: int = 100, prefix: int | None = PREFIX, sketch: int | None = SKETCH
) -> DataFrame:
    """(id, h, n_shingles, component, component_id, n_links) as in :func:`jaccard_classes`. h is a hash of the
    text, which with the id tells rows apart; component names the component where ids are null or repeated
    as well, null for rows without a set."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sketches = materialize(
        src.mapInArrow(lambda it: _sketches(it, k, sketch), "id long, h long, n long, d1 long, d2 long, sk binary"), "sketches"
    )
    # one row of each class stands for it: of its rows with an id, if any, the one with the smallest
    stands = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("h").alias("h")))
    classes = (
        sketches.where("n > 0").groupBy("d1", "d2")
        .agg(stands.alias("at"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("sk").alias("body"))
        .select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", F.col("at.id").alias("id"), F.col("at.h").alias("h"), "m", "n", "body")
    )
    classes = materialize(classes, "classes")
    members = materialize(sketches.select("id", "h", "n", "d1", "d2"), "members")
    discard(sketches)
    late = _frequent(classes)
    posted = classes.select("rep", "n", "body").mapInArrow(
        lambda it: _postings(it, late, num, den, prefix, sketch), "key long, rep long, n long, often int"
    )
    rows = _blocks(posted, num, den)
    sketched = rows.join(classes.select("rep", "n", "m", "body"), "rep").select(*ROW, "body")
    short = "key long, bucket int, bi int, bj int, probe int, rep long, n long, m long"
    hits = materialize(_dealt(sketched).mapInArrow(lambda it: _candidates(it, num, den, sketch, late), short), "hits")
    discard(rows)
    named = materialize(classes.select("rep", "d1", "d2", "id", "h", "m"), "names")
    discard(classes)
    # of the texts only those of hits go on, one of rows that agree in id and hash
    wanted = materialize(hits.select("rep").distinct().join(named.select("rep", *_named_row("id", "h")), "rep"), "wanted")
    texts = _filtered(src.select(*_named_row("id", "h"), "text"), wanted).groupBy(*PLACE).agg(F.first("text").alias("text"))
    whole = hits.join(wanted, "rep").join(texts, PLACE).select(*ROW, "text")
    found = materialize(_dealt(whole).mapInArrow(lambda it: _links(it, k, num, den, late), _LINK), "found")
    discard(hits)
    discard(wanted)
    comps = components(found.where("b is not null"))
    n_links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    joined = (
        named.join(n_links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("d1", "d2", "id", "m", "w", F.coalesce("component", "rep").alias("component"))
    )
    names = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    joined = materialize(joined.drop("id").join(names, "component"), "named")
    for gone in (named, found, comps):
        discard(gone)
    out = members.join(joined, ["d1", "d2"], "left")
    none = F.col("n") == 0
    return out.select(
        "id",
        "h",
        F.col("n").alias("n_shingles"),
        "component",
        F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(none, F.lit(0)).otherwise(F.coalesce("w", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n, count(*) AS m FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
tokens AS (SELECT rep, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
walk(a, b) AS (SELECT a, b FROM links UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
comp AS (SELECT a, min(b) AS b FROM walk GROUP BY a),
direct AS (SELECT a, sum(m) AS w FROM links JOIN classes ON classes.rep = links.b GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE least(classes.rep, coalesce(comp.b, classes.rep)) END AS component_id,
  CAST(CASE WHEN len(sets.s) = 0 THEN 0 ELSE coalesce(direct.w, 0) + classes.m - 1 END AS BIGINT) AS n_links
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s
LEFT JOIN comp ON comp.a = classes.rep LEFT JOIN direct ON direct.a = classes.rep
"""
