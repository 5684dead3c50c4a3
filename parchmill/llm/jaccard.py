"""Jaccard join of shingle sets over a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import bitmaps as B
from parchmill.llm.common import Forest, components, join_totals, staged
from parchmill.llm.shingles import Signatures, WordHashes, folded, odd_sketch, set_id, shingle_set

# Documents of a group, and queries that meet a group in one task.
GROUP = 512
QUERIES = 1024

# Sets of a block under one centre, rows that a task sifts at once, neighbours that
# a set looks at first, and words of sketches that are compared in one step.
BLOCK = 4096
ROWS = 1024
NEIGHBOURS = 4
SKETCH_WORDS = 1 << 16
DOCS_AT_ONCE = 256

# A shingle is frequent if so many sets of so many documents hold it.
FREQUENT = 6
SAMPLE = 10_000

SIGNED = "part int, row long, doc_id long, n_shingles long, set_id long, sketch binary, signatures binary, sets binary"
SORTED = "row long, doc_id long, n_shingles long, set_id long, sketch binary, centre long"
SHARED = "set_id long, centre long"
TOKENS = "set_id long, tokens binary"
LINKS = "a long, b long"


def _empty(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column, so many rows at a time that what is made of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), DOCS_AT_ONCE):
            yield batch.column(0).slice(at, DOCS_AT_ONCE)


def _sets_of(texts: pa.Array, words: int, memo: WordHashes) -> pa.RecordBatch:
    found = [shingle_set(t, words, memo) for t in texts.to_pylist()]
    ids = pa.array([set_id(f) for f in found], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array([f.tobytes() for f in found], pa.binary())], names=["set_id", "tokens"])


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least ``FREQUENT`` of about ``SAMPLE`` documents' sets hold, equal sets counting once, and by how many.

    They only steer which signatures are made (``Signatures``). At most
    ``SAMPLE / FREQUENT`` times the mean set size of them can exist, however
    many documents there are.
    """
    share = SAMPLE / max(docs.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_003))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for column in _slices(batches):
            yield _sets_of(column, words, memo)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _slices(batches):
            flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["token"])

    sample = docs.filter(draw < F.lit(int(share * 1_000_003) + 1)).select("text").mapInArrow(sets, TOKENS)
    counted = sample.dropDuplicates(["set_id"]).select("tokens").mapInArrow(each, "token long").groupBy("token").count()
    found = counted.filter(F.col("count") >= FREQUENT).select("token", "count").toArrow()
    tokens = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("count").to_numpy()[order]


def _sign(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """A row per document, and its set's signatures packed into a row per batch and part."""
    frequent, counts = frequent_tokens(docs, words)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, signatures, dealt = WordHashes(), Signatures(percent, frequent, counts=counts), 0
        names = [f.split()[0] for f in SIGNED.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                numbers, ids, texts = (c.slice(at, DOCS_AT_ONCE) for c in batch.columns)
                sizes, sets, sketches, seen = [], [], [], {}
                for text in texts.to_pylist():
                    tokens = shingle_set(text, words, memo)
                    sizes.append(len(tokens))
                    sets.append(set_id(tokens))
                    sketches.append(odd_sketch(tokens).tobytes())
                    if len(tokens) and sets[-1] not in seen:
                        seen[sets[-1]] = signatures.of(tokens)
                n = len(sizes)
                where = (np.arange(dealt, dealt + n) % parts).astype(np.int32)
                dealt += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), numbers, ids, pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()),
                     pa.array(sketches, pa.binary()), _empty(n, pa.binary()), _empty(n, pa.binary())],
                    names=names,
                )
                if not seen:
                    continue
                marks = np.concatenate(list(seen.values()))
                owners = np.repeat(np.fromiter(seen, dtype=np.int64, count=len(seen)), [len(s) for s in seen.values()])
                where = (marks % np.uint64(parts)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                where, marks, owners = where[order], marks[order], owners[order]
                first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                ends = np.append(first[1:], len(where))
                cut = list(zip(first.tolist(), ends.tolist(), strict=True))
                k = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[first]), *[_empty(k, pa.int64())] * 4, _empty(k, pa.binary()),
                     pa.array([marks[a:b].tobytes() for a, b in cut], pa.binary()),
                     pa.array([owners[a:b].tobytes() for a, b in cut], pa.binary())],
                    names=names,
                )

    return docs.select("row", "doc_id", "text").mapInArrow(sign, SIGNED)


def _meet(part: pa.Table) -> pa.Table:
    """The documents of a part as they are, and for each signature that sets share, each set with the smallest of them."""
    docs = part.filter(pc.is_valid(part.column("set_id")))
    packed = part.filter(pc.is_valid(part.column("sets")))
    read = lambda c, kind: np.frombuffer(b"".join(packed.column(c).to_pylist()), dtype=kind)
    marks, sets = read("signatures", np.uint64), read("sets", np.int64)
    order = np.lexsort((sets, marks))
    marks, sets = marks[order], sets[order]
    begins = np.append(True, marks[1:] != marks[:-1])[: len(marks)]
    centre = sets[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(marks) else sets
    pairs = np.unique(np.stack([sets, centre], axis=1)[sets != centre], axis=0)
    return pa.table({
        "row": pa.concat_arrays([docs.column("row").combine_chunks(), _empty(len(pairs), pa.int64())]),
        "doc_id": pa.concat_arrays([docs.column("doc_id").combine_chunks(), _empty(len(pairs), pa.int64())]),
        "n_shingles": pa.concat_arrays([docs.column("n_shingles").combine_chunks(), _empty(len(pairs), pa.int64())]),
        "set_id": pa.concat_arrays([docs.column("set_id").combine_chunks(), pa.array(pairs[:, 0], pa.int64())]),
        "sketch": pa.concat_arrays([docs.column("sketch").combine_chunks(), _empty(len(pairs), pa.binary())]),
        "centre": pa.concat_arrays([_empty(len(docs), pa.int64()), pa.array(pairs[:, 1], pa.int64())]),
    })


def _tokens(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """set_id and tokens of the ``chosen`` (row, set): texts outside a filter of their rows are not moved."""
    bits = B.filter_bits(chosen.count())
    asked = docs.select("row", "text")
    near = B.flagged(asked, "row", staged(B.members(chosen, "row", bits), "asked"), bits, "near").filter("near")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for column in _slices(batches):
            yield _sets_of(column, words, memo)

    return near.join(chosen.select("row"), "row", "left_semi").select("text").mapInArrow(count, TOKENS)


class TokenGroup:
    """A group's column of the token-group matrix, and who of the group has each token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.asarray([len(s) for s in sets])
        every = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owners = every[order], owners[order]
        self.union, self.first = np.unique(every, return_index=True)
        self.ends = np.append(self.first[1:], len(every))

    def matches(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity to ``tokens`` reaches ``percent``; the group is opened only if its union can hold one.

        A member shares no more with the query than the union does, and at
        least ``percent`` of the query where it is similar enough.
        """
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = at[self.union[at] == tokens]
        if 100 * len(hit) < percent * len(tokens):
            return np.zeros(0, dtype=int)
        first, lengths = self.first[hit], self.ends[hit] - self.first[hit]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(self.owners[np.repeat(first, lengths) + inside], minlength=len(self.sizes))
        return np.flatnonzero(100 * shared >= percent * (self.sizes + len(tokens) - shared))


def _read(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint64) for t in group.column("tokens").to_pylist()]


def _table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _alike(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, words: np.ndarray, place: np.ndarray, stacked: dict, percent: int) -> np.ndarray:
    """Which pairs of rows have sketches that leave it open that their sets are similar.

    They are not if the sketches differ in more bits than similar sets of these
    sizes may differ in elements.
    """
    swap = words[one] > words[two]
    small, large = np.where(swap, two, one), np.where(swap, one, two)
    total = sizes[one] + sizes[two]
    near = np.zeros(len(one), dtype=bool)
    for w in np.unique(words[small]).tolist():
        for v in (w, 2 * w):  # sizes that may be similar are less than a doubling apart
            at = np.flatnonzero((words[small] == w) & (words[large] == v))
            if len(at):
                right = stacked[v][place[large[at]]]
                bits = np.bitwise_count(stacked[w][place[small[at]]] ^ (folded(right) if v > w else right)).sum(axis=1, dtype=np.int64)
                near[at] = bits * (100 + percent) <= total[at] * (100 - percent)
    return near


def near_rows(segments: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Rows with another row of their segment that their sketch and size leave open to be similar.

    In a segment by size, a row's partners are the rows of a range. Each row
    looks at its neighbours first, as one of many near copies finds another
    there, and at its whole range only if none of them is near.
    """
    order = np.lexsort((sizes, segments))
    segments, sizes = segments[order], sizes[order].astype(np.int64)
    rows = [sketches[i] for i in order.tolist()]
    words = np.asarray([len(r) // 8 for r in rows], dtype=np.int64)
    place, stacked = np.zeros(len(rows), dtype=np.int64), {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        place[own] = np.arange(len(own))
        stacked[w] = np.frombuffer(b"".join(rows[i] for i in own.tolist()), dtype=np.uint64).reshape(-1, w)
    base = np.cumsum(np.append(0, segments[1:] != segments[:-1]))[: len(rows)] << 40
    low = np.searchsorted(base + sizes, base - (-sizes * percent // 100), "left")
    high = np.searchsorted(base + sizes, base + sizes * 100 // percent, "right")
    found = np.zeros(len(rows), dtype=bool)
    for reach in (NEIGHBOURS, len(rows)):
        open_ = np.flatnonzero(~found)
        if not len(open_):
            break
        begin, end = np.maximum(low[open_], open_ - reach), np.minimum(high[open_], open_ + reach + 1)
        costs = np.cumsum((end - begin) * words[np.maximum(end - 1, 0)])
        cuts = np.searchsorted(costs, np.arange(SKETCH_WORDS, costs[-1] + SKETCH_WORDS, SKETCH_WORDS), "right")
        for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            lengths = (end - begin)[a:b]
            one = np.repeat(open_[a:b], lengths)
            two = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[a:b], lengths)
            apart = one != two
            one, two = one[apart], two[apart]
            near = _alike(one, two, sizes, words, place, stacked, percent)
            found[one[near]] = found[two[near]] = True
    out = np.zeros(len(rows), dtype=bool)
    out[order] = found
    return out


def sifted(both: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (set_id, centre) whose set has a near one, by its sketch, under the same centre.

    Sets that share a passage and little else go here, so what follows grows
    with the sets that have near copies and not with the square of those that
    hold a passage. A centre's sets are dealt into blocks of about ``BLOCK`` and
    pairs of blocks into segments; a task sifts segments of about ``ROWS`` rows.
    """
    members = both.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    n_rows = both.count()
    sized = join_totals(both, members, "centre", "members", n_rows)
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = sized.select("set_id", "centre", F.pmod(F.xxhash64("set_id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    # Should two segments get one number, a few sets too many stay.
    segment = F.xxhash64("centre", F.least("own", "other"), F.greatest("own", "other"))
    buckets = max(1, -(-n_rows // ROWS))
    known = sets.select("set_id", F.col("n_shingles").alias("n"), "sketch")
    full = dealt.select("set_id", "centre", segment.alias("segment")).join(known, "set_id")
    full = full.withColumn("bucket", F.pmod(F.xxhash64("segment"), F.lit(buckets)))

    def sift(group: pa.Table) -> pa.Table:
        keep = near_rows(group.column("segment").to_numpy(), group.column("n").to_numpy(), group.column("sketch").to_pylist(), percent)
        return group.select(["set_id", "centre"]).filter(pa.array(keep))

    return full.groupBy("bucket").applyInArrow(sift, SHARED).distinct()


def set_links(docs: DataFrame, sets: DataFrame, shared: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between sets that connect all sets which similar pairs connect.

    ``shared``: set_id and centre of sets that share a signature; ``sets``: first (its
    row that counts), n_shingles and sketch for each set. What sketches rule out goes
    first (``sifted``), so that tokens are fetched for few sets. The rest is
    partitioned into groups of similar ones by their smallest centre, and large
    groups into units of about ``GROUP``. A set is a query to every unit with a
    set that shares a centre with it. Each unit is joined within itself, and what
    that connects is done with: other units are asked only if they hold another
    component.
    """
    both = shared.unionByName(shared.select(F.col("centre").alias("set_id"), "centre")).distinct()
    near = staged(sifted(staged(both, "centres"), sets, percent), "near")
    homes = staged(near.groupBy("set_id").agg(F.min("centre").alias("home")), "homes")
    # A home may have a home itself: following that twice brings small groups of similar sets together.
    for _ in range(2):
        further = homes.select(F.col("set_id").alias("home"), F.col("home").alias("further"))
        homes = staged(homes.join(further, "home", "left").select("set_id", F.coalesce("further", "home").alias("home")), "homes")
    members = homes.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    unit = F.xxhash64("home", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("members") / GROUP)))
    units = staged(join_totals(homes, members, "home", "members", homes.count()).select("set_id", unit.alias("unit")), "units")
    seated = near.join(units, "set_id")
    asked = seated.select("centre", F.col("unit").alias("of")).distinct()
    # Of two units one asks the other; within a unit all ask all.
    queries = seated.join(asked, "centre").filter("unit <= of").select("set_id", F.col("of").alias("unit"), (F.col("unit") == F.col("of")).alias("own"))
    queries = staged(queries.distinct(), "queries")
    chosen = staged(sets.join(units.select("set_id"), "set_id", "left_semi").select("first.row", F.col("set_id").alias("set")), "chosen")
    tokens = staged(_tokens(docs, chosen, words), "tokens")

    lot = F.abs(F.xxhash64("set_id") % 1_000_003)

    def together(asking: DataFrame, holding: DataFrame) -> DataFrame:
        """Queries (set_id, unit) and members (set_id, unit) of units, in lots of about ``QUERIES`` queries."""
        lots = asking.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("lots"))
        ask = asking.join(lots, "unit").select("set_id", "unit", F.pmod(lot, F.col("lots")).alias("lot"), F.lit(True).alias("query"), F.lit(False).alias("member"))
        hold = holding.join(lots, "unit").select(
            "set_id", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("query"), F.lit(True).alias("member")
        )
        return ask.unionByName(hold)

    def compare(group: pa.Table) -> pa.Table:
        members, asks = group.filter(group.column("member")), group.filter(group.column("query"))
        matrix, ids = TokenGroup(_read(members)), members.column("set_id").to_pylist()
        places = {one: i for i, one in enumerate(ids)}
        for one in asks.column("set_id").to_pylist():
            places.setdefault(one, len(places))
        forest, found = Forest(len(places)), []
        for one, tokens in zip(asks.column("set_id").to_pylist(), _read(asks), strict=True):
            if len(found) == len(places) - 1:
                break  # all are connected
            found += [(one, ids[i]) for i in matrix.matches(tokens, percent).tolist() if forest.join(places[one], i)]
        return _table(found)

    def compared(asking: DataFrame, holding: DataFrame) -> DataFrame:
        return together(asking, holding).join(tokens, "set_id").groupBy("unit", "lot").applyInArrow(compare, LINKS)

    inner = staged(compared(queries.filter("own"), units), "inner")
    joined = components(inner).withColumnRenamed("node", "set_id")
    component = F.coalesce("component", "set_id").alias("component")
    held = units.join(joined, "set_id", "left").select("unit", component)
    held = held.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = queries.filter("not own").join(joined, "set_id", "left").select("set_id", "unit", component).join(held, "unit")
    other = staged(other.filter("component <> low or component <> high").select("set_id", "unit"), "others")
    return inner.unionByName(staged(compared(other, units), "outer"))


def numbered(docs: DataFrame) -> DataFrame:
    """A copy of ``docs`` (doc, the row as it is) in which each row has a number of its own, row, whatever its doc_id."""
    return staged(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def decided(whole: DataFrame, words: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and stays (the row that stays of the component) for each row of ``numbered``."""
    docs = whole.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = _sign(docs, words, percent, parts)
    met = staged(signed.groupBy("part").applyInArrow(_meet, SORTED), "signed")
    rows = met.filter("centre is null").select("row", "doc_id", "n_shingles", "set_id", "sketch")
    shared = met.filter("centre is not null").select("set_id", "centre").distinct()
    full = rows.filter("n_shingles > 0")
    # Null ids come last; of rows with one id the first row counts.
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "row")
    sets = full.groupBy("set_id", "n_shingles").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch")
    )
    sets = staged(sets, "sets")
    links = set_links(docs, sets, shared, words, percent)
    groups = components(links).withColumnRenamed("node", "set_id")
    classed = sets.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    classed = staged(classed, "classed")
    least = classed.groupBy("component").agg(F.min("first").alias("least"))
    known = classed.join(least, "component").select("set_id", "copies", F.col("least.id").alias("component_id"), F.col("least.row").alias("stays"))
    full = full.select("row", "doc_id", "n_shingles", "set_id")
    linked = join_totals(full, known, "set_id", "copies", full.count()).select("row", "doc_id", "n_shingles", "component_id", "stays")
    alone = rows.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("stays"))
    return linked.unionByName(alone)


def similar_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Two documents link when ``100 |a & b| >= percent |a | b|`` over their sets of
    shingles of ``words`` words; component_id is the smallest doc_id reachable.
    No link between different sets is lost: sets that could be similar share a
    signature (``Signatures``), and everything after that is exact.

    Equal sets are one set from the first step on. Null texts and texts without
    words have no shingles and link with nothing; a text of fewer words is one
    shingle. Null ids count as larger than any other, and a component of them
    only has the null id; they link like any others. Rows that repeat a doc_id
    are rows of their own. An empty table gives no rows.
    """
    whole = numbered(docs.select("doc_id", "text"))
    return decided(whole, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, of the smallest doc_id (null last) and of its rows the first.

    Rows are told apart by a number of their own, so rows that repeat a doc_id
    or have none stay or go by their text, as all others do. Texts without words
    are components of their own.
    """
    whole = numbered(docs)
    gone = staged(decided(whole, words, percent).filter("row <> stays").select("row"), "gone")
    bits = B.filter_bits(gone.count())
    tested = B.flagged(whole, "row", staged(B.members(gone, "row", bits), "gone-bits"), bits, "perhaps")
    stay = tested.filter("perhaps").join(gone, "row", "left_anti")
    return tested.filter("not perhaps").select("doc.*").unionByName(stay.select("doc.*"))
