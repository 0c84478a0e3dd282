"""Fuzzy line dedup by MinHash: of each group of similar lines one stays.

1. Every line (split at ``\\n``, stripped of ASCII white space) gets a digest and the keys of the bands of a MinHash signature over its
   character shingles.  Equal lines share the digest and are one item from then on.  Keys are packed and sent once; only those of several lines become rows.
   Lines of ``LONG`` shingles and more take their minima from bins of two hashes, shorter ones from a hash for each; lines near the border do both.
2. Items that share a band with another are read from the texts once more, with the size and a sketch of their shingle sets.  Each is verified against the
   first item of its buckets by the exact Jaccard similarity of the sets, and a distributed union-find unites what is similar.  Sizes and sketches bound
   the similarity from above, so most pairs that are not similar are told without their sets.
3. Buckets that still hold more than one component are verified whole: small ones as pairs, larger ones in blocks of lines that meet in a task,
   which compares the sketches of all its pairs at once and puts out one link per pair of components it joins, not one per pair of lines.
4. A second union-find unites all links; the first line of each component, by doc_id and line number, stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm import hashing
from traceloom.llm.components import components
from traceloom.llm.ship import ship
from traceloom.llm.tables import SENT_ROWS, checked
from traceloom.session import materialize, small_batches

WIDTH = 9  # characters in a shingle
SIMILAR = (75, 100)
BANDS, ROWS = 20, 4  # a pair at 0.75 shares no band with probability 5e-4, one at 0.8 with 3e-5, one at 0.9 with 2e-10
LONG = 160  # distinct shingles from which a line's minima come from bins: four a bin, so lines without a shingle in common share no band of empty bins
RUN = 1 << 14  # lines whose keys a task packs together
SEEN = 1 << 18  # digests by which a task knows lines it has packed
CELL = 1 << 19  # keys of a cell, about
SMALL = 16  # lines of a bucket whose pairs may be written out
BLOCK = 256  # lines of a larger bucket that meet another such block in one task
AT_ONCE = 1 << 20  # characters of pairs that are compared at once
_BLANK = " \t\n\x0b\x0c\r"
_PACKED = pa.schema([("cell", pa.int64()), ("shared", pa.bool_()), ("keys", pa.binary()), ("items", pa.binary())])
_PLACES = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("item", pa.int64())])
_LINES = _PLACES.append(pa.field("text", pa.string()))
_TEXTS = "item bigint, text string, size int, sketch binary"


def line_digest(line: str) -> int:
    return hashing.digest(line.encode("utf-8", "surrogatepass"))


def _line_digests(lines: list[str]) -> np.ndarray:
    return hashing.digests([x.encode("utf-8", "surrogatepass") for x in lines])


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, list]]:
    """A few rows at a time, so that a task never holds the texts of a whole batch as Python strings."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows).to_pydict()


def _split(part: dict[str, list]) -> tuple[dict, list[str]]:
    """Places (doc_id, doc, line) and texts of the lines that are not blank."""
    counts, numbers, lines = [], [], []
    for text in part["text"]:
        before = len(lines)
        for number, line in enumerate((text or "").split("\n")):
            if line := line.strip(_BLANK):
                numbers.append(number)
                lines.append(line)
        counts.append(len(lines) - before)
    return {"doc_id": pd.array(part["doc_id"], "Int64").repeat(counts), "doc": np.repeat(np.array(part["doc"], np.int64), counts), "line": np.array(numbers, np.int32)}, lines


def _cell_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell (first ``bits``) of 64-bit keys and the next 48 bits; the two together are what a key is from then on."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64), (keys << np.uint64(bits)) >> np.uint64(16)


def _whole_keys(cells: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return ((cells.astype(np.uint64) << np.uint64(64 - bits)) | ((low << np.uint64(16)) >> np.uint64(bits))).view(np.int64)


def _pack(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _packed_rows(items: np.ndarray, keys: np.ndarray, bits: int) -> pd.DataFrame:
    """The keys of a run of distinct lines, a row per cell, sorted.  Of a key that several of the lines share only the first line goes to the key's cell;
    all of them are listed in a row of any cell (``shared``), so that a key of very many lines fills no cell."""
    keys, items = keys.view(np.uint64).ravel(), np.repeat(items, BANDS)
    order = np.argsort(keys >> np.uint64(max(0, 16 - bits)))
    (cells, low), items = _cell_keys(keys[order], bits), items[order]
    new = np.append(True, (cells[1:] != cells[:-1]) | (low[1:] != low[:-1]))
    starts = np.flatnonzero(new)
    often = np.repeat(np.diff(np.append(starts, len(new))) > 1, np.diff(np.append(starts, len(new))))
    held = cells[starts]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    data, named = _pack(low[starts]), items[starts]
    cuts = np.append(first, len(starts))
    rows = [(int(held[i]), False, data[6 * i : 6 * j], named[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
    if often.any():
        whole, named = _whole_keys(cells[often], low[often], bits), items[often]
        for i in range(0, len(whole), 1 << 16):
            anywhere = int(named[i]) & ((1 << bits) - 1)
            rows.append((anywhere, True, whole[i : i + (1 << 16)].tobytes(), named[i : i + (1 << 16)].tobytes()))
    return pd.DataFrame(rows, columns=["cell", "shared", "keys", "items"])


def _binned_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys from minima of bins; a band has as many bins of the one hash as of the other."""
    minima = hashing.binned_minima(sets, BANDS * ROWS // 2).reshape(-1, ROWS, BANDS).transpose(0, 2, 1)
    return hashing.wide_band_keys(minima.reshape(-1, BANDS * ROWS), BANDS, ROWS, BANDS)


def _line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of lines, and which line each row of them is of.

    Two similar lines both have fewer than ``LONG`` shingles times the inverse of the threshold, or both have ``LONG`` and more, so they meet in one kind of keys.
    """
    over, under = SIMILAR
    sets = hashing.char_shingles(lines, WIDTH)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(sizes >= LONG)
    border = -(-LONG * under // over)
    sizes[some] = hashing.distinct_at_least([sets[i] for i in some], np.where(sizes[some] < border, LONG, border))
    short, long = np.flatnonzero(over * sizes < under * LONG), np.flatnonzero(sizes >= LONG)
    plain = hashing.wide_band_keys(hashing.minhashes([sets[i] for i in short], BANDS * ROWS), BANDS, ROWS)
    return np.append(short, long), np.concatenate([plain, _binned_keys([sets[i] for i in long])])


def _packed_keys(bits: int, run: int, most: int):
    """Band keys of the lines of a task, each distinct line once as far as ``most`` digests tell, in runs of about ``run`` lines."""

    def rows_of(items: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        return _batch(_packed_rows(np.concatenate(items), np.concatenate(keys), bits), _PACKED)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        items: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for part in _slices(batches, 128):
            own: dict[int, str] = {}
            lines = _split(part)[1]
            for item, line in zip(_line_digests(lines).tolist(), lines, strict=True):
                if item not in seen:
                    seen.add(item)
                    own[item] = line
            if len(seen) > most:
                seen.clear()
            if own:
                of, held = _line_keys(list(own.values()))
                items.append(np.fromiter(own, np.int64, len(own))[of])
                keys.append(held)
            if sum(map(len, items)) >= run:
                yield rows_of(items, keys)
                items, keys = [], []
        if items:
            yield rows_of(items, keys)

    return packed


def _shared_keys(bits: int):
    """(key, item) of the keys of one cell that several lines have, and what the rows marked ``shared`` list."""

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame["shared"].to_numpy(bool)
        keys = [np.frombuffer(x, np.int64) for x in frame["keys"][known]]
        items = [np.frombuffer(x, np.int64) for x in frame["items"][known]]
        if not known.all():
            low = np.concatenate([_unpack(x) for x in frame["keys"][~known]])
            item = np.concatenate([np.frombuffer(x, np.int64) for x in frame["items"][~known]])
            order = np.argsort(low)
            low, item = low[order], item[order]
            same = low[1:] == low[:-1]
            other = np.append(False, same & (item[1:] != item[:-1]))
            start = np.append(True, ~same)
            groups = np.cumsum(start) - 1
            often = np.bincount(groups, other) > 0
            keep = often[groups] & (start | other)
            keys.append(_whole_keys(np.full(int(keep.sum()), frame["cell"].iloc[0], np.int64), low[keep], bits))
            items.append(item[keep])
        return pd.DataFrame({"key": np.concatenate(keys), "item": np.concatenate(items)})

    return shared


def shared_buckets(texts: DataFrame, n_items: int) -> DataFrame:
    """Distinct (key, item) of the band keys that more than one line has, stored.

    Keys travel packed, six bytes and eight of the line's digest, to cells of about ``CELL`` of them; only those of several lines become rows.
    A cell holds a key once for ``RUN`` lines, however many lines share it.
    """
    bits = max(1, int(np.ceil(np.log2(max(2, n_items * BANDS / CELL)))))
    rows = texts.select("doc_id", "doc", "text").mapInArrow(_packed_keys(bits, RUN, SEEN), "cell bigint, shared boolean, keys binary, items binary")
    found = rows.groupBy("cell").applyInPandas(_shared_keys(bits), "key bigint, item bigint")
    return materialize(found.distinct(), "buckets")


def _batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 512):
        places, lines = _split(part)
        yield _batch(pd.DataFrame({**places, "item": _line_digests(lines)}), _PLACES)


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 128):
        places, lines = _split(part)
        yield _batch(pd.DataFrame({**places, "item": _line_digests(lines), "text": lines}), _LINES)


def _wanted_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of the wanted lines."""
    for frame in frames:
        items, lines = [], []
        for text, numbers, wanted in zip(frame["text"], frame["lines"], frame["items"], strict=True):
            held = (text or "").split("\n")
            for number, item in zip(numbers, wanted, strict=True):
                line = held[number].strip(_BLANK) if number < len(held) else ""
                if line and line_digest(line) == item:
                    items.append(item)
                    lines.append(line)
        yield pd.DataFrame({"item": np.array(items, np.int64), "text": lines})


def _sets(lines: list[str]) -> list[np.ndarray]:
    return [hashing.distinct(x) for x in hashing.char_shingles(lines, WIDTH)]


def _sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``item`` and ``text`` with the size and the sketch of the line's shingle set."""
    for frame in frames:
        for run in _runs(frame["text"].str.len().to_numpy(np.int64), AT_ONCE):
            part = frame.iloc[run]
            sets = _sets(list(part["text"]))
            yield part.assign(size=np.array([len(x) for x in sets], np.int32), sketch=[x.tobytes() for x in hashing.sketches(sets)])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the exact Jaccard similarity of two sorted sets reaches the threshold."""
    over, under = SIMILAR
    if under * min(len(x), len(y)) < over * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # merges the two
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return under * common >= over * (len(both) - common)


def _close(different: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of ``sizes`` elements together may be similar if at least ``different`` are not in both."""
    over, under = SIMILAR
    return (under + over) * different <= (under - over) * sizes


def _possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of which the sketches do not tell that they are not similar."""
    for frame in frames:
        if len(frame):
            x, y = (np.frombuffer(b"".join(frame[c]), np.uint64).reshape(-1, 8) for c in ("ka", "kb"))
            different = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield frame.loc[_close(different, frame["sizes"].to_numpy(np.int64)), ["a", "b", "ta", "tb"]]


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes add up to about ``most``."""
    if not len(sizes):
        return
    number = (np.cumsum(sizes) - sizes) // most
    cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(sizes))
    for first, last in zip(cuts, cuts[1:]):
        yield slice(int(first), int(last))


def _confirmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for run in _runs((frame["ta"].str.len() + frame["tb"].str.len()).to_numpy(np.int64), AT_ONCE):
            part = frame.iloc[run]
            codes, ids = pd.factorize(np.concatenate([part["a"], part["b"]]))
            lines = dict(zip(codes, [*part["ta"], *part["tb"]], strict=True))
            sets = _sets([lines[i] for i in range(len(ids))])
            yield part.loc[[_alike(sets[x], sets[y]) for x, y in zip(codes[: len(part)], codes[len(part) :])], ["a", "b"]]


def _block_links(cell: pa.Table) -> pa.Table:
    """Links that join the components of the lines of two blocks: each similar pair whose lines no earlier link of the task joins."""
    over, under = SIMILAR
    order = np.argsort(cell["item"].to_numpy())
    items, blocks, sizes, roots = (cell[c].to_numpy()[order].astype(np.int64) for c in ("item", "block", "size", "root"))
    texts = np.array(cell["text"].to_pylist(), object)[order]
    signs = 1 - 2 * np.unpackbits(np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(-1, 64)[order], axis=1).astype(np.float32)
    different = (512 - (signs @ signs.T).astype(np.int64)) // 2
    possible = np.tril(_close(different, sizes[:, None] + sizes[None, :]), -1) & (roots[:, None] != roots[None, :])
    possible &= under * np.minimum.outer(sizes, sizes) >= over * np.maximum.outer(sizes, sizes)
    if cell["i"][0].as_py() != cell["j"][0].as_py():
        possible &= blocks[:, None] != blocks[None, :]
    needed = np.flatnonzero(possible.any(axis=0) | possible.any(axis=1))
    sets = dict(zip(needed, _sets(list(texts[needed])), strict=True))
    a, b = [], []
    for x, y in zip(*np.nonzero(possible), strict=True):
        if roots[x] != roots[y] and _alike(sets[x], sets[y]):
            a.append(items[x])
            b.append(items[y])
            roots[roots == roots[x]] = roots[y]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _different_buckets(buckets: DataFrame) -> DataFrame:
    """key, lead, last and n (first and last item, number of items) of the buckets of several items; of buckets that hold the same items only one.

    Similar lines share several bands, so most buckets repeat another.  Sets are told apart by their ends, size and 128 bits of their items' hashes.
    """
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "item")).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    spans = buckets.groupBy("key").agg(F.min("item").alias("lead"), F.max("item").alias("last"), F.count(F.lit(1)).alias("n"), *hashes)
    return spans.filter("lead <> last").groupBy("lead", "last", "n", "h1", "h2").agg(F.min("key").alias("key")).select("key", "lead", "last", "n")


def _links(buckets: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between the items of a stored table (key, item) that join all similar ones sharing a key; ``texts_of`` brings ``_TEXTS``."""
    spans = materialize(_different_buckets(buckets), "leads")
    pairs = spans.filter("n = 2").select(F.col("last").alias("a"), F.col("lead").alias("b"))
    members = materialize(buckets.join(spans.filter("n > 2").select("key", "lead", "n"), "key"), "members")
    texts = texts_of(members.select("item").union(pairs.select("a")).union(pairs.select("b")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        over, under = SIMILAR
        ta, tb = (texts.select(F.col("item").alias(x), F.col("text").alias(f"t{x}"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
        met = pairs.join(ta, "a").join(tb, "b").filter(under * F.least("na", "nb") >= over * F.greatest("na", "nb"))
        met = met.select("a", "b", "ta", "tb", "ka", "kb", (F.col("na") + F.col("nb")).alias("sizes"))
        return met.mapInPandas(lambda frames: _confirmed(_possible(frames)), "a bigint, b bigint")

    first = materialize(members.filter("item <> lead").select(F.col("item").alias("a"), F.col("lead").alias("b")).union(pairs).distinct(), "pairs")
    links = materialize(confirmed(first), "links")
    rooted = members.select("key", "item", "n").join(components(links, 1), "item", "left").withColumn("root", F.coalesce("root", "item"))
    rooted = materialize(rooted, "rooted")
    still = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    left = materialize(rooted.join(still, "key"), "open")

    small = left.filter(F.col("n") <= SMALL)
    few = small.join(small.select("key", F.col("item").alias("other"), F.col("root").alias("other_root")), "key")
    few = few.filter((F.col("item") > F.col("other")) & (F.col("root") != F.col("other_root")))
    few = few.select(F.col("item").alias("a"), F.col("other").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    blocks = F.ceil(F.col("n") / BLOCK)
    large = left.filter(F.col("n") > SMALL).join(texts, "item").withColumn("block", F.pmod(F.xxhash64("item"), blocks))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    met = large.select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "item", "root", "text", "size", "sketch")
    joined = met.groupBy("key", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")
    return links.union(materialize(confirmed(few), "links")).union(materialize(joined, "links"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a hash of the text) and text: rows are named by the two, so neither null nor repeated ids are mistaken for one another."""
    return docs.select("doc_id", F.xxhash64("text").alias("doc"), "text")


def _same(a: str, b: str):
    """Whether two rows of the names ``a`` and ``b`` (prefixes) are the same document."""
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}doc") == F.col(f"{b}doc"))


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, doc, line, item, first_doc, first_line, kept for every non-blank line: its place, digest, and the place of its component's first line.

    Null and blank texts have no line.  The first line is that of the smallest doc_id (null last), then of the smallest line number.  Rows with the same
    doc_id (null too) and the same text are one document, with the same answer for each.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = _named(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "doc")
    lines = materialize(texts.mapInArrow(_places, "doc_id bigint, doc bigint, line int, item bigint"), "places")
    items = materialize(lines.groupBy("item").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")), "items")

    def texts_of(some: DataFrame) -> DataFrame:
        named = some.join(items.select("item", "at"), "item").select("item", *[F.col(f"at.{c}").alias(f"_{c}") for c in ("doc_id", "doc", "line")])
        named = materialize(named, "wanted")
        if named.limit(SENT_ROWS + 1).count() > SENT_ROWS:  # too many to be sent or listed by document: by place, so that neither is one task
            here = named.withColumnRenamed("item", "_item")
            hit = _same("", "_") & (F.col("line") == F.col("_line")) & (F.col("item") == F.col("_item"))
            found = texts.mapInArrow(_line_texts, "doc_id bigint, doc bigint, line int, item bigint, text string").join(here, hit).select("item", "text")
        else:
            wanted = named.groupBy("_doc_id", "_doc").agg(F.collect_list(F.struct("_line", "item")).alias("w"))
            wanted = checked(materialize(wanted.select("_doc_id", "_doc", F.col("w._line").alias("lines"), F.col("w.item").alias("items")), "wanted"))
            found = texts.join(wanted, _same("", "_")).select("text", "lines", "items").mapInPandas(_wanted_lines, "item bigint, text string")
        return materialize(found.dropDuplicates(["item"]).mapInPandas(_sketched, _TEXTS), "texts")

    rooted = components(_links(shared_buckets(texts, items.count()), texts_of))
    placed = rooted.join(items.select("item", "at"), "item")
    first = placed.groupBy("root").agg(F.min("at").alias("first"))
    changed = placed.join(first, "root").select("item", "first")
    # Items that stand alone and occur once need no join; only repeated or linked ones have another first place.
    repeated = items.filter("n > 1").select("item", "at")
    firsts = repeated.join(changed, "item", "full").select("item", F.coalesce("first", "at").alias("first"))
    firsts = materialize(firsts, "firsts")
    marked = lines.join(firsts, "item", "left")
    own = F.col("first").isNull() | (_same("", "first.") & (F.col("first.line") == F.col("line")))
    return marked.select(
        "doc_id", "doc", "line", "item",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("first_doc"),
        F.coalesce("first.line", "line").alias("first_line"),
        own.alias("kept"),
    )


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in ``gone``.  Its lines are bound to a name once, so that they are split once."""

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda g: g["line"]))
        return F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n")

    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), kept), 1)


def dropped_lines(classes: DataFrame) -> DataFrame:
    """doc_id and doc with the places and digests of the lines that do not stay."""
    gone = classes.filter(~F.col("kept")).groupBy("doc_id", "doc").agg(F.sort_array(F.collect_set(F.struct("line", "item"))).alias("gone"))
    return materialize(gone, "gone")


def deduplicated(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs``: its columns but text in one named ``all``, ``text`` as it was, ``stripped`` without the dropped lines, and ``n_dropped``, their number."""
    # By shuffle at any size: the lists grow with the data; hashed, not sorted, so that texts need no sorting.
    small = gone.select(F.col("doc_id").alias("_doc_id"), F.col("doc").alias("_doc"), "gone").hint("shuffle_hash")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("all"), "doc_id", F.xxhash64("text").alias("doc"), "text")
    joined = rows.join(small, _same("", "_"), "left")
    stripped = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))
    return joined.select("all", "text", stripped.alias("stripped"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"))


def _n_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.ltrim(line, F.lit(_BLANK)) != ""))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, text for every row of ``docs``: the lines that are not blank, how many stay, and the text without the others.

    Null texts stay null; blank lines stay.  A document may lose every line.  Rows that repeat a doc_id lose their own lines only; rows without
    an id lose theirs like any other, after those with one.
    """
    out = deduplicated(docs.select("doc_id", "text"), dropped_lines(line_classes(docs)))
    out = out.select("all.doc_id", _n_lines(F.col("text")).cast("bigint").alias("n_lines"), "n_dropped", "stripped")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_dropped")).alias("n_kept"), F.col("stripped").alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the lines that do not stay and without the documents that lost all they had.

    Texts that were null or blank before stay as they are.  A column n_chars is set to the new length.
    """
    out = deduplicated(docs, dropped_lines(line_classes(docs)))
    out = out.filter((F.col("n_dropped") == 0) | (F.length(F.translate("stripped", _BLANK, "")) > 0))
    columns = []
    for c in docs.columns:
        own = F.col("stripped") if c == "text" else F.col("all")[c]
        if c == "n_chars":
            own = F.when(F.col("n_dropped") > 0, F.length("stripped").cast(docs.schema["n_chars"].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)
