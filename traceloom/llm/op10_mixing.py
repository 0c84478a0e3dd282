"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source's target divided by its size is the fractional number of copies of each of its documents.  The whole part is
taken at once; the rest is a probability.  Documents are dealt into blocks, and in a block two of them at a time exchange
words: one gains what the other loses, in a direction drawn so that each keeps its expectation, until one of them
is at 0 or 1.  The one that is still fractional meets the next.  A block leaves one fractional document, and the residuals of all
blocks meet in the next level of the tree, until one is left per source.  Since words are exchanged, the words of a source stay what
they were down to that last document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordered import scan
from traceloom.session import materialize

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MOST = 3  # copies
BLOCK = 256  # documents that meet in one block, on average
CHUNK = 4096  # rows of a group of equal rows that one task lists at once
SEED = 20260101


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: places where a word begins, counted without splitting the text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source (null included).

    The water level is found by the rule itself: what exceeds a cap is shared again by weight until no target is above
    its cap.  Each round is one aggregate over the sources.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = scan(ordered, [], ["_null", "source"], {"_rank": ("rank", None)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = materialize(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST)).alias("cap")), "sources")
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) >= F.col("cap")
        row = weighed.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if row["n"] == capped or not row["w"] or not row["total"]:
            break
        capped, level = row["n"], (row["total"] - (row["held"] or 0.0)) / row["w"]
    target = F.least(F.col("w") * F.lit(0.0 if level is None else level), F.col("cap"))
    return weighed.select("source", "source_size", target.alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit(of: Column, f: Column) -> Column:
    return F.struct(*[of[c].alias(c) for c in ("h", "doc_id", "size", "nth", "mass")], f.alias("f"))


_UNIT = "struct<h:bigint,doc_id:bigint,size:bigint,nth:bigint,mass:double,f:double>"


def _meet(acc: Column, x: Column, level: int) -> Column:
    """The fractional document of ``acc`` meets ``x``; at least one of them ends at 0 or 1."""
    a = acc["open"]
    gain = F.least((1 - a["f"]) * a["mass"], x["f"] * x["mass"])  # words that a can take from x
    loss = F.least(a["f"] * a["mass"], (1 - x["f"]) * x["mass"])  # words that a can give to x
    drawn = (F.pmod(F.xxhash64(a["h"], x["h"], F.lit(SEED + level)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def moved(m: Column) -> Column:
        up, gain, loss = m["up"], m["gain"], m["loss"]
        room_a, room_x = (1 - a["f"]) * a["mass"], (1 - x["f"]) * x["mass"]
        fa = F.when(up, F.when(gain >= room_a, 1.0).otherwise(a["f"] + gain / a["mass"])).otherwise(F.when(loss >= a["f"] * a["mass"], 0.0).otherwise(a["f"] - loss / a["mass"]))
        fx = F.when(up, F.when(gain >= x["f"] * x["mass"], 0.0).otherwise(x["f"] - gain / x["mass"])).otherwise(F.when(loss >= room_x, 1.0).otherwise(x["f"] + loss / x["mass"]))
        return F.struct(_unit(a, fa).alias("a"), _unit(x, fx).alias("x"))

    def settled(p: Column) -> Column:
        done = lambda u: u["f"].isin(0.0, 1.0)
        out = F.concat(acc["out"], F.when(done(p["a"]), F.array(p["a"])).otherwise(F.array().cast(f"array<{_UNIT}>")), F.when(done(p["x"]), F.array(p["x"])).otherwise(F.array().cast(f"array<{_UNIT}>")))
        rest = F.when(~done(p["a"]), p["a"]).when(~done(p["x"]), p["x"])
        return F.struct(rest.alias("open"), out.alias("out"))

    draw = F.struct((drawn < loss / (gain + loss)).alias("up"), gain.alias("gain"), loss.alias("loss"))
    met = _let(_let(draw, moved), settled)
    return F.when(a.isNull(), F.struct(x.alias("open"), acc["out"].alias("out"))).otherwise(met)


def _round_blocks(units: DataFrame, level: int) -> DataFrame:
    """source, open (the block's fractional document or null), out (its settled ones)."""
    # Long documents meet first: the last fractional one is then mostly short, and so is the error that its rounding leaves.
    entry = F.struct((-F.col("mass")).alias("first"), "h", "doc_id", "size", "nth", "mass", "f")
    blocks = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(entry)).alias("members"))
    blocks = blocks.withColumn("members", F.transform("members", lambda m: _unit(m, m["f"])))
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("out"))
    return blocks.select("source", F.aggregate("members", start, lambda acc, x: _meet(acc, x, level)).alias("s")).select("source", "s.open", "s.out")


def _each(units: DataFrame) -> DataFrame:
    """One row for each of the ``n`` rows of a unit, numbered nth from 1; a large unit is listed by many tasks."""
    few = units.filter(F.col("n") <= CHUNK).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("nth"))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n") - 1, F.lit(CHUNK)))
    many = units.filter(F.col("n") > CHUNK).select("*", F.explode(chunks).alias("chunk")).repartition("doc_id", "source", "size", "chunk")
    nth = F.sequence(F.col("chunk") * CHUNK + 1, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")))
    return few.unionByName(many.select("doc_id", "source", "size", F.explode(nth).alias("nth")))


def copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, nth, source_size, target, copies: one row for every row of ``docs``.

    Null texts count 0 words, a null source is a source of its own (the last), null doc_ids are allowed.  Rows that repeat a
    doc_id, source and size (null doc_ids too) are told apart by nth alone, from 1, and are taken independently.  Documents without words
    get none.  No rows: no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = materialize(_each(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))), "units")
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    sums = materialize(sums, "sums")
    targets = source_targets(sums.select("source", "source_size")).join(sums.select(F.col("source").alias("_s"), "units"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    targets = materialize(targets.withColumnRenamed("source", "_source"), "targets")
    whole = units.join(F.broadcast(targets) if targets.limit(100_001).count() <= 100_000 else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    share = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    whole = whole.withColumn("base", F.floor(share)).withColumn("f", share - F.floor(share)).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "size", "nth"))
    whole = materialize(whole, "shares")
    mass = F.col("size").cast("double").alias("mass")
    left = whole.filter("f > 0").select("source", "h", "doc_id", "size", "nth", mass, "f", F.pmod("h", F.ceil(F.col("units") / block)).alias("block"), F.ceil(F.col("units") / block).alias("blocks"))
    most, level, settled = sums.agg(F.max("units")).first()[0] or 0, 0, None
    while True:
        rounded = materialize(_round_blocks(left, level), "rounded")
        out = rounded.select("source", F.explode("out").alias("u")).select("source", "u.doc_id", "u.size", "u.nth", F.col("u.f").cast("int").alias("bit"))
        settled = out if settled is None else settled.union(out)
        most = -(-most // block)
        level += 1
        rest = rounded.filter("open is not null").select("source", "open.*")
        if most <= 1:
            break
        counted = F.lit(-(-most // block))
        left = rest.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), counted))
    last = (F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) + 0.5) / float(1 << 30) < F.col("f")
    settled = settled.union(rest.select("source", "doc_id", "size", "nth", last.cast("int").alias("bit")))
    bits = settled.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("nth").alias("_n"), "bit")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("nth") == F.col("_n"))
    return whole.join(bits, same, "left").select(
        "doc_id", "source", "size", "nth", F.col("source_size").cast("bigint").alias("source_size"), "target", (F.col("base") + F.coalesce("bit", F.lit(0))).cast("int").alias("copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for every row of ``docs``."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns: each as often as it is taken.

    Of rows that repeat a doc_id, source and size, those whose text has the smaller digest come first.  Such rows are numbered in a scan that no
    group of them overloads; all others are told by their key alone.
    """
    own = [f"_mix_{c}" for c in ("doc", "source", "size", "nth", "copies")]
    doc, source, size, nth, times = own
    chosen = copies(docs).select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "source", "size", "nth", "copies"), own, strict=True)])
    chosen = materialize(chosen, "chosen")
    keys = ["_key_doc", "_key_source", "_key_size"]
    # Rows travel as one column, so that no name of theirs clashes with another.
    sized = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), word_count(F.col("text")).alias(keys[2]))

    def same(left: list[str], right: list[str]) -> Column:
        hit = F.lit(True)
        for a, b in zip(left, right, strict=True):
            hit = hit & F.col(a).eqNullSafe(F.col(b))
        return hit

    repeated = materialize(chosen.filter(F.col(nth) == 2).select(*[F.col(o).alias(f"_again{i}") for i, o in enumerate(own[:3])]), "repeated")
    again = same(keys, [f"_again{i}" for i in range(3)])
    numbered = sized.join(repeated, again, "left_anti").withColumn("_nth", F.lit(1).cast("bigint"))
    if not repeated.isEmpty():
        some = sized.join(repeated, again, "left_semi").withColumns({"_digest": F.xxhash64("_all.text"), "_row": F.monotonically_increasing_id()})
        ranked = scan(materialize(some, "again"), keys, ["_digest", "_row"], {"_nth": ("rank", None)})
        numbered = numbered.unionByName(ranked.drop("_digest", "_row"))
    taken = numbered.join(chosen.filter(F.col(times) > 0), same([*keys, "_nth"], own[:4]))
    return taken.select("_all", F.explode(F.sequence(F.lit(1), times))).select("_all.*")
