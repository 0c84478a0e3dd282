"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. High-recall generators propose spans that may overlap: spelled-out addresses, dotted quads with guarded or spelled dots, long digit runs,
   numbers that could be phones.
2. Every candidate gets a few whole-number features of its format and context, so all candidates of a corpus fall into
   a bounded number of cells.  One aggregate counts the cells; nothing is sampled.
3. Boosted trees are fitted to the cells.  A candidate counts as a true one where a validated pattern finds the same span, or where it is
   valid for its kind and a word just before it names that kind ("phone", "card" ...).  Whether it is valid (check digits, ranges, counts) is no
   feature: the trees have to tell true candidates by how they are written and where they stand.
4. Per kind, the threshold is the lowest score that keeps ``PRECISION`` among the documents left out of the fit.
   The trees are then written out as an expression and score the candidates of every text.

The validated spans always stay; candidates above the threshold that touch none of them are added.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm import spans

KINDS = ("email", "ip", "card", "phone")
#: What the base patterns mean.  A match can only begin where a run begins or the last match ended, and a repeat at
#: the end of a pattern never has to give back, which keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators, more generous than the base patterns.
PROPOSED = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\x20?[\[(]?(?:\.|dot|DOT)[\])]?\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
)
#: Words that name a kind.
CUES = (r"(?i)e-?mail|contact|write to|courriel|correo", r"(?i)\bip\b|address|host|server|adresse", r"(?i)card|visa|credit|karte|carte|tarjeta", r"(?i)phone|tel\b|call|mobile|fax|telefon|téléphone|teléfono")
NEAR, COMPANY = 24, 60  # characters before a candidate searched for a cue; distance of other candidates
FEATURES = ("kind", "digits", "groups", "lead", "marks", "before", "after", "cue", "company")
FOLDS = 4  # one is left out of the fit and sets the thresholds
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION, LEAST = 0.95, 20  # of the left-out candidates at or above a threshold, and their least number


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(chars: Column) -> Column:
        values = F.transform(chars, lambda c, i: spans.let(c.cast("int") * (1 + (i % 2)), lambda v: v - F.when(v > 9, 9).otherwise(0)))
        return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0

    return spans.let(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), total)


def _octets(s: Column) -> Column:
    return F.forall(F.split(s, "[^0-9]+"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))).cast("int") <= 255))


def base(text: Column) -> Column:
    """The validated spans, by start."""
    some = text.rlike("[0-9]")
    email = spans.found(text, EMAIL, "email", 0, text.contains("@"))
    ip = F.filter(spans.found(text, IP, "ip", 1, some), lambda s: _octets(s["text"]))
    card = F.filter(spans.found(text, CARD, "card", 2, some), lambda s: spans.let(digits(s["text"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)))
    phone = F.filter(spans.found(text, PHONE, "phone", 3, text.contains("+")), lambda s: F.length(digits(s["text"])).between(9, 15))
    return spans.in_order(F.concat(email, ip, card, phone))


def proposed(text: Column) -> Column:
    """The candidates of all generators; they may overlap."""
    worth = {"email": text.contains("@") | text.rlike(r"[\[(](?:at|AT)[\])]")}
    some = text.rlike("[0-9]{2}|[0-9][.]")
    return F.concat(*[spans.found(text, pattern, kind, KINDS.index(kind), worth.get(kind, some)) for kind, pattern in PROPOSED])


def _class(c: Column) -> Column:
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def valid(s: Column) -> Column:
    """Whether a candidate holds what its kind must hold."""

    def of(d: Column) -> Column:
        n = F.length(d)
        return (
            F.when(s["rank"] == 0, s["text"].rlike(r"[A-Za-z]{2,}$"))
            .when(s["rank"] == 1, _octets(s["text"]))
            .when(s["rank"] == 2, F.when(n.between(12, 19), luhn(d)).otherwise(False))
            .otherwise(n.between(9, 15))
        )

    return spans.let(digits(s["text"]), of)


def _company(s: Column, ranked: Column) -> Column:
    """Whether a candidate of another kind ends at most ``COMPANY`` characters before ``s`` or begins as soon after it."""

    def close(own: Column) -> Column:
        before = spans.below(own["ends"], s["start"] + 1) > spans.below(own["ends"], s["start"] - (COMPANY - 1))
        return before | (spans.below(own["starts"], s["end"] + COMPANY) > spans.below(own["starts"], s["end"]))

    return F.exists(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda r: (r != s["rank"]) & spans.let(F.get(ranked, r), close))


def features(paged: Column, ranked: Column, s: Column) -> Column:
    """The whole-number features of candidate ``s`` of a text in pages; ``ranked``: all candidates by kind."""
    n = F.length(digits(s["text"]))
    groups = F.regexp_count(s["text"], F.lit("[0-9]+"))
    first = F.greatest(s["start"] - NEAR, F.lit(0))
    before = spans.cut(paged, first, s["start"] - first)

    def of(before: Column) -> Column:
        cue = F.lit(False)
        for rank, words in enumerate(CUES):
            cue = F.when(s["rank"] == rank, before.rlike(words)).otherwise(cue)
        marks = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(s["text"], r"[^\x20().\[\]-]", ""), ""), lambda c: c != "")))
        return F.struct(
            s["rank"].alias("kind"),
            F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 13, 3).when(n < 17, 4).otherwise(5).alias("digits"),
            F.least(groups, F.lit(5)).alias("groups"),
            F.when(s["text"].startswith("+"), 2).when(s["text"].startswith("("), 1).otherwise(0).alias("lead"),
            F.least(marks, F.lit(2)).alias("marks"),
            _class(F.right(before, F.lit(1))).alias("before"),
            _class(spans.cut(paged, s["end"], F.lit(1))).alias("after"),
            cue.cast("int").alias("cue"),
            _company(s, ranked).cast("int").alias("company"),
        )

    return spans.let(before, of)


class Split(NamedTuple):
    """A tree node: ``low`` where the feature is at most ``upto``, else ``high``; leaves are numbers."""

    feature: int
    upto: int
    low: "Split | float"
    high: "Split | float"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Split | float:
    leaf = -RATE * g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(x) < 2:
        return float(leaf)
    gain, best = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for upto in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= upto
            gl, hl = g[low].sum(), h[low].sum()
            now = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if now > gain:
                gain, best = now, (f, int(upto), low)
    if best is None:
        return float(leaf)
    f, upto, low = best
    return Split(f, upto, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.upto, _apply(tree.low, x), _apply(tree.high, x))


def boost(x: np.ndarray, true: np.ndarray, total: np.ndarray) -> tuple[float, list]:
    """Start and trees of gradient boosting with the logistic loss, on cells that ``total`` candidates share, ``true`` of them right."""
    start = float(np.log((true.sum() + 1) / (total.sum() - true.sum() + 1)))
    score, trees = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, total * p - true, total * p * (1 - p), DEPTH)
        if not isinstance(tree, Split):
            break
        score = score + _apply(tree, x)
        trees.append(tree)
    return start, trees


def thresholds(x: np.ndarray, score: np.ndarray, true: np.ndarray, total: np.ndarray) -> dict[int, float]:
    """Per kind the lowest score at or above which the share of true candidates is ``PRECISION``; a kind may have none.

    A candidate that is more likely wrong than right (score below 0) is never taken, however good those above it are.
    """
    out = {}
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        order = np.argsort(-score[own], kind="stable")
        s, t, n = score[own][order], np.cumsum(true[own][order]), np.cumsum(total[own][order])
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, int)
        good = [i for i in last if n[i] >= LEAST and t[i] >= PRECISION * n[i]]
        if good:
            out[kind] = max(float(s[good[-1]]), 0.0)
    return out


def _written(tree: Split | float, f: Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree.feature]] <= tree.upto, _written(tree.low, f)).otherwise(_written(tree.high, f))


def score(model: tuple[float, list], f: Column) -> Column:
    """The trees as an expression over the feature struct."""
    out = F.lit(model[0])
    for tree in model[1]:
        out = out + _written(tree, f)
    return out


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text in pages, base, and the candidates, as they are and by kind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base(F.col("text")).alias("base"), proposed(F.col("text")).alias("proposed"))
    paged = F.when(F.size("proposed") > 0, spans.pages(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "base", "proposed", paged.alias("paged"), spans.by_rank(F.col("proposed"), len(KINDS)).alias("ranked"))


def fit(docs: DataFrame) -> tuple[tuple[float, list], dict[int, float]]:
    """The model and the thresholds, from the cells of all candidates of ``docs``."""
    rows = _candidates(docs).filter(F.size("proposed") > 0).withColumn("own", spans.by_rank(F.col("base"), len(KINDS)))

    def cell(s: Column) -> Column:
        return F.struct(features(F.col("paged"), F.col("ranked"), s).alias("f"), spans.among(s, F.col("own")).alias("same"), valid(s).alias("valid"))

    described = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), F.explode(F.transform("proposed", cell)).alias("c"))
    true = (F.col("c.same") | ((F.col("c.f.cue") == 1) & F.col("c.valid"))).cast("int")
    # At most 4 kinds x 6 digits x 6 groups x 3 x 3 x 3 x 3 x 2 x 2 cells, twice: what reaches the driver does not grow with the corpus.
    cells = described.groupBy((F.col("fold") == 0).alias("left_out"), *[F.col(f"c.f.{n}").alias(n) for n in FEATURES]).agg(F.sum(true).alias("true"), F.count(F.lit(1)).alias("total"))
    found = sorted(cells.collect(), key=lambda r: tuple(r))
    if not found:
        return (0.0, []), {}
    x = np.array([[r[n] for n in FEATURES] for r in found])
    right, total, out = (np.array([float(r[n]) for r in found]) for n in ("true", "total", "left_out"))
    learn, judge = out == 0, out == 1
    if not learn.any():
        return (0.0, []), {}
    model = boost(x[learn], right[learn], total[learn])
    scores = sum((_apply(t, x) for t in model[1]), np.full(len(x), model[0]))
    return model, thresholds(x[judge], scores[judge], right[judge], total[judge])


def _best(judged: Column) -> Column:
    """Of candidates (score, span), best first: each stays that overlaps none that stayed.

    Candidates that do not hang together are chosen apart from each other, so only a chain of overlapping ones is compared with itself.
    """

    def key(j: Column) -> Column:
        s = j["span"]
        return F.struct(j["score"].alias("score"), (s["end"] - s["start"]).alias("long"), (-s["start"]).alias("early"), (-s["rank"]).alias("first"), s.alias("span"))

    def stay(acc: Column, k: Column) -> Column:
        hit = F.exists(acc, lambda o: (o["start"] < k["span"]["end"]) & (k["span"]["start"] < o["end"]))
        return F.when(hit, acc).otherwise(F.concat(acc, F.array(k["span"])))

    def over(rows: Column) -> Column:
        def chains(far: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.coalesce(F.get(rows, i)["span"]["start"] >= F.get(far, i - 1), F.lit(True)))

            def chosen(heads: Column) -> Column:
                chain = lambda i, n: F.slice(rows, i + 1, F.coalesce(F.get(heads, n + 1), F.size(rows)) - i)
                return F.flatten(F.transform(heads, lambda i, n: F.aggregate(F.reverse(F.array_sort(F.transform(chain(i, n), key))), spans.none(), stay)))

            return spans.let(heads, chosen)

        return F.when(F.size(rows) > 0, spans.let(spans.reach(F.transform(rows, lambda j: j["span"])), chains)).otherwise(spans.none())

    ordered = F.transform(F.array_sort(F.transform(judged, lambda j: F.struct(j["span"]["start"].alias("start"), j.alias("j")))), lambda x: x["j"])
    return spans.let(ordered, over)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, added for every row of ``docs``: arrays of spans by start.

    Offsets are code points, ends exclusive; null texts count as empty.  Of accepted candidates that overlap, the one with the higher score
    stays, then the longer, then the earlier, then the kind listed first; one that overlaps only such as do not stay, stays.  A corpus without
    candidates adds nothing.  Repeated rows are answered alike.
    """
    model, bars = fit(docs)
    rows = _candidates(docs)
    if not bars:
        return rows.select("doc_id", "base", spans.none().alias("added"))

    def judged(s: Column, taken: Column) -> Column:
        bar = F.lit(None).cast("double")
        for kind, lowest in sorted(bars.items()):
            bar = F.when(s["rank"] == kind, lowest - 1e-9).otherwise(bar)
        value = spans.let(features(F.col("paged"), F.col("ranked"), s), lambda f: score(model, f))
        worth = bar.isNotNull() & spans.apart(s, taken)
        return F.struct(F.when(worth, spans.let(value, lambda v: F.when(v >= bar, v))).alias("score"), s.alias("span"))

    scored = spans.let(spans.borders(F.col("base")), lambda taken: F.transform("proposed", lambda s: judged(s, taken)))
    rows = rows.withColumn("judged", F.filter(scored, lambda j: j["score"].isNotNull()))
    return rows.select("doc_id", "base", spans.in_order(_best(F.col("judged"))).alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    found = personal_data(docs)
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(spans.in_order(F.concat("base", "added"))).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; overlapping base spans are replaced as one, named by the first."""
    both = personal_data(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_doc"), spans.in_order(F.concat("base", "added")).alias("_spans")).dropDuplicates(["_doc", "_spans"])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(both, F.col("doc_id").eqNullSafe(F.col("_doc")))
    texts = texts.select("doc_id", "text", "_spans", spans.pages(F.col("text")).alias("_pages"), spans.reach(F.col("_spans")).alias("_reach"))

    def put(s: Column, i: Column) -> Column:
        def after(at: Column) -> Column:
            gap = spans.cut(F.col("_pages"), at, s["start"] - at)
            return F.when(s["start"] >= at, F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        return spans.let(F.coalesce(F.get(F.col("_reach"), i - 1), F.lit(0)), after)

    last = F.coalesce(F.get(F.col("_reach"), F.size("_reach") - 1), F.lit(0))
    rest = F.substring(F.col("text"), last + 1, F.length("text"))
    return texts.select("doc_id", F.concat(F.array_join(F.transform("_spans", put), ""), rest).alias("text"))
